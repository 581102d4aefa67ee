"""A Spark-native engine for preparing, selecting, comparing and scoring molecular and other record datasets."""
