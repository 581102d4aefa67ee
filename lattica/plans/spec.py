"""Declared schemas: a dataset's columns, labels and splits, as a Spark schema."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TASKS = ("regression", "classification", "multiclass")
EXTRAS = {"str": T.StringType(), "Int64": T.LongType(), "Float64": T.DoubleType()}
SPLITS = ("train", "valid", "test", "unassigned")


@dataclass(frozen=True)
class Label:
    name: str
    task: str = "regression"
    n_classes: int | None = None
    log10: tuple[float, float] | None = None  # clip and offset

    def __post_init__(self):
        if self.task not in TASKS:
            raise ValueError(f"{self.name}: unknown task {self.task}")
        if (self.task == "multiclass") != (self.n_classes is not None) or (self.n_classes or 2) < 2:
            raise ValueError(f"{self.name}: multiclass, and it alone, has two classes or more")
        if self.log10 and self.task != "regression":
            raise ValueError(f"{self.name}: only regression labels are transformed")


@dataclass(frozen=True)
class Spec:
    labels: tuple[Label, ...] = ()
    splits: tuple[str, ...] = ()
    default_split: str | None = None
    extras: dict[str, str] = field(default_factory=dict)
    structures: bool = False
    smiles: bool = True

    def __post_init__(self):
        names = [f.name for f in self.struct()]
        if len(names) != len(set(names)):
            raise ValueError("column names repeat")
        if any(s != "split" and not s.startswith("split__") for s in self.splits):
            raise ValueError("splits are named split or split__<variant>")
        if self.default_split and self.default_split not in self.splits:
            raise ValueError("the default split isn't a split")
        if self.splits and not self.labels:
            raise ValueError("an evaluation needs a label")

    def struct(self) -> T.StructType:
        """Ids, SMILES, charge, labels, splits, extras."""
        out = [T.StructField("structure_id", T.LongType(), False)] if self.structures else []
        out += [T.StructField("stereoisomer_id", T.LongType(), False), T.StructField("molecule_id", T.LongType(), False), T.StructField("enantiomer_of", T.LongType())]
        out += [T.StructField(c, T.StringType(), False) for c in ("isomeric_smiles", "nonisomeric_smiles")] if self.smiles else []
        out += [T.StructField(c, T.DoubleType(), False) for c in ("total_charge", "multiplicity")] if self.structures else []
        out += [T.StructField(x.name, T.DoubleType()) for x in self.labels] + [T.StructField(x, T.StringType(), False) for x in self.splits]
        return T.StructType(out + [T.StructField(k, EXTRAS[v]) for k, v in self.extras.items()])


def normalize_table(df: DataFrame, struct: T.StructType) -> DataFrame:
    """Declared columns first, in order and cast; other columns after them."""
    declared = [f.name for f in struct]
    return df.select(*[F.col(f.name).cast(f.dataType) for f in struct], *[c for c in df.columns if c not in declared])


def log10_label(y: Column, clip: float = 0.0, offset: float = 1.0) -> Column:
    """log10(max(y, clip) + offset); missing stays missing (greatest alone would skip it)."""
    return F.when(y.isNotNull() & ~F.isnan(y), F.log10(F.greatest(y, F.lit(clip)) + offset))


def split_code(name: Column, strict: bool = True) -> Column:
    out = F.when(name == "train", 0).when(name == "valid", 1).when(name == "test", 2).when(name == "unassigned", 255)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown split "), name)) if strict else F.lit(None)).cast("int")
