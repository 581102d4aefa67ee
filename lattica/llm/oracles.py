"""DuckDB SQL of the contracts that SQL can express, on tables whose ids are distinct; for small tables, to compare with.

The other queries return what was learnt (verdicts, scores, added spans), or ids of a tokenizer, and have no SQL.
"""
from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD, _TERM = r"'[^\x20\x09-\x0D]+'", r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP4 = rf"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM texts),
named AS MATERIALIZED (SELECT doc_id, dense_rank() OVER (ORDER BY shingle) AS s FROM shingles),
sizes AS (SELECT doc_id, count(*) AS n FROM named GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM named a JOIN named b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = reach.other)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

OP5 = rf"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM texts),
windows AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i:i + 19], ' ') END AS k FROM places),
judged AS (SELECT doc_id, i, word, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM windows),
covered AS (SELECT doc_id, i, word, max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM judged),
counts AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS g, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM covered GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(g, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN counts USING (doc_id)
"""

OP7 = rf"""
WITH items AS (SELECT item_id, regexp_extract_all({_LOWER}, {_TERM}) AS w FROM benchmark),
windows AS MATERIALIZED (
  SELECT row_number() OVER () AS id, item_id, own FROM (
    SELECT DISTINCT item_id, w[i:i + 12] AS own FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0))),
entries AS (SELECT id, unnest(own) AS term, unnest(range(len(own))) AS place FROM windows),
texts AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, {_TERM}) AS w FROM documents),
postings AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM texts),
agreed AS (SELECT doc_id, id, pos - place AS start, count(*) AS agree FROM postings JOIN entries USING (term) GROUP BY ALL),
matches AS MATERIALIZED (
  SELECT doc_id, start, item_id, len(own) AS size, agree = len(own) AS exact FROM agreed JOIN windows USING (id) WHERE agree >= 0.8 * len(own)),
hit AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(start, start + size)) AS pos FROM matches WHERE exact) GROUP BY doc_id),
found AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM matches WHERE exact AND item_id IS NOT NULL GROUP BY doc_id),
close AS (SELECT doc_id, count(DISTINCT item_id) + max((item_id IS NULL)::INT) AS n FROM matches WHERE NOT exact GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated,
  coalesce(close.n, 0)::BIGINT AS n_near
FROM texts LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN close USING (doc_id)
"""

OP9 = """
WITH texts AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT doc_id, i, b[i:i + 99] AS k FROM (SELECT doc_id, b, unnest(range(1, n - 98)) AS i FROM texts)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM windows) WHERE nth > 1),
apart AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 100, true) AS new FROM again),
numbered AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM apart),
spans AS MATERIALIZED (SELECT doc_id, min(i) AS first, max(i) + 100 AS next FROM numbered GROUP BY doc_id, span),
totals AS (SELECT doc_id, sum(next - first) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id),
edges AS (SELECT doc_id, first, next FROM spans UNION ALL SELECT doc_id, n + 1, n + 1 FROM texts),
gaps AS (SELECT doc_id, coalesce(lag(next) OVER (PARTITION BY doc_id ORDER BY first, next), 1) AS since, first AS til FROM edges),
kept AS (SELECT doc_id, string_agg(CASE WHEN til > since THEN hex(b[since:til - 1]) ELSE '' END, '' ORDER BY til) AS x FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(x)) AS kept_sha256
FROM texts JOIN kept USING (doc_id) LEFT JOIN totals USING (doc_id)
"""

ORACLE_SQL = {"op4_ngram_join": OP4, "op5_rlz_dedup": OP5, "op7_decontamination": OP7, "op9_suffix_dedup": OP9}
