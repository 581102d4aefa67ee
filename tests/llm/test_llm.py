"""The operators of lattica.llm against plain versions, on awkward rows and on the smallest tables."""
import random
import re
import subprocess
import sys
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import _common, _external, _graph, _repeats, decontamination, language_id, lm_score, ngram_join, packing, pii, quality_rules, rlz_dedup, suffix_dedup, toxicity
from lattica.llm.queries import ORACLE_SQL, QUERIES, tokenizer

from . import brute

DATA = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"w{i}" for i in range(40))


def awkward():
    r = random.Random(3)
    some = lambda n: " ".join(r.choice(["alpha", "beta,", "Gamma", "ñ", "42", "δέλτα"]) + str(r.randint(0, 30)) for _ in range(n))
    base = some(120)
    texts = [
        None, "", " \t\n ", "one", "one two three", base, base, base.replace("alpha", "Alpha", 1), base + " tail", PASSAGE, "x " + PASSAGE + " y", PASSAGE.upper(), "same " * 60, "a b " * 50,
        "line one\nline one\n\nline two\nline one", some(3000), "mail a.b@c.de, a@b.c_d@e.f 10.0.0.300 1.2.3.4.5 +49 (30) 1234-5678 4111 1111 1111 1111 9" + "1" * 400, "secret token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" password=b7db7aa4a5fcc78305 x",
        "a\n \nfoo  bar ", "!" * 300, "#" * 5, " wide space " + "é" * 150, "é" * 150,
    ]
    return list(enumerate(texts, 10))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in awkward()], "doc_id long, text string, lang string, n_words string, n int").repartition(3)


@pytest.fixture(scope="module")
def items():
    return [(1, PASSAGE), (2, "one"), (3, None), (4, ""), (5, "beta, gamma"), (None, "line two"), (7, "never to be found anywhere")]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(10 + i, i % 2, int(i % 3 == 0)) for i in range(20)] + [(None, 1, 1), (11, None, None)], "doc_id long, quality int, toxic int")


def rows(df, *columns):
    got = df.select("doc_id", *columns).collect()
    assert len(got) == len({r[0] for r in got})
    return {r[0]: tuple(r[1:]) for r in got}


def test_quality(spark, docs, labels, empty):
    got = rows(quality_rules.quality_rules(docs.drop("n_words"), labels), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {i: brute.quality(t) for i, t in awkward()}
    assert quality_rules.quality_rules(empty, labels).count() == 0
    d = quality_rules.quality_rules(docs, labels.where("false"))
    assert d.where("kept = base_failed").count() == 0


def test_decision_list_finds_the_rule():
    data = [{"doc_id": i, "bad": int(i % 4 == 0), **{f: 0.0 for f in quality_rules.FEATURES}, "symbols_per_word": (0.8 if i % 4 == 0 else 0.1) + i / 1e5, "upper_share": (i * 7 % 10) / 10} for i in range(400)]
    rules = quality_rules.learn_rules(data)
    assert [sum(r.holds(x) for x in data if x["bad"]) for r in rules[:1]] == [100] and not any(r.holds(x) for r in rules for x in data if not x["bad"])


def test_decontamination(spark, docs, items, empty):
    b = spark.createDataFrame(items, "item_id long, text string")
    d = decontamination.decontamination(docs, b, block=3)
    d = d.withColumn("sha", F.sha2(F.array_join("items", ",").cast("binary"), 256))
    assert rows(d, "n_words", "n_hit", "n_items", "sha", "contaminated") == brute.decontaminate(awkward(), items)
    assert decontamination.decontamination(empty, b).count() == 0
    assert rows(decontamination.decontamination(docs, b.where("false")), "n_hit", "contaminated") == {i: (0, False) for i, _ in awkward()}


def test_decontamination_of_a_long_text_and_repeated_rows(spark):
    r = random.Random(2)
    long = " ".join(f"x{r.randint(0, 300)}" for _ in range(30_000))
    d = spark.createDataFrame([(1, long), (1, long), (None, PASSAGE), (2, None), (2, None)], "doc_id long, text string").withColumns({"words": F.lit(1), "row": F.lit(2), "term": F.lit("x"), "item_id": F.lit(3)})
    b = spark.createDataFrame([(5, " ".join(long.split()[:3000])), (6, PASSAGE)], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in decontamination.decontamination(d, b).collect())
    assert got == [(0, 40, 40, 1), (1, 30000, 3000, 1), (1, 30000, 3000, 1), (2, 0, 0, 0), (2, 0, 0, 0)]


def test_decontamination_near_matches(spark):
    r = random.Random(6)
    items = [(i, " ".join(f"b{i}x{k}" if k % 3 else f"common{k % 5}" for k in range(r.choice([4, 5, 9, 13, 20])))) for i in range(30)]
    made = []
    for i in range(120):
        w = r.choice(items)[1].split()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"e{r.randint(0, 10**6)}"
        if r.random() < 0.3:
            w = w[r.randint(0, 3):]
        made.append((i, " ".join([*["common1"] * r.randint(0, 3), *w, *["common2"] * r.randint(0, 3)])))
    want = {}
    for i, t in made:
        w, hit = t.split(), set()
        for k, x in items:
            x = x.split()
            for y in {tuple(x[s: s + 13]) for s in range(max(len(x) - 12, 1))}:
                for s in range(-len(y), len(w)):
                    agree = sum(0 <= s + j < len(w) and w[s + j] == y[j] for j in range(len(y)))
                    if 0.8 * len(y) <= agree < len(y):
                        hit.add(k)
        want[i] = (len(hit),)
    d, b = spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(decontamination.decontamination(d, b, block=7), "n_near") == want and sum(x for x, in want.values()) > 20


def test_pii(spark, docs, empty):
    d = pii.find_private(docs).withColumns({"sha": F.sha2(pii.written(F.col("base")).cast("binary"), 256), **{f"n_{k}": F.size(k) for k in pii.KINDS[:4]}, "masked": pii.masked(F.col("text"), F.col("spans"))})
    got = rows(d, "n_email", "n_ip", "n_card", "n_phone", "sha")
    assert got == {i: brute.pii(t) for i, t in awkward()}
    text = rows(d, "masked")
    assert not any(x in t for (t,) in text.values() for x in ("@c.de", "b7db7aa4a5fcc78305", "04dbebab"))
    assert pii.find_private(empty).count() == 0


def test_pii_addresses_with_zero_parts(spark):
    made = list(enumerate(["10.0.0.1", "0.0.0.0", "at 192.168.0.1, 255.255.255.0 and 8.8.8.8", "00.000.0.010", "10.0.0.256 0256.0.0.1 0.0.0"]))
    d = pii.find_private(spark.createDataFrame(made, "doc_id long, text string"))
    d = d.withColumns({"sha": F.sha2(pii.written(F.col("base")).cast("binary"), 256), **{f"n_{k}": F.size(k) for k in pii.KINDS[:4]}, "masked": pii.masked(F.col("text"), F.col("base"))})
    assert rows(d, "n_email", "n_ip", "n_card", "n_phone", "sha") == {i: brute.pii(t) for i, t in made}
    assert rows(d, "masked")[2] == ("at [IP], [IP] and [IP]",)


def test_pii_time_is_linear_in_matches(spark):
    def took(n):
        d = spark.createDataFrame([(1, " ".join(f"10.0.{i % 256}.1" if i % 2 else f"key={i}abcdef{i * 7919:012d}" for i in range(n)))], "doc_id long, text string").coalesce(1)
        t = time.time()
        r = pii.find_private(d, [0.0] * 18 + [1.0]).select(F.size("ip"), F.length(pii.masked(F.col("text"), F.col("spans")))).first()
        assert r[0] == n // 2
        return time.time() - t

    took(100)
    assert took(16_000) < 10 * took(4_000) + 2


def test_em_trusts_good_labelers():
    v = lambda *x: tuple(x) + (0,) * (len(pii.LABELERS) - len(x))
    post, rates, _ = pii.estimate([(v(1, 1, 1), 50), (v(-1, -1, 1), 50), (v(0, 0, 0, 0, 0, -1), 100)])
    assert post[v(1, 1, 1)] > 0.8 > 0.5 > post[v(0, 0, 0, 0, 0, -1)] and rates[0][1] < rates[2][1] + 0.5


def test_jaccard_components(spark, docs, empty):
    assert rows(ngram_join.jaccard_join(docs), "n_shingles", "component_id") == brute.components(awkward())
    assert ngram_join.jaccard_join(empty).count() == 0


def test_jaccard_at_the_threshold(spark):
    r = random.Random(5)
    made, n = [], 0
    for _ in range(12):  # families with edits of all sizes: many similarities are near 0.8
        words = [f"v{r.randint(0, 10**6)}" for _ in range(r.randint(5, 90))]
        for _ in range(r.randint(2, 7)):
            w = list(words)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"e{r.randint(0, 10**6)}"
            made.append((n, " ".join(w[: r.randint(len(w) * 4 // 5, len(w))])))
            n += 1
    d = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    assert rows(ngram_join.jaccard_join(d), "n_shingles", "component_id") == brute.components(made)


def test_jaccard_of_sets_that_head_blocks_alone(spark):
    r = random.Random(11)
    made = []
    for _ in range(40):  # y and the larger z meet in lists of rare shingles, each headed by a small set that reaches y only
        word = lambda: f"u{r.randint(0, 10**9)}"
        y = [word() for _ in range(9)]
        made += [" ".join(y), " ".join([*y, word()])]
        made += [" ".join([*y[i: i + 5], *[word() for _ in range(3)]]) for i in range(5)]
    made = list(enumerate(made))
    d = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    want = brute.components(made)
    assert all(want[i][1] == want[i + 1][1] for i in range(0, len(made), 7))
    assert rows(ngram_join.jaccard_join(d), "n_shingles", "component_id") == want


def test_jaccard_by_positions(spark, monkeypatch):
    r = random.Random(17)
    passages = [[f"p{i}x{j}" for j in range(r.randint(15, 40))] for i in range(30)]
    made = []
    for _ in range(120):  # documents of shared passages: their lists are full of entries at other positions
        words = [w for i in r.sample(range(30), r.randint(2, 5)) for w in passages[i]]
        words += [f"own{r.randint(0, 10**6)}" for _ in range(r.randint(0, len(words) // 2))]
        for _ in range(r.randint(1, 3)):
            w = list(words)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"e{r.randint(0, 10**6)}"
            made.append(" ".join(w))
    made = list(enumerate(made))
    d = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    plain, skipped = ngram_join._heads, []

    def heads(lists, parts):
        out = plain(lists, parts)
        skipped.extend(out.where("skip").select("head", "doc_id").distinct().collect())
        return out

    monkeypatch.setattr(ngram_join, "_heads", heads)
    assert rows(ngram_join.jaccard_join(d), "n_shingles", "component_id") == brute.components(made)
    sets = {i: {tuple(t.split()[k: k + 5]) for k in range(len(t.split()) - 4)} for i, t in made}
    assert skipped
    assert all(100 * len(sets[a] & sets[b]) < 80 * len(sets[a] | sets[b]) for a, b in skipped)


def test_components(spark):
    r = random.Random(1)
    links = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    up = {}
    for a, b in links:
        up.setdefault(a, a), up.setdefault(b, b)
    for _ in range(200):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    got = {x.v: x.component for x in _graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: c for v, c in up.items() if v in got} and set(got) >= {a for a, b in links if a != b}


def test_word_repeats(spark, docs, empty):
    d = rlz_dedup.rlz_dedup(docs).withColumn("sha", F.sha2(F.col("kept").cast("binary"), 256))
    assert rows(d, "n_words", "n_removed", "sha") == brute.word_repeats(awkward())
    assert rlz_dedup.rlz_dedup(empty).count() == 0


def test_byte_repeats(spark, docs, empty):
    d = suffix_dedup.suffix_dedup(docs).withColumns({"sha": F.sha2("kept", 256), "n_spans": F.size("spans")})
    assert rows(d, "n_bytes", "n_removed", "n_spans", "sha") == brute.byte_repeats(awkward())
    assert suffix_dedup.suffix_dedup(empty).count() == 0


@pytest.mark.parametrize("collapse", [True, False])
def test_repeats_by_the_method_alone(spark, docs, collapse, monkeypatch):
    """Without the collapse of equal contexts everything is found by the parse and by the sort; HOT = 3 splits all anchors."""
    r = random.Random(3)
    made = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 150)))) for i in range(40)]
    d = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    words = lambda f, **k: rows(rlz_dedup.rlz_dedup(f, collapse=collapse, **k).withColumn("sha", F.sha2(F.col("kept").cast("binary"), 256)), "n_words", "n_removed", "sha")
    text = lambda f, **k: rows(suffix_dedup.suffix_dedup(f, collapse=collapse, **k).withColumns({"sha": F.sha2("kept", 256), "n_spans": F.size("spans")}), "n_bytes", "n_removed", "n_spans", "sha")
    assert words(docs) == brute.word_repeats(awkward()) and text(docs) == brute.byte_repeats(awkward())
    assert words(d, width=7, k=2) == brute.word_repeats(made, 7)
    assert text(d, width=17, k=5, limit=4000) == brute.byte_repeats(made, 17)  # shards larger than what is held
    for module in (_repeats, rlz_dedup):
        monkeypatch.setattr(module, "HOT", 3)
    assert words(d, width=7, k=2) == brute.word_repeats(made, 7) and text(d, width=17, k=5) == brute.byte_repeats(made, 17)


def test_rows_of_one_id_are_documents_of_their_own(spark):
    own = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (1, "x " + PASSAGE), (2, PASSAGE), (None, PASSAGE), (None, None)], "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in rlz_dedup.rlz_dedup(own).collect())
    assert got == [(0, 0, 0), (0, 40, 0), (1, 40, 0), (1, 40, 40), (1, 41, 40), (2, 40, 40)]
    n = len(PASSAGE)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(own).collect())
    assert got == [(0, 0, 0), (0, n, 0), (1, n, 0), (1, n, n), (1, n + 2, n), (2, n, n)]


def test_greedy_parse_of_a_document():
    at = lambda *x: np.array(x, np.int64)
    assert rlz_dedup.parse(at(0, 2, 9), at(3, 5, 1), at(7, 8, 9), at(10, 0, 4)) == [(0, 3, 7, 10), (3, 4, 8, 1), (9, 1, 9, 4)]


def test_external_order(tmp_path):
    r = random.Random(5)
    for _ in range(150):
        s = np.array([r.randint(1, r.choice([1, 2, 3, 30])) for _ in range(r.randint(1, 80))] + [0])
        assert _external.suffix_order(s, str(tmp_path), r.choice([2, 3, 5, 16])).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_induced_sorting(tmp_path):
    r = random.Random(1)
    for _ in range(300):
        width = r.choice([3, 8, 12, 200])
        t = re.sub(b"\0+", b"\0", bytes(r.randint(0 if r.random() < 0.3 else 1, r.choice([2, 3, 5])) for _ in range(r.randint(2, 60))) + b"\0")
        got = list(suffix_dedup.InducedSorter(np.frombuffer(t, np.uint8), width, str(tmp_path), limit=r.choice([1, 3, 1000])).descending()) if len(t) > 1 else []
        pos, lcp = ([int(x) for g in got for x in g[k]] for k in (0, 1))
        assert {*pos, len(t) - 1} == set(range(len(t)))
        order = [t[p: p + width] for p in pos]
        assert order == sorted(order, reverse=True)
        common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert lcp[1:] == [common(a, b) for a, b in zip(order, order[1:])]


def test_lm(spark, docs, empty):
    want = brute.lm(awkward())
    got = rows(lm_score.score(docs, bits=1 << 20, head=8), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert {i: g[:4] for i, g in got.items()} == {i: w[:4] for i, w in want.items()}
    assert all(abs(got[i][4] - want[i][4]) < 1e-9 and got[i][5] <= 0 for i in want)
    assert lm_score.score(empty, bits=1 << 16).count() == 0


def test_filter_counts(spark):
    words = [f"t{i}" for i in range(200) for _ in range(1 + i)]
    trained = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 7 != 2)
    d = spark.createDataFrame([(trained, " ".join(words))], "doc_id long, text string")
    model, table = lm_score.fit(d, bits=1 << 20)
    exact = {np.uint64(r.key & (2**64 - 1)): r.n for r in table.collect()}
    keys = np.array(list(exact), np.uint64)
    est, true = model.counts(keys), np.array([exact[k] for k in keys], float)
    assert (np.abs(np.log2(est) - np.log2(true)) <= 1.01).mean() > 0.99 and model.v == 201


def test_lm_holds_all_pairs(spark):
    r = random.Random(8)
    made = [(i, " ".join(f"q{r.randint(0, 60)}" for _ in range(r.randint(0, 80)))) for i in range(40)]
    d = spark.createDataFrame(made, "doc_id long, text string")
    one, two, own = Counter(), Counter(), {}
    for i, t in made:
        own[i] = ["<", *t.split(), ">"]
        if zlib.crc32(str(i).encode()) % 7 != 2:
            one.update(own[i])
            two.update(zip(own[i], own[i][1:]))
    n = sum(c for w, c in one.items() if w != "<")
    level = lambda c: c if c < 2 else 1.5 * 2 ** (int(c).bit_length() - 1)
    p = lambda a, b: (level(two[a, b]) + 1000 * (level(one[b]) + 1) / (n + len(one))) / (level(one[a]) + 1000)
    want = {i: sum(np.log10(min(p(a, b), 1)) for a, b in zip(w, w[1:])) for i, w in own.items()}
    got = rows(lm_score.score(d, bits=1 << 24), "score")
    assert all(abs(got[i][0] - want[i]) < 1e-6 for i in want)


def test_filter_grows_with_what_it_holds(spark, docs):
    r = random.Random(9)
    sizes = []
    for words in (150_000, 600_000):
        d = spark.createDataFrame([(i, " ".join(f"z{r.randint(0, 10**7)}" for _ in range(words // 20))) for i in range(20)], "doc_id long, text string")
        model, _ = lm_score.fit(d)
        sizes.append(len(model.words.bits))
        assert 0.2 < model.words.fill < 0.5 and all(0.2 < x.fill < 0.5 for _, _, x in model.slices(1 << 16))
    assert sizes[1] > 3 * sizes[0]
    full = lm_score.Filter(np.full(lm_score.SEGMENTS, 255, np.uint8), np.arange(lm_score.SEGMENTS + 1, dtype=np.uint64) * np.uint64(8), 4, 3)
    assert full.levels(np.array([1, 2**63], np.uint64)).tolist() == [3, 3]
    one, many = (rows(lm_score.score(docs, slice_bits=b), "n_known", "base_score", "score") for b in (1 << 30, 1 << 17))
    assert sum(1 for _ in lm_score.fit(docs)[0].slices(1 << 17)) > 1
    assert all(one[i] == pytest.approx(many[i]) for i in one)


def test_head_words_are_those_of_largest_counts(spark):
    words = spark.createDataFrame([(i, 1 + i // 100) for i in range(1000)], "key long, n long")
    for head in (0, 50, 150, 2000):
        n = words.where(F.col("n") >= lm_score._threshold(words, head)).count()
        assert n <= head and (head < 150 or n >= 100)


def test_workers_need_no_copy_of_the_package(tmp_path):
    """The driver finds the package on a path of its own; workers don't."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(toxicity.__file__).parents[2])!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
d = s.createDataFrame([(i, "good words " * 30 + "vile" * (i % 3 == 0), "en") for i in range(40)], "doc_id long, text string, lang string")
y = s.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(40)], "doc_id long, toxic int, quality int")
from lattica.llm import lm_score, ngram_join, rlz_dedup, suffix_dedup, toxicity
for f in (lm_score.score, ngram_join.jaccard_join, rlz_dedup.rlz_dedup, suffix_dedup.suffix_dedup, lambda d: toxicity.score_toxicity(d, y)):
    assert f(d).count() == 40 and len(f(d).collect()) == 40
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_packing(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    extra = [(500, "<|endoftext|> x"), (505, "a<|endoftext|>b  <|endoftext|"), (506, "<|endoftext|><|endoftext|>"), (501, "word " * 5000), (502, "don't  stop 's 't\t\tx "), (503, " lead"), (504, "a\n b\t c \n d")]
    own = awkward() + extra
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = packing.pack(d, *tokenizer()).collect()
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for i, x in own}
    by, seq = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(ids[r.doc_id][r.start: r.start + r.length].tobytes()) == r.ids_crc32
    for i, x in ids.items():
        at = 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (len(x) > 2048 or k == 0)
            at += r.length
        assert at == len(x)
    for own in seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty, *tokenizer()).count() == 0


def test_plan_is_tight():
    r = random.Random(2)
    h = Counter(min(2048, int(r.lognormvariate(5.5, 1.2)) + 1) for _ in range(20_000))
    plan = packing.Plan(h)
    assert Counter({x: n for x, n in h.items()}) == sum((Counter({x: k * t for x, k in c}) for t, _, c in plan.runs), Counter())
    assert plan.sequences() <= 1.02 * sum(x * n for x, n in h.items()) / 2048 + 1


def test_whole_copies_are_told_where_they_are_read(spark):
    """Equal texts under other ids give no runs; what was shuffled for a stage goes with it; shards follow the bytes sent."""
    r = random.Random(12)
    base = [" ".join(f"w{r.randint(0, 10**6)}" for _ in range(r.choice([3, 60]))) for _ in range(12)]
    own = [(i + 100 * c, x) for c in range(5) for i, x in enumerate(base)] + [(1000, base[1][3:] + "?" + base[2]), (1001, None)]
    docs = spark.createDataFrame(own, "doc_id long, text string")
    got = rows(suffix_dedup.suffix_dedup(docs).withColumns({"sha": F.sha2("kept", 256), "n_spans": F.size("spans")}), "n_bytes", "n_removed", "n_spans", "sha")
    assert got == brute.byte_repeats(own)
    only = spark.sparkContext.broadcast(suffix_dedup.first_ids(docs))
    found = {x.doc_id for x in suffix_dedup.factors(_repeats.numbered(docs), only=only).collect()}
    assert not found & {i for i, _ in own if 100 <= i < 1000}
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: files.getAllFiles().mkString(" ").count(".data")
    before = shuffled()
    staged, until = _common.stage(docs.repartition(7, "doc_id"), release=True), time.time() + 20
    while shuffled() > before and time.time() < until:
        time.sleep(0.1)
    assert shuffled() <= before and staged.count() == len(own)
    first = spark.range(3 * suffix_dedup.SHARD // 100).selectExpr("id DIV 1000 AS anchor", "1 AS n", "2 AS kind").unionByName(spark.range(2000).selectExpr("-1L AS anchor", "1 AS n", "2 AS kind"))
    assert suffix_dedup.shards(first, 100, 2) == 4 and suffix_dedup.shards(first, 100, 9) == 9 and suffix_dedup.shards(first.limit(0), 100, 2) == 2


@pytest.mark.parametrize("collapse", [True, False])
def test_lines_in_many_texts_send_few_windows(spark, collapse, monkeypatch):
    """Around a short line that stands in many texts hardly a window repeats: what is sent for it doesn't grow with the texts."""
    r = random.Random(14)
    some = lambda n: " ".join(f"{r.randint(0, 10**6):x}" for _ in range(n))
    lines, long = [some(8) for _ in range(12)], some(40)
    own = [(i, "\n".join(x for line in lines for x in (some(16), line))) for i in range(30)] + [(30 + i, f"{some(9)}\n{lines[0]}\n{long}\n{some(9)}") for i in range(6)]
    docs, sent, made = spark.createDataFrame(own, "doc_id long, text string").repartition(3), [], suffix_dedup.contexts
    monkeypatch.setattr(_repeats, "HOT", 5)
    monkeypatch.setattr(suffix_dedup, "contexts", lambda *a: sent.append(made(*a)) or sent[-1])
    got = rows(suffix_dedup.suffix_dedup(docs, collapse=collapse).withColumns({"sha": F.sha2("kept", 256), "n_spans": F.size("spans")}), "n_bytes", "n_removed", "n_spans", "sha")
    assert got == brute.byte_repeats(own)
    ids = [x.doc_id for x in sent[0].collect()]
    assert len([i for i in ids if i < 30]) < 60 and max(ids) >= 30


def test_toxicity(spark, empty, labels):
    r = random.Random(4)
    data = [(i, " ".join(r.choice(["fine", "good", "plain", "words"]) + str(r.randint(0, 99)) for _ in range(r.randint(0, 60))) + (" vilexy" + r.choice("abcde") if i % 5 == 1 else ""), "en") for i in range(600)]
    d = spark.createDataFrame(data + [(1000, None, None)], "doc_id long, text string, lang string")
    own = spark.createDataFrame([(i, int(i % 5 == 1)) for i in range(600)], "doc_id long, toxic int")
    got = rows(toxicity.score_toxicity(d, own), "held_out", "score", "predicted")
    held = [i for i in range(600) if got[i][0]]
    assert held and np.mean([got[i][2] == int(i % 5 == 1) for i in held]) > 0.97 and 0 <= got[1000][1] <= 1
    assert toxicity.score_toxicity(empty, own).count() == 0
    assert {s for _, s, _ in rows(toxicity.score_toxicity(d, own.where("toxic = 0")), "held_out", "score", "predicted").values()} == {0.0}


def test_toxicity_learns_from_all_rows_in_parts(spark):
    """More rows than fit at once: every labelled row counts, in the model and in the thresholds."""
    r = random.Random(6)
    data = [(i, " ".join(r.choice(["fine", "good", "plain", "words"]) + str(r.randint(0, 99)) for _ in range(30)) + (f" vilexy{i % 7}" if i % 5 == 1 else ""), "de" if i % 9 == 0 else "en") for i in range(900)]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(4)
    own = spark.createDataFrame([(i, int(i % 5 == 1)) for i in range(900)], "doc_id long, toxic int")
    n = own.where(~toxicity.held_out()).count()
    assert toxicity.labelled(d, own).count() == n > 100
    model, limits = toxicity.fit(d, own, at_once=100)
    assert set(limits) == {"de", "en"} and not np.array_equal(model.emb, toxicity.fit(d, own.where("doc_id < 450"), at_once=100)[0].emb)
    got = rows(toxicity.score_toxicity(d, own, at_once=100), "held_out", "predicted", "flag")
    held = [i for i in range(900) if got[i][0]]
    assert all(np.mean([got[i][k] == int(i % 5 == 1) for i in held]) > 0.97 for k in (1, 2))
    assert toxicity.best_step(np.array([5, 1, 0, 4]), np.array([0, 0, 0, 4])) == 0.5 and toxicity.best_step(np.array([3, 2]), np.array([0, 0])) == 0.5


def test_language(spark):
    assert Path(DATA).exists()
    pages = spark.read.parquet(f"{DATA}/pages.parquet").unionByName(spark.createDataFrame([(10**6, None, None), (10**6 + 1, "not an address", "")], "page_id long, url string, html string"))
    d = language_id.identify(pages, spark.read.parquet(f"{DATA}/documents.parquet")).join(pages, "page_id")
    d = d.withColumn("there", F.regexp_extract("url", "/([a-z][a-z])/", 1)).select("page_id", "lang", "there").collect()
    assert len(d) == 52 and np.mean([r.lang == r.there for r in d if r.there]) > 0.95
    assert language_id.identify(pages, spark.createDataFrame([], "doc_id long, text string, lang string")).where("lang IS NULL").count() == 52


def test_language_reads_words_whole():
    texts = ["ab cdefghijklmnopqrstuvwxyz", "", "日本語の文章には空白がない", "a b", "x" * 5000]
    h, at = language_id.features(texts)
    want = [sum(1 + max(len(w.encode()) - 2, 0) for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", x)) for x in texts]
    assert np.diff(at).tolist() == want and len(h) == sum(want)
    one = [language_id.features([x])[0] for x in texts]
    assert all(sorted(h[a:b].tolist()) == sorted(o.tolist()) for a, b, o in zip(at, at[1:], one))


@pytest.mark.parametrize("name", ["op4_ngram_join", "op5_rlz_dedup", "op7_decontamination", "op9_suffix_dedup"])
def test_on_tables(spark, name):
    own = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall()
    want = {"op4_ngram_join": lambda: brute.components(own), "op5_rlz_dedup": lambda: brute.word_repeats(own), "op7_decontamination": lambda: brute.decontaminate(own, items), "op9_suffix_dedup": lambda: brute.byte_repeats(own)}[name]()
    columns = {"op4_ngram_join": ("n_shingles", "component_id"), "op5_rlz_dedup": ("n_words", "n_removed", "kept_sha256"), "op7_decontamination": ("n_words", "n_hit", "n_items", "items_sha256", "contaminated"), "op9_suffix_dedup": ("n_bytes", "n_removed", "n_spans", "kept_sha256")}[name]
    assert rows(QUERIES[name](spark, DATA), *columns) == want


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql(spark, docs, items, tmp_path, name):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for folder, files in ((DATA, ""), (tmp_path, "/*.parquet")):
        sql = duckdb.connect()
        for t in ("documents", "benchmark"):
            sql.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{files}'")
        df = QUERIES[name](spark, str(folder))
        want = sql.sql(ORACLE_SQL[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())


def test_base_columns_on_tables(spark):
    own = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    quality = rows(QUERIES["op2_quality_rules"](spark, DATA), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert quality == {i: brute.quality(t) for i, t in own}
    private = rows(QUERIES["op8_pii"](spark, DATA), "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert private == {i: brute.pii(t) for i, t in own}
    got, want = rows(QUERIES["op3_lm_score"](spark, DATA), "held_out", "n_tokens", "n_known", "train_tokens", "base_score"), brute.lm(own)
    assert {i: r[:4] for i, r in got.items()} == {i: r[:4] for i, r in want.items()}
    assert all(abs(got[i][4] - want[i][4]) <= 1e-9 * max(1, abs(want[i][4])) for i in want)


def test_stages_on_awkward_rows(spark):
    import corpus_pipeline

    r = random.Random(12)
    words = [" ".join(f"t{r.randint(0, 500)}" for _ in range(60)) for _ in range(4)]
    own = [(1, words[0]), (1, words[0]), (2, words[0] + " tail"), (None, words[1]), (None, words[1]), (5, None), (6, ""), (7, words[2] + " mail me a.b@c.org now"), (8, words[3])]
    extra = {c: F.lit("x") for c in ("n", "token", "words", "component_id", "kept", "email", "spans", "row", "n_words", "length", "rule")}
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in own], "doc_id long, text string, lang string, source string, n_chars long").withColumns(extra)
    left = []
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, d.where("false"), DATA).collect() == []
        d = _common.stage(f(spark, d, DATA))
        assert set(extra) <= set(d.columns)
        left.append(sorted((x.doc_id or 0) for x in d.collect()))
    assert left == [[0, 0, 1, 1, 2, 7, 8], [0, 0, 1, 7, 8], [0, 0, 1, 7, 8], [0, 0, 1, 7, 8]]
    assert d.where("doc_id = 7").first().text == words[2] + " mail me [EMAIL] now"
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, d, DATA).count() == 5 and last(spark, d.where("false"), DATA).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, seen, DATA).cache()
        assert out.columns == docs.columns
        assert out.join(seen, "doc_id", "left_anti").count() == 0
        seen = out
    assert 0 < seen.count() < docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, DATA)
    assert packed.select("doc_id").distinct().count() == seen.count()
