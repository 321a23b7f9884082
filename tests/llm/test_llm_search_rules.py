"""Lexical search, quality rules and importance resampling against brute force and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from murmuration.llm import importance_resampling, lexical_search, quality_rules, queries, terms
from murmuration.llm.common import bytes_of

SF = "/root/testdata/sf0.001"
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ODD = [(1, None), (2, ""), (3, "the Word"), (3, "the Word"), (None, "no id, the word"), (4, "the x " * 60_000), (5, "éñ一二   \x85 \x1c9"), (6, " \t\n\x0b\x0c\r.,"), (7, "Word word\x00word"), (8, "the")]


def terms_of(text):
    return TERMS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def docs(spark, rows=ODD, clashes=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("_id", "_n", "_terms", "_tf", "_text", "_number", "rank", "score", "ids", "words", "buckets", "_at", "kept"):
        df = df.withColumn(name, df["doc_id"]) if clashes else df
    return df


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aB\x00 _9é一[`{\x7f", max_size=12) | st.none(), max_size=8))
def test_terms(texts):
    raw, offsets = bytes_of(pa.array(texts, pa.string()))
    words, of = terms.split(raw, offsets, terms.TERM)
    found = [[] for _ in texts]
    for w, k in zip(words.to_pylist(), of.tolist(), strict=True):
        found[k].append(w)
    assert found == [terms_of(t) for t in texts]


# Lexical search


def searched(rows, items, k=10):
    """Scores of all pairs, by the definition."""
    counts = {p: Counter(terms_of(t)) for p, (_, t) in enumerate(rows)}
    counts = {p: c for p, c in counts.items() if c}
    n, total = len(counts), sum(sum(c.values()) for c in counts.values())
    out = []
    for item, text in items:
        scored = []
        for p, c in counts.items():
            m = 100 - 90 + 90 * sum(c.values()) * n // total
            s = 0
            for t in set(terms_of(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in x for x in counts.values()) + 1)))
                s += w * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
            if s > 0:
                scored.append((-s, rows[p][0] is None, rows[p][0] or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def test_search_of_odd_tables(spark):
    items = [(1, "the word"), (2, None), (3, ""), (4, "absent"), (1, "WORD é"), (None, "the the x éñ一二")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = searched(ODD, items, 3)
    assert sorted(map(tuple, lexical_search.search(docs(spark), asked, 3).collect()), key=str) == want
    # In blocks of one item or so the result is the same.
    assert sorted(map(tuple, lexical_search.search(docs(spark), asked, 3, pairs=2).collect()), key=str) == want
    assert lexical_search.search(docs(spark, []), asked).count() == 0
    assert lexical_search.search(docs(spark), asked.limit(0)).count() == 0


def test_search_of_many_equal_scores(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["a b c", "a b", "c", "d e"])) for k in range(400)]
    rng.shuffle(rows)
    items = [(k, " ".join(rng.choice("abcde") for _ in range(4))) for k in range(7)]
    found = lexical_search.search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=str) == searched(rows, items)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 1, 70_000, 1 << 33, (1 << 62) + 5]), st.integers(0, 1 << 40)), max_size=60))
def test_sums_by_radix_sort(pairs):
    key, value = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    found = lexical_search.summed(key, value)
    want = Counter()
    for k, v in pairs:
        want[k] += v
    assert list(zip(*(x.tolist() for x in found), strict=True)) == sorted(want.items())


def test_impacts_beyond_64_bits():
    n, tf = np.array([10**12, 5]), np.array([7, 5])
    got = lexical_search.impacts(n, tf, np.array([3, 3]), 10**10, 10**15, 8, 90)
    assert got.tolist() == [3 * (10**9 * t // (1000 * t + 8 * (10 + 90 * m * 10**10 // 10**15))) for m, t in zip(n.tolist(), tf.tolist(), strict=True)]


# Quality rules


def counted(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#é一\x0b\x85 ", max_size=40) | st.none(), max_size=6))
def test_counts(texts):
    found, shares = quality_rules.statistics(*bytes_of(pa.array(texts, pa.string())))
    assert found.tolist() == [counted(t) for t in texts] and np.isfinite(shares).all()


def test_counts_of_more_words_than_pack():
    """Windows whose words' numbers don't fit one integer are numbered in two steps, with the same result."""
    rng = np.random.default_rng(2)
    word, of = rng.integers(0, 3, 500), np.sort(rng.integers(0, 4, 500))
    assert quality_rules._repeated(word, of, 3, 4).tolist() == quality_rules._repeated(word, of, 1 << 21, 4).tolist()


def test_trees_are_monotonic_and_flat():
    rng = np.random.default_rng(5)
    x = rng.random((1500, 4))
    y = ((x[:, 0] + 0.3 * np.sin(12 * x[:, 0]) - x[:, 1] + 0.2 * rng.standard_normal(1500)) > 0).astype(float)
    trees = quality_rules.grown(x, y, np.array([1, -1, 0, 0]), trees=30)
    loose = quality_rules.grown(x, y, np.zeros(4), trees=30)

    def walk(t, row):
        total = t.base
        for at in t.roots:
            while t.left[at] != at:
                at = t.left[at] if row[t.feature[at]] <= t.threshold[at] else t.right[at]
            total += t.value[at]
        return total

    assert np.allclose(trees.margins(x[:200]), [walk(trees, r) for r in x[:200]])
    assert np.mean((trees.scores(x) > 0.5) == y) > 0.85
    base = np.repeat(rng.random((60, 4)), 101, 0)
    for column, sign in ((0, 1), (1, -1)):
        line = base.copy()
        line[:, column] = np.tile(np.linspace(0, 1, 101), 60)
        steps = np.diff(trees.scores(line).reshape(60, 101), axis=1) * sign
        assert (steps >= -1e-12).all()
        assert (np.diff(loose.scores(line).reshape(60, 101), axis=1) * sign < -1e-6).any()


def test_rules_on_odd_tables(spark):
    model = quality_rules.fit(np.ones((20, len(quality_rules.STATISTICS))), np.ones(20), np.arange(20) % 4 == 0)
    assert model.trees is None
    rows = [*ODD, (9, " ".join(f"w{k}" for k in range(60)))]
    got = quality_rules.judged(docs(spark, rows, False), model).collect()
    for (i, t), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r["doc_id"], next(t for j, t in rows if j == r["doc_id"])))), strict=True):
        want = counted(t)
        assert [r["doc_id"], *(r[c] for c in quality_rules.COUNTS)] == [i, *want]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r["kept"] == (not r["base_failed"])
    assert quality_rules.judged(docs(spark, []), model, ("doc_id", "_id", "words")).count() == 0


def test_op12_against_held_out_labels(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    label = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet' WHERE quality IS NOT NULL").fetchall())
    got = queries.QUERIES["op12_quality_rules"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        want = counted(texts[r["doc_id"]])
        assert [r[c] for c in quality_rules.COUNTS] == want and 0 <= r["score"] <= 1
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [(label[r["doc_id"]], r["kept"] or r["base_failed"]) for r in got if r["held_out"] and r["doc_id"] in label]
    assert np.mean([bool(y) == kept for y, kept in held]) >= 0.8


# Importance resampling


def resampled(rows, target, grams=1, buckets=10_000, least=20):
    def features(t):
        w = terms_of(t)
        return [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, grams + 1) for k in range(len(w) - n + 1)]

    s, t = (Counter(f for _, x in table for f in features(x)) for table in (rows, target))
    every, wanted = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        f = features(text)
        gain = sum(math.floor(1000 * math.log((t[b] + 1) * (every + buckets) / ((s[b] + 1) * (wanted + buckets)))) for b in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = math.floor(Fraction(gain, len(f))) if f else 0
        out.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(terms_of(text)) >= least))
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = order[: len(order) // 10]
    left, result = Counter(), []
    for k, r in enumerate(drawn):
        left[r] += 1
        result.append((*r[:4], k + 1))
    for r in out:
        if left[r]:
            left[r] -= 1
        else:
            result.append((*r[:4], None))
    return sorted(result, key=str)


def test_resampling_of_odd_tables(spark):
    rng = random.Random(8)
    rows = ODD + [(100 + k, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(15, 40)))) for k in range(60)] + [(7, "a b " * 30)] * 3
    target = [(1, "a b c a"), (2, None), (2, "bb The word")]
    goal = spark.createDataFrame(target, "item_id long, text string")
    for grams, buckets in ((1, 10_000), (3, 97)):
        got = importance_resampling.resample(docs(spark, rows), goal, grams=grams, buckets=buckets)
        assert sorted(map(tuple, got.collect()), key=str) == resampled(rows, target, grams, buckets)
    assert importance_resampling.resample(docs(spark, []), goal).count() == 0
    assert importance_resampling.resample(docs(spark), goal.limit(0)).count() == len(ODD)


def test_csr_blocks_hold_all_counts(spark):
    got = importance_resampling.blocks(docs(spark), "doc_id", "text").collect()
    rows = []
    for b in got:
        assert b["indptr"][0] == 0 and b["indptr"][-1] == len(b["buckets"]) == len(b["counts"])
        for k, i in enumerate(b["ids"]):
            part = slice(b["indptr"][k], b["indptr"][k + 1])
            rows.append((i, sorted(zip(b["buckets"][part], b["counts"][part], strict=True))))
    want = [(i, sorted(Counter(zlib.crc32(w.encode()) % 10_000 for w in terms_of(t)).items())) for i, t in ODD]
    assert sorted(rows, key=str) == sorted(want, key=str)
