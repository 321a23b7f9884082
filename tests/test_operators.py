"""Operators on hand-made cases and against brute force."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from murmuration.functions import scalars as fn
from murmuration.operators import community, intervals, ordered, pairs, samediff, segment
from murmuration.plans.stages import Workspace
from murmuration.sources import files, formats
from murmuration.streaming import incremental


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], kinds).select(column).first()[0]


def lev(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


@pytest.mark.parametrize("phones,evaluated,graphed", [("sil1", ["sil"], []), ("AH0,,sp,spn,nan", ["AH"], ["AH"]), (None, [], []), (" AH1 ,X7", [" AH ", "X7"], ["AH", "X"]), ("sil, sp ", [], [])])
def test_clean_phones(spark, phones, evaluated, graphed):
    assert one(spark, fn.clean_phones_eval(F.col("p")), p=("string", phones)) == evaluated
    assert one(spark, fn.clean_phones_graph(F.col("p")), p=("string", phones)) == graphed


@pytest.mark.parametrize("seconds,frame", [(0.58, 28), (1.14, 56), (0.0, 0), (0.039, 1)])
def test_frame_index(spark, seconds, frame):
    assert int(seconds / 0.02) == frame
    assert one(spark, fn.frame_index(F.col("s")), s=("double", seconds)) == frame


@pytest.mark.parametrize("gold,found,ok", [((0.0, 1.0), (0.2, 0.4), True), ((0.0, 0.05), (0.025, 0.2), False), ((0.0, 0.06), (0.03, 0.2), True), ((0.0, 0.5), (0.49, 1.0), False), ((0.0, 0.04), (0.0, 0.03), True)])
def test_check_boundary(spark, gold, found, ok):
    got = one(spark, fn.check_boundary(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a=("double", gold[0]), b=("double", gold[1]), c=("double", found[0]), d=("double", found[1]))
    assert got is ok


def test_small_functions(spark):
    assert one(spark, fn.ned(F.col("a"), F.col("b")), a=("string", ""), b=("string", "")) == 1.0
    assert one(spark, fn.ned(F.col("a"), F.col("b")), a=("string", ""), b=("string", "x")) == 1.0
    assert one(spark, fn.ned(F.col("a"), F.col("b")), a=("string", "xy"), b=("string", "xy")) == 0.0
    assert one(spark, fn.base_of(F.col("k")), k=("string", "a_b_c")) is None
    assert one(spark, fn.word_id_of(F.col("k")), k=("string", "utt_12")) == 12
    assert one(spark, fn.pad_right(F.col("k"), 3), k=("string", "abcd")) == "abcd"
    assert one(spark, fn.code_string(F.col("c")), c=("array<int>", [0, 300])) == chr(0x4E00) + chr(0x4E00 + 300)
    assert [fn.sequences_of(fn.pairs_of(n)) for n in (2, 3, 1000)] == [2, 3, 1000]
    assert fn.chunks_of(5_000_001) == 2


@pytest.mark.parametrize("letters,longest", [(3, 9), (40, 14)])
def test_segments_find_what_all_pairs_find(spark, monkeypatch, letters, longest):
    """At every threshold, with empty, null and repeated sequences, and with every common segment split."""
    monkeypatch.setattr(pairs, "SEGMENT_ROWS", 20)
    rng = random.Random(letters)
    seqs = ["".join(chr(97 + rng.randrange(letters)) for _ in range(rng.randint(0, longest))) for _ in range(60)]
    for _ in range(40):
        s = list(rng.choice(seqs))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(s))
            s[at : at + rng.randint(0, 1)] = [chr(97 + rng.randrange(letters))] * rng.randint(0, 1)
        seqs.append("".join(s))
    df = pairs.keep(spark.createDataFrame([*enumerate(seqs), (200, None)], "id long, seq string"), "test-sequences")
    for t in (0.2, 0.4, 0.5, 0.7, 0.9):
        want = sorted(map(tuple, pairs.all_pairs_ned(df, "id", "seq", t, method="blocks").collect()))
        found = sorted(map(tuple, pairs.all_pairs_ned(df, "id", "seq", t, method="segments").collect()))
        assert found == want == sorted((a, b, np.float32(d)) for a, b, d in ((a, b, lev(seqs[a], seqs[b]) / max(1, len(seqs[a]), len(seqs[b]))) for a, b in itertools.combinations(range(100), 2) if seqs[a] or seqs[b]) if np.float32(d) < np.float32(t))


def copies_and_short_words(n=120):
    draw = random.Random(5)
    words = ["", "abab", "abba", "ab" * 9, *("".join(draw.choice("ab") for _ in range(draw.randrange(1, 12))) for _ in range(20)), *("".join(draw.choice("abcdefghij") for _ in range(draw.randrange(4, 12))) for _ in range(20))]
    return [(k, draw.choice(words)) for k in range(n)] + [(n, None)]


def brute(rows, threshold=None):
    every = [(a, b, np.float32(lev(x or "", y or "") / max(len(x or ""), len(y or "")) if x or y else 1.0)) for (a, x), (b, y) in itertools.combinations(rows, 2)]
    return sorted(p for p in every if threshold is None or p[2] < np.float32(threshold))


def test_equal_sequences_are_compared_once(spark, monkeypatch):
    """Every pair of keys gets a row, in parts too, also where a sequence has more keys than one row takes, but only distinct sequences meet."""
    rows = copies_and_short_words()
    df, met, old = spark.createDataFrame(rows, "id int, seq string"), [], pairs.block_pairs

    def noted(df, *a, **k):
        met.append(df.count())
        return old(df, *a, **k)

    monkeypatch.setattr(pairs, "block_pairs", noted)
    want = brute(rows)
    for most in (1000, 3):
        monkeypatch.setattr(pairs, "KEYS", most, raising=False)
        assert sorted(map(tuple, pairs.all_pairs_ned(df, "id", "seq").collect())) == want
    assert met[0] == len({x or "" for _, x in rows}) < met[1] < len(rows)
    parts = [r for k in range(3) for r in pairs.all_pairs_ned(df, "id", "seq", part=(k, 3)).collect()]
    assert sorted(map(tuple, parts)) == want
    assert sorted(map(tuple, pairs.all_pairs_ned(df, "id", "seq", 1.5).collect())) == want


@pytest.mark.parametrize("wide", [0.0, 1.0, 1e9])
def test_sequences_of_frequent_segments_are_not_indexed(spark, monkeypatch, wide):
    rows = copies_and_short_words()
    df, indexed, old = spark.createDataFrame(rows, "id int, seq string"), [], pairs.segment_candidates

    def noted(index, *a):
        indexed.append({r["_s"] for r in index.select("_s").distinct().collect()})
        return old(index, *a)

    monkeypatch.setattr(pairs, "segment_candidates", noted)
    monkeypatch.setattr(pairs, "WIDE", wide, raising=False)
    assert sorted(map(tuple, pairs.all_pairs_ned(df, "id", "seq", 0.5, method="segments").collect())) == brute(rows, 0.5)
    assert ("ab" * 9 in set().union(*indexed)) == (wide > 1)


def test_segments_compare_few_pairs(spark):
    rng = random.Random(1)
    types = [[rng.randrange(100) for _ in range(rng.randint(6, 16))] for _ in range(3000)]
    rows = [(k, "".join(chr(0x4E00 + (c if rng.random() > 0.05 else rng.randrange(100))) for c in t)) for k, t in enumerate(types + types[:300])]
    df = pairs.keep(spark.createDataFrame(rows, "id long, seq string"), "test-sequences")
    some = pairs.segment_candidates(pairs.segment_index(df, "id", "seq", 0.4), pairs.segment_probes(df, "id", "seq", 0.4), "id").count()
    assert 300 <= some < len(rows) ** 2 / 200


def test_all_pairs_and_pruning(spark):
    rng = random.Random(3)
    seqs = ["", "", "ab"] + ["".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(seqs)), "node_id long, seq string")
    want = {(i, j): np.float32(lev(a, b) / max(len(a), len(b))) if a or b else np.float32(1) for (i, a), (j, b) in itertools.combinations(enumerate(seqs), 2)}
    for blocks in (1, 3):
        got = {(r[0], r[1]): np.float32(r[2]) for r in pairs.all_pairs_ned(df, "node_id", "seq", blocks=blocks).collect()}
        assert got == want
    for t in (0.2, 0.7, 0.9):
        got = {(r[0], r[1]): np.float32(r[2]) for r in pairs.all_pairs_ned(df, "node_id", "seq", t).collect()}
        assert got == {k: v for k, v in want.items() if v < np.float32(t)}


def test_long_sequences_are_compared_in_full(spark):
    a = "a" * 5000
    df = spark.createDataFrame([(0, a), (1, a[:-3] + "bcd"), (2, "b" * 5000)], "node_id long, seq string")
    assert [tuple(r)[:2] for r in pairs.all_pairs_ned(df, "node_id", "seq", 0.1).collect()] == [(0, 1)]


@pytest.mark.parametrize("rows_a_block", [2000, 2])
def test_group_ned_equals_naive(spark, monkeypatch, rows_a_block):
    rng = random.Random(5)
    rows = [(rng.randint(0, 3), rng.choice(["", "ab", "abc", "xyz", "b"])) for _ in range(60)] + [(9, "alone"), (8, None), (8, None)]
    df = spark.createDataFrame(rows, "cluster_id int, seq string")
    monkeypatch.setattr(pairs, "GROUP_ROWS", rows_a_block)
    got = {r["cluster_id"]: (r["size"], r["pairs"], round(r["total"], 9)) for r in pairs.group_ned(df, "cluster_id", "seq").collect()}
    for c in {c for c, _ in rows}:
        s = [x or "" for k, x in rows if k == c]
        d = [lev(a, b) / max(len(a), len(b)) if a and b else 1.0 for a, b in itertools.combinations(s, 2)]
        assert got[c] == (len(s), len(d), round(sum(d), 9))


def segments_by_search(d, gamma):
    t, k = d.shape
    best = [(0.0, [])]
    for i in range(1, t + 1):
        ways = [(best[s][0] + d[s:i, c].sum() - gamma * (i - s - 1), s, c) for s in range(i) for c in range(k)]
        cost, s, c = min(ways)
        best.append((cost, best[s][1] + [c]))
    return best[-1]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 4), st.sampled_from([0.0, 0.25, 1.5, 50.0]), st.integers(0, 10**6))
def test_viterbi_is_the_search_over_segments(t, k, gamma, seed):
    d = np.random.default_rng(seed).random((t, k))
    got = segment.viterbi(d, gamma)
    if gamma:
        assert got == segments_by_search(d, gamma)[1]
    else:
        near = d.argmin(1).tolist()
        assert got == [c for k_, c in enumerate(near) if not k_ or near[k_ - 1] != c]
    if gamma == 50.0:
        assert len(got) == 1


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 9), st.integers(1, 4), st.sampled_from([0.0, 0.1, 0.25, 1.5]), st.integers(0, 10**6))
def test_single_precision_is_a_rounded_search(t, k, gamma, seed):
    """Against the table of all segments' sums, each rounded as it is made; coarse distances make ties."""
    rng = np.random.default_rng(seed)
    d = (rng.integers(0, 8, (t, k)) / 10 if seed % 2 else rng.random((t, k))).astype(np.float32)
    single = np.float32
    best, way = [single(0)], [[]]
    for end in range(t):
        least = None
        for begin in range(end + 1):
            sums = []
            for c in range(k):
                total = d[begin, c]
                for u in range(begin + 1, end + 1):
                    total = single(float(single(total + d[u, c])) - gamma)
                sums.append((total, c))
            total, c = min(sums)
            cost = single(best[begin] + total)
            if least is None or cost < least[0]:
                least = (cost, begin, c)
        best.append(least[0])
        way.append([*way[least[1]], least[2]])
    assert segment.single_precision(d, gamma) == way[-1]


def test_viterbi_of_nothing():
    assert segment.viterbi(np.zeros((0, 3)), 0.5) == []


def test_minibatch_resumes_where_it_stopped(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (80, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    frames = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(999, None)], "t int, vec array<double>")
    search = segment.MiniBatchKMeans(3, batches=3, epochs=2)
    whole = [(r["code"], r["vec"], r["frames"]) for r in search.fit(frames).orderBy("code").collect()]
    assert sum(n for _, _, n in whole) == 240
    assert sorted(tuple(round(v) for v in c) for _, c, _ in whole) == [(0, 0), (0, 5), (5, 5)]
    path = f"file://{tmp_path}/state"
    made = []
    old = segment.MiniBatchKMeans.sums

    def stops(self, some, centres):
        if len(made) == 4:
            raise RuntimeError("stopped")
        made.append(1)
        return old(self, some, centres)

    monkeypatch.setattr(segment.MiniBatchKMeans, "sums", stops)
    with pytest.raises(RuntimeError, match="stopped"):
        search.fit(frames, path)
    made[:] = []
    again = [(r["code"], r["vec"], r["frames"]) for r in search.fit(frames, path).orderBy("code").collect()]
    assert len(made) == 2 and again == whole
    monkeypatch.undo()
    assert search.fit(frames.limit(0)).count() == 0
    assert segment.MiniBatchKMeans(5).fit(spark.createDataFrame([([1.0],), ([1.0],)], "vec array<double>")).count() == 1


def test_overlap_join_forms_agree(spark):
    rng = random.Random(7)
    left = [(f"f{rng.randint(0, 2)}", i, a := rng.random() * 100, a + rng.random() * 40) for i in range(60)]
    right = [(f"f{rng.randint(0, 3)}", i, a := rng.random() * 100, a + rng.random() * 40) for i in range(60)] + [("f0", 99, 1e6, 2e6)]
    a = spark.createDataFrame(left, "filename string, l int, lb double, le double")
    b = spark.createDataFrame(right, "filename string, r int, rb double, re double")
    want = sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and y[2] < x[3] and y[3] > x[2])
    for bucket in (None, 7.0):
        got = intervals.overlap_join(a, b, "filename", ("lb", "le"), ("rb", "re"), bucket=bucket)
        assert sorted((r["l"], r["r"]) for r in got.collect()) == want
        outer = intervals.overlap_join(a, b, "filename", ("lb", "le"), ("rb", "re"), "left", bucket)
        assert {r["l"] for r in outer.collect()} == {x[1] for x in left}


def test_touching_spans_do_not_overlap(spark):
    w = spark.createDataFrame([("f", 1, 0.0, 1.0, "a"), ("f", 2, 1.0, 2.0, "b")], "filename string, word_id int, word_start double, word_end double, text string")
    p = spark.createDataFrame([("f", 0, 0.0, 1.0, "X"), ("f", 1, 1.0, 2.0, " Y ")], "filename string, idx int, xmin double, xmax double, text string")
    assert {r["word_id"]: r["phones"] for r in intervals.words_with_phones(w, p).collect()} == {1: "X", 2: "Y"}
    assert {r["word_id"]: r["phones"] for r in intervals.words_with_phones(w, p.limit(0)).collect()} == {1: "", 2: ""}


def test_transcribe_outcomes(spark):
    gold = spark.createDataFrame([("f", 0.0, 1.0, ["a"], "one"), ("f", 1.0, 2.0, ["b"], "two"), ("f", 5.0, 5.0, ["z"], "null")], "filename string, word_start double, word_end double, phones array<string>, word string")
    frags = [(1, 0, "f", 0.1, 0.9), (2, 0, "f", 0.99, 1.5), (3, 0, "g", 0.0, 1.0), (4, 0, "f", 1.99, 2.5), (5, 0, "f", 0.5, 0.5), (6, 0, "f", 4.9, 5.1)]
    df = spark.createDataFrame(frags, "frag_id int, cluster_id int, filename string, begin double, `end` double")
    got = {r["frag_id"]: (r["outcome"], r["word"]) for r in intervals.transcribe(df, gold, outcomes=True).collect()}
    assert got == {1: ("matched", "one"), 2: ("matched", "two"), 3: ("unmatched", ""), 4: ("dropped", ""), 5: ("unmatched", ""), 6: ("unmatched", "")}


def test_dense_index_and_runs(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(1000), 300)], "x int")
    assert [(r["x"], r["node_id"]) for r in ordered.dense_index(df, ["x"]).orderBy("x").collect()] == [(x, k) for k, x in enumerate(sorted(r["x"] for r in df.collect()))]
    codes = spark.createDataFrame([("u", i, c) for i, c in enumerate([1, 1, None, None, 1, 2])], "u string, t int, code int")
    assert [(r["run"], r["code"], r["size"]) for r in ordered.runs(codes, ["u"], "t", "code").orderBy("run").collect()] == [(0, 1, 2), (1, None, 2), (2, 1, 1), (3, 2, 1)]


def test_leiden_on_two_cliques():
    edges = [(a, b, 1.0) for g in (range(4), range(4, 8)) for a, b in itertools.combinations(g, 2)] + [(3, 4, 0.2)]
    assert community.leiden(8, edges, 0.3) == [0] * 4 + [1] * 4
    assert community.leiden(8, edges, 2.0) == list(range(8))
    assert community.leiden(8, edges, 1e-6) == [0] * 8
    assert community.leiden(3, [], 0.1) == [0, 1, 2]


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6))
def test_leiden_beats_trivial_partitions(seed):
    rng = random.Random(seed)
    n = 12
    edges = [(a, b, rng.random()) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.3]
    part = community.leiden(n, edges, 0.3)
    assert community.quality(n, edges, part, 0.3) >= max(community.quality(n, edges, list(range(n)), 0.3), community.quality(n, edges, [0] * n, 0.3) if len(edges) > 60 else -1e9) - 1e-9


def test_large_components_are_moved_apart(spark, monkeypatch):
    """By the caller's limit or by size: components go to one task or to the rounds, with one result."""
    edges = [(a, b, 1.0) for g in (range(6), range(6, 12)) for a, b in itertools.combinations(g, 2)] + [(5, 6, 0.2), (20, 21, 0.5)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    nodes = spark.createDataFrame([(k,) for k in [*range(12), 20, 21, 30]], "node_id long")
    found, kept = community.with_components(df, nodes)
    want = {k: 0 for k in range(6)} | {k: 6 for k in range(6, 12)} | {20: 20, 21: 20, 30: 30}
    for most in (None, 0):
        assert {r["node_id"]: r["cluster"] for r in community.partition(found, kept, 0.3, most=most).collect()} == want
    monkeypatch.setattr(community, "TASK_EDGES", 5)
    assert {r["node_id"]: r["cluster"] for r in community.partition(found, kept, 0.3).collect()} == want


def test_rounds_come_near_the_one_task_form(spark):
    """Twelve random graphs at once: connected communities, better than trivial ones, and a quality of 0.99 of the one-task form's in all."""
    rows, graphs = [], []
    for g in range(12):
        rng = random.Random(g)
        n, k, inside, across = rng.randint(8, 50), rng.randint(2, 8), rng.uniform(0.3, 0.9), rng.uniform(0.01, 0.2)
        edges = [(a, b, 0.2 + rng.random()) for a, b in itertools.combinations(range(n), 2) if rng.random() < (inside if a % k == b % k else across)]
        graphs.append((n, edges))
        rows += [(1000 * g + a, 1000 * g + b, w) for a, b, w in edges]
    got = {r["v"]: r["c"] for r in community.moved_apart(spark.createDataFrame(rows, "src long, dst long, w double"), 0.3).collect()}
    mine = other = 0.0
    for g, (n, edges) in enumerate(graphs):
        part = [got.get(1000 * g + v, 1000 * g + v) for v in range(n)]
        own = community.quality(n, edges, part, 0.3)
        assert own >= max(0.0, community.quality(n, edges, [0] * n, 0.3)) - 1e-9
        assert len(set(community._connected(n, edges, part))) == len(set(part))
        mine, other = mine + own, other + community.quality(n, edges, community.leiden(n, edges, 0.3), 0.3)
    assert mine >= 0.99 * other


def test_moves_at_once_raise_the_quality(spark):
    """Each round of moves that are made together gains, whatever they touch."""
    rng = random.Random(9)
    edges = [(a, b, 0.1 + rng.random()) for a, b in itertools.combinations(range(30), 2) if rng.random() < 0.4]
    both = spark.createDataFrame([(x, y, w) for a, b, w in edges for x, y in ((a, b), (b, a))], "v long, u long, w double").cache()
    part = [rng.randint(0, 5) for _ in range(30)]
    for _ in range(3):
        labels = spark.createDataFrame([(v, 1, c) for v, c in enumerate(part)], "v long, s long, c long")
        moves = community._harmless(community._proposals(both, labels, 0.4, False), 0.4).collect()
        after = list(part)
        for r in moves:
            after[r["v"]] = r["to"]
        assert moves and community.quality(30, edges, after, 0.4) > community.quality(30, edges, part, 0.4)
        part = after


def test_search_steps_by_hand():
    rules = community.Rules(patience=2)
    s = community.advance(community.Step(0.02, 0.01), 10, 30, rules)  # too few clusters: up
    assert (round(s.resolution, 6), round(s.length, 6), s.gap, s.stalls) == (0.03, 0.0095, 20, 0)
    s = community.advance(s, 8, 30, rules)  # no better: a first stall, still up
    assert (round(s.resolution, 6), s.gap, s.stalls) == (0.0395, 22, 1)
    s = community.advance(s, 8, 30, rules)  # a second: one longer move down
    assert round(s.resolution, 8) == round(0.0395 - 0.0095 * 0.95 * 1.1, 8) and s.stalls == 0
    s = community.advance(s, 50, 30, rules)  # too many: down, and nearer
    assert s.resolution < 0.0395 - 0.0095 * 0.95 * 1.1 and (s.gap, s.stalls) == (20, 0)
    assert community.advance(community.Step(0.001, 0.01), 99, 3, rules).resolution == 0.0
    assert community.advance(community.Step(4.995, 0.01), 1, 3, rules).resolution == 5.0
    assert community.advance(community.Step(1.0, 1e-5), 1, 3, rules).length == rules.shortest


def test_search_keeps_the_first_of_the_nearest(spark):
    edges = [(a, b, 1.0) for g in (range(4), range(4, 8)) for a, b in itertools.combinations(g, 2)] + [(3, 4, 0.2)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    nodes = spark.createDataFrame([(k,) for k in range(8)], "node_id long")
    best, part, trail = community.adaptive_resolution(df, nodes, 2, rules=community.Rules(start=0.001, step=0.1, close=1))
    assert trail[-1][1] == 2 and best == trail[-1][0] and part.select("cluster").distinct().count() == 2
    best, part, trail = community.adaptive_resolution(df, nodes, 1, rules=community.Rules(start=0.3, step=1e-4, close=0, most_steps=2))
    assert len(trail) == 2 and best == 0.3 and part.count() == 8


def test_roc_auc_with_ties(spark):
    rng = random.Random(2)
    data = [(rng.randint(0, 1), rng.choice([0.1, 0.2, 0.3])) for _ in range(40)] + [(1, None)]
    df = spark.createDataFrame(data, "label int, score double")
    pos, neg = [s for y, s in data if y and s is not None], [s for y, s in data if not y]
    want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
    assert abs(samediff.roc_auc(df).first()["auc"] - want) < 1e-12
    assert samediff.roc_auc(df.filter("label = 1")).first()["auc"] is None
    last = samediff.roc_points(df).orderBy("threshold").first()
    assert (last["fpr"], last["tpr"]) == (1.0, 1.0)


def test_running_sums_over_ranges(spark):
    rng = random.Random(6)
    data = [(k, rng.choice([None, rng.randint(-5, 9)]), rng.random()) for k in range(200)]
    df = spark.createDataFrame(data, "k long, n long, x double").repartition(7)
    out, total = ordered.running_sums(df, [F.desc("k")], ["n", "x"])
    upto, want = [0, 0.0], {}
    for k, n, x in sorted(data, reverse=True):
        want[k] = (upto[0], round(upto[1], 9))
        upto = [upto[0] + (n or 0), upto[1] + x]
    assert {r["k"]: (r["n_before"], round(r["x_before"], 9)) for r in out.collect()} == want
    assert total["n"] == upto[0] and total["x"] == pytest.approx(upto[1])
    plan = samediff.roc_points(df.select((F.col("k") % 2).alias("label"), F.col("x").alias("score")))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert ordered.running_sums(df.limit(0), ["k"], ["n"])[0].count() == 0
    assert samediff.roc_points(df.limit(0).select(F.col("k").alias("label"), F.col("x").alias("score"))).count() == 0


def test_counts_come_with_the_pass(spark):
    from pyspark.sql import Observation

    words = spark.createDataFrame([("f", 1, 0.0, 1.0, "a"), ("f", 2, 1.0, 2.0, "b"), ("g", 1, 0.0, 1.0, "c")], "filename string, word_id int, word_start double, word_end double, text string")
    phones = spark.createDataFrame([("f", 0, 0.2, 0.9, "A")], "filename string, idx int, xmin double, xmax double, text string")
    seen = Observation()
    assert intervals.words_with_phones(words, phones, seen).count() == 3
    assert seen.get == {"words": 3, "silent": 2}
    pairs_ = spark.createDataFrame([("a", "b", 1), ("a", "c", 0), ("a", "z", 0)], "key1 string, key2 string, label int")
    seen = Observation()
    assert len(samediff.scored_pairs(pairs_, spark.createDataFrame([("a", "xy"), ("b", "x"), ("c", "")], "key string, seq string"), "key", seen=seen).collect()) == 3
    assert seen.get == {"pairs": 3, "skipped": 2}


def test_samediff_limits(spark):
    rows = [(i, "four", "s") for i in range(4)] + [(10 + i, "five", "s") for i in range(5)] + [(100 + i, "many", "t") for i in range(101)]
    df = spark.createDataFrame(rows, "key int, text string, speaker string")
    same = samediff.same_pairs(df, "key").collect()
    assert {r["text"] for r in same} == {"five", "many"}
    assert sum(r["text"] == "five" for r in same) == 10 and sum(r["text"] == "many" for r in same) == 200
    assert max(r["key2"] for r in same) < 200
    both = samediff.labelled_pairs(df, "key")
    types = {(r["label"], r["pair_type"]) for r in both.collect()}
    assert types == {(1, "C1"), (0, "C4")}
    again = samediff.labelled_pairs(df, "key")
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, again.collect()))


GRID = """File type = "ooTextFile"
Object class = "TextGrid"

xmin = 0
xmax = 1
tiers? <exists>
size = 2
item []:
    item [1]:
        class = "IntervalTier"
        name = "words"
        xmin = 0
        xmax = 1
        intervals: size = 3
        intervals [1]:
            xmin = 0
            xmax = 0.4
            text = "say ""2"" = two"
        intervals [2]:
            xmin = 0.4
            xmax = 0.6
            text = ""
        intervals [3]:
            xmin = 0.6
            xmax = 1
            text = "it's"
    item [2]:
        class = "IntervalTier"
        name = "phones"
        xmin = 0
        xmax = 1
        intervals: size = 2
        intervals [1]:
            xmin = 0
            xmax = 0.5
            text = "AH0"
        intervals [2]:
            xmin = 0.5
            xmax = 0.58
            text = "sil"
"""


def test_textgrids_from_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/1-2-3.TextGrid").write_text(GRID)
    (tmp_path / "bad.TextGrid").write_text(GRID[:300])
    (tmp_path / "one.TextGrid").write_text(GRID.replace('"phones"', '"other"'))
    tiers, damaged = files.read_textgrids(spark, str(tmp_path))
    assert [r["filename"] for r in damaged.collect()] == ["bad"]
    words, phones = files.words_of(tiers)
    got = intervals.words_with_phones(words, phones).orderBy("word_id").collect()
    assert [(r["filename"], r["word_id"], r["text"], r["phones"]) for r in got] == [("1-2-3", 1, 'say "2" = two', "AH0"), ("1-2-3", 2, "", "AH0,sil"), ("1-2-3", 3, "it's", "")]


def test_partition_text_round_trip(spark, tmp_path):
    rows = [(0, "f-1", 0.125, 1.0, 1), (0, "f-2", 2.5, 3.25, 0), (3, "g", 0.0, 10.0, 2)]
    lines = files.partition_lines(spark.createDataFrame(rows, "cluster_id int, filename string, onset double, offset double, ord int"))
    files.write_lines(lines.coalesce(1), str(tmp_path / "p.txt"), ["cluster_id", "line_no"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "p.txt").glob("part-*")))
    assert text == "Class 0\nf-2 2.50 3.25\nf-1 0.12 1.00\n\nClass 3\ng 0.00 10.00\n\n"
    got = files.read_partition(spark, str(tmp_path / "p.txt")).orderBy("cluster_id", "filename").collect()
    assert [tuple(r) for r in got] == [(0, "f-1", 0.12, 1.0), (0, "f-2", 2.5, 3.25), (3, "g", 0.0, 10.0)]


def test_two_places_are_those_of_printf(spark):
    """Ties in the digits that are none in the double, exact ties, and negative numbers that round to nothing."""
    draw = random.Random(3)
    values = [0.155, 0.145, 0.135, 1.005, 2.675, 0.125, 0.375, -0.125, -0.001, -0.0, 0.0, 0.995, 0.9999, 1e-300, 123456789.125, 2.0**52 + 0.5, 2.0**53, 1e17]
    values += [draw.randrange(10**7) / 1000 * draw.choice((1, -1)) for _ in range(3000)] + [draw.randrange(10**6) / 800 for _ in range(500)]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(values)], "k int, x double").select("k", fn.two_places(F.col("x")).alias("s")).collect()
    assert {r["k"]: r["s"] for r in got} == {k: f"{x:.2f}" for k, x in enumerate(values)}


def test_alignment_csv_keeps_words_like_null(spark, tmp_path):
    (tmp_path / "a.csv").write_text(',word_id,filename,word_start,word_end,text,phones\n0,1,f,0.0,0.5,null,"AH0,T"\n1,2,f,0.5,1.0,,sil\n')
    got = files.read_alignments(spark, str(tmp_path / "a.csv")).orderBy("word_id").collect()
    assert [(r["text"], r["phones"]) for r in got] == [("null", "AH0,T"), (None, "sil")]


def test_npy_reader_lists_damaged_files(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6, dtype=np.float64).reshape(3, 2))
    (tmp_path / "b.npy").write_bytes(b"nothing")
    frames, damaged = files.split_damaged(files.read_npy(spark, str(tmp_path)))
    assert [(r["filename"], r["t"], r["vec"]) for r in frames.orderBy("t").collect()] == [("a", 0, [0.0, 1.0]), ("a", 1, [2.0, 3.0]), ("a", 2, [4.0, 5.0])]
    assert [r["filename"] for r in damaged.collect()] == ["b"]


def test_media_errors_are_rows(spark, tmp_path):
    for name, data in (("a", b"ab"), ("b", b"!"), ("c", b"xyz")):
        (tmp_path / f"{name}.raw").write_bytes(data)

    def encode(raw):
        if raw == b"!":
            raise RuntimeError("no sound")
        return [[float(x)] for x in raw]

    w = Workspace(spark, f"file://{tmp_path}/work")
    assert w.extract_features(str(tmp_path), ".raw", "m", 1, encode).count() == 5
    assert [tuple(r) for r in w.damaged("m", 1).collect()] == [("b", "RuntimeError: no sound")]


def test_formats_read_by_name(spark, tmp_path):
    """Both formats in every mode, one partition a file, equal to the reader functions."""
    from pyspark.errors import PySparkException

    grid = 'File type = "ooTextFile"\nObject class = "TextGrid"\n\n0\n2\n<exists>\n1\n"IntervalTier"\n"words"\n0\n2\n2\n0\n1\n"a"\n1\n2\n"b ""c"""\n'
    for k in range(3):
        (tmp_path / f"deep{k}").mkdir()
        (tmp_path / f"deep{k}" / f"u{k}.TextGrid").write_text(grid)
        np.save(tmp_path / f"deep{k}" / f"u{k}.npy", np.arange(4, dtype=np.float32).reshape(2, 2) + k)
    (tmp_path / "bad.TextGrid").write_text("File type")
    (tmp_path / "bad.npy").write_bytes(b"junk")
    formats.register(spark)
    for name, good in (("textgrid", 6), ("npy", 6)):
        read = spark.read.format(name).option("partitionBytes", 1)
        got = read.load(f"file://{tmp_path}")
        assert got.rdd.getNumPartitions() == 4
        assert got.filter("_corrupt is null").count() == good and [r["filename"] for r in got.filter("_corrupt is not null").collect()] == ["bad"]
        assert read.option("mode", "dropmalformed").load(str(tmp_path)).count() == good
        with pytest.raises(PySparkException, match="bad"):
            read.option("mode", "failfast").load(str(tmp_path)).count()
        assert read.option("mode", "permissive").load(f"{tmp_path}/deep1").count() == 2
        with pytest.raises(PySparkException):
            read.load(f"{tmp_path}/nowhere").count()
    want = files.read_textgrids(spark, str(tmp_path))[0]
    assert sorted(map(tuple, spark.read.format("textgrid").load(str(tmp_path)).filter("_corrupt is null").drop("_corrupt").collect())) == sorted(map(tuple, want.collect()))
    frames = files.split_damaged(files.read_npy(spark, str(tmp_path)))[0]
    assert sorted(map(tuple, spark.read.format("npy").load(str(tmp_path)).filter("_corrupt is null").select("filename", "t", "vec").collect())) == sorted(map(tuple, frames.collect()))


def test_workflow_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(0)
    align, frames = tmp_path / "align", tmp_path / "npy"
    align.mkdir()
    frames.mkdir()
    protos = rng.normal(size=(3, 4)) * 5
    for u in range(6):
        kinds = [u % 3, (u + 1) % 3, u % 3]
        words = "\n".join(f'intervals [{k + 1}]:\nxmin = {k}\nxmax = {k + 1}\ntext = "w{c}"' for k, c in enumerate(kinds))
        phones = words.replace('"w', '"P')
        (align / f"{u}-1-1.TextGrid").write_text(f'File type = "ooTextFile"\nObject class = "TextGrid"\nxmin = 0\nxmax = 3\ntiers? <exists>\nsize = 2\nitem []:\nitem [1]:\nclass = "IntervalTier"\nname = "words"\nxmin = 0\nxmax = 3\nintervals: size = 3\n{words}\nitem [2]:\nclass = "IntervalTier"\nname = "phones"\nxmin = 0\nxmax = 3\nintervals: size = 3\n{phones}\n')
        x = np.concatenate([protos[c] + rng.normal(scale=0.01, size=(50, 4)) for c in kinds])
        np.save(frames / f"{u}-1-1.npy", x.astype(np.float32))
    w = Workspace(spark, str(tmp_path / "work"))
    assert w.extract_alignment(str(align)).count() == 18
    assert w.extract_features(str(frames), ".npy", "m", 7).count() == 900
    assert w.kmeans("m", 7, 3).count() == 3
    codes = w.encode_features(str(align), "m", 7, 0.2, 3)
    assert codes.count() == 18 and all(len(r["codes"]) == 1 for r in codes.collect())
    assert w.distance("m", 7, 0.2, 3).count() == 153
    vertices, edges = w.graph("m", 7, 0.2, 3, str(align), 0.4)
    assert vertices.count() == 18 and edges.count() == 45
    path = w.cluster("m", 7, 0.2, 3, str(align), 0.4, target=3, resolution=1e-11, rules=community.Rules(close=1))
    assert files.read_partition(spark, path).select("cluster_id").distinct().count() == 3
    ned, wp = w.evaluate("m", 7, 0.2, 3, 0.4, str(align))
    assert ned == 0.0 and wp == 0.0
    pairs_, auc, points = w.samediff("m", 7, 0.2, 3, str(align))
    assert auc.first()["auc"] == 1.0 and points.count() >= 2
    assert w.extract_features("nowhere", ".npy", "m", 7).count() == 900  # the table is there


def test_distances_resume_by_parts(spark, tmp_path, monkeypatch):
    from murmuration.plans import stages

    w = Workspace(spark, f"file://{tmp_path}")
    codes = [(f"u{k % 4}", k, [k % 3, k % 5, 1][: k % 4]) for k in range(30)]
    spark.createDataFrame(codes, "filename string, word_id int, codes array<int>").write.parquet(w.coordinates("codes", "m", 1, 0.0, 5))
    made, old = [], stages.all_pairs_ned

    def stops(*a, **named):
        if len(made) == 3:
            raise RuntimeError("stopped")
        made.append(named["part"])
        return old(*a, **named)

    monkeypatch.setattr(stages, "all_pairs_ned", stops)
    with pytest.raises(RuntimeError, match="stopped"):
        w.distance("m", 1, 0.0, 5, parts=5)
    first, made[:] = list(made), []
    got = w.distance("m", 1, 0.0, 5, parts=7).collect()
    assert first == [(0, 5), (1, 5), (2, 5)] and made == [(3, 5), (4, 5)]
    nodes = w.nodes("m", 1, 0.0, 5)
    assert sorted(map(tuple, got)) == sorted(map(tuple, old(nodes, "node_id", "seq").collect())) and len(got) == 435
    made[:] = []
    assert w.distance("m", 1, 0.0, 5).count() == 435 and not made


def test_streaming_adds_each_edge_once(spark, tmp_path):
    known, edges = str(tmp_path / "known"), str(tmp_path / "edges")
    spark.createDataFrame([(0, "aaaa")], "node_id long, seq string").write.parquet(f"{known}/batch=-1")
    source = tmp_path / "in"
    spark.createDataFrame([(1, "aaab"), (2, "zzzz"), (0, "aaaa")], "node_id long, seq string").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("node_id long, seq string").parquet(str(source))
    q = incremental.watch(stream, known, edges, 0.4, str(tmp_path / "checkpoint"))
    q.processAllAvailable()
    spark.createDataFrame([(3, "aaac")], "node_id long, seq string").coalesce(1).write.mode("append").parquet(str(source))
    q.processAllAvailable()
    q.stop()
    assert sorted((r["src"], r["dst"]) for r in spark.read.parquet(edges).collect()) == [(0, 1), (0, 3), (1, 3)]
    assert spark.read.parquet(known).count() == 4


def test_command_line_arguments():
    from murmuration.__main__ import parser

    a = parser().parse_args(["--root", "r", "graph", "m", "7", "0.2", "50", "align", "0.4"])
    assert (a.command, a.layer, a.threshold) == ("graph", 7, 0.4)
