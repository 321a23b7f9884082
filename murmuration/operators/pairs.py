"""Pairs: all-pairs edit distance in blocks, with pruning below a threshold, and pairs within groups."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructField, StructType

from ..functions.distances import edit_distances
from ..functions.scalars import ned
from .scratch import keep


#: Pairs of blocks for each shuffle partition: enough that their different sizes even out.
CELLS_A_TASK = 6


def blocks_of(spark: SparkSession) -> int:
    """Blocks whose pairs are CELLS_A_TASK for each shuffle partition."""
    return max(1, math.isqrt(2 * CELLS_A_TASK * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys, in all shuffle partitions: the rows of a join that makes many rows of few are too small for adaptive execution to tell, which would put them in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def block_pairs(df: DataFrame, key: str, carried: list[str], blocks: int | None = None, part: tuple[int, int] | None = None) -> DataFrame:
    """Every unordered pair of rows, the smaller key first: key1, carried1.., key2, carried2...

    Rows are dealt to blocks by hash, and each pair of blocks is one key of an equi-join, so the pairs spread over all
    tasks and no side is broadcast. Each row is sent `blocks` times in all. part (k, n): only the k-th of n parts of the
    pairs of blocks.
    """
    blocks = blocks or blocks_of(df.sparkSession)
    rows = df.select(key, *carried).withColumn("_b", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    # A row of block b is the left side of cells (b, j >= b) and the right side of cells (i <= b, b).
    left = rows.withColumn("_j", F.explode(F.sequence("_b", F.lit(blocks - 1)))).withColumnRenamed("_b", "_i")
    right = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), "_b"))).withColumnRenamed("_b", "_j")
    if part:
        left, right = (side.filter(f"(_i * {blocks} + _j) % {part[1]} = {part[0]}") for side in (left, right))
    left = left.select("_i", "_j", *(F.col(c).alias(f"{c}1") for c in (key, *carried)))
    right = right.select("_i", "_j", *(F.col(c).alias(f"{c}2") for c in (key, *carried)))
    both = _dealt(left, "_i", "_j").join(_dealt(right, "_i", "_j").hint("shuffle_hash"), ["_i", "_j"])
    # In a block with itself every pair meets twice, in two blocks once, in either order.
    both = both.filter((F.col("_i") < F.col("_j")) & (F.col(f"{key}1") != F.col(f"{key}2")) | (F.col("_i") == F.col("_j")) & (F.col(f"{key}1") < F.col(f"{key}2")))
    swap = F.col(f"{key}1") > F.col(f"{key}2")
    pick = lambda c, a, b: F.when(swap, F.col(f"{c}{b}")).otherwise(F.col(f"{c}{a}"))
    return both.select(*(pick(c, a, b).alias(f"{c}{a}") for a, b in ((1, 2), (2, 1)) for c in (key, *carried)))


#: Keys of one sequence that are dealt with as one row at most.
KEYS = 1000


def _gathered(df: DataFrame, key: str, seq: str) -> DataFrame:
    """(_id, _keys): each distinct sequence with its keys, one with more than KEYS in several rows; _id (k, s) has the smallest key and the sequence. Null counts as empty; null keys are left out."""
    rows = df.select(F.col(key).alias("_key"), F.coalesce(F.col(seq), F.lit("")).alias("_s")).filter("_key is not null")
    many = rows.groupBy("_s").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > KEYS).select("_s", F.ceil(F.col("_n") / KEYS).alias("_parts"))
    parts = rows.join(many, "_s", "left").withColumn("_part", F.pmod(F.xxhash64("_key"), F.coalesce("_parts", F.lit(1))))
    return parts.groupBy("_s", "_part").agg(F.collect_list("_key").alias("_keys")).select(F.struct(F.array_min("_keys").alias("k"), F.col("_s").alias("s")).alias("_id"), "_keys")


def _spread(near: DataFrame, key: str) -> DataFrame:
    """(key1, key2, ned) from (_keys1, _keys2, ned): each key of one row with each of the other."""
    both = near.select("ned", "_keys2", F.explode("_keys1").alias("_a")).select("ned", "_a", F.explode("_keys2").alias("_b")).filter("_a != _b")
    return both.select(F.least("_a", "_b").alias(f"{key}1"), F.greatest("_a", "_b").alias(f"{key}2"), "ned")


#: Distinct sequences from which on all pairs are measured many at once; rows of a class of like lengths that is worth it; lengths of a
#: class differ by less than RATIO; rows, characters and keys of a block; rows that a task sends at once; tasks at most.
MANY, CROWD, RATIO = 1000, 48, 1.25
BLOCK_ROWS, BLOCK_TEXT, BLOCK_KEYS, SENT, TASKS = 8192, 1 << 22, 1 << 17, 1 << 18, 10_000


def _class() -> Column:
    return F.floor(F.log(F.length("_id.s").cast("double")) / F.lit(math.log(RATIO))).cast("int")


def _crowds(rows: DataFrame) -> dict[int, tuple[int, int, int]]:
    """(rows, keys, greatest length) of each class of like lengths that has CROWD rows; none if those are fewer than MANY in all. A row a class comes to the driver."""
    sized = rows.select(_class().alias("_c"), F.length("_id.s").alias("_n"), F.size("_keys").alias("_k")).filter("_n > 0")
    found = {r["_c"]: (r["n"], r["k"], r["m"]) for r in sized.groupBy("_c").agg(F.count(F.lit(1)).alias("n"), F.sum("_k").alias("k"), F.max("_n").alias("m")).collect()}
    found = {c: x for c, x in sorted(found.items()) if x[0] >= CROWD}
    return found if sum(x[0] for x in found.values()) >= MANY else {}


def _expanded(p1: np.ndarray, p2: np.ndarray, c1: np.ndarray, c2: np.ndarray):
    """(k1, k2, at) for some pairs of rows at once: each key of row p1 with each of row p2, by its place among all keys, and which pair it is of. c1, c2: keys of the rows."""
    if (c1 == 1).all() and (c2 == 1).all():
        for a in range(0, len(p1), SENT):
            yield p1[a : a + SENT], p2[a : a + SENT], slice(a, a + SENT)
        return
    o1, o2 = (np.append(0, np.cumsum(c)[:-1]) for c in (c1, c2))
    upto = np.append(0, np.cumsum(c1[p1] * c2[p2]))
    a = 0
    while a < len(p1):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + SENT, "right")) - 1)
        at = np.repeat(np.arange(a, b), np.diff(upto[a : b + 1]))
        x, y = np.divmod(np.arange(upto[a], upto[b]) - upto[at], c2[p2[at]])
        yield o1[p1[at]] + x, o2[p2[at]] + y, at
        a = b


def _measured(rows: DataFrame, crowds: dict[int, tuple[int, int, int]], threshold: float | None, digits: int | None) -> DataFrame:
    """(_a, _b, ned): the keys of all pairs of rows of crowded classes, with their distance if it is below the threshold.

    Blocks have sequences of like lengths, each a row of one list; each pair of blocks is one cell, whose distances are
    taken many at once (functions.distances).
    """
    spark, total, count, blocks = rows.sparkSession, sum(x[0] for x in crowds.values()), 0, F.lit(None)
    most = max(blocks_of(spark), -(-total // BLOCK_ROWS))
    for c, (n, k, m) in crowds.items():
        some = max(-(-n * most // total), -(-n * m // BLOCK_TEXT), -(-k // BLOCK_KEYS))
        blocks = F.when(F.col("_c") == c, F.pmod(F.xxhash64("_id"), F.lit(some)) + count).otherwise(blocks)
        count += some
    dealt = rows.withColumn("_c", _class()).select(blocks.cast("int").alias("_x"), F.struct(F.col("_id.s").alias("s"), F.col("_keys").alias("keys")).alias("_row")).filter("_x is not null")
    dealt = keep(dealt.groupBy("_x").agg(F.collect_list("_row").alias("_rows")), "sequence-blocks")
    left = dealt.select(F.col("_x").alias("_i"), F.explode(F.sequence("_x", F.lit(count - 1))).alias("_j"), F.col("_rows").alias("_rows1"))
    right = dealt.select(F.explode(F.sequence(F.lit(0), "_x")).alias("_i"), F.col("_x").alias("_j"), F.col("_rows").alias("_rows2"))
    cells = _dealt(left, "_i", "_j").join(_dealt(right, "_i", "_j").hint("shuffle_hash"), ["_i", "_j"])
    cells = cells.select((F.col("_i") == F.col("_j")).alias("_own"), "_rows1", "_rows2", (F.col("_i") * count + F.col("_j")).alias("_cell")).repartitionByRange(min(TASKS, count * (count + 1) // 2), "_cell")
    kind = rows.schema["_keys"].dataType.elementType
    schema = StructType([StructField("_a", kind), StructField("_b", kind), StructField("ned", FloatType() if digits is None else DoubleType())])

    def side(x):
        texts, keys = x.values.flatten()
        order = np.argsort(np.array([len(t) for t in texts.to_pylist()]), kind="stable")
        texts, keys = texts.take(pa.array(order)).to_pylist(), keys.take(pa.array(order))
        return texts, np.array([len(t) for t in texts]), keys.flatten(), np.asarray(keys.value_lengths()).astype(np.int64)

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                own, (texts, m, keys1, c1), (others, n, keys2, c2) = batch.column(0)[r].as_py(), side(batch.column(1)[r]), side(batch.column(2)[r])
                for first, d in edit_distances(texts, others):
                    value = (d / np.maximum(m[first : first + len(d), None], n)).astype(np.float32)
                    near = np.ones(d.shape, bool) if threshold is None else value < np.float32(threshold)
                    if own:  # both sides have the same order
                        near &= np.arange(len(others)) > np.arange(first, first + len(d))[:, None]
                    p1, p2 = np.nonzero(near)
                    value = value[near]
                    if digits is not None:  # halves go up, and a float's digits are no closer to a half than doubles tell
                        value = np.floor(value.astype(np.float64) * 10**digits + 0.5) / 10**digits
                    for k1, k2, at in _expanded(p1 + first, p2, c1, c2):
                        yield pa.RecordBatch.from_arrays([keys1.take(pa.array(k1)), keys2.take(pa.array(k2)), pa.array(value[at])], ["_a", "_b", "ned"])

    return cells.select("_own", "_rows1", "_rows2").mapInArrow(run, schema)


def _between(some: DataFrame, others: DataFrame) -> DataFrame:
    """(_keys1, _s1, _keys2, _s2): each row of some with each of the others. Pairs of blocks are keys of a join."""
    blocks = blocks_of(some.sparkSession)
    block, every = F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = some.select(F.col("_keys").alias("_keys1"), F.col("_id.s").alias("_s1"), block.alias("_i"), every.alias("_j"))
    right = others.select(F.col("_keys").alias("_keys2"), F.col("_id.s").alias("_s2"), block.alias("_j"), every.alias("_i"))
    return _dealt(left, "_i", "_j").join(_dealt(right, "_i", "_j").hint("shuffle_hash"), ["_i", "_j"]).select("_keys1", "_s1", "_keys2", "_s2")


def all_pairs_ned(df: DataFrame, key: str, seq: str, threshold: float | None = None, blocks: int | None = None, method: str = "auto", part: tuple[int, int] | None = None, digits: int | None = None) -> DataFrame:
    """(key1, key2, ned): normalised edit distance of all pairs as FLOAT, or of those strictly below a threshold.

    seq is a string with one character a token; null counts as empty. Equal sequences are compared once, and every pair of
    their keys gets a row. With a threshold there are two ways to the same pairs: `blocks` compares the lengths of all
    pairs and then the strings, and `segments` compares only pairs that share a segment (see near_pairs). `auto` counts
    what the segments would bring together first, and takes the way with fewer comparisons. MANY sequences or more that
    have to be compared with each other are measured many at once, those of rare lengths apart. part: without a threshold,
    only a part of the pairs of blocks (see block_pairs). digits: ned is a DOUBLE rounded to so many digits, 6 at most.
    """
    if method not in ("auto", "blocks", "segments") or digits is not None and not 0 <= digits <= 6:
        raise ValueError((method, digits))
    value = F.col("ned") if digits is None else F.round(F.col("ned").cast("double"), digits).alias("ned")
    rows, near, crowds = _gathered(df, key, seq), None, {}
    if threshold is not None and threshold < 1 and method != "blocks":
        rows = keep(rows.withColumn("_row", F.monotonically_increasing_id()), "sequences")
        near = near_pairs(rows.select("_row", F.col("_id.s").alias("_s")), "_row", "_s", threshold, always=method == "segments")
        crowds = _crowds(rows) if near is None else {}
    elif threshold is None and not (blocks or part) and method != "blocks":
        rows = keep(rows, "sequences")
        crowds = _crowds(rows)
    found = []
    if near is not None:
        for k in ("1", "2"):
            near = near.join(rows.select(F.col("_row").alias(f"_row{k}"), F.col("_keys").alias(f"_keys{k}")), f"_row{k}")
    else:
        some = rows
        if crowds:
            found.append(_measured(rows, crowds, threshold, digits).filter("_a != _b").select(F.least("_a", "_b").alias(f"{key}1"), F.greatest("_a", "_b").alias(f"{key}2"), "ned"))
            common = F.coalesce(_class().isin(*crowds), F.lit(False))  # an empty sequence has no class
            some, others = rows.filter(~common), rows.filter(common)
        if not crowds or not some.isEmpty():
            both = block_pairs(some.select("_id", "_keys"), "_id", ["_keys"], blocks, None if threshold is not None else part).select("_keys1", "_keys2", F.col("_id1.s").alias("_s1"), F.col("_id2.s").alias("_s2"))
            both = both.unionByName(_between(some, others)) if crowds else both
            near = both.withColumn("ned", ned(F.col("_s1"), F.col("_s2")).cast("float")) if threshold is None else pruned(both, threshold)
    if near is not None:
        found.append(_spread(near.select("_keys1", "_keys2", value), key))
    alike = rows.filter(F.size("_keys") > 1).select("_keys", F.when(F.col("_id.s") == "", 1.0).otherwise(0.0).cast("float").alias("ned"), F.col("_id.k").alias("_k"))
    if threshold is not None:
        alike = alike.filter(F.col("ned") < F.lit(threshold).cast("float"))
    elif part:
        alike = alike.filter(F.pmod(F.xxhash64("_k"), F.lit(part[1])) == part[0])
    alike = alike.select("_keys", value).select("ned", "_keys", F.explode("_keys").alias("_a")).select("ned", "_a", F.explode("_keys").alias("_b")).filter("_a < _b")
    for x in found:
        out = x if x is found[0] else out.unionByName(x)
    return out.unionByName(alike.select(F.col("_a").alias(f"{key}1"), F.col("_b").alias(f"{key}2"), "ned"))


def most_edits(length: Column, threshold: float) -> Column:
    """The largest number of edits that is below the threshold of a length, both compared as FLOAT; null for length 0."""
    t, about = F.lit(threshold).cast("float"), F.floor(length * F.lit(float(threshold))).cast("int")
    below = lambda d: (d / length).cast("float") < t
    return F.when(below(about + 1), about + 1).when(below(about), about).when(about > 0, about - 1)


#: Rows of either side of one segment that meet in one key; segments with more are split.
SEGMENT_ROWS = 4000


def segment_index(rows: DataFrame, key: str, seq: str, threshold: float) -> DataFrame:
    """(_seg, key, _s, _n, _k, _i, _p): each sequence cut into _k + 1 even segments, _k being the edits that its length allows: segment _i begins at _p, from 0. One that is long or short of its even share by one comes first."""
    sized = rows.select(F.col(key), F.col(seq).alias("_s"), F.length(seq).alias("_n")).filter("_n > 0").withColumn("_k", most_edits(F.col("_n"), threshold)).filter("_k >= 0")
    cut = sized.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_k"))))
    cut = cut.withColumn("_p", F.expr("_i * (_n div (_k + 1)) + least(_i, _n % (_k + 1))").cast("int")).withColumn("_q", F.expr("_n div (_k + 1) + if(_i < _n % (_k + 1), 1, 0)").cast("int"))
    return cut.select(F.expr("substring(_s, _p + 1, _q)").alias("_seg"), key, "_s", "_n", "_k", "_i", "_p")


def segment_probes(rows: DataFrame, key: str, seq: str, threshold: float) -> DataFrame:
    """(_seg, key, _s, _n, _at): the substrings of each sequence that may be a segment of one at least as long, by the lengths that such segments have, with where they begin, from 0."""
    sized = rows.select(F.col(key), F.col(seq).alias("_s"), F.length(seq).alias("_n")).filter("_n > 0")
    most = F.ceil(F.col("_n") / F.lit(1 - threshold)).cast("int") + 1
    lengths = F.transform(F.sequence(F.col("_n"), most), lambda n: F.struct(n.alias("n"), (most_edits(n, threshold) + 1).alias("parts")))
    sizes = F.array_distinct(F.flatten(F.transform(lengths, lambda x: F.array(F.floor(x["n"] / x["parts"]).cast("int"), F.ceil(x["n"] / x["parts"]).cast("int")))))
    sized = sized.withColumn("_q", F.explode(F.filter(sizes, lambda q: q <= F.col("_n"))))
    sized = sized.withColumn("_at", F.explode(F.expr("sequence(0, _n - _q)")))
    return sized.select(F.expr("substring(_s, _at + 1, _q)").alias("_seg"), key, "_s", "_n", "_at")


def segment_matches(index: DataFrame, probes: DataFrame) -> DataFrame:
    """(_seg, _a, _b): how many rows of the index and of the probes have each segment that both have."""
    # Sizes are estimated without what explode() makes, so neither side is left to be broadcast.
    return index.groupBy("_seg").agg(F.count(F.lit(1)).alias("_a")).join(probes.groupBy("_seg").agg(F.count(F.lit(1)).alias("_b")).hint("merge"), "_seg")


def _window(i: str, p: str, q: str) -> tuple[str, str]:
    """Where in the shorter string of a pair within _k edits segment i may begin that begins at p in the longer one and has q characters: shifted by i at most, and against the end by _k - i."""
    return f"greatest({p} - {i}, {p} + _n2 - _n1 - (_k - {i}), 0)", f"least({p} + {i}, {p} + _n2 - _n1 + _k - {i}, _n2 - {q})"


def _first_at(low: str, high: str, q: str, text: str) -> str:
    """Where a text of q characters first begins in a window of the shorter string, from low + 1; low if it does not."""
    return f"{low} + instr(substring(_s2, {low} + 1, {high} - {low} + {q}), {text})"


def segment_candidates(index: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    """(_key1, _s1, _key2, _s2, _k): the pairs that a segment brings together, each once; the first is the longer, of equal lengths the one with the smaller key.

    Of two sequences the longer allows _k edits. If they are within _k, one of its _k + 1 segments is unharmed and lies
    in the other, shifted by no more than the edits before and behind it. So segments are joined with substrings on
    their text and the shift is checked. Segments of many rows are split on both sides, so no key is one task's work.
    """
    counts = segment_matches(index, probes)
    # So many parts of either side, and each row of one meets each part of the other. At most one in SEGMENT_ROWS rows has such a segment.
    hot = keep(counts.filter((F.col("_a") > SEGMENT_ROWS) | (F.col("_b") > SEGMENT_ROWS)).select("_seg", F.ceil(F.col("_a") / SEGMENT_ROWS).cast("int").alias("_as"), F.ceil(F.col("_b") / SEGMENT_ROWS).cast("int").alias("_bs")), "hot-segments")

    def split(side: DataFrame, own: str, other: str) -> DataFrame:
        parts = side.join(hot, "_seg", "left").withColumn(own, F.pmod(F.xxhash64(key), F.coalesce(own, F.lit(1))).cast("int"))
        return parts.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))

    left = split(index, "_as", "_bs").select("_seg", "_as", "_bs", F.col(key).alias("_key1"), F.col("_s").alias("_s1"), F.col("_n").alias("_n1"), "_k", "_i", "_p")
    right = split(probes, "_bs", "_as").select("_seg", "_as", "_bs", F.col(key).alias("_key2"), F.col("_s").alias("_s2"), F.col("_n").alias("_n2"), "_at")
    low, high = _window("_i", "_p", "length(_seg)")
    both = _dealt(left, "_seg", "_as", "_bs").join(_dealt(right, "_seg", "_as", "_bs").hint("merge"), ["_seg", "_as", "_bs"]).filter("(_n1 > _n2 or _n1 = _n2 and _key1 < _key2) and _n1 - _n2 <= _k").filter(f"_at >= {low} and _at <= {high}")
    # The first place in the window; what a pair shares besides goes with distinct().
    both = both.filter(f"_at + 1 = {_first_at(low, high, 'length(_seg)', '_seg')}")
    return both.select("_key1", "_s1", "_key2", "_s2", "_k").distinct()


#: A sequence is compared with all others if its segments would meet more rows than so many times all.
WIDE = 1.0


def _crossed(some: DataFrame, rows: DataFrame, key: str, seq: str) -> DataFrame:
    """(_key1, _s1, _key2, _s2): each of some rows with all rows, the first being the longer, of equal lengths the one with the smaller key. Pairs of blocks are keys of a join."""
    blocks = blocks_of(rows.sparkSession)
    block, every = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = some.select(F.col(key).alias("_key1"), F.col(seq).alias("_s1"), block.alias("_i"), every.alias("_j"))
    right = rows.select(F.col(key).alias("_key2"), F.col(seq).alias("_s2"), block.alias("_j"), every.alias("_i"))
    both = _dealt(left, "_i", "_j").join(_dealt(right, "_i", "_j").hint("shuffle_hash"), ["_i", "_j"])
    return both.filter("length(_s1) > length(_s2) or length(_s1) = length(_s2) and _key1 < _key2").select("_key1", "_s1", "_key2", "_s2")


def near_pairs(rows: DataFrame, key: str, seq: str, threshold: float, always: bool = True) -> DataFrame | None:
    """(key1, key2, ned) of the pairs strictly below a threshold under 1, by an inverted index of segments. rows is a stored table. None if most of MANY rows or more would be compared with all others, or, unless `always`, if the segments would bring more rows together than there are pairs.

    A sequence whose segments lie in so many places that they meet more rows than there are (long strings of few letters)
    is not indexed but compared with all rows that are not longer, in blocks.
    """
    index, probes = segment_index(rows, key, seq, threshold), segment_probes(rows, key, seq, threshold)
    n = rows.count()
    if not always and (segment_matches(index, probes).agg(F.sum(F.col("_a").cast("double") * F.col("_b"))).first()[0] or 0.0) > n * (n - 1) / 2:
        return None
    places = probes.groupBy("_seg").agg(F.count(F.lit(1)).alias("_b"))
    met = index.groupBy(key, "_seg").agg(F.count(F.lit(1)).alias("_a")).join(places.hint("merge"), "_seg").groupBy(key).agg(F.sum(F.col("_a") * F.col("_b")).alias("_met"))
    wide = keep(met.filter(F.col("_met") > WIDE * n).select(key), "wide")
    if n >= MANY and 2 * wide.count() > n:
        return None
    some, others = rows.join(wide, key, "left_semi"), rows.join(wide, key, "left_anti").filter(F.length(seq) > 0)
    found = []
    if not wide.isEmpty():
        found.append(pruned(_crossed(some, rows, key, seq), threshold))
    if not found or not others.isEmpty():
        found.append(pruned(segment_candidates(segment_index(others, key, seq, threshold), probes, key).drop("_k"), threshold))
    near = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    swap = F.col("_key1") > F.col("_key2")
    return near.select(F.when(swap, F.col("_key2")).otherwise(F.col("_key1")).alias(f"{key}1"), F.when(swap, F.col("_key1")).otherwise(F.col("_key2")).alias(f"{key}2"), "ned")


#: Lengths up to each of which the distance of two strings stops at one limit.
STEPS = (8, 32, 128, 512)


def pruned(both: DataFrame, threshold: float, a: str = "_s1", b: str = "_s2") -> DataFrame:
    """Pairs of strings strictly below the threshold, compared as FLOAT, with their ned."""
    t = F.lit(threshold).cast("float")
    longer = F.greatest(F.length(a), F.length(b))
    near = both.filter((longer > 0) & ((F.abs(F.length(a) - F.length(b)) / longer).cast("float") < t)) if threshold <= 1 else both
    # levenshtein() takes a constant limit, so a few lengths share one. (Many branches would be more code than Java compiles.)
    out = F.levenshtein(F.col(a), F.col(b))
    if threshold <= 1:
        for s in reversed(STEPS):
            out = F.when(longer <= s, F.levenshtein(F.col(a), F.col(b), math.floor(threshold * s))).otherwise(out)
    # A generator is evaluated once; the filters on a plain column would each compute the distance again.
    d = near.select("*", F.explode(F.array(out)).alias("_d")).filter("_d >= 0")
    return d.withColumn("ned", F.when(longer == 0, F.lit(1.0)).otherwise(F.col("_d") / longer).cast("float")).drop("_d").filter(F.col("ned") < t)


def group_pairs(df: DataFrame, group: str, order: str, carried: list[str]) -> DataFrame:
    """Pairs within groups, in order: group, carried1.., carried2... For groups of bounded size."""
    numbered = df.select(group, *carried, F.row_number().over(Window.partitionBy(group).orderBy(order)).alias("_rn"))
    left = numbered.select(group, F.col("_rn").alias("_r1"), *(F.col(c).alias(f"{c}1") for c in carried))
    right = numbered.select(group, F.col("_rn").alias("_r2"), *(F.col(c).alias(f"{c}2") for c in carried))
    return left.join(right, group).filter("_r1 < _r2").drop("_r1", "_r2")


#: Distinct sequences of a block of a group.
GROUP_ROWS = 2000


def group_ned(df: DataFrame, group: str, seq: str) -> DataFrame:
    """(group, size, pairs, total): number of rows and pairs of each group, and the sum of their normalised distances.

    Distances are taken once for each pair of distinct sequences and multiplied by how often it occurs. Equal
    sequences are at distance 0, but two empty ones at 1. Groups of many distinct sequences are cut into blocks, and
    each pair of blocks is a key of its own, so no group is one task's work.
    """
    kinds = df.select(group, F.coalesce(F.col(seq), F.lit("")).alias("_s")).groupBy(group, "_s").agg(F.count(F.lit(1)).alias("_n"))
    own = kinds.groupBy(group).agg(F.sum("_n").alias("size"), F.count(F.lit(1)).alias("_kinds"), F.coalesce(F.sum(F.when(F.col("_s") == "", F.col("_n") * (F.col("_n") - 1) / 2)), F.lit(0.0)).alias("_own"))
    cut = kinds.join(own.select(group, F.ceil(F.col("_kinds") / GROUP_ROWS).alias("_g")), group).withColumn("_b", F.pmod(F.xxhash64("_s"), F.col("_g")))
    left = cut.select(group, F.col("_b").alias("_i"), F.explode(F.sequence("_b", F.col("_g") - 1)).alias("_j"), F.col("_s").alias("_s1"), F.col("_n").alias("_n1"))
    right = cut.select(group, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b"))).alias("_i"), F.col("_b").alias("_j"), F.col("_s").alias("_s2"), F.col("_n").alias("_n2"))
    both = left.join(right, [group, "_i", "_j"]).filter("_i < _j or _s1 < _s2")
    cross = both.groupBy(group).agg(F.sum(F.col("_n1") * F.col("_n2") * ned(F.col("_s1"), F.col("_s2"))).alias("_cross"))
    return own.join(cross, group, "left").select(group, "size", F.expr("size * (size - 1) div 2").alias("pairs"), (F.coalesce("_cross", F.lit(0.0)) + F.col("_own")).alias("total"))


def tokens_to_string(tokens: Column, vocabulary: list[str]) -> Column:
    """A character for each token of a known, small vocabulary."""
    known = F.create_map(*(x for k, t in enumerate(vocabulary) for x in (F.lit(t), F.lit(chr(0x4E00 + k)))))
    return F.array_join(F.transform(tokens, lambda t: F.element_at(known, t)), "")
