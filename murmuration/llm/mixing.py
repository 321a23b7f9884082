"""Mixing sources to target weights by a low-discrepancy schedule.

Slots are golden-ratio points. A point falls into a source's part of the cumulative target weights, the slots of a
source are ranked, and rank r takes the r-th block of the source's shuffled documents, laid end to end and cut into
blocks of equally many words. Documents wrap round at most three times. The points of a source are its share of all to
within a few; what is left of its target, less than a block as a rule, is settled in slots behind them.

All is DataFrame operations. Nothing orders a whole source in one task: ranks and positions are prefix sums over
chunks and buckets first, then within each. What is small (a row a slot, or a bucket) is stored on the way, so no plan holds all
steps: the driver plans a query again after each of its exchanges, and its memory grows with that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scratch import drop, sweep
from .common import materialise, table

WEIGHTS, MOST = (5, 2, 1), 3
GOLDEN = 0.6180339887498949
#: Words of a block at most, and blocks of a mix at least (the block shrinks for small corpora); slots of a chunk, documents of a bucket on average, cells of the weights' index.
BLOCK, LEAST_BLOCKS, CHUNK, BUCKET, CELLS = 4096, 16384, 65536, 2000, 4096
SEED = "mix-1"


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """sizes: (source, z). Adds sid, w and target: z shared out by weight, none above MOST times its own z.

    Sources are numbered by code point, null last; weights 5, 2, 1 repeat. Sorted by cap over weight, a source is
    capped exactly if an even share of what is left would exceed its cap, so one pass of running sums settles all.
    """
    every = Window.orderBy(F.asc_nulls_last("source"))
    out = sizes.withColumn("sid", (F.row_number().over(every) - 1).cast("long")).withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    by_cap = Window.orderBy(F.col("z") * MOST / F.col("w"), "sid")
    total = F.sum("z").over(Window.partitionBy())
    before = F.coalesce(F.sum("z").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * MOST
    left = F.sum("w").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = out.select("source", "sid", "w", "z", total.alias("_t"), (((total - before) * F.col("w")) >= (F.col("z") * MOST * left)).alias("_capped"))
    over = Window.partitionBy()
    free = F.sum(F.when(~F.col("_capped"), F.col("w")).otherwise(0.0)).over(over)
    rest = F.col("_t") - F.sum(F.when(F.col("_capped"), F.col("z") * MOST).otherwise(0)).over(over)
    return out.select("source", "sid", "w", "z", F.when(F.col("_capped"), (F.col("z") * MOST).cast("double")).otherwise(F.col("w") * rest.cast("double") / free).alias("target"))


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """(slot, sid, rank): which source each slot takes, and the how-manieth of the source's slots it is."""
    spark = sources.sparkSession
    total = Window.partitionBy()
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = sources.select("sid", (F.sum("target").over(upto) / F.sum("target").over(total)).alias("_hi")).withColumn("_lo", F.coalesce(F.lag("_hi").over(Window.orderBy("sid")), F.lit(0.0)))
    # The last edge is open upwards, so that rounding can't lose a point.
    edges = edges.filter("_hi > _lo").withColumn("_hi", F.when(F.col("_hi") >= F.lit(1.0) - F.lit(1e-12), F.lit(2.0)).otherwise(F.col("_hi")))
    cells = edges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") * CELLS), F.least(F.floor(F.col("_hi") * CELLS), F.lit(CELLS - 1).cast("long")))))
    at = F.col("id") * GOLDEN + 0.5
    points = spark.range(slots).select(F.col("id").alias("slot"), (at - F.floor(at)).alias("_u")).withColumn("_cell", F.floor(F.col("_u") * CELLS))
    dealt = materialise(points.join(cells, "_cell").filter("_u >= _lo and _u < _hi").select("slot", "sid", F.floor(F.col("slot") / CHUNK).alias("_chunk")), "mix-dealt")
    counts = dealt.groupBy("sid", "_chunk").count()
    earlier = Window.partitionBy("sid").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("sid", "_chunk", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("sid", "_chunk").orderBy("slot")) - 1
    return dealt.withColumn("_r", rank).join(counts, ["sid", "_chunk"]).select("slot", "sid", (F.col("_before") + F.col("_r")).alias("rank"))


def shuffled(docs: DataFrame, rows: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs: (doc_id, sid, size, keep). Adds start: the words of the source before the document, in an order by hash of the id (and of keep).

    Rows that are alike in all of these are one row with a count until their places are known, so many rows of one id are no burden to a window.
    """
    buckets = 1
    while buckets * BUCKET < rows:
        buckets *= 2
    name = F.concat(F.lit(SEED + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), *(x for c in keep for x in (F.lit("|"), F.coalesce(F.col(c).cast("string"), F.lit("")))))
    key = F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")
    docs = docs.withColumn("_key", key).withColumn("_bucket", F.floor(F.col("_key") / F.lit((1 << 60) // buckets)))
    alike = docs.groupBy("sid", "_bucket", "_key", "doc_id", "size", *keep).agg(F.count(F.lit(1)).alias("_n"))
    sums = docs.groupBy("sid", "_bucket").agg(F.sum("size").alias("_sum"))
    sums = sums.select("sid", "_bucket", F.coalesce(F.sum("_sum").over(Window.partitionBy("sid").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    sums = materialise(sums, "mix-buckets")
    within = Window.partitionBy("sid", "_bucket").orderBy("_key", F.asc_nulls_last("doc_id"), "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.withColumn("_in", F.coalesce(F.sum(F.col("size") * F.col("_n")).over(within), F.lit(0))).join(sums, ["sid", "_bucket"])
    return placed.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).select("doc_id", *keep, "sid", "size", (F.col("_before") + F.col("_in") + F.col("_k") * F.col("size")).alias("start"))


def pieces(docs: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """docs with a row for each part of a document in a block of its source: adds z, rank and length. A source's stream of words runs through its documents up to MOST times; what lies beyond its `words` has length 0 and is listed for the first turn only."""
    z = docs.join(sources.select("sid", "z", "words"), "sid").filter("size > 0")
    turns = z.withColumn("_turn", F.explode(F.array(*(F.lit(k).cast("long") for k in range(MOST))))).withColumn("_from", F.col("_turn") * F.col("z") + F.col("start")).filter("_turn = 0 or _from < words")
    cut = turns.withColumn("rank", F.explode(F.sequence(F.expr(f"_from div {block}"), F.expr(f"(_from + size - 1) div {block}"))))
    length = F.least(F.col("_from") + F.col("size"), (F.col("rank") + 1) * block, F.col("words")) - F.greatest(F.col("_from"), F.col("rank") * block)
    return cut.withColumn("length", F.greatest(length, F.lit(0))).drop("_turn", "_from", "z", "words")


def settled(sources: DataFrame, slots: int, block: int) -> DataFrame:
    """(sid, rank, slot): the slots that each source takes up to its `words`: those of the schedule, then as many as are missing, numbered behind all points."""
    dealt = schedule(sources, slots)
    need = sources.select("sid", F.ceil(F.col("words") / block).alias("_need"))
    have = dealt.groupBy("sid").agg(F.count(F.lit(1)).alias("_have"))
    short = need.join(have, "sid", "left").withColumn("_have", F.coalesce("_have", F.lit(0))).filter("_need > _have")
    more = short.select("sid", F.explode(F.sequence(F.col("_have"), F.col("_need") - 1)).alias("rank"))
    return dealt.join(need, "sid").filter("rank < _need").select("sid", "rank", "slot").unionByName(more.select("sid", "rank", (F.col("rank") + slots).alias("slot")))


def block_size(total: int) -> int:
    return max(1, min(BLOCK, total // LEAST_BLOCKS))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (), block: int = 0) -> DataFrame:
    """A row per row of docs: id, the columns in keep, size, source_size, target (its source's), taken (words the mix takes, repeats counted), first_slot (where the mix takes it first; null if never).

    Each source gives its target to the nearest word, however small it is, and no document more than MOST times its
    size. block: words of a slot; by default BLOCK, and fewer in a corpus of less than BLOCK * LEAST_BLOCKS words.
    A null text has size 0, a null source is a source of its own, the last. Documents without words are taken 0
    times. Repeated rows count as so many documents. An empty table gives an empty result. Reruns give the same rows.
    The sources are few enough for one task to sort their totals (some millions).
    """
    sized = materialise(docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")), "mix-sizes")
    head = sized.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first()
    block = block or block_size(head["t"])
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("z"))).withColumn("words", F.floor(F.coalesce("target", F.lit(0.0)) + 0.5))
    sources = materialise(sources, "mix-sources")
    keyed = sized.join(sources.select(F.col("source").alias("_source"), "sid"), F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", *keep, "sid", "size")
    keyed = materialise(keyed, "mix-keyed")
    drop(sized)
    parts = pieces(shuffled(keyed, head["n"], keep), sources, block)
    at = ("doc_id", *keep, "sid", "size", "start")
    slots = materialise(settled(sources, head["t"] // block, block), "mix-slots")
    sweep(docs.sparkSession)
    met = parts.join(slots, ["sid", "rank"], "left")
    taken = met.groupBy(*at).agg(F.sum("length").alias("taken"), F.min(F.when(F.col("length") > 0, F.col("slot"))).alias("first_slot")).drop("start")
    idle = keyed.filter("size = 0").select("doc_id", *keep, "sid", "size", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    return taken.unionByName(idle).join(sources, "sid").select(F.col("doc_id").alias(id_col), *keep, "size", F.col("z").alias("source_size"), "target", "taken", "first_slot")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS key
  FROM documents),
t AS (SELECT CAST(sum(size) AS BIGINT) AS total, greatest(1, least({BLOCK}, CAST(sum(size) AS BIGINT) // {LEAST_BLOCKS})) AS block FROM d),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS z, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
s1 AS (SELECT *, CAST([5, 2, 1][sid % 3 + 1] AS DOUBLE) AS w FROM s0),
s2 AS (
  SELECT *, total - coalesce(sum(z) OVER (ORDER BY z * 3 / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3 AS rest,
         sum(w) OVER (ORDER BY z * 3 / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lw
  FROM s1, t),
s3 AS (SELECT *, rest * w >= z * 3 * lw AS capped FROM s2),
s4 AS (
  SELECT source, sid, z, block, total,
         CASE WHEN capped THEN CAST(z * 3 AS DOUBLE)
              ELSE w * CAST(total - sum(CASE WHEN capped THEN z * 3 ELSE 0 END) OVER () AS DOUBLE) / sum(CASE WHEN capped THEN 0.0::DOUBLE ELSE w END) OVER () END AS target
  FROM s3),
s5 AS (SELECT *, sum(target) OVER (ORDER BY sid) / sum(target) OVER () AS hi FROM s4),
s6 AS (SELECT * REPLACE (CASE WHEN hi >= 1 - 1e-12 THEN 2.0 ELSE hi END AS hi), coalesce(lag(hi) OVER (ORDER BY sid), 0) AS lo FROM s5),
pts AS (SELECT i, i * {GOLDEN}::DOUBLE + 0.5::DOUBLE - floor(i * {GOLDEN}::DOUBLE + 0.5::DOUBLE) AS u FROM (SELECT unnest(range(total // block)) AS i FROM t)),
dealt AS (SELECT sid, i AS slot, row_number() OVER (PARTITION BY sid ORDER BY i) - 1 AS rank FROM pts JOIN s6 ON u >= lo AND u < hi AND hi > lo),
s AS (SELECT *, CAST(floor(coalesce(target, 0) + 0.5::DOUBLE) AS BIGINT) AS words FROM s6),
p AS (
  SELECT d.doc_id, d.size, s.sid, s.z, s.target, s.words, s.block, s.total // s.block AS slots,
         coalesce(sum(d.size) OVER (PARTITION BY s.sid ORDER BY key, doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, z AS source_size, target,
       CASE WHEN z = 0 THEN 0 ELSE CAST((words // z) * size + greatest(0, least(start + size, words % z) - start) AS BIGINT) END AS taken,
       CASE WHEN size > 0 AND start < words THEN CAST(coalesce(slot, slots + start // block) AS BIGINT) END AS first_slot
FROM p LEFT JOIN dealt ON dealt.sid = p.sid AND dealt.rank = p.start // p.block
"""
