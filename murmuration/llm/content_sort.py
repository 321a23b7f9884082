"""Exact dedup by content sort: sampled splitters range-partition the normalised bytes, an external sort places equal texts side by side, and full comparisons of neighbours form the groups.

DataFrame operations only. A text that holds a large share of the rows would fill one range, so such texts get a
salt as their second sort key: the splitters can then cut inside the group, and the few partial groups are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WHITE, materialise, partitions, table


#: Characters of a text that a splitter holds.
SPLITTER_CHARS = 32


def normalised(text: Column) -> Column:
    """The text without white space ([\\x20\\x09-\\x0D]); null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _sorted(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """Rows of docs beside their equals: _id, _points, _salt (-1: the group is whole), _rank, _head, _size, _sha, and _row, the row itself, if it is carried.

    Carried rows bring their own text, so the normalised one is made again behind the exchange instead of being sent too.
    """
    n = partitions(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_at"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("_points"), normalised(F.col(text_col)).alias("_norm"), *([F.struct("*").alias("_row")] if carry else [])).withColumn("_h", F.xxhash64("_norm"))
    # Salts go by place, not by id, so that rows of one id are cut too. A text with more rows than this is cut; at most 4 n texts can have so many, which bounds what is broadcast.
    heavy = max(64, docs.count() // (4 * n))
    hot = base.groupBy("_h").count().filter(F.col("count") > heavy).select("_h", F.lit(True).alias("_hot"))
    salted = base.join(F.broadcast(hot), "_h", "left").select("_id", "_points", "_h", "_row" if carry else "_norm", F.substring("_norm", 1, SPLITTER_CHARS).alias("_first"), F.when(F.col("_hot"), F.pmod(F.xxhash64("_at"), F.lit(4 * n))).otherwise(F.lit(-1)).alias("_salt"))
    # Splitters are sampled to the driver, so they hold the first bytes and a hash instead of whole texts.
    ranged = salted.repartitionByRange(n, "_first", "_h", "_salt")
    if carry:
        ranged = ranged.withColumn("_norm", normalised(F.col("_row").getField(text_col)))
    # That partitioning already keeps equal (text, salt) together: the window adds a sort, no exchange. The sort compares whole texts where first bytes and hash agree.
    group = Window.partitionBy("_first", "_h", "_norm", "_salt")
    ordered = group.orderBy(F.desc("_points"), F.asc_nulls_last("_id"))
    return ranged.select(
        "_id",
        "_points",
        "_salt",
        F.row_number().over(ordered).alias("_rank"),
        F.first("_id").over(ordered).alias("_head"),
        F.count(F.lit(1)).over(group).alias("_size"),
        F.unhex(F.sha2(F.col("_norm"), 256)).alias("_sha"),
        *(["_row"] if carry else []),
    )


def _merged(cut: DataFrame) -> DataFrame:
    """The parts of cut groups put together: _sha, _top (best row's id and salt), _all. There are at most a few texts of this kind per partition."""
    return cut.filter("_rank = 1").groupBy("_sha").agg(F.min(F.struct(-F.col("_points"), F.col("_id").isNull().alias("_none"), F.col("_id").alias("_best"), F.col("_salt").alias("_at"))).alias("_top"), F.sum("_size").alias("_all"))


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are, compared in full. Of equal texts the row with the most code
    points in its original text stays, then the one with the smallest id (null ids last); among repeated rows with
    the same id exactly one is kept. Null and empty texts form one group. Further columns of docs are ignored, so
    their names can't clash. An empty table gives an empty result.
    """
    local = materialise(_sorted(docs, id_col, text_col, False), "content-sort")
    out = lambda keep, size, kept: (F.col("_id").alias(id_col), keep.alias("keep_id"), size.cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))
    cold = local.filter("_salt < 0").select(*out(F.col("_head"), F.col("_size"), F.col("_rank") == 1))
    cut = local.filter("_salt >= 0")
    hot_rows = cut.join(F.broadcast(_merged(cut)), "_sha").select(*out(F.col("_top._best"), F.col("_all"), (F.col("_rank") == 1) & (F.col("_salt") == F.col("_top._at"))))
    return cold.unionByName(hot_rows)


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that content_sort() keeps, with all their columns, whatever their names. An empty table gives an empty result."""
    heads = materialise(_sorted(docs, id_col, text_col, True).filter("_rank = 1"), "content-heads")
    cut = heads.filter("_salt >= 0")
    best = _merged(cut).select("_sha", F.col("_top._at").alias("_at"))
    merged = cut.join(F.broadcast(best), "_sha").filter("_salt = _at")
    return heads.filter("_salt < 0").select("_row.*").unionByName(merged.select("_row.*"))


def op8_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equals that stays."""
    return content_sort(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id ASC NULLS LAST)
"""
