"""Interval joins and the transcription of found fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.scalars import check_boundary
from .ordered import first_rows

#: Seconds of a bucket of the long-file form of the join.
BUCKET_S = 30.0


def overlap_join(left: DataFrame, right: DataFrame, key: str, lspan: tuple[str, str], rspan: tuple[str, str], how: str = "inner", bucket: float | None = None) -> DataFrame:
    """Rows of equal key whose half-open spans overlap: right begins before left ends and ends after left begins.

    The key is hashed and the rest of the condition filters. Where one key holds many spans, `bucket` (seconds) makes
    time part of the hash: spans are listed under each bucket that they touch, and a pair counts where its overlap begins.
    Columns other than the key must have different names on the two sides.
    """
    (lb, le), (rb, re) = lspan, rspan
    over = (F.col(rb) < F.col(le)) & (F.col(re) > F.col(lb))
    right = right.withColumnRenamed(key, "_key")
    if bucket is None:
        return left.join(right, (F.col(key) == F.col("_key")) & over, how).drop("_key")
    if how not in ("inner", "left"):
        raise ValueError(how)
    cells = lambda b, e: F.explode(F.sequence(F.floor(F.col(b) / bucket), F.greatest(F.floor(F.col(b) / bucket), F.floor(F.col(e) / bucket))))
    rows = left.withColumn("_id", F.monotonically_increasing_id()) if how == "left" else left
    inner = rows.withColumn("_cell", cells(lb, le)).join(right.withColumn("_rcell", cells(rb, re)), (F.col(key) == F.col("_key")) & (F.col("_cell") == F.col("_rcell")) & over & (F.col("_cell") == F.floor(F.greatest(lb, rb) / bucket))).drop("_key", "_cell", "_rcell")
    if how == "inner":
        return inner
    alone = rows.join(inner.select("_id").distinct(), "_id", "left_anti")
    return inner.unionByName(alone, allowMissingColumns=True).drop("_id")


def words_with_phones(words: DataFrame, phones: DataFrame, seen: Observation | None = None) -> DataFrame:
    """words (filename, word_id, word_start, word_end, text) with `phones`: the phones that overlap, in order, joined with commas; empty if there are none. seen: is told how many `words` went by, and how many were `silent`, without phones."""
    p = phones.select("filename", F.col("idx").alias("_idx"), F.col("xmin").alias("_xmin"), F.col("xmax").alias("_xmax"), F.trim("text").alias("_text"))
    joined = overlap_join(words, p, "filename", ("word_start", "word_end"), ("_xmin", "_xmax"), "left")
    listed = F.array_sort(F.collect_list(F.when(F.col("_idx").isNotNull(), F.struct("_idx", "_text"))))
    out = joined.groupBy("word_id", "filename", "word_start", "word_end", "text").agg(F.array_join(F.transform(listed, lambda x: x["_text"]), ",").alias("phones"))
    return out if seen is None else out.observe(seen, F.count(F.lit(1)).alias("words"), F.count_if(F.col("phones") == "").alias("silent"))


def transcribe(fragments: DataFrame, gold: DataFrame, frag: str = "frag_id", carried: tuple[str, ...] = ("cluster_id",), outcomes: bool = False) -> DataFrame:
    """Each fragment (frag, filename, begin, end) with phones and word of the gold word that it stands for.

    Of the gold words that overlap a fragment, the first that passes the boundary test counts, in order of start, end,
    phones and word. Without any overlap the fragment stays, with no phones and an empty word; with overlaps of
    which none passes it goes (outcome `dropped`, if outcomes are asked for). Fragments that end at or before their
    begin overlap nothing. gold: filename, word_start, word_end, phones array<string>, word.
    """
    g = gold.filter("word_start < word_end").select("filename", "word_start", "word_end", F.col("phones").alias("_phones"), F.col("word").alias("_word"))
    spans = overlap_join(fragments, g, "filename", ("begin", "end"), ("word_start", "word_end"), "left")
    empty = F.col("begin") >= F.col("end")
    met = F.col("word_start").isNotNull() & ~empty
    ok = met & check_boundary(F.col("word_start"), F.col("word_end"), F.col("begin"), F.col("end"))
    ranked = spans.withColumn("_met", met).withColumn("_ok", ok)
    best = first_rows(ranked, [frag], [F.desc("_ok"), "word_start", "word_end", "_phones", "_word"])
    outcome = F.when(F.col("_ok"), "matched").when(F.col("_met"), "dropped").otherwise("unmatched")
    out = best.select(frag, *carried, "filename", "begin", "end", F.when(F.col("_ok"), F.col("_phones")).otherwise(F.array().cast("array<string>")).alias("phones"), F.when(F.col("_ok"), F.coalesce("_word", F.lit(""))).otherwise("").alias("word"), outcome.alias("outcome"))
    return out if outcomes else out.filter("outcome <> 'dropped'").drop("outcome")


def without_gold(fragments: DataFrame, gold: DataFrame) -> DataFrame:
    """Files of fragments of which no gold is known."""
    return fragments.select("filename").distinct().join(gold.select("filename"), "filename", "left_anti")


