"""Bounded samples of labelled documents, for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_of(text: Column, key: Column, chars: int) -> Column:
    """A text of at most `chars` characters whole; of a longer one a window of so many, whose place is a hash of the key."""
    start = F.pmod(F.xxhash64(F.lit("window"), key), F.greatest(F.length(text) - chars, F.lit(0)) + 1).cast("int") + 1
    return F.substring(text, start, F.lit(chars))


def drawn(rows: DataFrame, by: str, most: dict, factor: float = 1.25) -> DataFrame:
    """About most[c] of the rows of each class c of column `by`, never more than factor times that: a draw by hash of _id at a rate by class, then the first by that hash and the other columns, whatever ids repeat. (Window group limits cut rows before the shuffle.)"""
    counts = {r[by]: r["count"] for r in rows.groupBy(by).count().collect()}
    draw = F.xxhash64(F.lit("sample"), "_id")
    rate = F.lit(0)
    for c, n in counts.items():
        rate = F.when(F.col(by) == F.lit(c), min(1 << 20, int((1 << 20) * most[c] / n) + 1)).otherwise(rate)
    some = rows.filter(F.pmod(draw, F.lit(1 << 20)) < rate)
    limit = F.lit(0)
    for c in counts:
        limit = F.when(F.col(by) == F.lit(c), int(most[c] * factor) + 16).otherwise(limit)
    least = int(max((most[c] for c in counts), default=0) * factor) + 16
    place = F.row_number().over(Window.partitionBy(by).orderBy(draw, *(c for c in rows.columns if c != by)))
    return some.withColumn("_place", place).filter(F.col("_place") <= least).filter(F.col("_place") <= limit).drop("_place")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, fold: Column, per_class: dict[int, int], chars: int = 0, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """((_y, _text), rows of each label): about per_class documents of each label whose labels row passes fold; of a text longer than `chars` characters a window, or with 0 all texts whole.

    The rate is set by class, the draw is by hash of the id, so it is the same on every run. Only the drawn labels are
    broadcast, and at most 1.25 * per_class + 16 rows of a label are drawn, however often an id repeats in either
    table. Rows without a label or an id don't count.
    """
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).filter(fold & F.col("_y").isin(list(per_class)) & F.col("_id").isNotNull())
    counts = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
    some = drawn(rows, "_y", per_class).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    part = window_of(F.col("_text"), F.col("_id"), chars) if chars else F.col("_text")
    found = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).join(F.broadcast(some), "_id").select("_id", "_y", part.alias("_text"))
    place = F.row_number().over(Window.partitionBy("_y").orderBy(F.xxhash64(F.lit("sample"), "_id"), "_id", "_text"))
    return found.withColumn("_place", place).filter(F.col("_place") <= int(max(per_class.values()) * 1.25) + 16).select("_y", "_text"), counts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: Column, per_class: dict[int, int], chars: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[str, int]], dict[int, int]]:
    """([(text, label)], rows of each label) of labelled_rows(), gathered."""
    found, counts = labelled_rows(docs, labels, label, fold, per_class, chars, id_col, text_col)
    return sorted((r["_text"], r["_y"]) for r in found.select("_text", "_y").collect()), counts


def fold_of(mod: int, held_out: int) -> Column:
    """Whether a labels row may be learned from: crc32 of the id as text, modulo mod, is not held_out. The id is in column _id."""
    return F.crc32(F.col("_id").cast("string")) % mod != held_out
