"""Scores of a partition: edit distance within clusters, word distance within clusters, token counts, and the text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import pad_right
from .pairs import group_ned


def cluster_scores(rows: DataFrame, cluster: str = "cluster_id", seq: str = "seq") -> DataFrame:
    """(cluster, size, pairs, avg_ned): the mean over a cluster's pairs, null for clusters of one."""
    return group_ned(rows, cluster, seq).select(cluster, "size", "pairs", F.when(F.col("pairs") > 0, F.col("total") / F.col("pairs")).alias("avg_ned"))


def overall_score(rows: DataFrame, cluster: str = "cluster_id", seq: str = "seq") -> DataFrame:
    """One row, (pairs, avg_ned): the mean over all pairs of all clusters, 0 without any."""
    sums = group_ned(rows, cluster, seq).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.sum("total").alias("_t"))
    return sums.select("pairs", F.when(F.col("pairs") > 0, F.col("_t") / F.col("pairs")).otherwise(F.lit(0.0)).alias("avg_ned"))


def token_counts(rows: DataFrame, cluster: str = "cluster_id", token: str = "seq", order: str | None = None) -> DataFrame:
    """(cluster, token, count, place): how often each token sequence (or word) occurs in a cluster; place 1 is the most frequent, ties in text order, or with `order` by where the token comes first (`first_ord`, which is then a column too)."""
    from pyspark.sql import Window

    first = [F.min(order).alias("first_ord")] if order else []
    counts = rows.groupBy(cluster, token).agg(F.count(F.lit(1)).alias("count"), *first)
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("count"), "first_ord" if order else token)))


def token_speakers(rows: DataFrame, cluster: str = "cluster_id", token: str = "seq", speaker: str = "filename", order: str = "frag_id") -> DataFrame:
    """(cluster, token, speaker, count, first_ord): who says a token sequence, how often, and where first: a row a speaker, so no list grows with the corpus."""
    return rows.groupBy(cluster, token, speaker).agg(F.count(F.lit(1)).alias("count"), F.min(order).alias("first_ord"))


# The layout of the reports.
_RULE, _DOUBLE = "-" * 60, "=" * 60


def report(rows: DataFrame, shown: str, seq: str, width: int, score: str, overall: str, cluster: str = "cluster_id", order: str | None = None) -> DataFrame:
    """The lines of a text report, (cluster, part, place, line), to be written in that order; the last has no cluster.

    shown: the column whose values are counted; seq: the string whose characters are compared; order: the column by
    which of equally frequent values the first comes first (else they come in text order).
    """
    scores = cluster_scores(rows, cluster, seq)
    of = lambda part, place, line: (F.col(cluster).alias("cluster"), F.lit(part).alias("part"), place.cast("long").alias("place"), line.alias("line"))
    head = scores.select(F.col(cluster), F.posexplode(F.array(F.lit(""), F.lit(_RULE), F.concat(F.lit("🧩 Cluster "), F.col(cluster).cast("string"), F.lit(" | Size: "), F.col("size").cast("string")), F.lit(_RULE))).alias("_p", "_l"))
    head = head.select(*of(0, F.col("_p"), F.col("_l")))
    counts = token_counts(rows, cluster, shown, order)
    body = counts.select(*of(1, F.col("place"), F.concat(pad_right(F.coalesce(F.col(shown).cast("string"), F.lit("")), width), F.lit("  → "), F.col("count").cast("string"), F.lit(" times"))))
    tail = scores.filter("pairs > 0").select(F.col(cluster), F.posexplode(F.array(F.concat(F.lit(f"→ Avg {score} for Cluster "), F.col(cluster).cast("string"), F.lit(": "), F.format_string("%.4f", "avg_ned")), F.lit(_DOUBLE))).alias("_p", "_l"))
    tail = tail.select(*of(2, F.col("_p"), F.col("_l")))
    kind = rows.schema[cluster].dataType
    whole = overall_score(rows, cluster, seq).select(F.lit(None).cast(kind).alias("cluster"), F.lit(3).alias("part"), F.lit(0).cast("long").alias("place"), F.when(F.col("pairs") > 0, F.concat(F.lit(f"🔍 Overall {overall} across all clusters: "), F.format_string("%.4f", "avg_ned"))).otherwise("⚠️ No valid clusters with multiple elements found.").alias("line"))
    return head.unionByName(body).unionByName(tail).unionByName(whole)


def ned_report(transcription: DataFrame, seq: str = "seq", order: str | None = None) -> DataFrame:
    """transcription: cluster_id, phones array<string>, and seq with a character for each phone."""
    return report(transcription.withColumn("_shown", F.array_join("phones", " ")), "_shown", seq, 20, "NED", "NED", order=order)


def word_report(transcription: DataFrame, order: str | None = None) -> DataFrame:
    """The mean character distance between the words of a cluster; lower is purer."""
    return report(transcription.withColumn("_w", F.coalesce("word", F.lit(""))), "_w", "_w", 30, "word purity", "WP", order=order)
