"""Threshold graphs of edit distances, and their connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import edge_weight, is_spoken, vertex_name
from .pairs import all_pairs_ned
from .scratch import Scratch


def spoken_nodes(nodes: DataFrame, alignment: DataFrame) -> DataFrame:
    """Nodes (filename = utterance, word_id) whose word has phones other than silence."""
    spoken = alignment.filter(is_spoken(F.col("phones"))).select("filename", "word_id")
    return nodes.join(spoken, ["filename", "word_id"], "left_semi")


def threshold_edges(sequences: DataFrame, threshold: float, key: str = "node_id", seq: str = "seq") -> DataFrame:
    """(src, dst, weight) of pairs strictly below the threshold. Silence is to be filtered from sequences first: fewer rows, fewer pairs."""
    near = all_pairs_ned(sequences, key, seq, threshold)
    return near.select(F.col(f"{key}1").alias("src"), F.col(f"{key}2").alias("dst"), edge_weight(F.col("ned")).alias("weight"))


def sweep(edges: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, edges): distances are taken once, at the largest threshold, and counted for each."""
    marks = F.array(*(F.struct(F.lit(t).alias("threshold"), F.lit(t).cast("float").alias("_t")) for t in thresholds))
    return edges.withColumn("_m", F.explode(marks)).groupBy(F.col("_m.threshold").alias("threshold")).agg(F.count_if(F.col("weight") < F.col("_m._t")).alias("edges"))


def vertices(nodes: DataFrame, key: str) -> DataFrame:
    return nodes.select(F.col("node_id").alias("id"), vertex_name(F.col(key)).alias("name"), F.col(key).alias("filename"))


def degrees(edges: DataFrame, nodes: DataFrame, key: str = "node_id") -> DataFrame:
    """(key, degree) of every node, 0 for those without edges."""
    ends = edges.select(F.col("src").alias(key)).unionByName(edges.select(F.col("dst").alias(key)))
    return nodes.select(key).join(ends.groupBy(key).agg(F.count(F.lit(1)).alias("degree")), key, "left").select(key, F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def components(edges: DataFrame, nodes: DataFrame, key: str = "node_id", scratch: Scratch | None = None) -> DataFrame:
    """(key, component): the smallest node that each node reaches, itself included.

    Labels take the smallest label around them, then that label's label, until nothing moves; each round is written to
    the shared folder, so a lost executor costs one round at most, and the round before it is removed. The result is a
    kept table, which goes with scratch if that is given.
    """
    mine = Scratch()
    both = edges.select(F.col("src").alias("v"), F.col("dst").alias("u"))
    both = mine.keep(both.unionByName(both.select(F.col("u").alias("v"), F.col("v").alias("u"))).distinct(), "edges")
    kept = (scratch or mine).keep(nodes.select(F.col(key).alias("v"), F.col(key).alias("_new")).distinct().withColumn("c", F.col("_new")), "labels")
    while True:
        labels = kept.select("v", F.col("_new").alias("c"))
        around = both.join(labels.select(F.col("v").alias("u"), F.col("c").alias("_cu")), "u").groupBy("v").agg(F.min("_cu").alias("_around"))
        near = labels.join(around, "v", "left").select("v", F.least("c", "_around").alias("_near"), "c")
        jump = labels.select(F.col("v").alias("_near"), F.col("c").alias("_far"))
        after = (scratch or mine).keep(near.join(jump, "_near", "left").select("v", F.least("_near", "_far").alias("_new"), "c"), "labels")
        (scratch or mine).drop(kept)
        kept = after
        if not after.filter("_new < c").limit(1).count():
            mine.drop(*(t for t in mine.kept if t is not after))
            return after.select(F.col("v").alias(key), F.col("_new").alias("component"))
