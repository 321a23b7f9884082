"""New words on a stream: their distances to the words that are known, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import edge_weight
from ..operators.pairs import block_pairs, pruned
from ..sources.files import missing_rows


def new_edges(words: DataFrame, known: DataFrame, threshold: float, key: str = "node_id", seq: str = "seq") -> DataFrame:
    """(src, dst, weight) below the threshold between words and known words, and among words; words that are known already are left out."""
    fresh = missing_rows(words, known, [key])
    rows = fresh.select(key, F.coalesce(seq, F.lit("")).alias("_s"), F.lit(1).alias("_new")).unionByName(known.select(key, F.coalesce(seq, F.lit("")).alias("_s"), F.lit(0).alias("_new")))
    both = block_pairs(rows, key, ["_s", "_new"]).filter("_new1 + _new2 > 0")
    return pruned(both, threshold).select(F.col(f"{key}1").alias("src"), F.col(f"{key}2").alias("dst"), edge_weight(F.col("ned")).alias("weight"))


def watch(stream: DataFrame, known_path: str, edges_path: str, threshold: float, checkpoint: str, key: str = "node_id", seq: str = "seq") -> StreamingQuery:
    """Starts a query that adds each batch's words to the table at known_path and their edges to that at edges_path. A batch that is tried again replaces its own part, so each word and edge is there once."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = spark.read.parquet(known_path).filter(F.col("batch") != number).select(key, seq)
        words = batch.select(key, seq).dropDuplicates([key])
        fresh = missing_rows(words, known, [key])
        new_edges(words, known, threshold, key, seq).write.mode("overwrite").parquet(f"{edges_path}/batch={number}")
        fresh.write.mode("overwrite").parquet(f"{known_path}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
