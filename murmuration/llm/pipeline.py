"""The corpus pipeline: toxicity, exact dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns the columns of documents, but for the
last, which returns packed pieces. A stage's model or counts come from its own input and from the labels table.

docs is a stored table: rows are told apart by their place in it, so null and repeated ids do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import drop
from . import content_sort, jaccard_join, mixing, packing, toxicity
from .common import free_name, materialise, split_by_bloom, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. A null or empty text has nothing that the toxic dictionary compresses and stays."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = free_name(docs, "_toxicity_score"), free_name(docs, "_toxicity")
    return toxicity.scored(docs, model, out=out).filter(F.col(out[1]) == 0).drop(*out)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    return content_sort.kept_rows(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id stays (null ids last, then by place). Rows that are alone in their group stay, as do empty texts."""
    row = free_name(docs, "_row")
    keyed = docs.withColumn(row, F.monotonically_increasing_id())
    found = jaccard_join.near_duplicates(keyed, row)
    ids = keyed.select(F.col(row).alias("_at"), F.col("doc_id").alias("_id"))
    both = found.join(ids, F.col(row) == F.col("_at")).select("component_id", "_at", "_id")
    best = both.groupBy("component_id").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(F.col("_id").isNull(), "_id", "_at")).alias("_best")).filter("_n > 1")
    gone = materialise(both.join(best, "component_id").filter(F.col("_at") != F.col("_best._at")).select("_at"), "near-copies")
    drop(found)
    # Only rows that the filter can't tell from those that go are moved.
    maybe, sure = split_by_bloom(keyed, row, gone)
    return maybe.join(gone, F.col(row) == F.col("_at"), "left_anti").unionByName(sure).drop(row)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole number: none to three times. (Each source has at most one document that is cut in its last turn.) Documents without words are not taken."""
    row = free_name(docs, "_row")
    keyed = docs.withColumn(row, F.monotonically_increasing_id())
    copies = F.round(F.col("taken") / F.col("size")).cast("int")
    taken = mixing.mix(keyed, keep=(row,)).filter("taken > 0").select(F.col(row).alias("_at"), copies.alias("_copies")).filter("_copies > 0")
    taken = materialise(taken, "mix-taken")
    both = keyed.select(F.col(row).alias("_key"), F.struct(*(f"`{c}`" for c in docs.columns)).alias("_doc")).join(taken, F.col("_key") == F.col("_at"))
    return both.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", without_toxic), ("exact dedup", without_copies), ("n-gram Jaccard join", without_near_copies), ("mixing", mixed), ("packing", packed)]

#: The toxicity stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents. A stage's stored result goes when the next one's is written; the last stage's input is kept in its own form."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{k}")
        if before is not None and k < len(STAGES) - 1:
            drop(before)
        before = docs
    return docs
