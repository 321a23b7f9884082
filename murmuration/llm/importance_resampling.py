"""Importance resampling towards a target distribution by hashed word n-grams.

Documents become a sparse matrix of documents by buckets, kept as Parquet in blocks of compressed sparse rows. Its
column sums and those of the target give each bucket a gain, the logarithm of how much likelier the target has it; the
product of the matrix with the gains, by document, gives weights; and the documents with the highest weights plus
Gumbel noise, which is a draw without replacement, are the sample.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import dense_index
from .common import Scratch, materialise, released, table
from .terms import TERM, sliced

BUCKETS, GRAMS, SEED, LEAST_WORDS, PERCENT = 10_000, 1, 2024, 20, 10

#: Bytes of text that are cut into words at once; entries of a block of rows, where one row has no more; bytes of a Parquet
#: row group of blocks; blocks that a task works on at once. Spark's reader holds up to 4,096 rows of a group at once, so
#: large blocks in large groups would be a whole file in memory.
TEXT, ENTRIES, GROUP, STEP = 1 << 20, 8192, 1 << 21, 32


def _features(words: pa.LargeStringArray, of: np.ndarray, grams: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every run of 1 to grams words; each distinct run is hashed once, on top of the shorter run's hash."""
    coded = words.dictionary_encode()
    kinds, at = [w.encode() for w in coded.dictionary.to_pylist()], np.asarray(coded.indices).astype(np.int64)
    crc = np.array([zlib.crc32(w) for w in kinds], np.int64)
    run, texts, found = at, [of], [crc[at] % buckets if len(kinds) else at]
    for n in range(2, grams + 1):
        same = of[n - 1 :] == of[: len(of) - n + 1]
        # Each run of n words is a run of n - 1 words, by its number, and a word.
        key = (run[: len(at) - n + 1] * max(1, len(kinds)) + at[n - 1 :])[same]
        pairs, number = np.unique(key, return_inverse=True)
        crc = np.array([zlib.crc32(b" " + kinds[p % len(kinds)], int(crc[p // len(kinds)])) for p in pairs.tolist()], np.int64)
        texts.append(of[n - 1 :][same])
        found.append(crc[number] % buckets if len(pairs) else number)
        run = np.zeros(max(0, len(at) - n + 1), np.int64)
        run[same] = number
    return np.concatenate(texts), np.concatenate(found)


def blocks(docs: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, grams: int = GRAMS) -> DataFrame:
    """(ids, words, indptr, buckets, counts): a block of rows of the matrix. Row k of a block is that of ids[k], which has words[k] words; its entries are those from indptr[k] to indptr[k + 1]. A block has ENTRIES entries at most, or one row."""
    kind, names = docs.schema[id_col].dataType.simpleString(), ["ids", "words", "indptr", "buckets", "counts"]
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)

    def run(batches):
        for batch in batches:
            for first, last, words, of in sliced(batch.column(1), TERM, TEXT):
                n = last - first
                text, bucket = _features(words, of, grams, buckets)
                key, count = np.unique(text * buckets + bucket, return_counts=True)
                upto, sizes = np.searchsorted(key, np.arange(n + 1) * buckets), np.bincount(of, minlength=n)
                a = 0
                while a < n:
                    b = max(a + 1, int(np.searchsorted(upto, upto[a] + ENTRIES, "right")) - 1)
                    some = slice(upto[a], upto[b])
                    parts = batch.column(0)[first + a : first + b], pa.array(sizes[a:b], pa.int64()), pa.array(upto[a : b + 1] - upto[a], pa.int64()), pa.array(key[some] % buckets, pa.int32()), pa.array(count[some], pa.int32())
                    yield pa.RecordBatch.from_arrays([one(x) for x in parts], names)
                    a = b

    return docs.select(id_col, text_col).mapInArrow(released(run), f"ids array<{kind}>, words array<long>, indptr array<long>, buckets array<int>, counts array<int>")


def column_sums(matrix: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket. Each task adds up its blocks; a row a bucket comes back."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, STEP):
                bucket, count = (np.asarray(x[k : k + STEP].flatten()) for x in batch.columns)
                total += np.bincount(bucket, count, buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in matrix.select("buckets", "counts").mapInArrow(released(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's share of the target over its share of the raw data, each count raised by one."""
    s, t, k = float(raw.sum()), float(target.sum()), len(raw)
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """(_id, _words, n_features, weight): the matrix times the gains, over each document's number of features, rounded down; 0 for a document without any."""
    kind, names = matrix.schema["ids"].dataType.elementType.simpleString(), ["_id", "_words", "n_features", "weight"]

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, STEP):
                ids, words, indptr, bucket, count = (x[k : k + STEP] for x in batch.columns)
                # The rows' ends among the entries of all blocks here. Differences of running sums: empty rows have 0.
                begins = np.append(0, np.cumsum([len(x) for x in count])[:-1])
                at, count = [np.asarray(x.values) + a for x, a in zip(indptr, begins.tolist(), strict=True)], np.asarray(count.flatten()).astype(np.int64)
                upto = np.append(0, np.cumsum(count * gain[np.asarray(bucket.flatten())]))
                size = np.append(0, np.cumsum(count))
                n, total = (np.concatenate([np.diff(x[i]) for i in at]) for x in (size, upto))
                yield pa.RecordBatch.from_arrays([ids.flatten(), words.flatten(), pa.array(n, pa.int64()), pa.array(total // np.maximum(n, 1), pa.int64())], names)

    return matrix.mapInArrow(released(run), f"_id {kind}, _words long, n_features long, weight long")


def noise(id_col: str, seed: int):
    """floor(-1000 * ln(-ln(u))) with u from the first 32 bits of sha256("seed:id"); a null id is empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text", buckets: int = BUCKETS, grams: int = GRAMS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """A row per row of docs: id, n_features, weight, score, and rank from 1 of those drawn, null for the others.

    Of the documents with least_words words, percent hundredths, rounded down, are drawn: those with the highest scores,
    ties by id (null ids last), then by place. Repeated rows count as so many documents, with one score. A null or
    empty text has no features and weight 0. A text is one row of the matrix, however long. An empty target leaves the raw
    distribution against an even one; an empty table of documents gives an empty result. Only the named columns are
    read, so others may have any name. Ranks come from sorted ranges with offsets, so no task sorts all documents.
    """
    with Scratch() as scratch:
        matrix = scratch.keep(blocks(docs, id_col, text_col, buckets, grams), "resampling-matrix", **{"parquet.block.size": GROUP})
        gain = gains(column_sums(matrix, buckets), column_sums(blocks(target, target_id, target_text, buckets, grams), buckets))
        # Stored, since numbering reads them twice.
        weighed = scratch.keep(weights(matrix, gain), "resampling-weights")
        scratch.drop(matrix)
        scored = weighed.withColumn("score", (F.col("weight") + noise("_id", seed)).cast("long"))
        # Short documents follow all others, so one order numbers both.
        scored = scored.withColumn("_short", F.col("_words") < least_words).withColumn("_down", -F.col("score")).withColumn("_place", F.monotonically_increasing_id())
        placed = dense_index(scored.withColumn("_none", F.col("_id").isNull()), ["_short", "_down", "_none", "_id", "_place"], "_index", scratch)
        drawn = placed.filter(~F.col("_short")).count() * percent // 100
        out = placed.select(F.col("_id").alias(id_col), "n_features", "weight", "score", F.when(F.col("_index") < drawn, F.col("_index") + 1).cast("long").alias("rank"))
        return materialise(out, "resampled")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and score towards the benchmark, and the rank of those drawn."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# crc32 is a fold over the bytes of a word with the table of its polynomial, which the query makes first.
SQL = rf"""
WITH RECURSIVE bits AS (
  SELECT i AS byte, i AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT byte, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crcs AS (SELECT list(v ORDER BY byte) AS crcs FROM bits WHERE k = 8),
dw AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents),
tw AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
kinds AS (SELECT word, regexp_extract_all(hex(encode(word)), '..') AS hexes FROM (SELECT word FROM dw UNION SELECT word FROM tw)),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(hexes, lambda x: ('0x' || x)::BIGINT)), lambda a, b: xor(a >> 8, crcs[(xor(a, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM kinds, crcs),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM tw JOIN hashed USING (word) GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM tw) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)),
sums AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM dw JOIN hashed USING (word) JOIN g USING (bucket) GROUP BY doc_id),
w AS (
  SELECT d.doc_id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
         ('0x' || substr(sha256('{SEED}:' || CAST(d.doc_id AS VARCHAR)), 1, 8))::BIGINT AS h
  FROM documents d LEFT JOIN sums USING (doc_id)),
sc AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY n >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place FROM sc)
SELECT doc_id, n AS n_features, weight, score, CASE WHEN n >= {LEAST_WORDS} AND place <= (SELECT count(*) FROM sc WHERE n >= {LEAST_WORDS}) * {PERCENT} // 100 THEN place END AS rank FROM r
"""
