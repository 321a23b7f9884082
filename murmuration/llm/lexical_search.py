"""Ranked lexical search by sort-based accumulation.

Texts are cut into terms once; what is kept of a document are its length and its postings: the terms that a query has,
with their counts. Postings are range-partitioned by document, so all impacts of an item on a document lie in one task.
A task goes through its documents in order of id, a run at a time: the (item, document, impact) arrays of all matches
are concatenated, their packed keys radix sorted, and equal keys summed by reduceat. Of each item's sums those above the
worst of its best so far enter a heap, and the heaps of all ranges meet in a last ranking of at most k rows a range and item.

A score is a sum of w * (10^9 * tf div (1000 * tf + k1 * m)) in integers, with w = floor(1000 * ln((2N + 2) / (2df + 1)))
and m = 100 - b + b * n * N div L (k1 in tenths, b in percent).
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, materialise, partitions, table
from .terms import TERM, lists, sliced

#: Pairs of an item and a term of the items that are searched for together (more items go in blocks); matches that are sorted at once; results of an item.
PAIRS, MATCHES, BEST = 1 << 20, 1 << 21, 10
K1, B = 8, 90
_MOST = (1 << 63) - 1


def radix_order(key: np.ndarray) -> np.ndarray:
    """The stable order of integers that are not negative, by 16 bits at a time from the lowest (numpy sorts 16-bit integers by radix)."""
    order, shift, top = np.arange(len(key)), 0, int(key.max()) if len(key) else 0
    while top >> shift:
        digit = (key[order] >> shift & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
        shift += 16
    return order


def summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, the sum of each one's values)."""
    order = radix_order(key)
    key = key[order]
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[heads], np.add.reduceat(value[order], heads) if len(heads) else np.zeros(0, np.int64)


class Heaps:
    """The k best sums of each item, of documents that come in order of preference among equals."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps, self.floor, self.seen = k, [[] for _ in range(items)], np.zeros(items, np.int64), 0

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray, ids: list) -> None:
        """Sums in order of (item, doc); ids: the documents' own."""
        above = score > self.floor[item]
        item, doc, score = item[above], doc[above], score[above]
        # Of these no item has more than its k best; the order is stable, so earlier documents win among equals.
        order = np.lexsort((-score, item))
        item, doc, score = item[order], doc[order], score[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        for i, d, s in zip(*(x[place < self.k].tolist() for x in (item, doc, score)), strict=True):
            heap, entry = self.heaps[i], (s, -(self.seen + d), ids[d])
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry[:2] > heap[0][:2]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.floor[i] = heap[0][0]
        self.seen += len(ids)

    def rows(self) -> list[tuple]:
        return [(i, d, s) for i, heap in enumerate(self.heaps) for s, _, d in heap]


class Query:
    """A block of items: `words` in order, and for the k-th word the places in `numbers` of the items that have it, from first[k] to first[k + 1]."""

    def __init__(self, rows: list[tuple[int, list[str]]]):
        pairs = sorted((t, k) for k, (_, terms) in enumerate(rows) for t in terms)
        self.numbers = [n for n, _ in rows]
        self.words = sorted({t for t, _ in pairs})
        self.items = np.array([k for _, k in pairs], np.int64)
        at = {t: k for k, t in enumerate(self.words)}
        self.first = np.concatenate([[0], np.cumsum(np.bincount([at[t] for t, _ in pairs], minlength=len(at)))]).astype(np.int64)


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(_number, _item, _terms): each item's distinct terms. A null text has none."""
    kind = items.schema[item_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for first, last, words, of in sliced(batch.column(2), TERM):
                coded = words.dictionary_encode()
                size = max(1, len(coded.dictionary))
                key = np.unique(of * size + np.asarray(coded.indices))
                terms = lists(key % size, key // size, last - first, pa.int32())
                found = pa.ListArray.from_arrays(terms.offsets, coded.dictionary.take(terms.values).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], batch.column(1)[first:last], found], ["_number", "_item", "_terms"])

    return items.select(F.monotonically_increasing_id().alias("_number"), F.col(item_col).alias("_item"), F.col(text_col).alias("_text")).mapInArrow(run, f"_number long, _item {kind}, _terms array<string>")


def postings(docs: DataFrame, id_col: str, text_col: str, words: list[str]) -> DataFrame:
    """(_id, _n, _terms, _tf) of each document: its length in terms, and of the words (by place) that it has the count."""
    kind, names = docs.schema[id_col].dataType.simpleString(), ["_id", "_n", "_terms", "_tf"]
    known, size = pa.array(words, pa.large_string()), max(1, len(words))

    def run(batches):
        for batch in batches:
            for first, last, found, of in sliced(batch.column(1), TERM):
                n, at = last - first, np.asarray(pc.index_in(found, value_set=known).fill_null(-1)).astype(np.int64)
                key, tf = np.unique(of[at >= 0] * size + at[at >= 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array(np.bincount(of, minlength=n), pa.int64()), lists(key % size, key // size, n, pa.int32()), lists(tf, key // size, n, pa.int64())], names)

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, _n long, _terms array<int>, _tf array<long>")


def document_frequencies(kept: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each word. Each task counts its own; a row a word comes back."""

    def run(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(np.asarray(batch.column(0).flatten()), minlength=size)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(df[term], pa.int64())], ["term", "n"])

    out = np.zeros(size, np.int64)
    for r in kept.select("_terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def impacts(n: np.ndarray, tf: np.ndarray, weight: np.ndarray, docs: int, tokens: int, k1: int, b: int) -> np.ndarray:
    """What a word of a weight adds to the score of a document of n terms that has it tf times."""
    scaled = n * b
    if len(n) and int(scaled.max()) * docs > _MOST:  # beyond 64 bits
        share = np.array([int(x) * docs // tokens for x in scaled.tolist()], np.int64)
    else:
        share = scaled * docs // tokens
    return weight * (1_000_000_000 * tf // (1000 * tf + k1 * (100 - b + share)))


def _block(docs: DataFrame, query: Query, k: int, id_col: str, text_col: str, k1: int, b: int, scratch: Scratch) -> DataFrame:
    """(_number, _id, _score): the k best of each range of documents for each item of a block."""
    kind = docs.schema[id_col].dataType.simpleString()
    kept = scratch.keep(postings(docs, id_col, text_col, query.words), "search-postings")
    total, tokens = kept.agg(F.count_if(F.col("_n") > 0), F.coalesce(F.sum("_n"), F.lit(0))).first()
    df = document_frequencies(kept, len(query.words)) if query.words else np.zeros(0, np.int64)
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    fan = np.diff(query.first)

    def run(batches):
        heaps, id_type = Heaps(len(query.numbers), k), None
        for batch in batches:
            ids, id_type = batch.column(0).to_pylist(), batch.schema.field(0).type
            term, tf = np.asarray(batch.column(2).flatten()), np.asarray(batch.column(3).flatten())
            size = np.asarray(pc.list_value_length(batch.column(2)))
            of = np.repeat(np.arange(len(ids)), size)
            value = impacts(np.asarray(batch.column(1))[of], tf, weight[term], total, tokens, k1, b)
            of, term, value = of[value > 0], term[value > 0], value[value > 0]
            matches = np.concatenate([[0], np.cumsum(np.bincount(of, fan[term], len(ids)).astype(np.int64))])
            upto = np.searchsorted(of, np.arange(len(ids) + 1))
            first = 0
            while first < len(ids):
                last = max(first + 1, int(np.searchsorted(matches, matches[first] + MATCHES, "right")) - 1)
                some = slice(int(upto[first]), int(upto[last]))
                times, n = fan[term[some]], last - first
                begin = np.cumsum(times) - times
                item = query.items[np.repeat(query.first[term[some]] - begin, times) + np.arange(int(times.sum()))]
                key, score = summed(item * n + np.repeat(of[some] - first, times), np.repeat(value[some], times))
                heaps.add(key // n, key % n, score, ids[first:last])
                first = last
        if id_type is not None:
            found = heaps.rows()
            number, doc, score = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array([query.numbers[i] for i in number], pa.int64()), pa.array(doc, id_type), pa.array(score, pa.int64())], ["_number", "_id", "_score"])

    order = F.asc_nulls_last("_id"), F.col("_place")
    ranged = kept.filter(F.size("_terms") > 0).withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return ranged.select("_id", "_n", "_terms", "_tf").mapInArrow(run, f"_number long, _id {kind}, _score long")


def search(docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k1: int = K1, b: int = B, pairs: int = PAIRS) -> DataFrame:
    """(item, rank from 1, id, score): each item's k best documents with a score above 0, equal scores by id, null ids last.

    Counts are those of all documents with a term. Items and documents are rows: one that is repeated counts, and is
    ranked, as often as it is there. A null, empty or wordless text matches nothing, and an item without any match
    has no rows; so has every item of an empty table of documents. Texts are taken whole, however long. Only the
    named columns are read, so others may have any name. The items' terms go to all tasks, so items go in blocks of `pairs`
    pairs of an item and a term at most, each a pass over the documents; an item that has more alone is a block.
    """
    with Scratch() as scratch:
        asked = scratch.keep(item_terms(items, item_col, item_text_col), "search-items")
        every = asked.agg(F.coalesce(F.sum(F.size("_terms").cast("long")), F.lit(0))).first()[0]
        if every <= pairs:
            blocks = [asked.orderBy("_number").collect()]
        else:
            # About half full, so that chance does not overfill one by much; each row is read when its block is due.
            count = -(-2 * every // pairs)
            block = F.pmod(F.xxhash64("_number"), F.lit(count))
            blocks = (asked.filter(block == x).orderBy("_number").collect() for x in range(count))
        out = None
        for rows in blocks:
            query = Query([(r["_number"], r["_terms"]) for r in rows if r["_terms"]])
            found = scratch.keep(_block(docs, query, k, id_col, text_col, k1, b, scratch), "search-best")
            out = found if out is None else out.unionByName(found)
        best = Window.partitionBy("_number").orderBy(F.desc("_score"), F.asc_nulls_last("_id"))
        ranked = out.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k)
        named = ranked.join(asked.select("_number", "_item"), "_number").select(F.col("_item").alias(item_col), F.col("_rank").alias("rank"), F.col("_id").alias(id_col), F.col("_score").alias("score"))
        return materialise(named, "search-results")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of all for each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = rf"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS N_docs, CAST(sum(n) AS BIGINT) AS L FROM n),
q AS (SELECT DISTINCT item_id, term FROM (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(N_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, c GROUP BY term),
m AS (SELECT doc_id, {100 - B} + ({B} * n * N_docs) // L AS m FROM n, c),
s AS (
  SELECT q.item_id, tf.doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + {K1} * m.m))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m ON m.doc_id = tf.doc_id GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {BEST}
"""
