"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import Scratch
from ..operators.scratch import keep as materialise

__all__ = ["WHITE", "Scratch", "bloom_blocks", "bloom_hit", "bytes_of", "free_name", "id_hash", "materialise", "partitions", "released", "split_by_bloom", "table", "texts_of"]

#: The white space of the contracts: space and the code points 9 to 13.
WHITE = "\x20\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, n + 1 offsets) of a string column without a copy; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    if at is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def released(run):
    """run, a function for mapInArrow, after whose last batch the worker gives back to the system what memory it has free. Workers serve later tasks and stages too, and the allocators would keep it."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
                ctypes.CDLL(None).malloc_trim(0)

    return tidy


def texts_of(column: pa.Array):
    """The strings of a column, null as empty, a few hundred at a time."""
    for k in range(0, len(column), 256):
        for x in column[k : k + 256].to_pylist():
            yield "" if x is None else x


def id_hash(column: str = "doc_id"):
    """crc32 of the id as text: the contracts' fold key."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of df has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


#: Keys per block of 256 bits of a Bloom filter, and blocks (of 40 bytes) at most of one that is broadcast.
PER_BLOCK, MOST_BLOCKS = 20, 1 << 19


def _bits(key: Column) -> list[Column]:
    """One bit for each of a block's four words, from independent parts of a second hash."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(4)]


def bloom_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(_block, _w0.._w3): the filter's blocks that hold a bit. Partial aggregation combines them before the shuffle."""
    return keys.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("_block"), *(b.alias(f"_b{k}") for k, b in enumerate(_bits(F.col(key))))).groupBy("_block").agg(*(F.bit_or(f"_b{k}").alias(f"_w{k}") for k in range(4)))


def bloom_hit(key: Column) -> Column:
    """Whether the block that a row was joined with may hold the key."""
    hit = F.lit(True)
    for k, b in enumerate(_bits(key)):
        hit = hit & (F.coalesce(F.col(f"_w{k}"), F.lit(0)).bitwiseAND(b) != 0)
    return hit


def split_by_bloom(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of df whose key may be one of keys, rows whose key is none): what an exact join need not move.

    keys: one stored column, counted first. The filter has MOST_BLOCKS blocks at most; with more keys than those hold
    more rows may be among them, and no row is lost. A null key is a key like others.
    """
    name = keys.columns[0]
    blocks = max(1, min(MOST_BLOCKS, -(-keys.count() // PER_BLOCK)))
    filt = F.broadcast(bloom_blocks(keys, name, blocks))
    names = [f"`{c}`" for c in df.columns]
    probed = df.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks))).join(filt, "_block", "left")
    return probed.filter(bloom_hit(F.col(key))).select(*names), probed.filter(~bloom_hit(F.col(key))).select(*names)
