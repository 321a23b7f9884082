"""Readers and writers of the engine's file formats."""

from __future__ import annotations

import io
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.scalars import draw_key, two_places
from ..operators.ordered import forward_fill


def stem(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])


#: A quoted string, a flag, or a number that is not an index in brackets or part of a name.
_ITEM = re.compile(r'"((?:[^"]|"")*)"|(<[a-z]+>)|(?<![\w\[.])(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)(?![\w\]])')


def parse_textgrid(text: str) -> list[tuple[str, int, float, float, str]]:
    """(tier, idx from 0, xmin, xmax, text) of the interval tiers of a TextGrid, in the long or the short form. Raises ValueError if it is none.

    Both forms hold the same quoted strings, flags and numbers in the same order; the long form has names around them.
    """
    items: list = []
    for m in _ITEM.finditer(text):
        items.append(m[1].replace('""', '"') if m[1] is not None else m[2] if m[2] else float(m[3]))
    if items[:2] != ["ooTextFile", "TextGrid"]:
        raise ValueError("not a TextGrid")
    at, out = 2, []
    try:
        at += 2  # the grid's own span
        if items[at] != "<exists>":
            return []
        tiers, at = int(items[at + 1]), at + 2
        for _ in range(tiers):
            kind, name, n = items[at], items[at + 1], int(items[at + 4])
            at += 5
            for k in range(n):
                if kind == "IntervalTier":
                    a, b, label = items[at : at + 3]
                    out.append((name, k, float(a), float(b), str(label)))
                    at += 3
                else:
                    at += 2
    except (IndexError, TypeError, ValueError) as e:
        raise ValueError("damaged TextGrid") from e
    return out


def read_textgrids(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(intervals, damaged): the interval tiers of all *.TextGrid files below a folder, and (filename, error) of files that can't be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.TextGrid").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    found = parse_textgrid(text_of(bytes(content)))
                    rows += [(stem(p), *x, None) for x in found]
                except (ValueError, UnicodeError) as e:
                    rows.append((stem(p), None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["filename", "tier", "idx", "xmin", "xmax", "text", "error"]).astype({"idx": "Int32"})

    every = files.mapInPandas(run, "filename string, tier string, idx int, xmin double, xmax double, text string, error string")
    return every.filter("error is null").drop("error"), every.filter("error is not null").select("filename", "error")


def text_of(raw: bytes) -> str:
    return raw.decode("utf-16" if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig")


def words_of(intervals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, phones) of the files that have both tiers: words as (filename, word_id from 1, word_start, word_end, text)."""
    tiers = intervals.filter(F.col("tier").isin("words", "phones")).groupBy("filename").agg(F.count_distinct("tier").alias("_n")).filter("_n = 2").select("filename")
    good = intervals.join(tiers, "filename", "left_semi")
    words = good.filter("tier = 'words'").select("filename", (F.col("idx") + 1).alias("word_id"), F.col("xmin").alias("word_start"), F.col("xmax").alias("word_end"), F.trim("text").alias("text"))
    return words, good.filter("tier = 'phones'").select("filename", "idx", "xmin", "xmax", "text")


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """An alignment table from CSV with a header, by name. Only empty fields are null: words like `null` stay words. A leading index column is left out."""
    raw = spark.read.option("header", True).option("nullValue", "").option("escape", '"').csv(path)
    names = {c for c in raw.columns}
    missing = {f.name for f in S.ALIGNMENT} - names
    if missing:
        raise ValueError(f"columns missing: {', '.join(sorted(missing))}")
    return raw.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in S.ALIGNMENT))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def load_npy(raw: bytes) -> np.ndarray:
    """A file's matrix, a frame a row; one of one dimension has a value a row. Raises ValueError if it is damaged."""
    x = np.load(io.BytesIO(raw), allow_pickle=False)
    return (x.reshape(len(x), -1) if x.ndim else x.reshape(1, 1)).astype(np.float32)


def _frames(spark: SparkSession, path: str, pattern: str, matrix) -> DataFrame:
    """(filename, t, vec, error) of the files below a folder, by matrix(bytes). A file for which that raises an exception is one row, of its name and the error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    x, error = np.asarray(matrix(bytes(content)), np.float32), None
                    x = x if x.ndim == 2 else x.reshape(len(x), -1)
                except Exception as e:  # noqa: BLE001 - the encoder is the caller's
                    yield pd.DataFrame({"filename": [stem(p)], "t": pd.array([None], "Int32"), "vec": [None], "error": [f"{type(e).__name__}: {e}"]})
                    continue
                yield pd.DataFrame({"filename": stem(p), "t": np.arange(len(x), dtype=np.int32), "vec": list(x), "error": error})

    return files.mapInPandas(run, "filename string, t int, vec array<float>, error string")


def split_damaged(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames, damaged): (filename, t, vec), and (filename, error) of the files that can't be read."""
    return found.filter("error is null").drop("error"), found.filter("error is not null").select("filename", "error")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(filename, t, vec, error) of the .npy files below a folder; see split_damaged(). Spark does not list empty files (the format `npy` does)."""
    return _frames(spark, path, "*.npy", load_npy)


def read_media(spark: SparkSession, path: str, extension: str, encode) -> DataFrame:
    """(filename, t, vec, error) of audio files: encode(bytes) gives a matrix of a frame a row. The encoder (decoding, resampling and a model's layer) is the caller's; it runs file by file on the executors, and a file that it fails on is a row with its error."""
    return _frames(spark, path, f"*{extension}", encode)


def seeded_files(files: DataFrame, n: int, seed: int = 42, key: str = "filename") -> DataFrame:
    """n files, drawn in the order of a hash, or all if there are fewer."""
    return files.orderBy(draw_key(seed, F.col(key))).limit(n)


def missing_rows(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run has still to do."""
    return wanted.join(done.select(*keys), keys, "left_anti")


def partition_lines(partition: DataFrame, order: str = "ord") -> DataFrame:
    """(cluster_id, line_no, line): `Class k`, a line `file onset offset` with two decimals for each fragment in order, and an empty line, for each cluster."""
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(order))
    body = partition.select("cluster_id", place.cast("long").alias("line_no"), F.concat_ws(" ", "filename", two_places(F.col("onset")), two_places(F.col("offset"))).alias("line"))
    ends = partition.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_n"))
    head = ends.select("cluster_id", F.lit(0).cast("long").alias("line_no"), F.concat(F.lit("Class "), F.col("cluster_id").cast("string")).alias("line"))
    tail = ends.select("cluster_id", (F.col("_n") + 1).alias("line_no"), F.lit("").alias("line"))
    return head.unionByName(body).unionByName(tail)


def write_lines(lines: DataFrame, path: str, order: list, whole: int = 1) -> None:
    """Lines as text files, one for each range of the first `whole` columns of order, whose concatenation in order of name is sorted. Lines that are alike in those columns lie in one file."""
    ranges = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(ranges, *order[:whole]).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


def parse_partition(lines: DataFrame, file: str = "file", number: str = "n", line: str = "line") -> DataFrame:
    """(cluster_id, filename, onset, offset) from numbered lines: a line that starts with `Class` names the cluster of the lines after it; other lines count if they have exactly three parts."""
    parts = F.split(F.trim(line), " ")
    marked = lines.withColumn("cluster_id", F.when(F.col(line).startswith("Class"), parts[1].try_cast("int")))
    filled = forward_fill(marked, [file], number, "cluster_id")
    return filled.filter(~F.col(line).startswith("Class") & (F.size(parts) == 3) & F.col("cluster_id").isNotNull()).select("cluster_id", parts[0].alias("filename"), parts[1].try_cast("double").alias("onset"), parts[2].try_cast("double").alias("offset"))


def read_partition(spark: SparkSession, path: str) -> DataFrame:
    """The fragments of partition text files. A file is one reader's state machine, so it is read as one value and cut into numbered lines."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "line"))
    return parse_partition(whole)


