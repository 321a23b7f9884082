"""Annotation and frame files as Spark data sources: spark.read.format("textgrid") and spark.read.format("npy").

After register(spark) a folder or file is read by name, in partitions of whole files planned by size. Options: `path`;
`mode`, as Spark's own readers have it: `permissive` (the default: a file that can't be read is a row with its error in
`_corrupt` and nothing else but its name), `dropmalformed` (it has no row) or `failfast` (it is an error);
`partitionBytes`, the bytes of a partition; `pathGlobFilter`, a pattern that file names match.

Files are listed and opened by pyarrow's file systems, so paths are local, shared, s3, gs or hdfs. read_textgrids() and
read_npy() of the module `files` read what only Spark reaches.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .files import load_npy, parse_textgrid, stem, text_of

PARTITION_BYTES = 32 << 20
MODES = ("permissive", "dropmalformed", "failfast")
#: Rows of a batch of frames.
BATCH = 4096


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class FileReader(DataSourceReader):
    """Whole files of a folder; a format says what a file's bytes become."""

    def __init__(self, source: FormatSource, schema: StructType):
        options = {k.lower(): v for k, v in source.options.items()}
        self.uri, self.mode = options.get("path", ""), options.get("mode", "permissive").lower()
        if not self.uri:
            raise ValueError("no path")
        if self.mode not in MODES:
            raise ValueError(f"mode {self.mode}; there are {', '.join(MODES)}")
        self.bytes, self.pattern = int(options.get("partitionbytes", PARTITION_BYTES)), options.get("pathglobfilter", source.pattern)
        self.batches, self.schema = source.batches, schema

    def _system(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.uri) if "://" in self.uri or self.uri.startswith("file:") else (pafs.LocalFileSystem(), self.uri)

    def partitions(self) -> list[Files]:
        system, path = self._system()
        one = system.get_file_info(path)
        if one.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.uri)
        every = [one] if one.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(path, recursive=True))
        found = sorted((f.path, f.size or 0) for f in every if f.type == pafs.FileType.File and (fnmatch.fnmatch(f.base_name, self.pattern) or f is one))
        out: list[Files] = []
        held = self.bytes
        for name, size in found:
            if held + size > self.bytes:
                out.append(Files([]))
                held = 0
            out[-1].paths.append(name)
            held += size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = self._system()
        for path in partition.paths:
            try:
                with system.open_input_stream(path) as f:
                    found = self.batches(f.read())
            except (ValueError, UnicodeError, OSError, EOFError) as e:
                if self.mode == "failfast":
                    raise ValueError(f"{path}: {e}") from e
                found = [] if self.mode == "dropmalformed" else [{"_corrupt": [str(e) or type(e).__name__]}]
            for columns in found:
                n = len(next(iter(columns.values())))
                columns = {"filename": [stem(path)] * n, **columns}
                yield pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in self.types.items()], list(self.types))

    @property
    def types(self) -> dict[str, pa.DataType]:
        kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<float>": pa.list_(pa.float32())}
        return {f.name: kinds[f.dataType.simpleString()] for f in self.schema.fields}


class FormatSource(DataSource):
    pattern = "*"

    @staticmethod
    def batches(raw: bytes) -> list[dict]:
        """The columns of a file's rows, in batches. Raises ValueError if it is damaged, before any batch is given out."""
        raise NotImplementedError

    def reader(self, schema: StructType) -> DataSourceReader:
        return FileReader(self, schema)


class TextGridSource(FormatSource):
    """(filename, tier, idx, xmin, xmax, text, _corrupt): the intervals of TextGrid files."""

    pattern = "*.TextGrid"

    @classmethod
    def name(cls) -> str:
        return "textgrid"

    def schema(self) -> str:
        return "filename string, tier string, idx int, xmin double, xmax double, text string, _corrupt string"

    @staticmethod
    def batches(raw: bytes) -> list[dict]:
        rows = parse_textgrid(text_of(raw))
        return [dict(zip(("tier", "idx", "xmin", "xmax", "text"), map(list, zip(*rows, strict=True)), strict=True))] if rows else []


class NpySource(FormatSource):
    """(filename, t, vec, _corrupt): the rows of .npy matrices."""

    pattern = "*.npy"

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "filename string, t int, vec array<float>, _corrupt string"

    @staticmethod
    def batches(raw: bytes) -> list[dict]:
        x = load_npy(raw)
        return [{"t": np.arange(k, min(k + BATCH, len(x)), dtype=np.int32), "vec": list(x[k : k + BATCH])} for k in range(0, len(x), BATCH)]


def register(spark: SparkSession) -> None:
    for source in (TextGridSource, NpySource):
        spark.dataSource.register(source)
