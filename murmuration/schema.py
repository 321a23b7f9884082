"""Relations of the engine; every reader states its schema."""

from __future__ import annotations

from pyspark.sql import types as T


_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "float": T.FloatType()}


def _kind(name: str) -> T.DataType:
    return T.ArrayType(_kind(name[6:-1])) if name.startswith("array<") else _KINDS[name]


def _s(text: str) -> T.StructType:
    """A schema from `name type, ...`; needs no session."""
    return T.StructType([T.StructField(n, _kind(t)) for n, t in (x.split() for x in text.split(", "))])


TEXTGRID = _s("filename string, tier string, idx int, xmin double, xmax double, text string")
ALIGNMENT = _s("word_id int, filename string, word_start double, word_end double, text string, phones string")
FRAMES = _s("filename string, t int, vec array<float>")
CODEBOOK = _s("code int, vec array<float>")
CODES = _s("filename string, word_id int, codes array<int>")
NODES = _s("node_id bigint, filename string, word_id int")
DISTANCES = _s("i bigint, j bigint, ned float")
VERTICES = _s("id bigint, name string, filename string")
EDGES = _s("src bigint, dst bigint, weight float")
PARTITION = _s("cluster_id int, filename string, onset double, offset double")
TRANSCRIPTION = _s("cluster_id int, filename string, begin double, end double, phones array<string>, word string")
SEGMENTS = _s("filename string, word_id int, speaker string, text string, word_start double, word_end double, phones string")
PAIRS = _s("file1 string, speaker1 string, text1 string, start1 double, end1 double, phones1 string, file2 string, speaker2 string, text2 string, start2 double, end2 double, phones2 string, label int, pair_type string")
ROC = _s("threshold double, fpr double, tpr double")
