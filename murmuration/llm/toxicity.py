"""Toxicity by compression distance: short windows of a text are compressed with a zstandard dictionary of ordinary text and with one of toxic text, and the bytes saved by the second are compared with calibrated thresholds.

zstandard trains both dictionaries: one on ordinary texts, the other on the segments that mark toxic texts off from
ordinary ones (what is frequent in whole toxic texts is ordinary wording as well). The toxic compressor also has the
ordinary dictionary, nearest to the window, so both compress ordinary wording alike and the difference is due to toxic wording.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_hash, released, table, texts_of
from .training import fold_of, labelled_sample

#: The training sample: so many documents of a label at most, and of a longer document a window of so many characters.
SAMPLE, SAMPLE_CHARS = {1: 2400, 0: 6000}, 20_000
#: Bytes of a window (it ends before a space if it can; under 64 bytes zstandard stores literals as they are, so each match saves whole bytes), of a segment's grams, of the two dictionaries.
WINDOW, LONGEST, GRAM, ORDINARY_BYTES, TOXIC_BYTES = 28, 44, 5, 4096, 2048
#: The trainer's segment length and gram length.
TRAINER = {"k": 50, "d": 8, "steps": 0}
#: A gram marks toxic text if this share of the toxic training documents has it, so many times the share of the ordinary ones.
SHARE, RATIO = 0.015, 20
CUT, MOST_WRONG = 0.7, 0.01
#: Bytes of ordinary text before each window. They are a match in either dictionary, so a window is never stored as it is for want of other matches.
PRIME = 48
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")


def plain(text: str) -> bytes:
    """A text in lower-case ASCII letters and with spaces for all white space, one in front."""
    return b" " + text.encode().translate(_LOWER)


def windows(raw: bytes) -> list[bytes]:
    """The whole text in windows of WINDOW to LONGEST bytes (the last may be shorter), in time linear in its length."""
    out, at = [], 0
    while at < len(raw):
        end = raw.find(b" ", at + WINDOW, at + LONGEST)
        end = min(at + LONGEST, len(raw)) if end < 0 else end
        out.append(raw[at:end])
        at = end
    return out


class Model:
    """Two dictionaries and the calibration; plain bytes and numbers, so it is shipped with the code that uses it."""

    def __init__(self, ordinary: bytes, toxic: bytes, weights=(0.0, 0.0, 0.0, 0.0), shift: float = -10.0):
        self.ordinary, self.toxic, self.weights, self.shift = ordinary, toxic, tuple(weights), shift
        self._pair = None

    def __getstate__(self):
        return self.__dict__ | {"_pair": None}

    def pair(self):
        if self._pair is None:
            p = zstandard.ZstdCompressionParameters.from_level(6, write_content_size=False, write_checksum=False, write_dict_id=False, min_match=5, window_log=17, hash_log=17)
            out = []
            for data in (self.ordinary, self.toxic + self.ordinary):
                d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=p)
                out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress)
            self._pair = out
        return self._pair

    def features(self, text: str) -> tuple[float, float, float, float]:
        """(largest saving of a window, savings of 2 bytes and more in all, windows with such savings, log of the number of windows)."""
        a, b = self.pair()
        prime = self.ordinary[-PRIME:]
        saved = [x for w in windows(plain(text)) if (x := len(a(prime + w)) - len(b(prime + w))) > 0]
        big = [x for x in saved if x >= 2]
        return float(min(max(saved, default=0), 12)), float(np.log1p(sum(big))), float(np.log1p(len(big))), float(np.log1p(len(text) / WINDOW))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.features(text), self.weights) + self.shift, -30, 30))))


def _grams(raw: bytes) -> set[bytes]:
    words = [b" " + w for w in raw.split()]
    return {w[k : k + GRAM] for w in words for k in range(len(w) - GRAM + 1)}


def _segments(raw: bytes, marks: set[bytes]):
    """The runs of marking grams in a text's words. Each gram within a run marks, so ordinary text doesn't match a part of it."""
    for word in raw.split():
        w = b" " + word
        hits = [k for k in range(len(w) - GRAM + 1) if w[k : k + GRAM] in marks]
        while hits:
            start = end = hits[0]
            while hits and hits[0] <= end + 1:
                end = hits.pop(0)
            yield w[start : end + GRAM]


def _dictionary(size: int, samples: list[bytes], **parameters) -> bytes:
    """A dictionary that zstandard trains; of samples that are too few for its trainer, their last bytes."""
    try:
        return zstandard.train_dictionary(size, samples, **parameters).as_bytes()
    except (zstandard.ZstdError, MemoryError, ValueError):
        return b"\n".join(samples)[-size:]


def fit(sample: list[tuple[str, int]]) -> Model:
    """A model of labelled texts. Near copies among them count once. Half of them make the dictionaries, the other half calibrates. Without texts of both labels the model scores everything near 0."""
    halves: list[list[tuple[bytes, int]]] = [[], []]
    seen = set()
    for text, y in sample:
        raw = plain(text)
        some = tuple(sorted({zlib.crc32(w) for w in raw.split()})[:3])
        if (some, y) not in seen:
            seen.add((some, y))
            halves[zlib.crc32(repr(some).encode()) % 2].append((raw, y))
    by = {y: [raw for raw, x in halves[0] if x == y] for y in (0, 1)}
    if not by[0] or not by[1]:
        return Model(b"", b"")
    n1, n0 = len(by[1]), len(by[0])
    often = Counter(g for raw in by[1] for g in _grams(raw))
    often = {g: c for g, c in often.items() if c >= max(3, SHARE * n1)}
    plainly = Counter(g for raw in by[0] for g in _grams(raw) if g in often)
    marks = {g for g, c in often.items() if c / n1 >= RATIO * (plainly[g] + 0.5) / n0}
    del often, plainly
    toxic = _dictionary(TOXIC_BYTES, [x for raw in by[1] if len(x := b"\n".join(_segments(raw, marks))) >= TRAINER["d"]], **TRAINER)
    ordinary = _dictionary(ORDINARY_BYTES, by[0])
    model = Model(ordinary, toxic)
    held = halves[1] or halves[0]
    x = np.array([model.features(raw[1:].decode()) for raw, _ in held])
    y = np.array([v for _, v in held], float)
    w = np.zeros(x.shape[1] + 1)
    z = np.c_[x, np.ones(len(x))]
    for _ in range(60):  # Newton's method, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.3 * np.eye(len(w)), z.T @ (p - y) + 0.3 * w)
    margin = z @ w
    cuts = np.unique(margin)
    cuts = np.r_[(cuts[1:] + cuts[:-1]) / 2, cuts[-1:] + 1e-9]
    tp = np.array([(y[margin >= c]).sum() for c in cuts])
    every = np.array([(margin >= c).sum() for c in cuts])
    # The best cut leaves all but MOST_WRONG of the ordinary texts alone; if none finds anything, nothing is toxic.
    f1 = np.where(every - tp <= MOST_WRONG * (y == 0).sum(), 2 * tp / (every + y.sum() + 1e-9), 0)
    cut = cuts[int(np.argmax(f1))] if f1.max() > 0 else cuts[-1] + 2
    model.weights, model.shift = tuple(w[:-1]), float(w[-1] - cut + np.log(CUT / (1 - CUT)))
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of the labels that may be learned from (crc32 of the id modulo 3 is not 1)."""
    sample, _ = labelled_sample(docs, labels, "toxic", fold_of(3, 1), SAMPLE, SAMPLE_CHARS, id_col, text_col)
    return fit(sample)


def scored(docs: DataFrame, model: Model, text_col: str = "text", out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """A row per row of docs: its columns, score (0 to 1) and predicted (1 if score >= 0.7), from the whole text alone.

    A null text counts as empty; equal texts have equal scores, so ties and repeated rows are judged alike. Time is
    linear in the text's length. An empty table gives an empty result. A column of docs that is called as one of out
    is a clash, which is an error: choose other names.
    """
    if clash := {c.lower() for c in docs.columns} & {c.lower() for c in out}:
        raise ValueError(f"columns {sorted(clash)} are there already")
    names = docs.columns
    docs = docs.select(*(f"`{c}`" for c in names))
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            score = [model.score(x) for x in texts_of(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array([int(s >= CUT) for s in score], pa.int32())], [*names, *out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(released(run), f"{kinds}, `{out[0]}` double, `{out[1]}` int")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, by a model of the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", (id_hash() % 3 == 1).alias("held_out"), "text"), model).drop("text")
