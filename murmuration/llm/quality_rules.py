"""Quality rules: counts of a document's words, characters and lines, fixed limits on them, and gradient-boosted trees over statistics made of them.

Trees are grown on the driver from a bounded sample of labelled documents: each split is the best of the histograms of
all statistics, leaves are Newton steps of the logistic loss, and on statistics where more is worse a split that would
say otherwise is refused and its value bounds both sides, so the score never rises with them. All trees lie flat in
arrays of nodes, and a batch of documents goes down all of them at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_hash, table
from .terms import WORD, sliced, split
from .training import fold_of, labelled_rows

#: The training sample: so many documents of a label at most; one in CALIBRATE of them sets the cut, which rejects at most this share of the good ones.
SAMPLE, CALIBRATE, MOST_LOST = {1: 4000, 0: 4000}, 4, 0.005
TREES, DEPTH, RATE, BINS, RIDGE, LEAST = 80, 4, 0.2, 64, 1.0, 2.0
#: Rules that hold whatever the model says: a document has so many words, and at most so many hundredths of them in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATISTICS = ("log_words", "word_length", "symbols", "duplicate_lines", "repeated", "commonest", "distinct", "upper", "letters", "digits", "stops", "marks", "line_words", "log_lines")
#: Statistics of which more never raises the score (-1) or never lowers it (1).
MONOTONE = {"symbols": -1, "duplicate_lines": -1, "repeated": -1, "commonest": -1, "marks": -1}
_KIND = np.full(256, 7, np.uint8)  # 0 lower-case letters and first bytes of other characters, 1 A-Z, 2 digits, 3 stops, 4 white space, 5 symbols, 6 further bytes, 7 other marks
for _chars, _k in ((bytes(range(97, 123)) + bytes(range(192, 256)), 0), (bytes(range(65, 91)), 1), (b"0123456789", 2), (b".,;:?'\"-()", 3), (b"\x20\t\n\x0b\x0c\r", 4), (b"#*$%&|<>", 5), (bytes(range(128, 192)), 6)):
    _KIND[list(_chars)] = _k


def _per_text(key: np.ndarray, size: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, distinct values, rows of the commonest value) of each of n texts, from keys text * size + value."""
    value, count = np.unique(key, return_counts=True)
    of, most = value // size, np.zeros(n, np.int64)
    np.maximum.at(most, of, count)
    return np.bincount(of, count, n).astype(np.int64), np.bincount(of, minlength=n), most


def _repeated(word: np.ndarray, of: np.ndarray, size: int, n: int) -> np.ndarray:
    """Words of each text that lie in a window of three that the text has twice or more."""
    inside = np.flatnonzero(of[2:] == of[:-2])
    if not len(inside):
        return np.zeros(n, np.int64)
    pair = word[:-1] * size + word[1:]
    if size >= 1 << 21:  # three words don't fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * size + word[2:]
    order = inside[np.lexsort((key[inside], of[inside]))]
    same = (key[order][1:] == key[order][:-1]) & (of[order][1:] == of[order][:-1])
    again = order[np.r_[same, False] | np.r_[False, same]]
    covered = np.zeros(len(word), bool)
    for k in range(3):
        covered[again + k] = True
    return np.bincount(of[covered], minlength=n)


def statistics(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(COUNTS, STATISTICS) of texts that lie end to end, a row each, from whole texts. A text without words has counts of 0."""
    n = len(offsets) - 1
    kinds = np.bincount(np.repeat(np.arange(n), np.diff(offsets)) * 8 + _KIND[raw], minlength=8 * n).reshape(n, 8)
    words, of = split(raw, offsets, WORD)
    coded = words.dictionary_encode()
    word, size = np.asarray(coded.indices).astype(np.int64), max(1, len(coded.dictionary))
    total, distinct, most = _per_text(of * size + word, size, n)
    repeated = _repeated(word, of, size, n)
    texts = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
    lines = pc.split_pattern(texts, "\n")
    of_line = np.repeat(np.arange(n), np.diff(np.asarray(lines.offsets)))
    full = np.asarray(pc.binary_length(pc.ascii_trim_whitespace(lines.flatten()))) > 0
    line = lines.flatten().dictionary_encode()
    many = max(1, len(line.dictionary))
    some, different, _ = _per_text((of_line * many + np.asarray(line.indices))[full], many, n)
    chars = kinds.sum(1) - kinds[:, 4] - kinds[:, 6]
    counts = np.stack([total, chars, kinds[:, 5], some - different, repeated], 1)
    w, c, f = np.maximum(total, 1), np.maximum(chars, 1), np.maximum(some, 1)
    shares = (np.log1p(total), chars / w, kinds[:, 5] / w, (some - different) / f, repeated / w, most / w, distinct / w, kinds[:, 1] / c, (kinds[:, 0] + kinds[:, 1]) / c, kinds[:, 2] / c, kinds[:, 3] / w, kinds[:, 7] / w, total / f, np.log1p(some))
    return counts, np.stack(shares, 1)


class Trees:
    """Nodes of all trees in arrays. A leaf leads to itself."""

    def __init__(self, depth: int):
        self.depth, self.base = depth, 0.0
        self.roots: list | np.ndarray = []
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []

    def node(self, value: float) -> int:
        k = len(self.value)
        for at, x in ((self.feature, 0), (self.threshold, np.inf), (self.left, k), (self.right, k), (self.value, value)):
            at.append(x)
        return k

    def flat(self) -> Trees:
        for name, kind in (("roots", np.int32), ("feature", np.int32), ("threshold", float), ("left", np.int32), ("right", np.int32), ("value", float)):
            setattr(self, name, np.array(getattr(self, name), kind))
        return self

    def margins(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None], len(x), 0)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def grown(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Trees for labels y (0 or 1) of rows x. signs: of each column 1, -1 or 0, the direction in which the score may go with it."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(width)]
    codes = np.stack([np.searchsorted(e, x[:, j]) + BINS * j for j, e in enumerate(edges)], 1)
    out = Trees(depth)
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    out.base = float(np.log(share / (1 - share)))
    margin = np.full(n, out.base)

    def step(g, h, low, high):
        return np.clip(-g / (h + RIDGE), low, high)

    def gain(g, h, w):
        return -(g * w + (h + RIDGE) / 2 * w * w)

    def grow(rows: np.ndarray, left: int, low: float, high: float) -> int:
        g, h = slope[rows].sum(), bend[rows].sum()
        own = float(step(g, h, low, high))
        k = out.node(own * rate)
        if left and h >= 2 * LEAST:
            at = codes[rows].ravel()
            sums = [np.bincount(at, np.repeat(v[rows], width), BINS * width).reshape(width, BINS).cumsum(1) for v in (slope, bend)]
            (gl, hl), (gr, hr) = sums, (g - sums[0], h - sums[1])
            wl, wr = step(gl, hl, low, high), step(gr, hr, low, high)
            worth = gain(gl, hl, wl) + gain(gr, hr, wr) - gain(g, h, own)
            worth[(hl < LEAST) | (hr < LEAST) | (signs[:, None] * (wr - wl) < 0)] = 0
            j, b = divmod(int(worth.argmax()), BINS)
            if worth[j, b] > 1e-9 and b < len(edges[j]):
                middle = (wl[j, b] + wr[j, b]) / 2
                sides = [[low, high], [low, high]]
                if signs[j]:
                    sides[0 if signs[j] > 0 else 1][1] = middle
                    sides[1 if signs[j] > 0 else 0][0] = middle
                out.feature[k], out.threshold[k] = j, float(edges[j][b])
                low_side = codes[rows, j] - BINS * j <= b
                out.left[k] = grow(rows[low_side], left - 1, *sides[0])
                out.right[k] = grow(rows[~low_side], left - 1, *sides[1])
                return k
        margin[rows] += own * rate
        return k

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, bend = p - y, p * (1 - p)
        out.roots.append(grow(np.arange(n), depth, -np.inf, np.inf))
    return out.flat()


class Model:
    """The trees and the score that a document must have."""

    def __init__(self, trees: Trees | None = None, cut: float = 0.0):
        self.trees, self.cut = trees, cut

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.trees.scores(x) if self.trees else np.ones(len(x))


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Model:
    """A model of rows of statistics and their labels (1 good). Those held are left out of the trees and set the cut. Without both labels everything passes."""
    if len(np.unique(y[~held])) < 2:
        return Model()
    trees = grown(x[~held], y[~held], np.array([MONOTONE.get(s, 0) for s in STATISTICS]))
    good = np.sort(trees.scores(x[held & (y == 1)]))
    return Model(trees, min(0.5, float(good[int(MOST_LOST * len(good))])) if len(good) else 0.0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of the quality labels that may be learned from (crc32 of the id modulo 5 is not 0).

    Statistics of the drawn documents' whole texts are made in tasks, and only they come to the driver: 14 numbers a
    document. One in CALIBRATE of them, by hash of the text, so that copies stay together, sets the cut.
    """
    rows, _ = labelled_rows(docs, labels, "quality", fold_of(5, 0), SAMPLE, 0, id_col, text_col)

    def run(batches):
        for batch in batches:
            for first, last, raw, offsets in sliced(batch.column(1)):
                x = statistics(raw, offsets)[1]
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], batch.column(2)[first:last], pa.array(list(x), pa.list_(pa.float64()))], ["y", "held", "x"])

    found = rows.select("_y", "_text", (F.crc32("_text") % CALIBRATE == 0).alias("held")).mapInArrow(run, "y int, held boolean, x array<double>").collect()
    found.sort(key=lambda r: (r["x"], r["y"]))
    return fit(np.array([r["x"] for r in found], float).reshape(-1, len(STATISTICS)), np.array([r["y"] for r in found], float), np.array([r["held"] for r in found], bool))


def judged(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED) -> DataFrame:
    """A row per row of docs: the columns in keep, COUNTS, base_failed, score (0 to 1, higher is better) and kept.

    All come from the whole text alone, so equal texts, ties and repeated rows are judged alike. A null or empty text has no
    words and fails. Time is that of sorting a text's words, however long it is. An empty table gives an empty result.
    A column in keep that is called as one of the new ones is a clash, which is an error.
    """
    new = {"base_failed", "score", "kept", *COUNTS}
    if clash := {c.lower() for c in keep} & new:
        raise ValueError(f"columns {sorted(clash)} are there already")
    rows = docs.select(*(f"`{c}`" for c in keep), F.col(f"`{text_col}`").alias("_text_"))
    names = [*keep, *COUNTS, "base_failed", "score", "kept"]

    def run(batches):
        for batch in batches:
            for first, last, raw, offsets in sliced(batch.column(len(keep))):
                counts, x = statistics(raw, offsets)
                failed = (counts[:, 0] < least_words) | (100 * counts[:, 4] > most_repeated * counts[:, 0])
                score = model.scores(x)
                own = [batch.column(k)[first:last] for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(counts[:, k], pa.int64()) for k in range(len(COUNTS))), pa.array(failed), pa.array(score), pa.array(~failed & (score >= model.cut))], names)

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kinds}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, score double, kept boolean")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict, by a model of the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return judged(docs.withColumn("held_out", id_hash() % 5 == 0), model, ("doc_id", "held_out"))
