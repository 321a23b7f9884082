"""Quality by Bradley-Terry ranking: document scores are learned from preference pairs by logistic loss on feature differences, and a quantile of the scores is the threshold.

The pairs are all pairs of a learnable document of quality 1 and one of quality 0; none is drawn. The features are general: a few shares and counts of a text, and the frequencies of its words and of its runs of three
bytes, each hashed to a fixed number of places.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import running_sums
from .common import Scratch, bytes_of, id_hash, split_by_bloom, table
from .shingles import word_hashes
from .training import fold_of

#: In training, scores are told apart by STEP within FAR; rounds at most, and the part of the loss by which a round must lower it for another to follow.
STEP, FAR, ROUNDS, SETTLED = 1 / 64, 64, 40, 1e-3
CUT, RIDGE = 0.3, 1e-3
SHARES = ("repeats", "distinct", "letters", "upper", "digits", "stops", "marks", "word_bytes", "log_words", "distinct_lines", "log_lines")
#: Places of hashed words and of hashed runs of three bytes; texts and bytes whose features are made at once.
PLACES, TEXTS, BYTES = 512, 1024, 1 << 22
WIDTH = len(SHARES) + 2 * PLACES
_KIND = np.full(256, 6, np.uint8)  # 0 letters, 1 upper case, 2 digits, 3 stops, 4 white space, 5 line ends, 6 other marks
for _chars, _k in ((b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)), 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b".,;:?'\"-()", 3), (b" \t\x0b\x0c\r", 4), (b"\n", 5)):
    _KIND[list(_chars)] = _k
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The features of texts, given as their bytes end to end, a row each; an empty text has those of no words."""
    out = np.zeros((len(offsets) - 1, WIDTH), np.float32)
    first = 0
    while first < len(out):
        last = min(first + TEXTS, max(first + 1, int(np.searchsorted(offsets, offsets[first] + BYTES, "right")) - 1))
        out[first:last] = _features(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last
    return out


def _features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n, size = len(offsets) - 1, np.diff(offsets)
    of = np.repeat(np.arange(n), size)
    kinds = np.bincount(of * 7 + _KIND[raw], minlength=7 * n).reshape(n, 7)
    words, at = word_hashes(raw, offsets)
    count = np.diff(at)
    of_word = np.repeat(np.arange(n), count)
    again = (words[1:] == words[:-1]) & (of_word[1:] == of_word[:-1])
    order = np.lexsort((words, of_word))
    w, o = words[order], of_word[order]
    new = np.r_[True, (w[1:] != w[:-1]) | (o[1:] != o[:-1])] if len(w) else np.zeros(0, bool)
    lines = [raw[a:b].tobytes().split(b"\n") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    some, c = np.maximum(count, 1), np.maximum(size, 1)
    length = np.array([len(x) for x in lines])
    shares = [
        np.bincount(of_word[1:][again], minlength=n) / some,
        np.bincount(o[new], minlength=n) / some,
        (kinds[:, 0] + kinds[:, 1]) / c,
        kinds[:, 1] / c,
        kinds[:, 2] / c,
        kinds[:, 3] / some,
        kinds[:, 6] / some,
        (c - kinds[:, 4] - kinds[:, 5]) / some,
        np.log1p(count),
        np.array([len(set(x)) for x in lines]) / length,
        np.log1p(length),
    ]
    word = np.bincount(of_word * PLACES + (words % np.uint64(PLACES)).astype(np.int64), minlength=n * PLACES).reshape(n, PLACES) / some[:, None]
    x = _LOWER[raw]
    if len(x) > 2:
        run = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - PLACES.bit_length() + 1)
        inside = of[:-2] == of[2:]
        runs = np.bincount(of[:-2][inside] * PLACES + run[inside].astype(np.int64), minlength=n * PLACES).reshape(n, PLACES) / c[:, None]
    else:
        runs = np.zeros((n, PLACES))
    return np.concatenate([np.stack(shares, axis=1), np.sqrt(word), np.sqrt(runs)], axis=1)


class Ranker:
    """A linear score, and the shift that puts its threshold at CUT."""

    def __init__(self, mean, scale, weights, threshold: float):
        self.mean, self.scale, self.weights, self.threshold = mean, scale, weights, threshold

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weights

    def places(self, x: np.ndarray) -> np.ndarray:
        """Scores as multiples of STEP."""
        return np.rint(np.clip(self.raw(x), -FAR, FAR) / STEP).astype(np.int32)

    def scores(self, column: pa.Array) -> np.ndarray:
        """A score for each text of a column, null as empty."""
        raw, offsets = bytes_of(column)
        out, first = np.zeros(len(offsets) - 1), 0
        while first < len(out):
            last = min(first + TEXTS, len(out))
            out[first:last] = self.raw(features(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]))
            first = last
        return 1 / (1 + np.exp(-np.clip(out - self.threshold + np.log(CUT / (1 - CUT)), -30, 30)))


def _slices(batches):
    """(labels, features) of rows (y, x), some at a time."""
    for batch in batches:
        y, x = batch.column(0).to_numpy(), bytes_of(batch.column(1))[0].view(np.float32).reshape(-1, WIDTH)
        for k in range(0, len(y), TEXTS):
            yield y[k : k + TEXTS], x[k : k + TEXTS]


def _summed(rows: DataFrame, totals) -> list[np.ndarray]:
    """Sums over all tasks of what each finds for every feature. The tasks' parts are put in order first, so the sum is the same on every run."""

    def run(batches):
        parts = totals(batches)
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(WIDTH, dtype=np.int32), len(parts))), pa.array(np.repeat(np.arange(len(parts), dtype=np.int32), WIDTH)), pa.array(np.concatenate(parts))], ["place", "kind", "part"])

    found = rows.mapInArrow(run, "place int, kind int, part double").groupBy("kind", "place").agg(F.aggregate(F.array_sort(F.collect_list("part")), F.lit(0.0), lambda x, y: x + y).alias("sum"))
    got = sorted(tuple(r) for r in found.collect())  # a row a feature and kind
    return list(np.array([x for _, _, x in got]).reshape(-1, WIDTH))


class _Pairs:
    """The logistic loss of the score differences of all pairs of a row of quality 1 and one of quality 0, and its slope.

    What a row adds depends on its own score and on how often the other label has which scores. So a pass counts the
    scores, to a multiple of STEP, and a second adds up features by what is lost at their row's score: every pair is
    in it, and no pair is made.
    """

    def __init__(self, rows: DataFrame, model: Ranker, counts: dict[int, int]):
        self.rows, self.model, self.counts = rows, model, counts

    def loss(self, w: np.ndarray) -> float:
        model = self.model = Ranker(self.model.mean, self.model.scale, w.astype(np.float32), 0.0)

        def run(batches):
            held = Counter()
            for y, x in _slices(batches):
                kinds, n = np.unique(np.stack([y, model.places(x)], axis=1), axis=0, return_counts=True)
                held.update(dict(zip(map(tuple, kinds.tolist()), n.tolist(), strict=True)))
            cols = [[y for y, _ in held], [s for _, s in held], list(held.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64()), strict=True)], ["y", "s", "n"])

        # Places lie within FAR, so their number is bounded.
        found = self.rows.mapInArrow(run, "y int, s int, n long").groupBy("y", "s").agg(F.sum("n").alias("n")).collect()
        self.low, high = min(r["s"] for r in found), max(r["s"] for r in found)
        share = np.zeros((2, high - self.low + 1))
        for r in found:
            share[r["y"], r["s"] - self.low] = r["n"] / self.counts[r["y"]]
        gap = np.arange(self.low - high, high - self.low + 1) * STEP  # the score of quality 0 less that of quality 1
        p = 1 / (1 + np.exp(-gap))
        # By label and place, the mean over the other label's rows.
        self.pull = np.stack([np.convolve(p, share[1], "valid") / self.counts[0], -np.convolve(p[::-1], share[0], "valid") / self.counts[1]])
        return float(share[1] @ np.convolve(np.logaddexp(0, gap)[::-1], share[0], "valid") + RIDGE / 2 * w @ w)

    def slope(self, w: np.ndarray) -> np.ndarray:
        """At w, whose loss was asked for last."""
        low, pull, model = self.low, self.pull, self.model

        def totals(batches):
            total = np.zeros(WIDTH)
            for y, x in _slices(batches):
                total += pull[y, model.places(x) - low] @ model.standard(x)
            return [total]

        return _summed(self.rows, totals)[0] + RIDGE * w


def _least(pairs: _Pairs) -> np.ndarray:
    """The weights of least loss, by L-BFGS."""
    w = np.zeros(WIDTH)
    at, g, past = pairs.loss(w), pairs.slope(w), []
    for _ in range(ROUNDS):
        d, back = g.copy(), []
        for s, y in reversed(past):
            back.append((s @ d) / (s @ y))
            d -= back[-1] * y
        d *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(np.linalg.norm(g), 1e-12)
        for (s, y), c in zip(past, reversed(back), strict=True):
            d += (c - (y @ d) / (s @ y)) * s
        step = 1.0
        while (after := pairs.loss(w - step * d)) > at - 1e-4 * step * (g @ d) and step > 1e-4:
            step /= 2
        if after >= at:
            break
        v = w - step * d
        h = pairs.slope(v)
        if (v - w) @ (h - g) > 0:
            past = [*past[-9:], (v - w, h - g)]
        settled = at - after < SETTLED * at
        w, at, g = v, after, h
        if settled:
            break
    return w


def fit(rows: DataFrame, scratch: Scratch) -> Ranker:
    """The ranker of stored rows (y, x): weights of least loss over all pairs of a row of quality 1 and one of quality 0; of all rows' scores the quantile at the share of quality 0 is the threshold. Without both labels everything scores above the threshold."""
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(counts) < 2:
        return Ranker(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), -1.0)

    def totals(batches):
        one, two = np.zeros(WIDTH), np.zeros(WIDTH)
        for _, x in _slices(batches):
            x = x.astype(float)
            one += x.sum(0)
            two += (x * x).sum(0)
        return [one, two]

    one, two = (t / sum(counts.values()) for t in _summed(rows, totals))
    flat = Ranker(one.astype(np.float32), (np.sqrt(np.maximum(two - one * one, 0)) + 1e-3).astype(np.float32), None, 0.0)
    model = Ranker(flat.mean, flat.scale, _least(_Pairs(rows, flat, counts)).astype(np.float32), 0.0)

    def scores(batches):
        for _, x in _slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(x).astype(float))], ["s"])

    # Equal scores are one row before they are sorted, however many there are.
    each = rows.mapInArrow(scores, "s double").groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    placed = scratch.keep(running_sums(each, ["s"], ["n"], scratch)[0], "quality-scores")
    last = placed.filter(F.col("n_before") < counts[0]).agg(F.max("s")).first()[0]
    above = placed.filter(F.col("s") > last).agg(F.min("s")).first()[0]
    model.threshold = last if above is None else (last + above) / 2
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Ranker:
    """The ranker of all labels that may be learned from (crc32 of the id modulo 5 is not 0), by the whole texts of their documents. A label that is there twice counts once; rows without a label or an id don't count."""

    def made(batches):
        for batch in batches:
            raw, offsets = bytes_of(batch.column(1))
            for k in range(0, batch.num_rows, TEXTS):
                at = offsets[k : k + TEXTS + 1]
                x = features(raw[at[0] : at[-1]], at - at[0])
                yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + TEXTS], pa.array([r.tobytes() for r in x], pa.binary())], ["y", "x"])

    known = labels.select(F.col(id_col).alias("_id"), F.col("quality").cast("int").alias("y")).filter(fold_of(5, 0) & F.col("y").isin(0, 1))
    known = known.select(F.col("_id").cast(docs.schema[id_col].dataType).alias("_id"), "y").filter(F.col("_id").isNotNull()).distinct()
    with Scratch() as scratch:
        known = scratch.keep(known, "quality-labels")
        # Texts that the filter tells to be without a label are not moved.
        texts, _ = split_by_bloom(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", known.select("_id"))
        rows = scratch.keep(texts.join(known, "_id").select("y", "_text").mapInArrow(made, "y int, x binary"), "quality-features")
        return fit(rows, scratch)


def ranked(docs: DataFrame, model: Ranker, text_col: str = "text", out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """A row per row of docs: its columns, score (0 to 1) and predicted (1 if score >= 0.3), from the whole text alone.

    A null text counts as empty; equal texts have equal scores, so ties and repeated rows are judged alike. An empty
    table gives an empty result. A column of docs that is called as one of out is a clash, which is an error: choose
    other names.
    """
    if clash := {c.lower() for c in docs.columns} & {c.lower() for c in out}:
        raise ValueError(f"columns {sorted(clash)} are there already")
    names = docs.columns
    docs = docs.select(*(f"`{c}`" for c in names))
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            score = model.scores(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array((score >= CUT).astype(np.int32), pa.int32())], [*names, *out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, `{out[0]}` double, `{out[1]}` int")


def op9_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, by a model of the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return ranked(docs.select("doc_id", (id_hash() % 5 == 0).alias("held_out"), "text"), model).drop("text")
