"""Quantising frames: nearest codes, and segmentation by dynamic programming."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import euclidean, frame_index
from .ordered import runs
from .scratch import path_exists

#: A codebook of more cells is not broadcast.
BROADCAST_CODES = 100_000


def nearest_code(frames: DataFrame, codebook: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """keys with the code of the nearest codebook vector; ties go to the lowest code.

    The codebook (code, vec) has a few hundred rows; it is folded into one row, whose size is checked, and the minimum
    is taken within each frame's row, so no pair of frame and code is ever a row.
    """
    book = [(r["code"], [float(x) for x in r["vec"]]) for r in _book(codebook)]
    table = codebook.sparkSession.createDataFrame([(book,)], "book array<struct<code:int,vec:array<double>>>")
    one = frames.select(*keys, F.col(vec).alias("_v"), F.lit(1).alias("_one")).join(F.broadcast(table.withColumn("_one", F.lit(1))), "_one")
    best = F.array_min(F.transform("book", lambda b: F.struct(euclidean(F.col("_v"), b["vec"]).alias("d"), b["code"].alias("code"))))
    return one.select(*keys, best["code"].alias("code"))


def collapse(codes: DataFrame, utterance: str, order: str) -> DataFrame:
    """Segments of a stay bonus of 0: runs of equal nearest codes. (utterance, run, code, first, size)."""
    return runs(codes, [utterance], order, "code")


def viterbi(d: np.ndarray, gamma: float) -> list[int]:
    """Codes of the segments of T frames with distances d[T, K] that minimise the sum of distances less gamma for each frame but a segment's first.

    The best way to end at a frame with each code either goes on with the code, for a bonus of gamma, or begins a
    segment after the best way of all. Of equal ways the one whose last segment began earlier counts, then the lowest code.
    """
    t, k = d.shape
    if not t:
        return []
    cost, start = d[0].astype(float).copy(), np.zeros(k, int)
    best, pick = np.zeros(t + 1), np.zeros((t + 1, 2), int)

    def close(i: int) -> None:
        low = cost.min()
        ties = np.flatnonzero(cost == low)
        c = ties[np.lexsort((ties, start[ties]))[0]]
        best[i + 1] = low
        pick[i + 1] = start[c], c

    close(0)
    for i in range(1, t):
        stay, fresh = cost - gamma, best[i]
        go = stay <= fresh
        cost = np.where(go, stay, fresh) + d[i]
        start = np.where(go, start, i)
        close(i)
    out, at = [], t
    while at:
        at, c = pick[at]
        out.append(int(c))
    return out[::-1]


def single_precision(d: np.ndarray, gamma: float) -> list[int]:
    """The segments that a search in single precision finds: sums of a segment are rounded after each frame's distance and after each bonus, so its ties and runs are not those of viterbi().

    For each frame the sums of all segments that end there are one array, by start and code, made from those of the
    frame before; time grows with the square of the frames, memory with frames times codes.
    """
    d = d.astype(np.float32)
    t, k = d.shape
    sums, best, pick = np.empty((t, k), np.float32), np.zeros(t + 1, np.float32), np.zeros((t + 1, 2), int)
    for i in range(t):
        sums[:i] = (sums[:i] + d[i]).astype(float) - gamma
        sums[i] = d[i]
        codes = sums[: i + 1].argmin(1)
        ways = best[: i + 1] + sums[np.arange(i + 1), codes]
        first = int(ways.argmin())  # of equal ways the earliest start
        best[i + 1], pick[i + 1] = ways[first], (first, codes[first])
    out, at = [], t
    while at:
        at, c = pick[at]
        out.append(int(c))
    return out[::-1]


#: Numbers of a block of frames by codes by dimensions.
CELLS = 1 << 22


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The distance of each frame to each centre, a block of frames at a time."""
    out, step = np.empty((len(x), len(centres))), max(1, CELLS // max(1, centres.size))
    for k in range(0, len(x), step):
        out[k : k + step] = np.sqrt(((x[k : k + step, None, :] - centres[None]) ** 2).sum(-1))
    return out


def _book(codebook: DataFrame) -> list:
    """The codes in order, with their vectors; their number is checked first."""
    size = codebook.count()
    if size > BROADCAST_CODES:
        raise ValueError(f"{size} codes; at most {BROADCAST_CODES} fit")
    return codebook.orderBy("code").select("code", F.col("vec").cast("array<double>").alias("vec")).collect()


def segment(words: DataFrame, codebook: DataFrame, gamma: float, keys: list[str], frames: str = "frames", compat: bool = False) -> DataFrame:
    """keys with `codes`, the segment codes of each row's frames (array of vectors, in order). No frames give no codes. The codebook's vectors travel with the function; code k is the k-th in order of code. compat: sums in single precision, as the original workflow has them."""
    book = _book(codebook)
    names, centres = [r["code"] for r in book], np.array([r["vec"] for r in book], float)
    kinds = ", ".join(f"`{c}` {words.schema[c].dataType.simpleString()}" for c in keys)
    search = single_precision if compat else viterbi

    def run(batches):
        for batch in batches:
            out = []
            for f in batch.column(len(keys)).to_pylist():
                x = np.array(f or [], float).reshape(-1, centres.shape[1])
                out.append([names[c] for c in search(distances(x, centres), gamma)])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), pa.array(out, pa.list_(pa.int32()))], [*keys, "codes"])

    return words.select(*keys, F.col(frames).cast("array<array<double>>").alias("_f")).mapInArrow(run, f"{kinds}, codes array<int>")


def word_frames(frames: DataFrame, alignment: DataFrame) -> DataFrame:
    """(filename, word_id, frames): the frames t of each word, from start to end index exclusive. Words without frames have an empty list; files without words go.

    frames is the long table (filename, t, vec): a frame joins the words of its file that hold it.
    """
    words = alignment.select("filename", "word_id", frame_index(F.col("word_start")).alias("_a"), frame_index(F.col("word_end")).alias("_b"))
    inside = words.join(frames, "filename", "left")
    held = F.when((F.col("t") >= F.col("_a")) & (F.col("t") < F.col("_b")), F.struct("t", "vec"))
    return inside.groupBy("filename", "word_id").agg(F.transform(F.array_sort(F.collect_list(held)), lambda x: x["vec"]).alias("frames"))


def thin(frames: DataFrame, most: int = 1000, every: int = 3) -> DataFrame:
    """Every third frame of files with more than `most` frames, all of the others: what a codebook is trained on."""
    sizes = frames.groupBy("filename").agg(F.count(F.lit(1)).alias("_n"))
    return frames.join(sizes, "filename").filter((F.col("_n") <= most) | (F.col("t") % every == 0)).drop("_n")


def kmeans_codebook(frames: DataFrame, k: int, seed: int = 0, vec: str = "vec") -> DataFrame:
    """(code, vec): centres of k-means over the frames in full passes, initialised in parallel with a fixed seed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = frames.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features")).persist(StorageLevel.DISK_ONLY)
    try:
        model = KMeans(k=k, seed=seed, maxIter=20).fit(points)
    finally:
        points.unpersist()
    return frames.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "code int, vec array<float>")


#: Draws of a batch's first frames from which the centres of a mini-batch search are spread.
START_ROWS = 50


class MiniBatchKMeans:
    """Centres that move by batches: a batch's frames go to their nearest centres, and each centre moves to the mean of all frames that it has been given so far.

    A batch is a part of the frames by hash. Its tasks add up frames and counts by centre, so k rows a task are shuffled
    and k come to the driver; a centre's rate is the batch's count over its count so far. The state, centres with
    their counts, is a small table, so a search that was stopped goes on after the last batch that it wrote.
    """

    def __init__(self, k: int, batches: int = 10, epochs: int = 3, seed: int = 0, vec: str = "vec"):
        self.k, self.batches, self.epochs, self.seed, self.vec = k, batches, epochs, seed, vec

    def _start(self, frames: DataFrame) -> np.ndarray:
        """k of the frames, each the farthest of a few drawn in turn from those before (a greedy spread over a draw of START_ROWS * k frames at most)."""
        draw = F.xxhash64(F.lit(self.seed), *(c for c in frames.columns))
        rows = frames.select(F.col(self.vec).cast("array<double>").alias("_v"), draw.alias("_h")).orderBy("_h", "_v").limit(START_ROWS * self.k).collect()
        x = np.array([r["_v"] for r in rows], float)
        if not len(x):
            return x.reshape(0, 0)
        rng = np.random.default_rng(self.seed)
        out, near = [x[0]], ((x - x[0]) ** 2).sum(1)
        while len(out) < min(self.k, len(np.unique(x, axis=0))):
            some = rng.choice(len(x), 8, p=near / near.sum())
            # Of a few drawn by squared distance the one that leaves the least.
            gaps = [np.minimum(near, ((x - x[c]) ** 2).sum(1)) for c in some]
            best = int(np.argmin([g.sum() for g in gaps]))
            out.append(x[some[best]])
            near = gaps[best]
        return np.array(out)

    def batch(self, frames: DataFrame, number: int) -> DataFrame:
        return frames.filter(F.pmod(F.xxhash64(F.lit(self.seed + 1), *(c for c in frames.columns)), F.lit(self.batches)) == number)

    def sums(self, frames: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(sum of the frames of each centre, their number, sum of squared distances)."""
        width = centres.shape[1]

        def run(batches):
            total, count, inertia = np.zeros_like(centres), np.zeros(len(centres), np.int64), np.zeros(len(centres))
            for b in batches:
                x = np.asarray(b.column(0).flatten()).reshape(-1, width)
                for part in np.array_split(x, max(1, len(x) // 4096)):
                    at, gap = nearest(part, centres)
                    np.add.at(total, at, part)
                    count += np.bincount(at, minlength=len(count))
                    inertia += np.bincount(at, gap, len(count))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(list(total[some]), pa.list_(pa.float64())), pa.array(count[some]), pa.array(inertia[some])], ["code", "total", "n", "inertia"])

        found = frames.select(F.col(self.vec).cast("array<double>").alias("_v")).filter("_v is not null").mapInArrow(run, "code int, total array<double>, n long, inertia double")
        parts = [F.sum(F.get("total", F.lit(j))).alias(f"t{j}") for j in range(width)]
        total, count, inertia = np.zeros_like(centres), np.zeros(len(centres), np.int64), 0.0
        for r in found.groupBy("code").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), *parts).collect():
            total[r["code"]], count[r["code"]], inertia = [r[f"t{j}"] for j in range(width)], r["n"], inertia + r["inertia"]
        return total, count, inertia

    def fit(self, frames: DataFrame, state_path: str = "") -> DataFrame:
        """(code, vec, frames): the centres after all batches of all epochs, with how many frames each was given in the last. With state_path each batch's state is written there, and those that are there are not computed again. No frames give no centres."""
        spark, schema = frames.sparkSession, "code int, vec array<double>, n long, frames long"
        done = spark.read.schema("step int, " + schema).option("recursiveFileLookup", False).parquet(state_path) if state_path and path_exists(spark, state_path) else None
        first = 0
        last = done.agg(F.max("step")).first()[0] if done is not None else None
        if last is None:
            centres, count, given = self._start(frames), None, None
        else:
            rows = done.filter(F.col("step") == last).orderBy("code").collect()
            centres, count, given, first = np.array([r["vec"] for r in rows], float), np.array([r["n"] for r in rows]), np.array([r["frames"] for r in rows]), last + 1
        count = np.zeros(len(centres), np.int64) if count is None else count
        given = np.zeros(len(centres), np.int64) if given is None else given
        for step in range(first, self.epochs * self.batches if len(centres) else 0):
            if step % self.batches == 0:
                # What an epoch's frames weigh is a tenth in the next, so late centres can still move.
                count, given = count // 10, np.zeros(len(centres), np.int64)
            total, n, _ = self.sums(self.batch(frames, step % self.batches), centres)
            count, given = count + n, given + n
            rate = np.where(count > 0, 1 / np.maximum(count, 1), 0)[:, None]
            centres = centres + rate * (total - n[:, None] * centres)
            if state_path:
                state = [(i, [float(v) for v in c], int(count[i]), int(given[i])) for i, c in enumerate(centres)]
                spark.createDataFrame(state, schema).coalesce(1).write.mode("overwrite").parquet(f"{state_path}/step={step}")
        return spark.createDataFrame([(i, [float(v) for v in c], int(given[i])) for i, c in enumerate(centres)], "code int, vec array<double>, frames long")


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the nearest centre of each row, its squared distance); the square is expanded, so there is no array of rows by centres by dimensions."""
    d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
    at = d.argmin(1)
    return at, ((x - centres[at]) ** 2).sum(1)
