"""op9 learns from every row: no pair is drawn, no threshold comes from a part of the rows."""

import random

import numpy as np
import pyarrow as pa
from murmuration.llm import quality_rank
from murmuration.llm.common import bytes_of
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def rows_of(n, good):
    """Documents of which a word tells the quality, but not for sure; every tenth is of quality 0."""
    rng = random.Random(5)
    for k in range(n):
        y = int(k % 10 > 0)
        yield k, " ".join(rng.choices(WORDS, k=12) + (["rubbish"] if rng.random() < (good if y else 0.6) else [])) + f" {k * 7919 % 10007}", y


def test_threshold_is_the_quantile_of_all_rows(spark):
    df = spark.createDataFrame(list(rows_of(9000, 0.1)), "doc_id long, text string, quality int").repartition(4)
    model = quality_rank.train(df, df.select("doc_id", "quality"))
    learned = df.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    low = quality_rank.ranked(learned, model).agg(F.sum(1 - F.col("predicted")), F.sum(1 - F.col("quality"))).first()
    assert learned.filter("quality = 1").count() > 5016  # more than were taken of a label
    assert low[0] == low[1]


def test_loss_and_slope_are_those_of_all_pairs(spark):
    rows = list(rows_of(300, 0.3))
    x = quality_rank.features(*bytes_of(pa.array([t for _, t, _ in rows])))
    y = np.array([v for *_, v in rows])
    table = spark.createDataFrame([(v, r.tobytes()) for v, r in zip(y.tolist(), x, strict=True)], "y int, x binary").repartition(3)
    model = quality_rank.Ranker(x.mean(0), x.std(0) + np.float32(1e-3), None, 0.0)
    pairs = quality_rank._Pairs(table, model, {v: int((y == v).sum()) for v in (0, 1)})
    w = np.random.default_rng(1).standard_normal(quality_rank.WIDTH) / 30
    z = model.standard(x).astype(float)
    gap = (z[y == 0] @ w)[None, :] - (z[y == 1] @ w)[:, None]
    p = 1 / (1 + np.exp(-gap)) / gap.size
    slope = p.sum(0) @ z[y == 0] - p.sum(1) @ z[y == 1] + quality_rank.RIDGE * w
    assert abs(pairs.loss(w) - np.logaddexp(0, gap).mean() - quality_rank.RIDGE / 2 * w @ w) < 1e-3
    assert np.abs(pairs.slope(w) - slope).max() < 3e-3


def test_all_of_a_long_text_is_learned_from(spark):
    """What tells the quality stands in any of five parts of a long text, the rest of which is the same."""
    rng, plain = random.Random(9), "word " * 9000
    rows = []
    for k in range(120):
        at = rng.randrange(5) * 9000
        rows.append((k, plain[:at] + ("zzqx " * 400 if k % 2 else "bbrt " * 400) + plain[at:], k % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(3)
    model = quality_rank.train(df, df.select("doc_id", "quality"))
    assert all(r["predicted"] == r["quality"] for r in quality_rank.ranked(df, model).select("predicted", "quality").collect())
