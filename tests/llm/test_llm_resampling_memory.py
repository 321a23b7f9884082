"""The stored matrix of importance resampling is in small blocks and row groups, so no task holds a file of it."""

import glob
import random

import numpy as np
import pyarrow.parquet as pq
from murmuration.llm import importance_resampling
from murmuration.operators.scratch import Scratch


def test_blocks_and_row_groups_are_small(spark, monkeypatch):
    rng, files = random.Random(4), []
    words = [f"w{k}" for k in range(30_000)]
    rows = [(k, " ".join(rng.choices(words, k=200))) for k in range(20_000)] + [(k, " ".join(words)) for k in range(20_000, 20_020)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    goal = spark.createDataFrame([(1, " ".join(words[:50]))], "item_id long, text string")
    keep = Scratch.keep

    def kept(self, df, tag, *a, **b):
        out = keep(self, df, tag, *a, **b)
        files.extend((tag, pq.ParquetFile(f).metadata) for f in glob.glob(f"{out._murmuration_path.removeprefix('file://')}/*.parquet"))
        return out

    monkeypatch.setattr(Scratch, "keep", kept)
    got = importance_resampling.resample(docs, goal).toPandas().sort_values("doc_id")
    assert list(got["n_features"]) == [200] * 20_000 + [30_000] * 20
    assert sorted(got["rank"].dropna()) == list(range(1, 2003))
    groups = [m.row_group(k) for tag, m in files if tag == "resampling-matrix" for k in range(m.num_row_groups)]
    entries = [g.column(k).num_values for g in groups for k in range(g.num_columns) if g.column(k).path_in_schema.startswith("buckets")]
    assert sum(entries) > 3_900_000  # nothing is left out
    assert len(entries) >= 3 and max(entries) < 1_500_000

    sizes = np.array([len(b["buckets"]) for b in importance_resampling.blocks(docs.filter("doc_id % 50 = 0 or doc_id >= 20000"), "doc_id", "text").collect()])
    assert len(sizes) > 20 and sizes.max() <= importance_resampling.BUCKETS
