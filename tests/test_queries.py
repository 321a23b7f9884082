"""Every registered query of the engine's own operators against its SQL, and invariants of the others."""

import glob
import os

import duckdb
import pytest

from murmuration.operators import community
from murmuration.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}/*.parquet'" if os.path.isdir(f) else f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(values, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple("None" if v is None else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v) for v in (r[k] for k in order)) for r in values))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    wanted = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows([tuple(r) for r in found.collect()], found.columns) == rows(wanted.fetchall(), columns)


def test_viterbi_segments_of_every_utterance(spark):
    got = {r["filename"]: r["codes"] for r in registry.QUERIES["segment_viterbi"](spark, SF).collect()}
    zero = {str(r["utterance"]): r["n"] for r in registry.QUERIES["segment_gamma0"](spark, SF).groupBy("utterance").count().withColumnRenamed("count", "n").collect()}
    assert got.keys() == zero.keys()
    assert all(1 <= len(codes) <= zero[name] for name, codes in got.items())


def test_leiden_is_connected_and_no_worse_than_trivial(spark):
    nodes = {r["node_id"] for r in registry.QUERIES["dense_nodes"](spark, SF).limit(0).collect()} | {r["node_id"] for r in registry.QUERIES["leiden_singletons"](spark, SF).collect()}
    edges = [(r["src"], r["dst"], r["weight"]) for r in registry.QUERIES["threshold_graph_edges"](spark, SF).collect()]
    part = {r["node_id"]: r["cluster"] for r in registry.QUERIES["leiden_cpm"](spark, SF).collect()}
    assert part.keys() == nodes
    n = len(nodes)
    labels = [part[k] for k in range(n)]
    components = {r["node_id"]: r["component"] for r in registry.QUERIES["connected_components"](spark, SF).collect()}
    best = community.quality(n, edges, labels, 0.1)
    assert best >= community.quality(n, edges, list(range(n)), 0.1)
    assert best >= community.quality(n, edges, [components[k] for k in range(n)], 0.1) - 1e-9
    for c in set(labels):
        inside = {k for k in range(n) if labels[k] == c}
        seen, todo = {c}, [c]
        while todo:
            v = todo.pop()
            for a, b, _ in edges:
                for x, y in ((a, b), (b, a)):
                    if x == v and y in inside and y not in seen:
                        seen.add(y)
                        todo.append(y)
        assert seen == inside


def test_kmeans_counts_all_frames(spark):
    assert sum(r["frames"] for r in registry.QUERIES["kmeans_codebook"](spark, SF).collect()) == spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_minibatch_codebook_is_near_full_passes(spark, duck):
    """SQL finds the same frames and inertia from the centres, and the sum is within a hundredth of that of full passes."""
    got = registry.QUERIES["minibatch_codebook"](spark, SF).collect()
    duck.execute("CREATE OR REPLACE TABLE centres (code INT, vec DOUBLE[])")
    duck.executemany("INSERT INTO centres VALUES (?, ?)", [(r["code"], list(r["centre"])) for r in got])
    sql = "SELECT code, count(*), sum(d * d) FROM (SELECT arg_min(code, (d, code)) AS code, min(d) AS d FROM (SELECT e.vec_id, c.code, list_distance(e.embedding::DOUBLE[], c.vec) AS d FROM embeddings e, {0} c) GROUP BY vec_id) GROUP BY code"
    want = {c: (n, s) for c, n, s in duck.execute(sql.format("centres")).fetchall()}
    assert {r["code"]: r["frames"] for r in got} == {c: n for c, (n, _) in want.items()}
    assert all(r["inertia"] == pytest.approx(want[r["code"]][1]) for r in got)
    full = registry.segment.kmeans_codebook(registry.b.frames(spark, SF), 10).collect()
    duck.execute("CREATE OR REPLACE TABLE full_centres (code INT, vec DOUBLE[])")
    duck.executemany("INSERT INTO full_centres VALUES (?, ?)", [(r["code"], [float(x) for x in r["vec"]]) for r in full])
    assert sum(r["inertia"] for r in got) <= 1.01 * sum(s for _, _, s in duck.execute(sql.format("full_centres")).fetchall())


def test_adaptive_resolution_searches_in_full(spark, monkeypatch):
    """The query takes as many steps as the operator and the original workflow, 50."""
    seen = {}

    def noted(edges, nodes, target, rules=None, **named):
        seen["steps"] = (rules or community.Rules()).most_steps
        return 0.0, nodes, []

    monkeypatch.setattr(registry.community, "adaptive_resolution", noted)
    registry.QUERIES["adaptive_resolution"](spark, SF)
    assert seen["steps"] == community.Rules().most_steps == 50


def test_adaptive_resolution_covers_all_nodes(spark):
    got = registry.QUERIES["adaptive_resolution"](spark, SF)
    assert got.count() == registry.QUERIES["leiden_singletons"](spark, SF).count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
