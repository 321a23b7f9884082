"""Memory of the driver: mixing is no single large plan, and what the JVM has freed goes back to the system."""

import re
import sys
from pathlib import Path

import pytest
from murmuration.llm import common, mixing, pipeline
from murmuration.operators import scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture
def planned(monkeypatch):
    """Exchanges of every query that is written, by its tag."""
    seen: dict[str, int] = {}
    keep = scratch.keep

    def exchanges(df):
        return len(re.findall(r"(?<!Reused)Exchange ", df._jdf.queryExecution().executedPlan().toString()))

    def counted(df, tag):
        seen[tag] = max(seen.get(tag, 0), exchanges(df))
        return keep(df, tag)

    monkeypatch.setattr(scratch, "keep", counted)
    for module in (mixing, pipeline):
        monkeypatch.setattr(module, "materialise", counted)
    return seen, exchanges


def test_mixing_is_planned_in_parts(spark, planned):
    seen, exchanges = planned
    docs = common.table(spark, SF, "documents")
    assert exchanges(mixing.mix(docs)) <= 8
    assert exchanges(pipeline.mixed(spark, docs, SF)) <= 2
    assert max(seen.values()) <= 10, seen


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="glibc")
def test_what_the_drivers_jvm_has_freed_goes_back(spark):
    jvm = spark.sparkContext._jvm
    at = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")
    held = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", at.read_text())[1]) / 1024
    made = [jvm.java.util.zip.Deflater() for _ in range(800)]  # some 200 kB each from the C allocator
    for x in made[::2] + made[1:-1:2]:
        x.end()  # the last one stays, behind what is free
    full = held()
    scratch.sweep(spark)
    assert full - held() > 60
    made[-1].end()
