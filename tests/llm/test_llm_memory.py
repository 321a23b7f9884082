"""Workers give memory back between tasks."""

import re
import sys
from pathlib import Path

import numpy as np
import pytest
from murmuration.llm import common


def held():
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="glibc")
def test_what_a_task_has_freed_goes_back():
    kept = []

    def run(batches):
        for _ in batches:
            some = [np.ones(8000) for _ in range(3000)]  # 190 MB in blocks that the allocator keeps
            kept.append(np.ones(8000))  # lies behind them
            del some
            yield held()

    plain = list(run([None]))[0]
    assert plain - held() < 60  # without it they stay
    out = list(common.released(run)([None, None]))
    assert len(out) == 2 and out[-1] - held() > 100
