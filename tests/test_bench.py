"""bench.py prints exactly one JSON line with the fields the driver reads."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path


def test_bench_prints_one_json_line():
    root = Path(__file__).resolve().parents[1]
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_RUNS="1", BENCH_CPUS="4")
    out = subprocess.run(
        [sys.executable, "bench.py"], cwd=root, env=env, capture_output=True, text=True, timeout=900
    )
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(d)
    assert d["unit"] == "sec" and d["sf"] == 0.001 and len(d["queries"]) == 17
    assert abs(d["value"] - sum(d["queries"].values())) < 0.01
