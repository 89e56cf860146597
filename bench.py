"""Benchmark: every registered analysis on the stand-in views.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (timed runs per query, default 5). All queries run once
untimed, then ``BENCH_RUNS`` timed passes over all of them; each time spans
building the plan to ``collect()``, and the per-query median is reported. ``value`` is the sum over the 17 reference result sets; the
roll-ups are reported separately. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ledgerlens.plans.catalog import QUERIES, standin_query  # noqa: E402
from ledgerlens.session import local_session  # noqa: E402

REFERENCE_SETS = [n for n in QUERIES if not n.startswith("d")]

BASELINE_SF01 = {
    "chk_offline_nonstore": 0.89,
    "chk_online_store": 0.59,
    "q1_quarterly_growth": 1.58,
    "q2_territory_rank": 0.86,
    "q3_channel_share": 1.20,
    "q4_top5_customers": 1.35,
    "q5_top10_profit": 2.00,
    "q6a_vendor_reject": 3.85,
    "q6b_vendor_product_reject": 3.96,
    "q7_high_revenue_loss": 3.76,
    "q8_line_margin_by_quarter": 2.77,
    "scrap_reasons": 0.41,
    "kpi1_quarterly_margin": 2.12,
    "kpi2_aov_by_channel": 0.81,
    "kpi3_loss_product_rate": 2.06,
    "rfm_customers": 2.03,
    "rfm_segments": 1.81,
}


def _sf(sf_dir: str) -> float | str:
    tail = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    try:
        return float(tail)
    except ValueError:
        return sf_dir


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = local_session(cpus, app="ledgerlens-bench")

    builders = {name: standin_query(name) for name in QUERIES}
    rows: dict[str, int] = {}
    for name, build in builders.items():  # untimed pass: JIT, file listing, metadata
        rows[name] = len(build(spark, sf_dir).collect())
    samples: dict[str, list[float]] = {name: [] for name in builders}
    for _ in range(runs):  # timed passes, queries interleaved
        for name, build in builders.items():
            t0 = time.perf_counter()
            build(spark, sf_dir).collect()
            samples[name].append(time.perf_counter() - t0)
    times = {name: round(statistics.median(s), 4) for name, s in samples.items()}
    spark.stop()

    ref = {n: times[n] for n in REFERENCE_SETS}
    sf = _sf(sf_dir)
    versus = (
        {
            "baseline_sf0.1_sum": round(sum(BASELINE_SF01.values()), 2),
            "speedup_vs_baseline": {n: round(BASELINE_SF01[n] / ref[n], 2) for n in ref if ref[n] > 0},
        }
        if sf == 0.1
        else {}
    )
    print(
        json.dumps(
            {
                "metric": "sum of median query latency, 17 reference result sets",
                "value": round(sum(ref.values()), 3),
                "unit": "sec",
                "queries": ref,
                "rollups": {n: t for n, t in times.items() if n not in ref},
                **versus,
                "rows": rows,
                "sf": sf,
                "cpus": cpus,
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
