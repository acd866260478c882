"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the
threads. Every query runs once to warm the JVM up on the smallest tables, then once timed
into the no-op sink, planning included.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "entry_history_on_scale", "i01_validity_gate", "i05_mattr", "h05_i07_lexicon_rates", "i26_wide_table", "i03_pace",
    "k06_permutation_test", "k09_scale", "k10_cell_cuts", "k14_correlation_matrix",
    "k15_c06_panel_placement", "k17_gold_rows", "l01_diet_rows", "l04_channel_concentration", "n07_bursts",
    "m02_quote_anchoring", "m06_f11_control_cascade", "m11_d04_retention", "a16_e03_upsert_rows",
    "a20_coalesce_merge", "b03_work_queue", "d02_stratum_state", "e05_m12_even_picks", "f06_stratified_draw",
    "j01_j10_e08_signals",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from contentgauge.session import local_session

    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    from contentgauge.plans.catalog import QUERIES

    small = str(Path(folder).parent / "sf0.001")
    warm = small if Path(small).is_dir() else folder
    chosen = [n for n in HEADLINE if not sys.argv[1:] or n in sys.argv[1:]]
    took: dict[str, float] = {}
    for name in chosen:
        for where in (warm, folder):
            start = time.perf_counter()
            QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total wall clock", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
