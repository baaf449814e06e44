"""Bench: headline ledger queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is built and fully executed (``noop`` sink: every row computed,
nothing collected) RUNS times after one warm-up pass; the best time counts.
Prints one JSON line: {"metric", "value" (sum of per-query seconds), "unit",
"queries": {name: sec}, "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillbook.registry import QUERIES  # noqa: E402
from tillbook.session import local_session  # noqa: E402

HEADLINE = [
    "sum_doc", "sum_doc_all", "sum_total", "sum_wallet_compat", "sum_requests", "sum_total_requests",
    "exp_index", "exp_index_deep", "exp_index_far", "exp_index_keyset", "inc_index",
    "exp_detail", "exp_latest", "inc_detail",
    "validate_expenses", "validate_transfers",
    "exp_insert", "exp_insert_tags", "transfer_fees",
    "exp_update", "exp_delete_tags",
]


def run(spark, name: str, sf_dir: str) -> float:
    t = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) if cpus.isdigit() else 8), app="tillbook-bench")
    for name in names:  # warm-up: JVM, file listing, dimension size proofs
        run(spark, name, sf_dir)
    best = {name: min(run(spark, name, sf_dir) for _ in range(runs)) for name in names}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "ledger_headline_total_sec",
        "value": round(sum(best.values()), 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in best.items()},
        "sf": float(m.group(1)) if m else sf_dir,
    }))


if __name__ == "__main__":
    main()
