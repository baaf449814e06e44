"""CLI: executed-plan shape of every registered query (markdown table).

python tests/plan_shapes.py [sf_dir]
Counts, per query, every hash and range exchange, single-partition and
broadcast exchanges, sort-merge joins and parquet scans.
"""

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillbook.registry import QUERIES  # noqa: E402
from tillbook.session import local_session  # noqa: E402


def shape(df):
    df.collect()  # explain() below then shows this execution's final plan
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    text = buf.getvalue().split("== Initial Plan ==")[0]
    shuffles = re.findall(r"Exchange (?:hashpartitioning|rangepartitioning)\((\w+)", text)
    single = len(re.findall(r"Exchange SinglePartition", text))
    return {
        "shuffles": len(shuffles),
        "single": single,
        "broadcasts": len(re.findall(r"BroadcastExchange", text)),
        "smj": len(re.findall(r"SortMergeJoin", text)),
        "scans": len(re.findall(r"FileScan parquet", text)),
        "reused": len(re.findall(r"ReusedExchange", text)),
    }


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    print("| query | key shuffles | single-partition | broadcasts | sort-merge joins | scans | reused |")
    print("|---|---|---|---|---|---|---|")
    for name, fn in QUERIES.items():
        s = shape(fn(spark, sf_dir))
        print(f"| `{name}` | {s['shuffles']} | {s['single']} | {s['broadcasts']} | {s['smj']} | {s['scans']} | {s['reused']} |")


if __name__ == "__main__":
    main()
