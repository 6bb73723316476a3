"""Count plan nodes of every registered query: scans, shuffles, and the nodes to avoid.

usage: python tools/audit.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import collections
import pathlib
import re
import sys

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

NODES = re.compile(
    r"\b(FileScan|Exchange|BroadcastExchange|SortMergeJoin|BroadcastHashJoin|BroadcastNestedLoopJoin|"
    r"CartesianProduct|SortAggregate|ObjectHashAggregate|HashAggregate|Window|WindowGroupLimit|MapInPandas|SinglePartition)\b"
)


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.001")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()

    from quaymark.plans import QUERIES
    from quaymark.session import local_session

    spark = local_session("8")
    for name, q in QUERIES.items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        plan = q.run(spark, args.sf)._jdf.queryExecution().executedPlan().toString()
        seen = collections.Counter(NODES.findall(plan))
        bad = [k for k in ("BroadcastNestedLoopJoin", "CartesianProduct", "SinglePartition", "SortAggregate") if seen[k]]
        print(f"{name:28s} scans {seen['FileScan']:2d} shuffles {seen['Exchange']:2d} {' '.join(f'{k}={seen[k]}' for k in bad)}", flush=True)


if __name__ == "__main__":
    main()
