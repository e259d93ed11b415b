"""Time every registered query once (warm session) at a scale factor; print a
markdown table of wall seconds and output rows."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from intentloom.registry import QUERIES, load_all
    from intentloom.session import get_spark
    load_all()
    spark = get_spark("local[8]", 16, extra={"spark.driver.memory": "16g"})
    QUERIES["a1_distinct_labels"](spark, sf).count()
    print("| query | sec | rows |\n|---|---|---|")
    for name in sorted(QUERIES):
        t0 = time.perf_counter()
        n = QUERIES[name](spark, sf).count()
        print(f"| {name} | {time.perf_counter() - t0:.2f} | {n} |", flush=True)


if __name__ == "__main__":
    main()
