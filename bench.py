"""Headline benchmark: time the main pipelines at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is run to completion with the ``noop`` sink (full execution, no
collect), median of $BENCH_REPEAT runs in a warm session.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "e1_class_report",        # support -> prototypes -> nearest -> report (flagship)
    "s10_split_parts",        # dedup, novel draw, per-class split, all K
    "w10_label_space_sweep",  # split + label-space sweep
    "j1_entail_pairs",        # entailment pairs
    "a13_neg_sample",         # capped negative sampling
    "x12_pair_encode",        # pair encoding of all pairs
    "p1a_hash_encode",        # hashed bag of words over whole documents
    "j3_token_lookup",        # vocabulary ids + lookup over whole documents
    "a12_pool_max_mean",      # word-vector pooling
    "e3_episodic_eval",       # episodes + episodic prototype accuracy
    "x19_maxsim",             # head matching inside episodes
    "e5_run_summary",         # five seeded runs in one job
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    from intentloom.registry import QUERIES, load_all
    from intentloom.session import get_spark
    load_all()
    spark = get_spark(f"local[{cpus}]", int(cpus) * 2, extra={"spark.driver.memory": "16g"})
    # warm the JVM and the parquet footers once
    QUERIES["a1_distinct_labels"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, failed = {}, []
    for name in HEADLINE:
        runs = []
        try:
            for _ in range(repeat):
                spark.catalog.clearCache()  # what an earlier repeat persisted must not help
                t0 = time.perf_counter()
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - t0)
            times[name] = round(statistics.median(runs), 3)
        except Exception as e:  # keep the line: a failed query is reported, not hidden
            times[name] = None
            failed.append(f"{name}: {type(e).__name__}")
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    total = round(sum(v for v in times.values() if v is not None), 3)
    out = {"metric": "headline_total_sec", "value": total, "unit": "sec",
           "queries": times, "sf": sf, "cpus": int(cpus), "repeat": repeat}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))


if __name__ == "__main__":
    main()
