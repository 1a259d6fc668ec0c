"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR picks the tables (default sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import time

from catalog import QUERIES
from nearfold.session import build_session

HEADLINE = (
    "nearest_cluster",
    "top5_clusters",
    "standard_scale",
    "cluster_summary",
    "lloyd_step",
    "cluster_corpus",
    "best_of_k",
    "geomean_ratio",
    "cluster_p10",
    "zero_shot_final",
    "top5_final",
    "normalize_text",
    "word_frequency",
    "chunk_tokens",
    "mlm_examples",
    "instruction_count",
    "train_val_split",
    "combine_chunks",
    "compare_sequences",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's and the workers' machinery before the clock runs.
    QUERIES["nearest_cluster"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds over headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
