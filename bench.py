"""Time the headline queries on whole tables; prints one JSON line.

``BENCH_SF_DIR`` chooses the tables and ``BENCH_CPUS`` the number of cores. A
query counts with the faster of two runs, after one that starts the Python
workers; results go to Spark's ``noop`` sink, so every row is made.
"""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ.setdefault("OMP_NUM_THREADS", "1")
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

from pyspark.sql import SparkSession  # noqa: E402

from checks.queries import REGISTRY  # noqa: E402
from chunkwell.session import configure  # noqa: E402

HEADLINE = (
    "chunk_basic",
    "chunk_by_title",
    "chunk_windows",
    "partition_html",
    "embed_hashed",
    "ingest_documents",
    "vector_search",
    "filter_pre",
    "search_batch",
    "search_collections",
    "search_ann",
    "search_documents",
    "query_contract",
    "collection_stats",
)
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    ).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("search_batch")  # starts the Python workers
    times = {name: round(min(run(name) for _ in range(RUNS)), 3) for name in only}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
