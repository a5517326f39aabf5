"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from answerloom.registry import QUERIES, load_all  # noqa: E402
from answerloom.registry.fixtures import stored_index  # noqa: E402
from answerloom.session import build_session  # noqa: E402

HEADLINE = [
    "bm25_topk", "bm25_postings", "vector_topk", "hash_embedding", "search_vector", "search_bm25", "search_hybrid",
    "search_hybrid_rerank", "evaluation_summary", "usage_totals", "usage_by_mode", "usage_hourly", "chunk_rows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    load_all()
    spark = build_session(f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    times = {}
    start = time.perf_counter()
    stored_index(spark, sf_dir)  # written once; the searches read it
    times["index_write"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        if name not in QUERIES:
            continue
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    sf = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
