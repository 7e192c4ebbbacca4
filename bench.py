"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "text_normalize", "sentences_from_words", "plan_stories", "build_chunks", "paragraphs", "detect_pauses", "related_stories", "entity_timelines",
    "timeline_gaps", "locate_exact", "time_expressions", "bm25_topk", "cosine_topk", "search_policy", "mention_scan", "resolve_offsets", "heard_coverage",
    "playback_sessions",
]


def main() -> None:
    from taleloom.plans.registry import all_queries
    from taleloom.session import get_session, ship_package

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", spark__sql__shuffle__partitions=8, spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    spark.range(1000).selectExpr("sum(id)").collect()
    every, seconds, rows = all_queries(), {}, {}
    wanted = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    for name in wanted:
        start = time.perf_counter()
        df = every[name].run(spark, sf_dir)
        rows[name] = df.count() if not df.columns else df.selectExpr("count(*) as n", f"count(struct({', '.join('`' + c + '`' for c in df.columns)})) as m").first()[0]
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "rows": rows,
        "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
