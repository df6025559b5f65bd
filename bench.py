"""Headline queries, timed end to end on one machine; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "latest_signal",
    "tech_indicators",
    "tech_macd",
    "price_patterns",
    "asof_macro",
    "sector_features",
    "cross_section_ranks",
    "sentiment_daily",
    "label_forward_sum_up",
    "cv_combinatorial",
    "metric_auc",
    "metric_ic",
    "strategy_evaluation",
    "backtest_signal_metrics",
    "backtest_threshold_sweep",
    "backtest_topk_summary",
    "dm_test",
    "block_bootstrap",
    "merged_history",
    "promotion_decisions",
    "linear_attributions",
    "score_model_c",
    "predict_latest",
    "backtest_compare_models",
]


def main() -> None:
    from quantloom.plans.catalog import ENTRIES
    from quantloom.session import build_session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    ENTRIES["latest_signal"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        ENTRIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    result = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
    print(json.dumps(result))


if __name__ == "__main__":
    main()
