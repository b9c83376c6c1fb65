"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line with their seconds: the best of three runs after a warm-up."""

from __future__ import annotations

import json
import os
import time

from pulsegrid import registry
from pulsegrid.session import session

HEADLINES = [
    "flagship_topic_momentum", "agg_overall", "agg_by_both", "agg_activity_cube", "agg_rollup_periods", "agg_monthly_series", "agg_composite", "agg_hhi_density",
    "win_velocity", "win_consistency", "win_rolling_robust_z", "win_anomalies", "win_percentile", "score_trend", "score_innovation", "score_threat", "score_discovery",
    "entry_detect", "topk_evidence_per_org", "anti_orphans", "agg_quality_checks", "fc_backtest", "m_errors", "fc_models", "ev_topic_backtest", "sink_upsert_records",
    "fn_normalize_title", "ai_cosine_nearest", "st_tumbling", "st_sessions", "er_resolve", "join_fuzzy_best", "fact_scores", "insight_generate", "fc_select",
]
#: Runs of each query; the fastest counts.
RUNS = 3


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    registry.QUERIES["flagship_topic_momentum"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINES:
        runs = []
        for _ in range(RUNS):
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs), 3)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
