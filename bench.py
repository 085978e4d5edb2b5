"""Time every headline query; print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS
(default 1, median after one warm-up), BENCH_QUERIES (comma list, or "all").
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tidemark.plans import REGISTERED
from tidemark.session import local_session

HEADLINE = (
    "bars_daily", "feature_price", "feature_volume", "feature_moving_average", "feature_oscillators", "feature_exponential",
    "cross_section_rank", "feature_rolling_correlation", "factor_builtin", "factor_composite_score", "factor_ic_summary",
    "factor_evaluation", "backtest_summary", "portfolio_performance", "risk_value_at_risk", "dq_bar_metrics", "points_score",
    "source_metrics", "source_outliers_iqr", "feature_profile", "state_full", "regime_vote", "weights_ucb", "weights_ewma",
    "graph_pagerank", "graph_components", "sentiment_lexicon", "entity_extraction", "triple_ordered", "metric_statistics",
    "store_upsert", "stream_windows",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(REGISTERED) if asked == "all" else [n for n in asked.split(",") if n] or list(HEADLINE)
    spark = local_session(cpus)
    times, rows, failed = {}, {}, {}
    for name in names:
        run = REGISTERED[name].run
        try:
            rows[name] = run(spark, folder).count()
            taken = []
            for _ in range(runs):
                start = time.perf_counter()
                run(spark, folder).write.format("noop").mode("overwrite").save()
                taken.append(time.perf_counter() - start)
            times[name] = round(statistics.median(taken), 3)
        except Exception as error:  # one broken query must not hide the others' times
            failed[name] = str(error).splitlines()[0][:200]
        print(name, times.get(name, failed.get(name)), file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rows": rows,
                "failed": failed,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
