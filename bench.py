"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query is built and executed in full into a sink that discards rows; building counts,
since some operators run small jobs while they plan.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from modelwatch.session import build_session  # noqa: E402
from modelwatch.suite import all_queries  # noqa: E402

HEADLINE = [
    "latency_total",
    "latency_by_phase",
    "latency_composition",
    "histogram_quantile",
    "latency_over_time",
    "error_ratio",
    "score_quantiles_daily",
    "contract_violations",
    "contract_json",
    "join_truth_left",
    "row_parity",
    "reconcile_vantage",
    "reconcile_vantage_orders",
    "reconcile_weekly_orders",
    "reconcile_mature",
    "mature_labels",
    "fit_bins",
    "drift_psi_7d",
    "drift_detection",
    "average_precision_events",
    "pr_curve_events",
    "bootstrap_band",
    "stratified_split",
    "grouped_describe",
    "standardise",
    "stream_latency_histogram",
    "stream_label_join",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def scoring(spark, sf_dir: str) -> dict:
    """Validate, score and decide on every document; the model is fitted beforehand."""
    from pyspark.sql import functions as F

    from modelwatch.operators.scoring import score_requests
    from modelwatch.sources.files import table
    from modelwatch.suite.training import DOCUMENT_CONTRACT, labelled, train

    result = train(labelled(spark, sf_dir), "logreg")
    requests = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("customer_id"), "n_chars", "lang", "source"
    )
    n = requests.count()
    start = time.perf_counter()
    facts, _ = score_requests(
        requests, result.model, result.metrics["threshold"], "1", DOCUMENT_CONTRACT, "good", "poor"
    )
    run(facts)
    took = time.perf_counter() - start
    return {"records": n, "sec": round(took, 3), "ms_per_record": round(1000 * took / n, 4)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = sys.argv[1:] or HEADLINE
    # One untimed aggregate starts the executor threads and loads the Parquet reader.
    run(queries["request_counts"](spark, sf_dir))
    seconds = {}
    for name in names:
        start = time.perf_counter()
        run(queries[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - start, 3)
    scored = scoring(spark, sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "scoring": scored,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
