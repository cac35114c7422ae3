"""Request latency: exact percentiles, composition of slow requests, mergeable histograms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelwatch.functions.columns import percent, round_half_up, sql_literal, unpivot_columns
from modelwatch.operators.ordering import exact_percentiles
from modelwatch.schemas import LATENCY_BUCKETS

PERCENTILES = {"p50_ms": 0.50, "p95_ms": 0.95, "p99_ms": 0.99}
PHASES = {"routing": "routing_ms", "predict": "predict_ms", "insert": "insert_ms", "total": "duration_ms"}
INFINITE = "+Inf"
# Duration in seconds, as SQL over the request log.
SECONDS = "duration_ms / 1000D"


def successful(log: DataFrame, path: str = "/predict", status: int = 200) -> DataFrame:
    return log.filter((F.col("path") == path) & (F.col("status_code") == status))


def with_all_phases(log: DataFrame) -> DataFrame:
    return log.dropna(subset=["routing_ms", "predict_ms", "insert_ms"])


def total_percentiles(log: DataFrame, path: str = "/predict") -> DataFrame:
    """(n, p50_ms, p95_ms, p99_ms, max_ms) of successful requests; one row, exact."""
    return exact_percentiles(
        successful(log, path), "duration_ms", {**PERCENTILES, "max_ms": 1.0}
    )


def phase_percentiles(log: DataFrame, path: str = "/predict") -> DataFrame:
    """(phase, p50_ms, p95_ms, p99_ms) in processing order, for requests with every phase timed."""
    timed = with_all_phases(successful(log, path))
    long = timed.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("ord"), F.lit(name).alias("phase"), F.col(c).alias("ms"))
                    for i, (name, c) in enumerate(PHASES.items(), start=1)
                ]
            )
        )
    )
    return (
        exact_percentiles(long, "ms", PERCENTILES, by=["ord", "phase"])
        .orderBy("ord")
        .select("phase", *PERCENTILES)
    )


def composition(
    log: DataFrame, path: str = "/predict", places: int = 2
) -> DataFrame:
    """Where the time goes in typical (p45 to p55) and slow (p99 and above) requests.

    Shares are ratios of averages, not averages of ratios.
    """
    base = with_all_phases(successful(log, path)).withColumn(
        "other_ms", F.col("duration_ms") - (F.col("routing_ms") + F.col("predict_ms") + F.col("insert_ms"))
    )
    cuts = exact_percentiles(
        base, "duration_ms", {"p45": 0.45, "p55": 0.55, "p99": 0.99}
    )
    parts = ["routing_ms", "predict_ms", "insert_ms", "other_ms"]
    bucket = F.when(F.col("duration_ms").between(F.col("p45"), F.col("p55")), F.lit("p50")).when(
        F.col("duration_ms") >= F.col("p99"), F.lit("p99+")
    )
    grouped = (
        base.crossJoin(F.broadcast(cuts.drop("n")))  # one row
        .select(bucket.alias("bucket"), "duration_ms", *parts)
        .filter(F.col("bucket").isNotNull())
        .groupBy("bucket")
        .agg(
            F.count("*").alias("n"),
            F.avg("duration_ms").alias("_total"),
            *[F.avg(p).alias(f"_{p}") for p in parts],
        )
    )
    return grouped.select(
        "bucket",
        "n",
        round_half_up("_total", places).alias("avg_total_ms"),
        *[round_half_up(f"_{p}", places).alias(p) for p in parts],
        *[
            round_half_up(percent(f"_{p}", "_total"), max(places - 1, 1)).alias(p.replace("_ms", "_pct"))
            for p in parts
        ],
    ).orderBy("bucket")


def bucket_label(bound: float) -> str:
    return str(float(bound))


def bucket_counts(seconds: str, bounds: Sequence[float]) -> list[Column]:
    """Cumulative bucket counts of a SQL expression as aggregates: mergeable, fixed-size state."""
    counts = [f"count_if({seconds} <= {sql_literal(float(b))}) AS _le{i}" for i, b in enumerate(bounds)]
    return [F.expr(c) for c in [*counts, f"count({seconds}) AS _le{len(bounds)}"]]


def bucket_rows(aggregated: DataFrame, by: Sequence[str], bounds: Sequence[float]) -> DataFrame:
    """Unfold the aggregates into (by, le_ord, le, cum) rows, `+Inf` last."""
    labels = [*[bucket_label(b) for b in bounds], INFINITE]
    rows = ", ".join(f"{i}, '{label}', _le{i}" for i, label in enumerate(labels))
    return aggregated.selectExpr(*by, f"stack({len(labels)}, {rows}) AS (le_ord, le, cum)")


def latency_histogram(
    log: DataFrame,
    by: Sequence[str] = ("path",),
    seconds: str = SECONDS,
    bounds: Sequence[float] = LATENCY_BUCKETS,
) -> DataFrame:
    """Cumulative `le` buckets of request duration in seconds, per group."""
    return bucket_rows(log.groupBy(*by).agg(*bucket_counts(seconds, bounds)), by, bounds)


def merge_histograms(parts: DataFrame, by: Sequence[str] = ("path",)) -> DataFrame:
    """Add histograms with the same bounds: bucket counts add up, exact percentiles do not."""
    return parts.groupBy(*by, "le_ord", "le").agg(F.sum("cum").alias("cum"))


def histogram_quantile(
    histogram: DataFrame,
    quantiles: Mapping[str, float],
    by: Sequence[str] = ("path",),
    bounds: Sequence[float] = LATENCY_BUCKETS,
) -> DataFrame:
    """Estimated quantiles from cumulative buckets, linear inside the bucket.

    The first bucket starts at zero; a rank in the open-ended bucket gives the last
    finite bound; a group without observations gives null. One column per quantile.
    """
    ends = [float(b) for b in bounds]
    starts = [0.0, *ends[:-1]]
    # Per group the cumulative counts in bucket order: a fixed number of small rows.
    counts = F.expr("transform(array_sort(collect_list(struct(le_ord, cum))), x -> x.cum)")
    columns = []
    for name, q in quantiles.items():
        rank = f"({float(q)!r}D * _c[{len(ends)}])"
        whens = []
        for i, (start, end) in enumerate(zip(starts, ends)):
            before = f"_c[{i - 1}]" if i else "0"
            inside = f"{start!r}D + {end - start!r}D * (({rank} - {before}) / nullif(_c[{i}] - {before}, 0))"
            whens.append(f"WHEN _c[{i}] >= {rank} THEN {inside}")
        columns.append(f"CASE WHEN _c[{len(ends)}] = 0 THEN NULL {' '.join(whens)} ELSE {ends[-1]!r}D END AS `{name}`")
    return histogram.groupBy(*by).agg(counts.alias("_c")).selectExpr(*by, *columns)


def quantile_error(
    log: DataFrame,
    path: str = "/predict",
    seconds: str = SECONDS,
    bounds: Sequence[float] = LATENCY_BUCKETS,
) -> DataFrame:
    """Exact against estimated percentiles of successful requests: (quantile, exact, estimated, error)."""
    base = successful(log, path).select("path", F.expr(seconds).alias("_seconds"))
    names = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
    exact = exact_percentiles(base, "_seconds", names)
    estimated = histogram_quantile(
        latency_histogram(base, ["path"], "_seconds", bounds),
        {f"{k}_est": q for k, q in names.items()},
        ["path"],
        bounds,
    )
    both = exact.crossJoin(F.broadcast(estimated))  # one row each
    rows = both.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(k).alias("quantile"),
                        F.col(k).alias("exact"),
                        F.col(f"{k}_est").alias("estimated"),
                    )
                    for k in names
                ]
            )
        )
    )
    return rows.withColumns(
        {
            "error": F.col("estimated") - F.col("exact"),
            "error_pct": percent(F.col("estimated") - F.col("exact"), "exact"),
        }
    )


def phases_long(log: DataFrame) -> DataFrame:
    """(request_id, phase, ms): the timed phases as rows."""
    return log.select("request_id", unpivot_columns(PHASES, "phase", "ms"))


def running_over_buckets(counts: DataFrame, by: Sequence[str] = ("path",)) -> DataFrame:
    """Per-bucket counts to cumulative ones, when a source delivers the former."""
    w = Window.partitionBy(*by).orderBy("le_ord").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("cum", F.sum("cnt").over(w))
