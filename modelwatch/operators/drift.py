"""Population Stability Index of live traffic against a reference sample.

Bin counts add up over days, so the traffic is read once: it becomes a table of
(day, feature, bin) counts whose size depends on days, features and bins only, and every
window length is a range frame over that small table.

Bin numbers: 0.. are bins or levels, MISSING holds nulls and NaN, OTHER holds levels
outside the declared domain.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modelwatch.functions.columns import level_index, nan_to_null, ratio, right_closed_bin, sql_name
from modelwatch.operators.ordering import exact_percentiles

N_BINS = 10
WINDOWS = (1, 7)
MISSING = -1
OTHER = -2

_REFERENCE_SCHEMA = (
    "feature_id int, feature string, bin int, p double, n_ref bigint, numeric boolean, scored boolean"
)


def quantile_fractions(n_bins: int = N_BINS) -> list[float]:
    """n_bins + 1 evenly spaced fractions, computed as start + i * step."""
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def fit_bin_edges(df: DataFrame, features: Sequence[str], n_bins: int = N_BINS) -> DataFrame:
    """Quantile edges per numeric feature: one row (feature, n, edges), duplicates dropped.

    The outer edges are the sample's own; binning treats them as open-ended.
    """
    long = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(f).alias("feature"), nan_to_null(F.col(f).cast("double")).alias("x"))
                    for f in features
                ]
            )
        )
    )
    names = {f"e{i:03d}": q for i, q in enumerate(quantile_fractions(n_bins))}
    cut = exact_percentiles(long, "x", names, by=["feature"], kind="linear")
    return cut.select("feature", "n", F.array_distinct(F.array(*names)).alias("edges"))


def bin_generator(numeric: Mapping[str, Sequence[float]], categorical: Mapping[str, Sequence]) -> Column:
    """Generator of (feature_id, bin) rows, one per feature, in order of the mappings.

    `numeric` maps features to inner edges, `categorical` to levels.
    """
    bins = []
    for f, edges in numeric.items():
        v = f"CAST({sql_name(f)} AS DOUBLE)"
        bins.append(f"CASE WHEN {v} IS NULL OR isnan({v}) THEN {MISSING} ELSE {right_closed_bin(v, edges)} END")
    for f, levels in categorical.items():
        bins.append(level_index(sql_name(f), levels, MISSING, OTHER))
    rows = ", ".join(f"struct({i} AS feature_id, {b} AS bin)" for i, b in enumerate(bins))
    return F.expr(f"inline(array({rows}))")


def bin_counts(
    df: DataFrame,
    numeric: Mapping[str, Sequence[float]],
    categorical: Mapping[str, Sequence],
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows per (by, feature_id, bin): one scan, one shuffle of already combined counts."""
    return (
        df.select(*by, bin_generator(numeric, categorical))
        .groupBy(*by, "feature_id", "bin")
        .agg(F.count("*").alias("cnt"))
    )


@dataclass(frozen=True)
class DriftReference:
    """A fitted reference: edges, domains and shares. Its size is features x bins."""

    numeric: dict[str, list[float]]
    categorical: dict[str, list]
    n_ref: int
    counts: dict[str, dict[int, int]]

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def rows(self) -> list[tuple]:
        """One row per (feature, bin), in `_REFERENCE_SCHEMA`.

        Numeric shares divide by all rows and score the missing bin; categorical shares
        divide by the non-null rows and score the declared levels only.
        """
        out = []
        for i, f in enumerate(self.features):
            is_numeric = f in self.numeric
            counts = self.counts.get(f, {})
            n_bins = len(self.numeric[f]) + 1 if is_numeric else len(self.categorical[f])
            bins = [*range(n_bins), MISSING] + ([] if is_numeric else [OTHER])
            whole = sum(c for b, c in counts.items() if is_numeric or b != MISSING)
            for b in bins:
                scored = is_numeric or b >= 0
                p = counts.get(b, 0) / whole if scored and whole else None
                out.append((i, f, b, p, self.n_ref, is_numeric, scored))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), _REFERENCE_SCHEMA)

    def to_json(self) -> str:
        return json.dumps(
            {
                "numeric": self.numeric,
                "categorical": self.categorical,
                "n_ref": self.n_ref,
                "counts": {f: {str(b): c for b, c in m.items()} for f, m in self.counts.items()},
            }
        )

    @staticmethod
    def from_json(text: str) -> DriftReference:
        d = json.loads(text)
        counts = {f: {int(b): c for b, c in m.items()} for f, m in d["counts"].items()}
        return DriftReference(d["numeric"], d["categorical"], d["n_ref"], counts)


def fit_reference(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Mapping[str, Sequence],
    n_bins: int = N_BINS,
) -> DriftReference:
    """Fit edges and shares on the reference sample.

    What reaches the driver is the fitted state: at most n_bins + 1 edges per numeric
    feature and one count per feature and bin.
    """
    inner: dict[str, list[float]] = {f: [] for f in numeric}
    if numeric:
        for row in fit_bin_edges(df, numeric, n_bins).collect():
            inner[row["feature"]] = list(row["edges"])[1:-1]
    domains = {f: list(levels) for f, levels in categorical.items()}
    features = [*inner, *domains]
    counts: dict[str, dict[int, int]] = {f: {} for f in features}
    for row in bin_counts(df, inner, domains).collect():
        counts[features[row["feature_id"]]][row["bin"]] = row["cnt"]
    n_ref = sum(counts[features[0]].values()) if features else 0
    return DriftReference(inner, domains, n_ref, counts)


def daily_bin_counts(traffic: DataFrame, reference: DriftReference, day: str = "day") -> DataFrame:
    """(day, feature_id, bin, cnt): the only pass over the traffic."""
    return bin_counts(traffic, reference.numeric, reference.categorical, by=[day])


def psi_term(p: Column, q: Column, n_ref: Column, n_cur: Column) -> Column:
    """One bin's contribution, each share floored at half an observation of its sample."""
    p = F.greatest(p, F.lit(0.5) / n_ref)
    q = F.greatest(q, F.lit(0.5) / n_cur)
    return (q - p) * F.log(q / p)


def rolling_psi(
    daily: DataFrame,
    reference: DriftReference,
    windows: Sequence[int] = WINDOWS,
    day: str = "day",
) -> DataFrame:
    """(day, feature, window_days, psi, n_rows) for trailing windows ending on observed days.

    Windows reaching back before the first observed day are left out; days without rows
    inside a window are allowed.
    """
    ref = reference.table(daily.sparkSession)
    # One row per (day, feature) with its counts as a map; the reference then makes it
    # dense, so that a bin without rows still adds its floored term.
    by_feature = daily.groupBy(day, "feature_id").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "cnt"))).alias("counts")
    )
    dense = by_feature.join(F.broadcast(ref), "feature_id").select(
        F.col(day).alias("day"),
        *[c for c in ref.columns],
        F.coalesce(F.try_element_at("counts", F.col("bin")), F.lit(0).cast("bigint")).alias("cnt"),
    )
    series = Window.partitionBy("feature_id", "bin")
    day_no = F.unix_date("day")
    rolled = dense.withColumns(
        {
            "age": day_no - F.min(day_no).over(series),
            **{
                f"_c{w}": F.sum("cnt").over(series.orderBy(day_no).rangeBetween(-(w - 1), 0))
                for w in windows
            },
        }
    ).select(
        *dense.columns,
        "age",
        F.inline(
            F.array(*[F.struct(F.lit(w).alias("window_days"), F.col(f"_c{w}").alias("c")) for w in windows])
        ),
    ).filter(F.col("age") >= F.col("window_days") - 1)

    one = Window.partitionBy("day", "feature_id", "window_days")
    shares = rolled.withColumns(
        {
            "n_rows": F.sum("c").over(one),
            "n_base": F.sum(F.when(F.col("numeric") | (F.col("bin") != MISSING), F.col("c")).otherwise(0)).over(one),
        }
    )
    term = psi_term(F.col("p"), ratio("c", "n_base"), F.col("n_ref"), F.col("n_rows"))
    return (
        shares.groupBy("day", "feature_id", "feature", "window_days")
        .agg(
            F.sum(F.when(F.col("scored"), term)).alias("psi"),
            F.max("n_rows").alias("n_rows"),
        )
        .select("day", "feature", "window_days", "psi", "n_rows")
    )


def drift_metrics(
    traffic: DataFrame,
    reference: DriftReference,
    windows: Sequence[int] = WINDOWS,
    day: str = "day",
) -> DataFrame:
    """The rolling PSI job over a traffic table with a `day` column."""
    return rolling_psi(daily_bin_counts(traffic, reference, day), reference, windows, day)


def psi_between(
    current: DataFrame, reference: DriftReference
) -> DataFrame:
    """PSI per feature of one whole sample against the reference: (feature, psi, n_rows)."""
    day = current.withColumn("day", F.lit("2000-01-01").cast("date"))
    return drift_metrics(day, reference, windows=(1,)).select("feature", "psi", "n_rows")


def numeric_shares(df: DataFrame, edges: Mapping[str, Sequence[float]]) -> DataFrame:
    """(feature, bin, cnt, share): share over all rows, nulls in their own bin. `edges` are inner."""
    return _shares(df, {f: list(e) for f, e in edges.items()}, {})


def categorical_shares(df: DataFrame, domains: Mapping[str, Sequence]) -> DataFrame:
    """(feature, bin, cnt, share): every declared level, absent ones with share 0.

    The denominator is the non-null rows; unknown levels stay in it but get no row.
    """
    return _shares(df, {}, {f: list(v) for f, v in domains.items()})


def _shares(df: DataFrame, numeric: dict, categorical: dict) -> DataFrame:
    layout = DriftReference(numeric, categorical, 0, {}).table(df.sparkSession)
    counted = bin_counts(df, numeric, categorical).groupBy("feature_id").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "cnt"))).alias("counts"),
        F.sum("cnt").alias("n_all"),
        F.sum(F.when(F.col("bin") != MISSING, F.col("cnt")).otherwise(0)).alias("n_known"),
    )
    cnt = F.coalesce(F.try_element_at("counts", F.col("bin")), F.lit(0).cast("bigint"))
    return (
        layout.join(F.broadcast(counted), "feature_id", "left")  # one row per feature
        .filter("scored")
        .select("feature", "bin", cnt.alias("cnt"), "numeric", "n_all", "n_known")
        .select(
            "feature",
            "bin",
            "cnt",
            ratio("cnt", F.when(F.col("numeric"), F.col("n_all")).otherwise(F.col("n_known"))).alias("share"),
        )
    )


def drift_summary(metrics: DataFrame) -> DataFrame:
    """Rows and distinct days per window length."""
    return metrics.groupBy("window_days").agg(
        F.count("*").alias("n_metrics"), F.count_distinct("day").alias("n_days")
    )
