"""Preprocessing and estimators as one fitted, serialisable pipeline.

There is one path from a record to a score: the fitted PipelineModel. Only native
stages remain after fitting, so it saves, loads and streams like any Spark model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.functions.columns import number_sql, ratio
from modelwatch.schemas import FeatureSet

FEATURES = "features"
LABEL = "label"
WEIGHT = "class_weight"


def clean_stage(columns: Sequence[str], prefix: str = "clean_") -> SQLTransformer:
    """Text or null to number, missing to 0."""
    exprs = ", ".join(
        f"coalesce({number_sql(f'CAST(`{c}` AS STRING)')}, 0D) AS `{prefix}{c}`" for c in columns
    )
    return SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__")


def standardise_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: `<c>_mean` and `<c>_std`, the population deviation; a constant column gets 1."""
    aggregates = []
    for c in columns:
        std = F.stddev_pop(F.col(c).cast("double"))
        aggregates += [
            F.avg(F.col(c).cast("double")).alias(f"{c}_mean"),
            F.when(std == 0, F.lit(1.0)).otherwise(std).alias(f"{c}_std"),
        ]
    return df.agg(*aggregates)


def standardise(df: DataFrame, columns: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """Centre and scale columns by the frame's own moments (one row, broadcast)."""
    moments = standardise_moments(df, columns)
    return df.crossJoin(F.broadcast(moments)).select(
        *df.columns,
        *[
            ((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")).alias(f"{c}{suffix}")
            for c in columns
        ],
    )


class PopulationScaler(Estimator):
    """Learns mean and population deviation; the fitted stage is a SQL projection."""

    def __init__(self, columns: Sequence[str], prefix: str = "scaled_"):
        super().__init__()
        self.columns = list(columns)
        self.prefix = prefix

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        row = standardise_moments(dataset, self.columns).first()
        exprs = ", ".join(
            f"(CAST(`{c}` AS DOUBLE) - ({row[c + '_mean']!r}D)) / ({row[c + '_std']!r}D) AS `{self.prefix}{c}`"
            for c in self.columns
        )
        return SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__")


def build_pipeline(estimator, features: FeatureSet, scale_numeric: bool) -> Pipeline:
    """Clean, optionally scale, one-hot (unknown level = all zeros), assemble, estimate."""
    stages: list = []
    numbers = list(features.numeric)
    if features.nullable_numeric:
        stages.append(clean_stage(features.nullable_numeric))
        numbers += [f"clean_{c}" for c in features.nullable_numeric]
    if scale_numeric and numbers:
        stages.append(PopulationScaler(numbers))
        numbers = [f"scaled_{c}" for c in numbers]
    inputs = list(numbers)
    if features.categorical:
        names = list(features.categorical)
        indexed, encoded = [f"{c}_index" for c in names], [f"{c}_onehot" for c in names]
        # 'keep' adds one index for unknown values; dropping the last one makes it all zeros.
        stages.append(
            StringIndexer(
                inputCols=names, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"
            )
        )
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True))
        inputs += encoded
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES))
    stages.append(estimator)
    return Pipeline(stages=stages)


def balanced_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Add `class_weight` = n / (classes * rows of the class)."""
    per_class = df.groupBy(label).agg(F.count("*").alias("_n"))
    totals = per_class.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    weights = per_class.crossJoin(F.broadcast(totals)).select(
        label, ratio("_all", F.col("_k") * F.col("_n")).alias(WEIGHT)
    )
    return df.join(F.broadcast(weights), label)  # one row per class of a 0/1 target


def make_estimator(name: str, n_rows: int, seed: int = 42, max_iter: int | None = None):
    """'logreg', 'logreg_balanced' or 'gb'. The L2 penalty is 1 / n, i.e. unit strength."""
    if name in ("logreg", "logreg_balanced"):
        model = LogisticRegression(
            featuresCol=FEATURES,
            labelCol=LABEL,
            maxIter=max_iter or 1000,
            regParam=1.0 / n_rows,
            elasticNetParam=0.0,
            standardization=False,
            tol=1e-8,
        )
        return model.setWeightCol(WEIGHT) if name == "logreg_balanced" else model
    if name == "gb":
        return GBTClassifier(
            featuresCol=FEATURES,
            labelCol=LABEL,
            maxDepth=5,
            maxIter=max_iter or 100,
            stepSize=0.1,
            seed=seed,
        )
    raise ValueError(f"unknown estimator {name!r}")


def fit(name: str, train: DataFrame, features: FeatureSet, scale_numeric: bool, seed: int = 42,
        max_iter: int | None = None) -> PipelineModel:
    """Fit one named estimator on a frame with a 0/1 `label` column."""
    needed = train.select(*features.all, LABEL)
    if name == "logreg_balanced":
        needed = balanced_weights(needed)
    needed = needed.persist()  # the optimiser reads it many times; lost blocks are recomputed
    try:
        estimator = make_estimator(name, needed.count(), seed, max_iter)
        return build_pipeline(estimator, features, scale_numeric).fit(needed)
    finally:
        needed.unpersist()
