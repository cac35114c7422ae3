"""Drift from stored counts: a run reads only the files of facts that no run has counted.

Counts by (day, feature, bin) add up, so each run stores those of its new files, with the names of the
files, as one segment (`streaming.segments`). A segment counts once it is whole: a run that dies leaves
nothing, and the next one counts its files. Back-dated facts are new files of old days and are added like
others. The counts of a reference lie in a folder named by its edges and levels, so another binning starts
anew, while new reference shares do not. One run at a time.

The driver holds the list of files, as it does for every scan of that folder; the counts stay in tables.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelwatch.operators.checks import CheckFailed, require_single_version
from modelwatch.operators.drift import WINDOWS, DriftReference, daily_bin_counts, rolling_psi
from modelwatch.sinks.tables import replace_table
from modelwatch.sources.files import read_latest, read_traffic
from modelwatch.streaming.segments import current_segments, read_rows, store_segment

SEGMENT = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("day", T.DateType()),
        T.StructField("feature_id", T.IntegerType()),
        T.StructField("bin", T.IntegerType()),
        T.StructField("cnt", T.LongType()),
    ]
)


def counts_folder(store: str, reference: DriftReference) -> str:
    layout = json.dumps([list(reference.numeric.items()), list(reference.categorical.items())])
    return f"{store}/bins={hashlib.sha256(layout.encode()).hexdigest()[:24]}"


def stored_counts(spark: SparkSession, store: str, reference: DriftReference) -> DataFrame:
    """(day, feature_id, bin, cnt) of all files counted so far, as `drift.daily_bin_counts` gives them."""
    rows = read_rows(spark, counts_folder(store, reference), SEGMENT)
    kept = rows.filter("source IS NULL").groupBy("day", "feature_id", "bin")
    return kept.agg(F.sum("cnt").alias("cnt"))


def uncounted(facts: DataFrame, store: str, reference: DriftReference) -> list[str]:
    """Files of `facts` that are not in the stored counts; raises if a counted file is gone."""
    rows = read_rows(facts.sparkSession, counts_folder(store, reference), SEGMENT)
    known = {r["source"] for r in rows.filter("source IS NOT NULL").select("source").collect()}
    files = {unquote(f) for f in facts.inputFiles()}
    if known - files:
        raise CheckFailed(f"{len(known - files)} counted files are gone, such as {min(known - files)}: count anew")
    return sorted(files - known)


def update_counts(
    spark: SparkSession,
    facts_path: str,
    store: str,
    reference: DriftReference,
    prepare: Callable[[DataFrame], DataFrame],
) -> list[str]:
    """Count the new files of the Parquet table at `facts_path` and store the counts; returns these files.

    `prepare` turns facts into traffic: `day` and the features of the reference.
    """
    facts = spark.read.parquet(facts_path)
    new = uncounted(facts, store, reference)
    if new:
        rows = spark.read.schema(facts.schema).option("basePath", facts_path).parquet(*new)
        counts = daily_bin_counts(prepare(rows), reference)
        sources = spark.createDataFrame([(f,) for f in new], "source string")
        segment = counts.withColumn("source", F.lit(None).cast("string")).unionByName(sources, allowMissingColumns=True)
        folder = counts_folder(store, reference)
        past = current_segments(spark, folder)
        wanted = segment.select(*[F.col(f.name).cast(f.dataType) for f in SEGMENT])
        store_segment(wanted, past[-1][1] + 1 if past else 0, folder)
    return new


def incremental_drift_job(
    spark: SparkSession,
    facts_path: str,
    store: str,
    reference: DriftReference,
    champion: str,
    path: str,
    windows: Sequence[int] = WINDOWS,
) -> DataFrame:
    """`monitoring.drift_job` whose work is that of the new facts; refuses mixed or foreign versions in them."""
    watched = [f for f in reference.features if f != "score"]

    def traffic(rows: DataFrame) -> DataFrame:
        require_single_version(rows, champion)
        return read_traffic(rows, watched)

    update_counts(spark, facts_path, store, reference, traffic)
    replace_table(rolling_psi(stored_counts(spark, store, reference), reference, windows), path)
    return read_latest(spark, path)
