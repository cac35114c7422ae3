"""File scans with declared schemas: no inference pass, no surprises in types."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelwatch.functions.columns import day_of, map_values
from modelwatch.operators.checks import require_no_nulls
from modelwatch.operators.contract import TELCO_CONTRACT, Contract, parse_records
from modelwatch.operators.joins import join_one_to_one
from modelwatch.schemas import RAW_DATASET, SERVICE_LOG, SPLIT_MANIFEST, VERIFICATION_SAMPLE


#: Folder of the empty files that name complete refreshes.
POINTERS = "_pointers"


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV. A missing path fails here, with the path in the message."""
    try:
        return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    except AnalysisException as e:
        raise RuntimeError(f"could not read the dataset at {path}: {e}") from e


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, RAW_DATASET)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, SPLIT_MANIFEST)


def load_dataset(dataset: DataFrame, manifest: DataFrame, key: str = "customerID",
                 target: str = "Churn", values: dict | None = None) -> DataFrame:
    """Dataset joined one-to-one with its split manifest, target as 0/1 in `label`."""
    joined = join_one_to_one(dataset, manifest, key)
    encoded = joined.withColumn("label", map_values(target, values or {"Yes": 1, "No": 0}))
    require_no_nulls(encoded, ["label"])
    return encoded


def read_traffic(
    predictions: DataFrame, features: list[str], score: str = "probability", time: str = "event_time"
) -> DataFrame:
    """(day, score, features) of a prediction log; only these columns reach the scan."""
    return predictions.select(day_of(time).alias("day"), F.col(score).alias("score"), *features)


def read_prediction_keys(predictions: DataFrame) -> DataFrame:
    return predictions.select("request_id", "customer_id", "event_time")


def read_verification_sample(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VERIFICATION_SAMPLE).json(path)


def read_requests(spark: SparkSession, path: str, contract: Contract = TELCO_CONTRACT) -> DataFrame:
    """One JSON request record per line, typed, with malformed fields named."""
    return parse_records(spark.read.text(path), "value", contract)


def with_position(requests: DataFrame, name: str = "position") -> DataFrame:
    """Add where each record was read, so that equal records stay different requests.

    File and row for columnar files; for text, file and number among the equal records of that file.
    Both are the same whenever the file is read again, however it is split. Records that come from no
    file are told apart by this call and their place in it.
    """

    def known(field: str) -> bool:
        try:
            requests.select(f"_metadata.{field}")
            return True
        except AnalysisException:
            return False

    if known("row_index"):
        return requests.withColumn(name, F.concat_ws("#", "_metadata.file_path", "_metadata.row_index"))
    if known("file_path"):
        content = F.col("_raw") if "_raw" in requests.columns else F.to_json(F.struct(*requests.columns))
        digest = F.unhex(F.sha2(content, 256))
        # Dealt by the digest before the window asks for it as a column, so the shuffle does not carry it.
        placed = requests.withColumn(name, F.col("_metadata.file_path")).repartition(name, digest)
        equal = Window.partitionBy(name, digest).orderBy(F.lit(0))
        return placed.withColumn(name, F.concat_ws("#", name, F.row_number().over(equal)))
    return requests.withColumn(name, F.concat_ws("#", F.lit(uuid.uuid4().hex), F.monotonically_increasing_id()))


def read_service_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SERVICE_LOG).json(path)


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, str, float]:
    """(model, version, threshold) of a saved model folder."""
    meta = spark.read.schema("version string, threshold double").json(f"{path}/meta").first()
    if meta is None:
        raise RuntimeError(f"no model metadata at {path}")
    return PipelineModel.load(f"{path}/model"), meta["version"], meta["threshold"]


def load_champion(spark: SparkSession, path: str) -> tuple[PipelineModel, str, float]:
    """(model, version, threshold) of the model that the champion record at `path` names."""
    record = spark.read.schema("model_path string, version string, threshold double").json(path).first()
    if record is None:
        raise RuntimeError(f"no champion at {path}")
    return load_model(spark, record["model_path"])[0], record["version"], record["threshold"]


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def current_versions(spark: SparkSession, path: str) -> list[int]:
    """Complete refreshes of a table written by `sinks.replace_table`."""
    fs, pointers = file_system(spark, f"{path}/{POINTERS}")
    return [int(s.getPath().getName()) for s in fs.listStatus(pointers)] if fs.exists(pointers) else []


def read_latest(spark: SparkSession, path: str, version_column: str = "refresh") -> DataFrame:
    """The newest complete refresh of a table written by `sinks.replace_table`; only its folder is read."""
    versions = current_versions(spark, path)
    if not versions:
        raise RuntimeError(f"no complete refresh at {path}")
    return spark.read.parquet(f"{path}/{version_column}={max(versions)}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def between(df: DataFrame, column: str, start: Column, end: Column) -> DataFrame:
    """Half-open time range; on a date-partitioned table it prunes folders."""
    return df.filter((F.col(column) >= start) & (F.col(column) < end))
