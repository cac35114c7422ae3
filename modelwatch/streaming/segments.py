"""Running results as segments that are merged, so that a table stays readable after any number of micro-batches.

A micro-batch writes one segment. Each `fan_in` segments of one size are merged into one of the next
size, so n micro-batches leave at most (fan_in - 1) * log(n) segments to read, and a row is written
log(n) times. A segment counts once its empty marker file exists, and markers are written last: a reader
sees whole segments only, and a merge that dies is done again by the next micro-batch that is
repeated, and its parts stand until then. The parts of a merge are removed one merge later, for
readers still at work. Micro-batch numbers are those of one checkpoint: a new checkpoint needs a new folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from modelwatch.sources.files import file_system

#: Column that numbers the micro-batch of a row, and folder of the markers.
WRITTEN, MARKERS = "_written", "_segments"
FAN_IN = 16


def _names(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    fs, folder = file_system(spark, f"{path}/{MARKERS}")
    found = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return [(int(first), int(last)) for first, last in (name.split("-") for name in found)]


def current_segments(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(first, last) micro-batch of the largest segments, which together hold every row once."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(_names(spark, path), key=lambda s: (s[0], -s[1])):
        if not out or first > out[-1][1]:
            out.append((first, last))
    return out


def newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row of each key that was written last, in one aggregation."""
    values = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), WRITTEN).alias("_newest"))
    return last.select(*keys, "_newest.*").select(*rows.columns)


def _put(rows: DataFrame, path: str, first: int, last: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/{first}-{last}")
    fs, markers = file_system(rows.sparkSession, f"{path}/{MARKERS}")
    fs.mkdirs(markers)
    fs.create(file_system(rows.sparkSession, f"{path}/{MARKERS}/{first}-{last}")[1]).close()


def _remove(spark: SparkSession, path: str, first: int, last: int) -> None:
    for gone in (f"{path}/{MARKERS}/{first}-{last}", f"{path}/{first}-{last}"):
        fs, target = file_system(spark, gone)
        fs.delete(target, True)


def _merged(rows: DataFrame, keys: Sequence[str], fan_in: int) -> DataFrame:
    return newest(rows, keys) if keys else rows.repartition(max(1, len(rows.inputFiles()) // fan_in))


def store_segment(batch: DataFrame, batch_id: int, path: str, keys: Sequence[str] = (), fan_in: int = FAN_IN) -> None:
    """Write a micro-batch as a segment, then merge what is due.

    With `keys` a merge keeps the newest row of each; without, all rows. Repeating the micro-batch after
    a failure leaves what is whole as it is and writes the rest again.
    """
    spark = batch.sparkSession
    done = set(_names(spark, path))
    if not any(first <= batch_id <= last for first, last in done):
        _put(batch.withColumn(WRITTEN, F.lit(batch_id).cast("long")), path, batch_id, batch_id)
    size = fan_in
    while (batch_id + 1) % size == 0:
        first = batch_id + 1 - size
        if (first, batch_id) not in done:
            parts = [f"{path}/{a}-{b}" for a, b in current_segments(spark, path) if first <= a and b <= batch_id]
            rows = spark.read.schema(StructType([*batch.schema.fields, StructField(WRITTEN, LongType())])).parquet(*parts)
            _put(_merged(rows, keys, fan_in), path, first, batch_id)
        if (first - size, first - 1) in done:
            for a, b in done:
                if first - size <= a and b < first and (a, b) != (first - size, first - 1):
                    _remove(spark, path, a, b)
        size *= fan_in


def read_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all segments, with the micro-batch that wrote them; an empty table before the first one."""
    written = StructType([*schema.fields, StructField(WRITTEN, LongType())])
    paths = [f"{path}/{first}-{last}" for first, last in current_segments(spark, path)]
    return spark.read.schema(written).parquet(*paths) if paths else spark.createDataFrame([], written)


def read_segments(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]) -> DataFrame:
    """The newest row of each key; an empty table before the first micro-batch."""
    return newest(read_rows(spark, path, schema), keys).select(*schema.names)
