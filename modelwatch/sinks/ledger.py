"""A ledger of stored request ids, so that an id is stored once whatever day it comes back on.

Facts lie in one folder per event date, which says nothing about where an id was stored before: a
request without an event time that is sent again after midnight has another date. The ledger has one
row per stored id with a digest of its record, in buckets by id, sorted inside each file. A batch is
staged in the same buckets, which is its only shuffle by id; it is checked, matched against the ledger by
merge joins and added to it bucket by bucket.

Order of an append: a pending mark with the batch's days, the facts, their ledger rows, removal of the
mark. A mark that is still there was left by an append that died; the next one first adds the ids of
that append's days which reached the facts but not the ledger.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.operators.checks import CheckFailed
from modelwatch.sources.files import file_system

#: Columns of a fact that tell when and how it was answered, not what was asked. A repeated request may differ in them.
ANSWER_COLUMNS = (
    "event_time", "event_date", "created_at", "prediction", "probability", "threshold", "model_version",
)
BUCKETS = 16
#: Ids and digests are mostly hexadecimal text, which this codec stores in half its length.
CODEC = "zstd"


def record_digest(columns: Sequence[str], key: str) -> Column:
    """Digest of what was asked: all columns but the id and the answer."""
    asked = [F.col(f"`{c}`").cast("string") for c in sorted(columns) if c != key and c not in ANSWER_COLUMNS]
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in asked]
    return F.sha2(F.concat_ws("|", F.lit(""), *parts), 256)


class KeyLedger:
    """Ids stored in the facts at `path`. The ledger lies inside that folder, hidden from its readers."""

    def __init__(self, spark: SparkSession, path: str, key: str, key_type: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.buckets, self.folder = buckets, f"{self.path}/_ledger/keys"
        self.marks = f"{self.path}/_ledger/pending"
        self.name = "ledger_" + hashlib.sha256(self.path.encode()).hexdigest()[:32]
        self.batch, self.batch_folder = f"{self.name}_batch", f"{self.path}/_ledger/batch"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (`{key}` {key_type}, record STRING) USING parquet "
            f"OPTIONS (compression '{CODEC}') "
            f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{self.folder}'"
        )
        spark.catalog.refreshTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def stage(self, batch: DataFrame) -> DataFrame:
        """Write a batch once, in the ledger's buckets; what is read from there is not shuffled by id again."""
        self.unstage()
        (
            batch.repartition(self.buckets, self.key)
            .write.format("parquet")
            .bucketBy(self.buckets, self.key)
            .option("path", self.batch_folder)
            .option("compression", CODEC)
            .saveAsTable(self.batch)
        )
        return self.spark.table(self.batch)

    def unstage(self) -> None:
        """Drop the staged batch, also one that an append which died has left."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.batch}")
        fs, path = file_system(self.spark, self.batch_folder)
        fs.delete(path, True)

    def split(self, batch: DataFrame) -> DataFrame:
        """The rows of (key, record, ...) that are not stored; raises where an id has two records."""
        known = self.rows().withColumnsRenamed({self.key: "_key", "record": "_record"}).hint("merge")
        met = batch.join(known, F.col(self.key) == F.col("_key"), "left")
        odd = met.filter("_record IS NOT NULL AND record <> _record").select(self.key).limit(5).collect()
        if odd:
            raise CheckFailed(f"stored ids come back with another record: {[r[0] for r in odd]}")
        return batch.join(known, F.col(self.key) == F.col("_key"), "left_anti")

    def add(self, keys: DataFrame) -> None:
        """Append (key, record). Rows matched against the ledger are in its buckets, so a bucket gets one file."""
        (
            keys.select(self.key, "record")
            .write.bucketBy(self.buckets, self.key)
            .sortBy(self.key)
            .option("path", self.folder)
            .mode("append")
            .saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)

    def open_mark(self, days: DataFrame) -> str:
        """Note that facts of these days (event_date) are about to be written."""
        mark = f"{self.marks}/{uuid.uuid4().hex}"
        days.select("event_date").distinct().coalesce(1).write.parquet(mark)
        return mark

    def close_mark(self, mark: str) -> None:
        fs, path = file_system(self.spark, mark)
        fs.delete(path, True)

    def recover(self, facts_schema) -> None:
        """Add the ids that appends which died have stored without a ledger row."""
        fs, path = file_system(self.spark, self.marks)
        left = [str(s.getPath()) for s in fs.listStatus(path)] if fs.exists(path) else []
        for mark in left:
            days = self.spark.read.schema("event_date date").parquet(mark)
            first, last = days.agg(F.min("event_date"), F.max("event_date")).first()
            if first is not None:
                stored = self.spark.read.schema(facts_schema).parquet(self.path)
                stored = stored.filter(F.col("event_date").between(F.lit(first), F.lit(last)))
                keyed = stored.select(self.key, record_digest(stored.columns, self.key).alias("record"))
                known = self.rows().select(F.col(self.key).alias("_key")).hint("merge")
                self.add(keyed.dropDuplicates([self.key]).join(known, F.col(self.key) == F.col("_key"), "left_anti"))
            self.close_mark(mark)

    def compact(self) -> int:
        """One file a bucket again, after many appends; returns the ids. Not beside an append."""
        fresh = f"{self.path}/_ledger/keys-{uuid.uuid4().hex}"
        rows = self.rows().dropDuplicates([self.key])
        name = f"{self.name}_{uuid.uuid4().hex[:8]}"
        rows.repartition(self.buckets, self.key).write.bucketBy(self.buckets, self.key).sortBy(self.key).option(
            "path", fresh
        ).option("compression", CODEC).saveAsTable(name)
        n = self.spark.table(name).count()
        fs, old = file_system(self.spark, self.folder)
        _, new = file_system(self.spark, fresh)
        fs.delete(old, True)
        fs.rename(new, old)
        self.spark.sql(f"DROP TABLE {name}")
        self.spark.catalog.refreshTable(self.name)
        return n

    def close(self) -> None:
        """Drop the staged batch and forget the ledger's catalog entry; its files are found again by the next one."""
        self.unstage()
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def unseen(batch: DataFrame, ledger: KeyLedger) -> DataFrame:
    """Of a staged batch with `record`: one row for each id that is not stored yet.

    Rows that repeat an id and what was asked are one request; two requests with one id raise.
    """
    key = ledger.key
    if batch.filter(F.col(key).isNull()).limit(1).count():
        raise CheckFailed(f"facts without {key}")
    clash = batch.groupBy(key).agg(F.min("record").alias("lo"), F.max("record").alias("hi")).filter("lo <> hi")
    odd = clash.select(key).limit(5).collect()
    if odd:
        raise CheckFailed(f"two records with one id: {[r[0] for r in odd]}")
    return ledger.split(batch).dropDuplicates([key])
