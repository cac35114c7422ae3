"""Exact deduplication against a persistent digest index, bucketed and sorted by digest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.llm.common import sha256, unused
from modelwatch.session import materialise, shared_path


class DigestIndex:
    """One row per text ever kept: its SHA-256 digest and the document that stands for it.

    A Parquet table of `buckets` buckets by digest, each file sorted by digest, in a folder that
    all executors share. An index is reopened by its folder; adding the same batch again (after a
    failure between two steps, say) changes nothing, since its own rows are named by the index.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = 16, id_type: str = "bigint"):
        self.spark, self.buckets = spark, buckets
        self.folder = folder or shared_path(spark, "digests")
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest STRING, keep_id {id_type}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.folder}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, fresh: DataFrame) -> None:
        """Add (digest, keep_id) rows; each writing task holds whole buckets."""
        (
            fresh.select("digest", "keep_id")
            .repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.folder)
            .mode("append")
            .saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)


def with_digest(docs: DataFrame, text_col: str = "text", name: str = "digest") -> DataFrame:
    """Null counts as empty text; the text is not changed before hashing."""
    return docs.withColumn(name, sha256(F.coalesce(F.col(text_col), F.lit(""))))


def dedupe(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add a batch to the index and tell what became of each row.

    (doc_id, keep_id, group_size, kept, text_sha256), one row per input row. Of equal texts in a
    batch the largest doc_id stays, unless an earlier batch holds the text: then its document
    stays and the whole group goes. group_size counts the batch's rows of that text. Of rows that
    repeat both doc_id and text, one is kept. Null ids stay only if no other row has the text.

    Only digests are shuffled. Rows are first counted by (digest, doc_id), which no group of
    copies can skew; groups are reduced by partial maxima.
    """
    rows = with_digest(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    rows = materialise(rows.groupBy("digest", "doc_id").agg(F.count("*").alias("copies")))
    groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    index.append(groups.join(index.rows().select("digest").hint("merge"), "digest", "left_anti"))
    known = groups.drop("keep_id").join(index.rows().hint("merge"), "digest")
    copy = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    return (
        rows.join(known, "digest")
        .select("doc_id", "keep_id", "group_size", "digest", copy)
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    )


def kept_documents(docs: DataFrame, report: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that `report` keeps, with all their columns.

    Of rows that repeat id and text but differ in other columns, any one stays.
    """
    name, digest = unused(docs, "kept_row"), unused(docs, "text_digest")
    wanted = report.filter("kept").select(F.struct("doc_id", "text_sha256").alias(name))
    rows = with_digest(docs, text_col, digest)
    same = F.col(id_col).eqNullSafe(F.col(f"{name}.doc_id")) & (F.col(digest) == F.col(f"{name}.text_sha256"))
    return rows.join(wanted, same, "left_semi").dropDuplicates([id_col, digest]).select(*docs.columns)
