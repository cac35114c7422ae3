"""From raw documents to encoded training text, stage by stage.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and gives the documents that
go on, with the columns of documents; the last gives ids. Stages are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.llm import exact_dedup, mixing, ngram_join, pieces, quality
from modelwatch.llm.common import table, unused
from modelwatch.session import shared_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on this very input, accepts.

    Null and empty texts have no quality and go. Rows that repeat are decided alike; a very long text is
    measured whole; further columns, whatever their names, stay as they are; an empty table stays empty.
    """
    return quality.score_quality(docs, quality.learn_quality(docs), keep_columns=True)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id.

    Null and empty texts are equal. A null id stays only if no other row has its text; of rows that
    repeat id and text one stays. Long texts count whole; further columns stay as they are.
    """
    report = exact_dedup.dedupe(docs, exact_dedup.DigestIndex(spark))
    return exact_dedup.kept_documents(docs, report)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id; ids may be null or repeat.

    Null and empty texts are near nothing and stay. Rows that repeat id and text stay or go together.
    Long texts count whole; further columns stay as they are; an empty table stays empty.
    """
    gone = ngram_join.near_copies(docs)
    key = unused(docs, "gone_key")
    gone = gone.withColumnRenamed("row_key", key)
    return docs.join(gone, ngram_join.row_key("doc_id", "text") == F.col(key), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Texts without words are taken by the same rule. A null source is a source; rows that repeat are
    taken alike; further columns stay as they are; an empty table stays empty.
    """
    return mixing.mixed_documents(docs, mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): one row for each copy that the mix takes.

    Null and empty texts have no ids; long texts are encoded whole; further columns are not read.
    """
    out = pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("encode", encode),
]

#: Expectation-maximisation and random rounding have no SQL form; tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            folder = shared_path(spark, f"pipeline-{name}")
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
    return docs
