"""Registered queries of this subpackage, with SQL twins where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.llm import alignment, chat, exact_dedup, language, mixing, ngram_join, pieces, pq_dedup, quality
from modelwatch.llm import sharding, topk, url_filter, whitening
from modelwatch.llm.common import sha256, table

#: Fixed values of the url query's contract: host, path, verdict.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
#: Fixed value of the chat query's contract: the text of both rows of conversation -1.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes, equal texts together."""
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), 24)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision of the quality classifier for each document."""
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.learn_quality(docs))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of each document."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    out = pieces.encode_documents(table(spark, sf_dir, "documents"), model)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against an index that starts empty."""
    return exact_dedup.dedupe(table(spark, sf_dir, "documents"), exact_dedup.DigestIndex(spark))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of each document, learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    model = language.learn_languages(docs.filter(~held_out))
    out = language.predict_languages(docs, model, carry=held_out)
    return out.select("doc_id", F.col("carried").alias("held_out"), "lang_pred", "score", "n_languages")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each page's url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets are 75 percent alike."""
    return ngram_join.near_groups(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its written examples and their targets."""
    extra = spark.sql(
        "SELECT * FROM VALUES (-1L, 0L, 'user'), (-1L, 1L, 'assistant') AS t (conv_id, turn, role)"
    ).withColumn("text", F.lit(CONTROL_TEXT))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.read_examples(chat.format_conversations(turns))
    return read.select(
        "conv_id",
        "n_turns",
        sha256(F.col("lines")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        sha256(F.col("loss")).alias("loss_sha256"),
        "formatted_chars",
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    out = mixing.mix(table(spark, sf_dir, "documents"))
    taken = F.col("size") * F.col("copies")
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of vectors of one label whose cosine is 0.93 or more."""
    return pq_dedup.near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every vector."""
    out, model, error = whitening.whiten(table(spark, sf_dir, "embeddings"), 4)
    explained = F.array(*[F.lit(e).cast("double") for e in model.explained]).cast("array<double>")
    return out.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers align in each document, and how usual its links are."""
    models = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    aligned = alignment.align_documents(table(spark, sf_dir, "documents"), *models)
    digest = F.when(F.col("groups") == "", "").otherwise(sha256(F.col("groups")))
    aligned = alignment.written(aligned, groups_sha256=digest)
    sums = alignment.link_statistics(aligned)
    out = aligned.filter("row IS NOT NULL").join(sums, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality": op2_quality,
    "op3_pieces": op3_pieces,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_language": op5_language,
    "op6_url_filter": op6_url_filter,
    "op7_top_k": op7_top_k,
    "op8_ngram_join": op8_ngram_join,
    "op9_chat": op9_chat,
    "op10_mixing": op10_mixing,
    "op11_near_vectors": op11_near_vectors,
    "op12_whitening": op12_whitening,
    "op13_alignment": op13_alignment,
}

ORACLES = {
    "op4_exact_dedup": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g USING (text)""",
    "op6_url_filter": """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
           FROM pages),
s AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
h AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM s),
r(rule_host, rule_path, rule_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
    ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
j AS (SELECT h.*, rule_host || rule_path AS rule, rule_verdict,
             row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS n
      FROM h LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM j WHERE n = 1""",
    "op7_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS v
           FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_ngram_join": r"""
WITH RECURSIVE d AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY ALL),
e AS MATERIALIZED (
    SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
l AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
c AS (SELECT x AS node, x AS low FROM l UNION SELECT l.y, c.low FROM c JOIN l ON l.x = c.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.low, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(low) AS low FROM c GROUP BY node) m ON m.node = d.doc_id""",
    "op11_near_vectors": """
WITH RECURSIVE v AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS MATERIALIZED (
    SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
c AS (SELECT x AS node, x AS low FROM e UNION SELECT e.y, c.low FROM c JOIN e ON e.x = c.node),
m AS (SELECT node, min(low) AS low FROM c GROUP BY node),
n AS (SELECT x, count(*) AS n FROM e GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(low, vec_id) AS component_id, coalesce(low, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN m ON m.node = vec_id""",
}
