"""Url rules, chat formatting, top-k search and the pipeline."""

import collections
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from modelwatch.llm import chat, exact_dedup, queries, topk, url_filter


def test_url_rules(spark):
    urls = [
        None,
        "",
        "no scheme/a",
        "http://",
        "HTTP://WWW.Example.NET/en/x?y#z",
        "http://net/",
        "http://net",
        "http://a.internet/",
        "https://example.com/de/1",
        "https://example.com/DE/1",
        "ftp://x.org/fr/?q=://net/",
        "http://example.com:80/de/",
        "http://" + "a." * 2000 + "net/" + "p" * 5000,
        "http://net/",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").selectExpr("*", "1 AS host", "2 AS row")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert len(got) == len(urls)
    hits = {4: ("example.net/en/", "allow"), 5: ("net/", "block"), 8: ("example.com/de/", "block")}
    hits |= {10: ("org/fr/", "allow"), 12: ("net/", "block"), 13: ("net/", "block")}
    assert got == {i: hits.get(i, (None, "allow")) for i in range(len(urls))}
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_chat_round_trip(spark):
    rng = random.Random(4)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<\\s>", "[\\INST]", " ", "\n", "é", "x", " [/INST] "]
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 150 if conv == 0 else 9)):
            role = rng.choice(["user", "assistant", "system", "</s>[/INST] "])
            rows.append((conv, turn, role, "".join(rng.choice(parts) for _ in range(rng.randrange(9)))))
    rows += [(50, 0, None, None), (51, None, "assistant", "t"), (51, 0, "user", "u"), (52, 0, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    turns = turns.selectExpr("*", "1 AS chunk", "2 AS t")
    formatted = chat.format_conversations(turns).select(
        "*", chat.read_turns(F.col("stream")).alias("read"), chat.read_replies(F.col("stream"), F.col("spans")).alias("loss")
    )
    read, loss = collections.defaultdict(list), collections.defaultdict(list)
    for r in sorted(formatted.collect(), key=lambda r: (r.conv_id, -1 if r.chunk is None else r.chunk)):
        read[r.conv_id] += [tuple(t) for t in r.read]
        loss[r.conv_id] += r.loss
    want = collections.defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1])):
        want[conv].append((role or "", text or ""))
    assert read == want
    assert loss == {c: [x for role, x in t if role == "assistant"] for c, t in want.items()}
    plain = chat.format_conversations(turns)
    texts = chat.example_texts(plain).collect()
    spans = {(r.conv_id, r.target_start): r for r in chat.examples(plain).collect()}
    assert len(texts) == len(spans) == sum(role == "assistant" for t in want.values() for role, _ in t)
    for r in texts:
        assert len(r.context) == spans[r.conv_id, r.target_start].context_chars
        assert len(r.target) == spans[r.conv_id, r.target_start].target_chars
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=12).tolist()) for i in range(400)]
    vectors += [(400, None), (401, [None, 1.0]), (402, [float("nan")] * 12), (403, [float("inf")]), (None, [1.0] * 12)]
    vectors += [(404, vectors[7][1]), (405, vectors[7][1]), (405, vectors[7][1]), (450, [])]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS score", "2 AS v")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()
    good = []
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, [int(np.floor(float(np.float32(x)) * 256)) for x in v]))
    want = set()
    for q, v in {i: v for i, v in good if i % 50 == 0}.items():
        ranked = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in good if i != q)[:5]
        want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(ranked, 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df.filter("vec_id < 3"), F.col("vec_id") == 0).count() == 2


def test_pipeline_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "mix", "encode"]
    stage = dict(corpus_pipeline.STAGES)
    unique = stage["exact_dedup"](spark, docs, sf_dir)
    largest = {}
    for r in docs.collect():
        largest[r.text] = max(r.doc_id, largest.get(r.text, -1))
    assert unique.columns == docs.columns
    assert sorted(r.doc_id for r in unique.collect()) == sorted(largest.values())
    near = stage["near_dedup"](spark, docs, sf_dir)
    labels = {r.doc_id: r.component_id for r in queries.op8_ngram_join(spark, sf_dir).collect()}
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, c in labels.items() if i == c)
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in out} <= {r.doc_id for r in docs.collect()}
    assert all(r.n_tokens == len(r.ids) for r in out)


def test_index_survives_a_new_session_object(spark):
    index = exact_dedup.DigestIndex(spark, buckets=2)
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id bigint, text string")
    assert exact_dedup.dedupe(docs, index).filter("kept").count() == 1
    again = exact_dedup.DigestIndex(spark.newSession(), folder=index.folder, buckets=2)
    assert [r.digest for r in again.rows().collect()] == [hashlib.sha256(b"a").hexdigest()]
