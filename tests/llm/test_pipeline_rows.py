"""The pipeline on odd rows: names that the code itself uses, nulls, empty and repeated rows."""

import numpy as np
import pytest

import corpus_pipeline
from modelwatch.llm import ngram_join

NAMES = (
    "row_key _n _d _s _z _w _c _text_digest _id _digest digest keep_id kept group_size kept_row text_digest mix_size mix_row "
    "mix_copy gone_key cls token n size copies part chunk draw votes score doc own label node a b"
).split()


def documents(spark, n):
    rng = np.random.default_rng(n)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(400)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words, 60)) + "."
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
    rows += [
        (900, None, None, None, None),
        (901, "", "en", "src0", 0),
        (902, rows[0][1], None, None, 1),
        (903, rows[1][1] + " one more word.", "en", "src1", 1),
        (None, rows[2][1], "en", "src1", 1),
        (3, rows[3][1], "en", "src0", 1),
        (904, " ".join(rng.choice(words, 20_000)) + ".", "en", "src2", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.selectExpr("*", *[f"concat('{c}', doc_id) AS {c}" for c in NAMES])


def test_stages_leave_other_columns_alone(spark):
    docs = documents(spark, 60).cache()
    before = {(r.doc_id, r.text): tuple(r) for r in docs.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(tuple(r)[5:] == before[r.doc_id, r.text][5:] for r in rows)
        seen.append((name, rows))
        docs = spark.createDataFrame(rows, docs.schema)
    ids = {name: [r.doc_id for r in rows] for name, rows in seen}
    assert 900 not in ids["quality"] and 901 not in ids["quality"] and 904 in ids["quality"]
    assert 902 in ids["exact_dedup"] and 0 not in ids["exact_dedup"] and None not in ids["exact_dedup"]
    assert ids["exact_dedup"].count(3) == 1
    assert 903 not in ids["near_dedup"] and 1 in ids["near_dedup"]
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len(encoded) == len(seen[-1][1]) and all(r.n_tokens == len(r.ids) > 0 for r in encoded)


def test_stages_on_an_empty_table(spark):
    docs = documents(spark, 4).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_shingles_equal_plain_sets(monkeypatch):
    rng = np.random.default_rng(0)
    texts = ["", " ", "a", "A b", "a  b\tc\nd\x0be\x0cf\rg", "x" * 3_000 + " y z", "É é A a", "one two three four five one two three four five"]
    texts += [" ".join(rng.choice(["a", "b", "Cc", "dd"], rng.integers(30))) for _ in range(300)]

    def plain(text):
        w = text.encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    got = [s.tobytes() for s in ngram_join.shingle_sets(texts, 5)]
    assert [len(s) // 8 for s in got] == [len(plain(t)) for t in texts]
    assert len(set(zip(map(plain, texts), got, strict=True))) == len(set(got)) == len(set(map(plain, texts)))
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 64)
    assert [s.tobytes() for s in ngram_join.shingle_sets(texts, 5)] == got


@pytest.mark.parametrize("at_once", [0, 10, ngram_join.LOCAL_LINKS])
def test_components_by_rounds_and_at_once(spark, monkeypatch, at_once):
    monkeypatch.setattr(ngram_join, "LOCAL_LINKS", max(at_once, 10))
    rng = np.random.default_rng(4)
    links = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5), (7, 6)]
    links += [(int(a), int(b)) for a, b in rng.integers(1000, 1100, (60, 2))]
    label = {x: x for pair in links for x in pair}
    while True:
        new = dict(label)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b], label[a], label[b])
        if new == label:
            break
        label = new
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(5)
    got = [(r.node, r.label) for r in ngram_join.components(df, at_once).collect()]
    alone = {x for x in label if all(a == b for a, b in links if x in (a, b))}
    assert dict(got) == {x: y for x, y in label.items() if x not in alone} and len(got) == len(dict(got))
