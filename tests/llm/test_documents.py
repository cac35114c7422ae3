"""Operators on documents against brute-force versions, and their defined results on odd input."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from modelwatch.llm import exact_dedup, language, mixing, ngram_join, pieces, quality, sharding

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"word{i % 977}" for i in range(20_000))
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "ÀB c d e"),
    (5, LONG),
    (6, LONG),
    (6, LONG),
    (None, "no id at all here now"),
    (7, "</s> <s> ▁▁x  y\0 😀 １"),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_components(docs):
    sets = {}
    for i, text in docs:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            k = len(sets[x] & sets[y])
            if x < y and k and 100 * k >= 75 * (len(sets[x]) + len(sets[y]) - k):
                a, b = sorted((find(x), find(y)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("most", [1, 4])
def test_ngram_join_equals_brute_force(make, most):
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    docs = []
    for i in range(160):
        w = list(base) if i % 2 else [f"w{rng.randrange(400)}" for _ in range(60)] + base[20:60]
        for _ in range(rng.randrange(8)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10_000)}"
        docs.append((i, " ".join(w)))
    docs += [(1000, None), (1001, ""), (1002, "two words"), (1003, "TWO\x0bwords"), (1004, docs[3][1])]
    got = ngram_join.near_groups(make(docs), most_matches=most).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs)


def test_ngram_join_odd_input(make):
    got = ngram_join.near_groups(make(ODD)).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    assert {r.component_id for r in got if r.doc_id == 2} == {2}
    assert ngram_join.near_groups(make([])).count() == 0


def test_split_runs_keep_entries(monkeypatch, make):
    monkeypatch.setattr(ngram_join, "RUN_ROWS", 4)
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    docs = [(i, text + f" {i}") for i in range(30)]
    got = ngram_join.near_groups(make(docs)).collect()
    assert {r.component_id for r in got} == {0}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(40, 41), (41, 40)], "a bigint, b bigint")
    got = {r.node: r.label for r in ngram_join.components(links).collect()}
    assert got == {i: 0 for i in range(31)} | {40: 40, 41: 40}


def test_exact_dedup_and_second_batch(spark, make):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    docs = make(ODD)
    got = exact_dedup.dedupe(docs, index).collect()
    assert len(got) == len(ODD)
    kept = sorted((r.doc_id or -1) for r in got if r.kept)
    assert kept == [-1, 2, 3, 4, 6, 7]
    assert {r.group_size for r in got if r.text_sha256 == sha(LONG)} == {3}
    assert sorted((r.doc_id or -1) for r in exact_dedup.kept_documents(docs, exact_dedup.dedupe(docs, index)).collect()) == kept
    later = exact_dedup.dedupe(make([(90, LONG), (91, "new"), (92, "new")]), index).collect()
    assert [(r.doc_id, r.keep_id, r.kept) for r in sorted(later)] == [(90, 6, False), (91, 92, False), (92, 92, True)]
    assert index.rows().count() == 7
    assert exact_dedup.dedupe(make([]), index).count() == 0


def least_capacity(sizes, shards):
    def fits(c):
        used, load = 1, 0
        for s in sizes:
            if s > c:
                return False
            if load + s > c:
                used, load = used + 1, 0
            load += s
        return used <= shards

    return next(c for c in range(-(-sum(sizes) // shards), sum(sizes) + 1) if fits(c))


def test_minimax_cuts_equal_linear_search(spark):
    rng = random.Random(2)
    rows = sorted((rng.randrange(-(1 << 63), 1 << 63), rng.randrange(1, 300)) for _ in range(500))
    groups = spark.createDataFrame(rows, "key bigint, size bigint")
    cuts = sharding.minimax_cuts(groups, 7)
    loads = collections.Counter()
    for key, size in rows:
        loads[sum(key >= c for c in cuts)] += size
    assert max(loads.values()) == least_capacity([s for _, s in rows], 7)


def test_sharding_odd_input(make):
    rows = sharding.shard_documents(make(ODD + [(i, f"t{i}") for i in range(10, 300)]), 5).collect()
    slots, groups = collections.defaultdict(list), collections.defaultdict(set)
    texts = dict(ODD) | {i: f"t{i}" for i in range(10, 300)}
    for r in rows:
        slots[r.shard].append(r.slot)
        groups[texts[r.doc_id] or ""].add(r.shard)
        assert r["size"] == len((texts[r.doc_id] or "").encode()) + 8
        assert r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in groups.values())
    assert len(groups[LONG]) == 1 and set(slots) == set(range(5))
    assert sharding.shard_documents(make([]), 5).count() == 0
    assert sharding.shard_documents(make([(1, None)]), 5).first().slot == 0


def test_pieces_equal_library(make):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    letters = "ab eéß▁\n漢😀１\0the"
    texts = [t for _, t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["a" * 3000, "ab" * 999 + "aab", "漢" * 50, " " * 40]
    rows = pieces.encode_documents(make(list(enumerate(texts))), MODEL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "")
        assert r.ids == ids
        assert r.decoded == library.decode(ids)
    assert pieces.encode_documents(make([]), MODEL).count() == 0


def test_pieces_decode_any_ids():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    with open(MODEL, "rb") as file:
        model = pieces.PieceModel(file.read())
    rng = np.random.default_rng(4)
    for _ in range(50):
        ids = rng.integers(300, model.size, 20)
        assert model.decode(ids) == library.decode(ids.tolist())


def test_mixing_targets_and_bounds(make):
    rng = random.Random(6)
    docs = [(i, " ".join("x" * 1 for _ in range(rng.randrange(1, 60))), f"s{i % 5}" if i % 6 else None) for i in range(3000)]
    docs += [(5000, None, "s1"), (5001, "", "empty"), (5002, "twice said", "s1"), (5002, "twice said", "s1")]
    df = make(docs, "doc_id bigint, text string, source string")
    rows = mixing.mix(df).collect()
    assert len(rows) == len(docs) and sorted(rows, key=str) == sorted(mixing.mix(df).collect(), key=str)
    sizes = collections.Counter()
    for _, text, source in docs:
        sizes[source] += len((text or "").split())
    order = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        left = total - sum(fixed.values())
        free = sum(w for s, w in weight.items() if s not in fixed)
        over = [s for s in order if s not in fixed and weight[s] * left / free > 2 * sizes[s]]
        if not over:
            break
        fixed |= {s: 2.0 * sizes[s] for s in over}
    want = {s: fixed.get(s, weight[s] * left / free) for s in order}
    taken = collections.Counter()
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r["size"]
    assert all(abs(taken[s] - want[s]) <= 30 for s in order)
    copies = {(r.doc_id, r.source): r.copies for r in rows}
    mixed = collections.Counter(r.doc_id for r in mixing.mixed_documents(df, mixing.mix(df)).collect())
    for (i, _), n in copies.items():
        assert mixed[i] == n * (2 if i == 5002 else 1)
    assert mixing.mix(make([], "doc_id bigint, text string, source string")).count() == 0


def test_pivotal_rounding_keeps_expectation():
    rng = random.Random(8)
    sizes, parts = [9, 7, 4, 2, 1], [0.3, 0.6, 0.5, 0.8, 0.1]
    mean = np.mean([mixing.round_pivotal(sizes, parts, [rng.random() for _ in sizes])[0] for _ in range(20_000)], axis=0)
    assert np.abs(mean - parts).max() < 0.02


def test_language_mixture(make):
    words = {"x": "alpha beta gamma delta", "y": "uno dos tres cuatro", "z": "eins zwei drei vier"}
    rng = random.Random(1)

    def text(lang, n=30):
        return " ".join(rng.choice(words[lang].split()) for _ in range(n))

    train = [(i, text(lang), lang) for i, lang in enumerate("xyz" * 30)] + [(99, "noise", None), (98, None, "x")]
    schema = "doc_id bigint, text string, lang string"
    model = language.learn_languages(make(train, schema))
    docs = [(0, text("x")), (1, text("y", 3)), (2, text("z")), (3, None), (4, "12 34 !"), (5, ""), (6, text("x", 60) + " " + text("z", 20))]
    got = {r.doc_id: r for r in language.predict_languages(make(docs), model).collect()}
    assert [got[i].lang_pred for i in range(7)] == ["x", "y", "z", "und", "und", "und", "x"]
    assert got[3].score == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert got[6].n_languages == 2 and 0.6 < got[6].score < 0.9
    none = language.learn_languages(make([], schema))
    assert {r.lang_pred for r in language.predict_languages(make(docs), none).collect()} == {"und"}


def test_quality_against_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = quality.score_quality(docs, quality.learn_quality(docs)).collect()
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1]
    bad = [r.kept for r in rows if labels.get(r.doc_id) == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.05


def test_quality_odd_input(make):
    docs = make(ODD)
    model = quality.learn_quality(docs)
    rows = quality.score_quality(docs, model).collect()
    assert len(rows) == len(ODD) and not any(r.kept for r in rows if r.doc_id in (1, 2, 3))
    kept = quality.score_quality(docs, model, keep_columns=True)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)
    empty = make([])
    assert quality.score_quality(empty, quality.learn_quality(empty)).count() == 0


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.7
    rows = []
    for j in range(quality.HEURISTICS):
        right = rng.random(len(good)) < 0.75 + 0.02 * j
        rows.append(np.where(right == good, quality.GOOD, quality.BAD))
    patterns = collections.Counter(map(tuple, np.array(rows).T.tolist()))
    table, prior = quality.learn_votes(sorted(patterns.items()))
    assert prior == pytest.approx(0.7, abs=0.02)
    for j in range(quality.HEURISTICS):
        assert table[j, 1, quality.GOOD] == pytest.approx(0.75 + 0.02 * j, abs=0.02)
