"""Alignment of two tokenisations against a plain two-finger walk."""

import collections
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from modelwatch.llm import alignment

MODELS = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def tokens():
    with open(MODELS[0], encoding="utf-8") as a, open(MODELS[1], "rb") as b:
        return alignment.loaded(a.read(), b.read())


def walk(a, b):
    """Overlaps and shared ends of two lists of byte ends, one step at a time."""
    links, shared, i, j = [], [], 0, 0
    while i < len(a) and j < len(b):
        links.append((i, j))
        if a[i] == b[j]:
            shared.append((i, j))
            i, j = i + 1, j + 1
        elif a[i] < b[j]:
            i += 1
        else:
            j += 1
    return links, shared


def test_pieces_equal_a_plain_walk():
    rng = random.Random(2)
    for steps in (1, 2, 3, 7, 64):
        for n in (1, 2, 5, 40, 300):
            a, b = (sorted(rng.sample(range(1, n), rng.randrange(n)) + [n]) for _ in range(2))
            links, shared = walk(a, b)
            got = alignment.overlaps(np.array(a), np.array(b), steps)
            assert list(zip(got[0], got[1], strict=True)) == links
            assert list(zip(got[2], got[3], strict=True)) == shared
    assert [len(x) for x in alignment.overlaps(np.zeros(0, int), np.zeros(0, int))] == [0] * 4


def test_cut_points_follow_the_merge():
    a, b = np.array([2, 4, 4, 9]), np.array([1, 4, 9, 9])
    merged = sorted([(v, 0) for v in a] + [(v, 1) for v in b])
    want = [sum(side == 0 for _, side in merged[:d]) for d in range(9)]
    assert alignment.cut_points(a, b, np.arange(9)).tolist() == want


TEXTS = [
    "The quick brown fox, the quick brown fox.",
    "<|endoftext|> and </s> are <unk> plain text",
    "Ünïcödé 漢字かな交じり文 🙂🙂 ‍﻿",
    "tabs\tand\n\nnewlines   and  spaces ",
    " leading space",
    "a▁b has a mark",
    "nul \x00 byte",
    "x" * 3_000 + " " + "word " * 2_000,
    "",
    None,
    "The quick brown fox, the quick brown fox.",
]


def plain(texts):
    """What the operator should say of each text, from the libraries and a plain walk."""
    tokenizer = Tokenizer.from_file(MODELS[0])
    tokenizer.encode_special_tokens = True
    processor = sentencepiece.SentencePieceProcessor(model_file=MODELS[1])
    symbols = alignment.byte_symbols()
    names = {i: p for p, i in tokenizer.get_vocab().items()}
    out, counts = [], collections.Counter()
    for text in texts:
        a = tokenizer.encode(" " + (text or ""), add_special_tokens=False).ids
        b = processor.encode(text or "")
        shown_a = [bytes(symbols[c] for c in names[i]) for i in a]
        pieces = [processor.id_to_piece(i) for i in b]
        shown_b = [
            bytes([int(p[3:5], 16)]) if processor.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in zip(b, pieces, strict=True)
        ]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(shown_a) != raw or b"".join(shown_b) != raw:
            a, b, shown_a, shown_b = [], [], [], []
        links, shared = walk(np.cumsum([len(s) for s in shown_a]), np.cumsum([len(s) for s in shown_b]))
        pairs = [(a[i], b[j]) for i, j in links]
        counts.update(pairs)
        groups, i0, j0 = [], 0, 0
        for i, j in shared:
            groups.append(",".join(map(str, a[i0 : i + 1])) + "|" + ",".join(map(str, b[j0 : j + 1])))
            i0, j0 = i + 1, j + 1
        out.append((len(a), len(b), len(groups), pairs, ";".join(groups)))
    highest = collections.defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return [
        (n_a, n_b, n, len(pairs), sum(counts[p] == highest[p[1]] for p in pairs), sum(counts[p] for p in pairs), groups)
        for n_a, n_b, n, pairs, groups in out
    ]


@pytest.mark.parametrize("chunk_chars", [alignment.CHUNK_CHARS, 50])
def test_documents_equal_a_plain_walk(make, monkeypatch, chunk_chars):
    monkeypatch.setattr(alignment, "CHUNK_CHARS", chunk_chars)
    docs = make(list(enumerate(TEXTS))).selectExpr("*", "1 AS pair", "2 AS chunk", "3 AS groups", "4 AS kind").repartition(3)
    aligned = alignment.align_documents(docs, *MODELS)
    table = alignment.written(aligned, shown=F.col("groups"))
    rows = table.filter("row IS NOT NULL").join(alignment.link_statistics(table), "row", "left").collect()
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.shown) for r in rows}
    assert len(rows) == len(TEXTS) and got == dict(enumerate(plain(TEXTS)))
    assert got[5][0] == 0 and got[8] == got[9] == (0, 0, 0, 0, 0, 0, "")


def test_empty_table_and_null_ids(make):
    docs = make([(None, "one two"), (None, "one two"), (1, None)])
    table = alignment.written(alignment.align_documents(docs, *MODELS))
    rows = table.filter("row IS NOT NULL").join(alignment.link_statistics(table), "row", "left").collect()
    assert sorted((str(r.doc_id), r.n_a > 0, r.count_sum > 0) for r in rows) == [("1", False, False)] + [("None", True, True)] * 2
    empty = alignment.written(alignment.align_documents(docs.limit(0), *MODELS))
    assert empty.count() == 0 and alignment.link_statistics(empty).count() == 0


def test_units_give_the_models_ids(tokens):
    tokenizer = Tokenizer.from_file(MODELS[0])
    tokenizer.encode_special_tokens = True
    processor = sentencepiece.SentencePieceProcessor(model_file=MODELS[1])
    rng = random.Random(6)
    parts = ["word", "Wörter", "it's", "we'll", "1½२", "!?—", "漢字", " ", "  ", "\n", "\t ", "\x1c", "\u3000", "\u00a0", "\u2028", ".", "x", "▁"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(1500)]
    for some in (texts, texts):
        (a, b), _ = tokens.encode(some)
        assert [x.tolist() for x in a] == [tokenizer.encode(" " + t, add_special_tokens=False).ids if t else [] for t in some]
        assert [x.tolist() for x in b] == [processor.encode(t) for t in some]
