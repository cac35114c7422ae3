"""Quality classifier from weak labels.

Overlapping heuristics (labelling functions) vote good, bad or nothing on each document. The votes
of the whole corpus are counted by pattern; expectation-maximisation over these counts estimates how
often each heuristic votes what on good and on bad documents, without any true label, and gives each
pattern a posterior. Documents of a bounded sample, weighted by their posteriors, train a linear
scorer on hashed features; it scores every whole text and decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import PIECE_CHARS, pieces

FEATURES = 1_024
#: Documents that train the scorer, those with the smallest hash of (id, text length).
TRAIN_ROWS = 8_192
EM_ROUNDS = 60
#: Rows of a block of the scorer's fit.
FIT_ROWS = 1_024
ABSTAIN, BAD, GOOD = 0, 1, 2

#: Character classes: blank, line end, lower, upper, other letter, digit, stop, comma-like, bar, symbol.
BLANK, LINE, LOWER, UPPER, LETTER, DIGIT, STOP, COMMA, BAR, SYMBOL = range(10)


@dataclass(frozen=True)
class QualityModel:
    votes: np.ndarray  # heuristic x (bad, good) x vote: probability
    prior: float
    weights: np.ndarray
    bias: float


_CLASSES: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    if not _CLASSES:

        def kind(c: str) -> int:
            if c in "\n\r\x0b\x0c  ":
                return LINE
            if c.isspace():
                return BLANK
            if c.isalpha():
                return UPPER if c.isupper() else LOWER if c.islower() else LETTER
            if c.isnumeric():
                return DIGIT
            return STOP if c in ".?。！？" else COMMA if c in ",;:'\"()-’“”«»" else BAR if c == "|" else SYMBOL

        _CLASSES.append(np.fromiter((kind(chr(c)) for c in range(0x110000)), np.uint8, 0x110000))
    return _CLASSES[0]


def measures(text: str) -> tuple[dict[str, float], np.ndarray]:
    """What the heuristics look at, and the character classes of the text."""
    kinds = _class_table()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    n = np.bincount(kinds, minlength=10)
    words = text.split()
    count = max(1, len(words))
    solid = max(1, len(kinds) - n[BLANK] - n[LINE])
    letters = max(1, n[LOWER] + n[UPPER] + n[LETTER])
    ends = (kinds == STOP) & np.r_[kinds[1:] <= LINE, True] if len(kinds) else np.zeros(0, bool)
    marked = (kinds >= BAR) & np.r_[kinds[1:] <= LINE, True] if len(kinds) else ends
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return {
        "words": len(words),
        "symbols": (n[SYMBOL] + n[BAR]) / solid,
        "upper": n[UPPER] / letters,
        "marked": float(marked.sum()) / count,
        "bars": n[BAR] / count,
        "repeats": max(0, again - 1) / count,
        "variety": len(set(words)) / (2 * count) ** 0.5,
        "stops": float(ends.sum()) / count,
        "length": solid / count,
        "digits": n[DIGIT] / solid,
    }, kinds


def votes(m: dict[str, float]) -> list[int]:
    """One vote for each heuristic. Most know one kind of junk and are silent on all else."""

    def bad(if_bad: bool) -> int:
        return BAD if if_bad else ABSTAIN

    some = m["words"] >= 8
    plain = m["symbols"] < 0.02 and m["repeats"] < 0.05
    ended = m["stops"] > 0.02 and (m["stops"] < 0.35 or not some)
    return [
        bad(m["symbols"] > 0.06),
        bad(some and m["upper"] > 0.5),
        bad(m["marked"] > 0.15),
        bad(m["bars"] > 0.1),
        bad(some and m["repeats"] > 0.2),
        bad(m["words"] >= 20 and m["variety"] < 1.5),
        bad(m["digits"] > 0.5),
        bad(m["length"] > 20),
        GOOD if plain and (m["upper"] < 0.3 or not some) else ABSTAIN,
        GOOD if plain and ended else ABSTAIN,
    ]


HEURISTICS = len(votes(dict.fromkeys("words symbols upper marked bars repeats variety stops length digits".split(), 0)))


def features(m: dict[str, float], kinds: np.ndarray) -> np.ndarray:
    """Hashed features: roots of class 4-gram shares, and binned measures."""
    out = np.zeros(FEATURES, np.float32)
    if len(kinds) >= 4:
        k = kinds.astype(np.uint64)
        gram = ((k[:-3] * np.uint64(10) + k[1:-2]) * np.uint64(10) + k[2:-1]) * np.uint64(10) + k[3:]
        at = ((gram + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)
        out += np.sqrt(np.bincount(at.view(np.int64), minlength=FEATURES) / len(k))
    for i, value in enumerate(m.values()):
        step = int(np.log2(1 + value) * 8)
        out[(0x9E3779B97F4A7C15 * (10_007 * (i + 1) + step) % (1 << 64)) >> 54] += 0.5
    return out


def learn_votes(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, float]:
    """EM over (votes, count): probability of each vote given bad or good, and the share of good.

    Starts from the majority of the votes. Heuristics are taken as independent given the class.
    """
    table = np.zeros((HEURISTICS, 2, 3)) + 1 / 3
    if not patterns:
        return table, 0.5
    seen = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    lead = (seen == GOOD).sum(axis=1) - (seen == BAD).sum(axis=1)
    good = 1 / (1 + np.exp(-1.0 * lead))
    prior = 0.5
    for _ in range(EM_ROUNDS):
        for j in range(HEURISTICS):
            for y, w in enumerate((n * (1 - good), n * good)):
                counts = np.bincount(seen[:, j], w, 3) + 1
                table[j, y] = counts / counts.sum()
        prior = float(((n * good).sum() + 1) / (n.sum() + 2))
        good = posterior(table, prior, seen)
    return table, prior


def posterior(table: np.ndarray, prior: float, seen: np.ndarray) -> np.ndarray:
    """Probability of good for rows of votes."""
    logs = np.log(table)
    odds = np.log(prior / (1 - prior)) + sum(
        logs[j, 1, seen[:, j]] - logs[j, 0, seen[:, j]] for j in range(table.shape[0])
    )
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient descent; classes weigh the same.

    x stays as it is, in single precision; a round goes through it in blocks of rows.
    """
    width = x.shape[1] if len(x) else FEATURES
    weights = np.zeros(width + 1)
    if not len(x):
        return weights[:-1], 0.0
    mass = np.where(y >= 0.5, 1 / max(1e-9, (y >= 0.5).mean()), 1 / max(1e-9, (y < 0.5).mean())) / len(x) / 2
    blocks = [slice(at, at + FIT_ROWS) for at in range(0, len(x), FIT_ROWS)]
    squares = np.concatenate([np.einsum("ij,ij->i", x[b], x[b]) for b in blocks]) + 1.0
    step = 1 / (0.25 * (mass * squares).sum() + ridge)
    ahead, last = weights.copy(), weights
    for t in range(rounds):
        slope = ridge * ahead
        single = ahead[:-1].astype(np.float32)
        for b in blocks:
            p = 1 / (1 + np.exp(-np.clip(x[b] @ single + ahead[-1], -50, 50)))
            off = mass[b] * (p - y[b])
            slope[:-1] += off.astype(np.float32) @ x[b]
            slope[-1] += off.sum()
        weights = ahead - step * slope
        ahead, last = weights + t / (t + 3) * (weights - last), weights
    return weights[:-1], float(weights[-1])


def _voted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in pieces(batches):
        found = [votes(measures(t)[0]) for t in frame["text"]]
        yield pd.DataFrame({"votes": ["".join(map(str, v)) for v in found]})


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in pieces(batches):
        found = [measures(t) for t in frame["text"]]
        yield pd.DataFrame(
            {
                "votes": ["".join(map(str, votes(m))) for m, _ in found],
                "features": [features(m, k).tobytes() for m, k in found],
            }
        )


def learn_quality(docs: DataFrame, id_col="doc_id", text_col="text", train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Vote statistics over all rows, then the scorer from `train_rows` rows (exactly bounded).

    The driver gets one count for each pattern of votes (3 to the number of heuristics at most) and
    the sample's features (4 KiB a row).
    """
    rows = docs.select(
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.xxhash64(F.col(id_col), F.length(F.col(text_col))).alias("draw"),
    )
    counts = rows.select("text").mapInPandas(_voted, "votes string").groupBy("votes").count().collect()
    table, prior = learn_votes(sorted((tuple(map(int, r.votes)), r["count"]) for r in counts))
    drawn = rows.select("draw").orderBy("draw").limit(train_rows)
    cutoff = drawn.agg(F.max("draw")).first()[0]
    if cutoff is None:
        return QualityModel(table, prior, np.zeros(FEATURES), 0.0)
    sample = rows.filter(F.col("draw") <= cutoff).orderBy("draw", F.sha2("text", 256)).limit(train_rows)
    sample = sample.select("text").mapInPandas(_featured, "votes string, features binary").toArrow().combine_chunks()
    sample = sample.sort_by([("votes", "ascending"), ("features", "ascending")])
    x = np.empty((sample.num_rows, FEATURES), np.float32)
    for i, row in enumerate(sample["features"]):
        x[i] = np.frombuffer(row.as_buffer(), np.float32)
    seen = np.array([[int(v) for v in row.as_py()] for row in sample["votes"]]).reshape(-1, HEURISTICS)
    del sample
    weights, bias = fit_scorer(x, posterior(table, prior, seen))
    return QualityModel(table, prior, weights, bias)


def score_quality(
    docs: DataFrame, model: QualityModel, id_col="doc_id", text_col="text", least: float = 0.5, keep_columns: bool = False
) -> DataFrame:
    """(doc_id, weak_label, score, kept) for every row, or with `keep_columns` the kept rows of `docs`.

    score: the linear scorer's probability of good quality; kept where it reaches `least`. weak_label:
    posterior of the votes alone. Null and empty texts have no quality: score 0, not kept. One narrow
    pass; the model has a fixed size.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(texts) -> tuple[np.ndarray, np.ndarray]:
        m = sent.value
        odds, seen, none = np.zeros(len(texts)), [], np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            found, kinds = measures(text)
            odds[i] = features(found, kinds) @ m.weights + m.bias
            seen.append(votes(found))
            none[i] = found["words"] == 0
        weak = posterior(m.votes, m.prior, np.array(seen).reshape(-1, HEURISTICS))
        score = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        return np.where(none, 0.0, weak), np.where(none, 0.0, score)

    if keep_columns:
        place = docs.columns.index(text_col)

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = pc.fill_null(pc.utf8_length(batch.column(place)), 0).to_numpy().cumsum() // PIECE_CHARS
                cuts = [0, *(sizes[1:] != sizes[:-1]).nonzero()[0] + 1, batch.num_rows]
                for start, end in zip(cuts, cuts[1:], strict=False):
                    part = batch.slice(start, end - start)
                    good = scored(pc.fill_null(part.column(place), "").to_pylist())[1] >= least
                    yield part.filter(pa.array(good))

        return docs.mapInArrow(kept, docs.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pieces(batches):
            weak, score = scored(frame["text"])
            yield frame.drop(columns="text").assign(weak_label=weak, score=score, kept=score >= least)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, weak_label double, score double, kept boolean")
