"""Language identification by multilingual mixture inference.

Each language is a distribution over hashed character trigrams, learnt by counting. A document's
trigrams come from a mixture of languages: expectation-maximisation estimates the proportions, and
languages leave the mixture, smallest first, while a likelihood penalised by the number of languages
improves. The language with the largest proportion is the prediction, the proportion its score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import pieces

BUCKETS = 1 << 14
SMOOTHING = 0.1
ROUNDS, MORE_ROUNDS = 10, 4
#: Trigrams overlap, so their count overstates the evidence; log-likelihoods are scaled by this.
EVIDENCE = 1 / 3
#: The model takes 128 KiB a language on the driver and in each task.
MOST_LANGUAGES = 1_000
#: Rows of the mixture that are worked on at once: documents' distinct trigrams.
BLOCK_ENTRIES = 1_000_000


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # languages x BUCKETS


_LETTERS: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def trigrams(text: str) -> np.ndarray:
    """Hashed character trigrams of the lower-cased text; runs of other characters are one space.

    Empty without a letter.
    """
    chars = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letter_table()[chars]
    if not letter.any():
        return np.empty(0, np.int64)
    chars = np.where(letter, chars, 32)
    chars = np.r_[32, chars[np.r_[True, letter[1:] | letter[:-1]]], 32].astype(np.uint64)
    h = (chars[:-2] * np.uint64(0x9E3779B1) + chars[1:-1]) * np.uint64(0x85EBCA77) + chars[2:]
    h *= np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(50)).view(np.int64)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    for frame in pieces(batches):
        for text, language in zip(frame["text"], frame["language"], strict=True):
            if language not in counts:
                counts[language] = np.zeros(BUCKETS, np.int64)
            counts[language] += np.bincount(trigrams(text), minlength=BUCKETS)
    for language, n in counts.items():
        at = np.flatnonzero(n)
        yield pd.DataFrame({"language": language, "bucket": at, "n": n[at]})


def learn_languages(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> LanguageModel:
    """Trigram distributions of every non-null language, from all rows of `docs`."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("language"))
    rows = rows.filter("text IS NOT NULL AND language IS NOT NULL")
    n = rows.select("language").distinct().limit(MOST_LANGUAGES + 1).count()
    if n > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = rows.mapInPandas(_counted, "language string, bucket bigint, n bigint")
    counts = counts.groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["language"].unique())
    table = np.full((len(languages), BUCKETS), SMOOTHING)
    at = counts["language"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)
    table[at, counts["bucket"].to_numpy(np.int64)] += counts["n"].to_numpy(np.float64)
    return LanguageModel(languages, np.log(table / table.sum(axis=1, keepdims=True)))


def _em(share, prob, n, doc, first, rounds):
    """Proportions (documents x languages) and log-likelihoods after `rounds` rounds."""
    total = np.add.reduceat(n, first)
    for _ in range(rounds):
        mixed = prob * share[doc]
        mixed *= (n / mixed.sum(axis=1))[:, None]
        share = np.add.reduceat(mixed, first, axis=0) / total[:, None]
    return share, np.add.reduceat(n * np.log((prob * share[doc]).sum(axis=1)), first)


def infer_mixtures(log_prob: np.ndarray, grams: list[np.ndarray]) -> np.ndarray:
    """Language proportions of documents, each given by a non-empty array of trigrams."""
    sparse = [np.bincount(g, minlength=BUCKETS) for g in grams]
    places = [np.flatnonzero(s) for s in sparse]
    size = np.array([len(p) for p in places])
    bucket, first = np.concatenate(places), np.cumsum(size) - size
    n = np.concatenate([s[p] for s, p in zip(sparse, places, strict=True)]).astype(np.float64)
    doc = np.repeat(np.arange(len(grams)), size)
    log = log_prob[:, bucket].T
    top = log.max(axis=1, keepdims=True)
    prob = np.exp(log - top)  # a common factor of an entry moves no proportion
    width = log_prob.shape[0]
    share, fit = _em(np.full((len(grams), width), 1 / width), prob, n, doc, first, ROUNDS)
    penalty = np.log(np.array([len(g) for g in grams])) / EVIDENCE
    active = np.ones(share.shape, bool)
    open_ = np.arange(len(grams))
    for _ in range(width - 1):
        weakest = np.where(active[open_], share[open_], np.inf).argmin(axis=1)
        fewer = share[open_].copy()
        fewer[np.arange(len(open_)), weakest] = 0
        fewer += 1e-12 * active[open_]
        fewer[np.arange(len(open_)), weakest] = 0
        fewer /= fewer.sum(axis=1, keepdims=True)
        entry = np.isin(doc, open_) if len(open_) < len(grams) else slice(None)
        local = np.repeat(np.arange(len(open_)), size[open_])
        start = np.cumsum(size[open_]) - size[open_]
        tried, tried_fit = _em(fewer, prob[entry], n[entry], local, start, MORE_ROUNDS)
        better = tried_fit + penalty[open_] >= fit[open_]
        active[open_[better], weakest[better]] = False
        share[open_[better]], fit[open_[better]] = tried[better], tried_fit[better]
        open_ = open_[better]
        if not len(open_):
            break
    return share


def predict_languages(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None
) -> DataFrame:
    """(doc_id, lang_pred, score, n_languages) for every row, and `carry` as column carried.

    lang_pred is `und` with score 0 where the text is null or has no letter, or where the model knows
    no language. Ties go to the language first by code point. One narrow pass, no shuffle; the model is
    sent to the tasks and has a proven bound.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for frame in pieces(batches):
            grams = [trigrams(t) for t in frame["text"]] if known.languages else [np.empty(0, np.int64)] * len(frame)
            pred = np.full(len(frame), -1)
            score, number = np.zeros(len(frame)), np.zeros(len(frame), np.int64)
            some = [i for i, g in enumerate(grams) if len(g)]
            while some:
                held, used = 0, 0
                while used < len(some) and (not used or held < BLOCK_ENTRIES):
                    held += min(len(grams[some[used]]), BUCKETS)
                    used += 1
                block, some = some[:used], some[used:]
                share = infer_mixtures(known.log_prob, [grams[i] for i in block])
                pred[block], score[block] = share.argmax(axis=1), share.max(axis=1)
                number[block] = (share > 1e-9).sum(axis=1)
            names = np.array([*known.languages, "und"], object)
            yield frame.drop(columns="text").assign(
                lang_pred=names[pred], score=np.clip(score, 0.0, 1.0), n_languages=number
            )

    columns = [F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")]
    rows = docs.select(*columns, *([] if carry is None else [carry.alias("carried")]))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    return rows.mapInPandas(run, ", ".join([*fields, "lang_pred string, score double, n_languages bigint"]))
