"""Language identification by words first, then by ever shorter character n-grams.

A known word scores its log frequency in each language (a fixed penalty where a
language lacks it).  A word that no language knows scores the mean over its character
n-grams of the greatest length of which any is known, from ``longest`` down to 1.  A
text's score is the mean over its words; the best language wins, ties by name.

The model is fitted on a sample: about ``sample_docs`` whole documents of each language,
chosen by a hash of doc_id.  All their n-grams count, and all words but those that a
language has once.  Every document is then scored over its whole text.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is
any text if nothing could be learned; a null ``doc_id`` is neither held out nor learned
from; repeated rows get equal results; an empty table gives an empty result; columns
other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, released

_RUN = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def letter_words(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    found = _RUN.findall(text.lower())
    return found if text.isascii() else [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def ngrams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Log frequencies by gram (n = 0 for whole words) and language.

    A gram's row holds the languages that have it, each with its log frequency above
    ``-penalty``: row r is ``langs[first[r] : first[r + 1]]`` and as many ``above``.
    """

    def __init__(self, languages: list[str], grams: dict[int, dict[str, int]], first: np.ndarray, langs: np.ndarray, above: np.ndarray, longest: int, penalty: float):
        self.languages, self.grams, self.longest, self.penalty = languages, grams, longest, penalty
        self.first, self.langs, self.above = first, langs, above

    def scores(self, rows: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Sum over rows, each taken so many times, for each language."""
        low = self.first[rows]
        size = self.first[rows + 1] - low
        at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.langs[at], self.above[at] * np.repeat(times, size), len(self.languages)) - self.penalty * times.sum()

    def unseen(self, word: str) -> tuple[int, ...]:
        """Rows of an unseen word's known n-grams of the greatest length that has any."""
        for n in range(self.longest, 0, -1):
            known = self.grams[n]
            rows = tuple(known[g] for g in ngrams(word, n) if g in known)
            if rows:
                return rows
        return ()


class Scorer:
    """Scores texts; remembers a bounded number of unseen words."""

    def __init__(self, model: Model, most: int = 100_000):
        self.model, self.most, self.memo = model, most, {}

    def __call__(self, text: str | None) -> tuple[str, float]:
        model = self.model
        words = letter_words(text or "")
        if not words or not model.languages:
            return UNKNOWN, 0.0
        counts = Counter(words)
        known, memo = model.grams[0].get, self.memo
        rows = np.fromiter((known(w, -1) for w in counts), np.int64, len(counts))
        times = np.fromiter(counts.values(), np.float64, len(counts))
        lost = 0.0
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            # An unseen word counts as the mean of its n-grams: each takes its share.
            own = list(counts)
            more: list[int] = []
            shares: list[float] = []
            for k, n in zip(missing.tolist(), times[missing].tolist(), strict=True):
                word = own[k]
                grams = memo.get(word)
                if grams is None:
                    if len(memo) >= self.most:
                        memo.clear()
                    grams = memo[word] = model.unseen(word)
                if grams:
                    more += grams
                    shares += [n / len(grams)] * len(grams)
                else:
                    lost += n
            seen = rows >= 0
            rows = np.concatenate([rows[seen], np.array(more, np.int64)])
            times = np.concatenate([times[seen], np.array(shares)])
        mean = (model.scores(rows, times) - model.penalty * lost) / len(words)
        best = int(np.argmax(mean))
        odds = np.exp((mean - mean[best]) * min(len(words), 20))
        return model.languages[best], float(1.0 / odds.sum())


def train(docs: DataFrame, sample_docs: int = 2500, longest: int = 4, penalty: float = 16.0) -> Model:
    """Fit on (doc_id, text, lang) rows whose lang is known; see the module."""
    prepare(docs.sparkSession)
    rows = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    chosen = draw <= F.floor(F.least(F.lit(1.0), sample_docs / F.col("n")) * 1_000_003)

    def count(batches):
        for batch in batches:
            seen: dict[str, Counter] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(letter_words(text))
            found: Counter = Counter()
            for lang, own in seen.items():
                for word, k in own.items():
                    found[lang, 0, word] += k
                    for n in range(1, longest + 1):
                        for g in ngrams(word, n):
                            found[lang, n, g] += k
            keys = list(found)
            if keys:
                langs, sizes_, grams = zip(*keys, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(sizes_, pa.int32()), pa.array(grams), pa.array(list(found.values()), pa.int64())], names=["lang", "n", "gram", "k"])

    counted = rows.join(F.broadcast(sizes), "lang").where(chosen).select("text", "lang").mapInArrow(lambda batches: released(count(batches)), "lang string, n int, gram string, k long").groupBy("lang", "n", "gram").agg(F.sum("k").alias("k"))
    kept = counted.where((F.col("n") > 0) | (F.col("k") >= 2)).orderBy("n", "gram", "lang")
    found = kept.toArrow().to_pydict()
    languages = sorted(set(found["lang"]))
    column = {x: i for i, x in enumerate(languages)}
    grams: dict[int, dict[str, int]] = {n: {} for n in range(longest + 1)}
    first: list[int] = []
    at = np.array([column[x] for x in found["lang"]], np.int64)
    n, k = np.array(found["n"], np.int64), np.array(found["k"], np.float64)
    total = np.zeros((longest + 1, len(languages)))
    np.add.at(total, (n, at), k)
    for place, (of, gram) in enumerate(zip(found["n"], found["gram"], strict=True)):
        if gram not in grams[of]:
            grams[of][gram] = len(first)
            first.append(place)
    above = np.maximum(np.log(k / total[n, at]), -penalty) + penalty
    return Model(languages, grams, np.array([*first, len(at)], np.int64), at.astype(np.int32), above, longest, penalty)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; reads doc_id and text alone."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def score(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(lambda batches: released(score(batches)), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.4) -> DataFrame:
    """Rows whose language is found with at least ``min_score``; columns unchanged."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    return docs.where(F.pandas_udf(_keeping(shared, min_score), "boolean")(F.col("text")))


def _keeping(shared, min_score: float):
    import pandas as pd

    def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)  # one for all batches of a task: it remembers words
        for texts in parts:
            found = [scorer(t) for t in texts]
            yield pd.Series([lang != UNKNOWN and score >= min_score for lang, score in found], dtype=bool)

    def keeps(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from released(each(parts))

    keeps.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return keeps


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
