"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs of word characters.  Seeds, hashes of ``least`` consecutive
words, join documents with benchmark items.  Where the items' words that any shared seed
covers could reach the threshold, the pair is tiled: running Karp-Rabin searches with a
rolling hash of falling length for the longest matches of words that no tile has marked,
each checked word by word; the longest becomes a tile and marks its words, what is left
of others stays in the queue, until none of ``least`` words is left.  Of a document only
words that shared seeds cover can be in a tile, so only those are searched.  An item is
leaked if tiles, in whatever order they stand, cover ``threshold`` of its words.

The benchmark's index is broadcast only if its texts measure ``broadcast_bytes`` or less;
beyond it, seeds are joined by a shuffle.  Both ways give the same rows.

Defined results: a null or empty text is clean; an item without words matches nothing,
one shorter than ``least`` words must stand whole; the best item is that of the greatest
coverage, ties by the smallest item_id (null last); a benchmark row given twice counts
once; null and repeated doc_ids pass through; an empty table on either side is fine;
columns other than ids and texts are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, prepare, released, unused

_WORD = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def seed_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive word ids."""
    n = len(ids) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64) + np.uint64(1))
    return out


#: Words of a document that are looked up at once.
CHUNK = 1 << 16
#: Modulus and base of the rolling hash, and the length that the search begins with.
_PRIME, _BASE, SEARCH = (1 << 61) - 1, 1_000_003, 20


def rolling(words: list[int], free: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """(place, hash) of each ``size`` consecutive words that are all free, rolled from one to the next."""
    top = pow(_BASE, size, _PRIME)
    value = run = 0
    for k, word in enumerate(words):
        if not free[k]:
            value = run = 0
            continue
        value = (value * _BASE + word + 2) % _PRIME
        run += 1
        if run > size:
            value = (value - (words[k - size] + 2) * top) % _PRIME
        if run >= size:
            yield k - size + 1, value


def _matches(doc: list[int], item: list[int], free_doc: list[bool], free_item: list[bool], size: int) -> tuple[list[tuple[int, int, int]], int]:
    """(-words, place in item, place in document) of all longest matches of ``size`` words or more.

    A match of more than twice as many words ends the search: it is to begin again there.
    """
    where: dict[int, list[int]] = {}
    for j, h in rolling(item, free_item, size):
        where.setdefault(h, []).append(j)
    found = []
    for i, h in rolling(doc, free_doc, size):
        for j in where.get(h, ()):
            if i and j and free_doc[i - 1] and free_item[j - 1] and doc[i - 1] == item[j - 1]:
                continue  # part of the match that begins before
            k = 0
            while i + k < len(doc) and j + k < len(item) and free_doc[i + k] and free_item[j + k] and doc[i + k] == item[j + k]:
                k += 1
            if k > 2 * size:
                return [], k
            if k >= size:
                found.append((-k, j, i))
    return found, size


def tiles(doc: np.ndarray, item: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in document, place in item, words), the longest first."""
    own, other = doc.tolist(), item.tolist()
    free_doc, free_item = [True] * len(own), [True] * len(other)
    size, out = max(width, min(SEARCH, len(other))), []
    while True:
        heap, longest = _matches(own, other, free_doc, free_item, size)
        if longest > size:
            size = longest
            continue
        heapq.heapify(heap)
        while heap:
            n, j, i = heapq.heappop(heap)
            n = -n
            free = [free_doc[i + k] and free_item[j + k] for k in range(n)]
            if all(free):
                out.append((i, j, n))
                free_doc[i : i + n] = free_item[j : j + n] = [False] * n
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[0], np.array(free, np.int8), [0]])))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if b - a >= size:  # shorter ones are found again at their length
                    heapq.heappush(heap, (a - b, j + a, i + a))
        if size == width or not any(free_item):
            return out
        size = max(width, size // 2)


class Index:
    """Seeds of benchmark items by hash, for one seed width after another."""

    def __init__(self, items: list[tuple[int | None, str | None]], least: int):
        self.vocabulary: dict[str, int] = {}
        self.ids = [k for k, _ in items]
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in tokens(t)], np.int64) for _, t in items]
        #: By seed width: seed hashes in order, their items and places.
        self.widths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        rows: dict[int, list] = {}
        self.seeds: list[np.ndarray] = []
        for n, own in enumerate(self.words):
            width = min(least, len(own))
            self.seeds.append(seed_hashes(own, width) if width else np.zeros(0, np.uint64))
            rows.setdefault(width, []).extend((h, n, j) for j, h in enumerate(self.seeds[-1].tolist()))
        for width, found in rows.items():
            if width:
                found.sort()
                hashes, items_, places = zip(*found, strict=True)
                self.widths[width] = (np.array(hashes, np.uint64), np.array(items_, np.int64), np.array(places, np.int64))

    def _document(self, text: str | None) -> np.ndarray:
        """Word ids, -1 for words that no item has; a long text's words are not held all at once."""
        get, found = self.vocabulary.get, _WORD.finditer((text or "").lower())
        parts = [np.zeros(0, np.int64)]
        while len(part := np.fromiter((get(m[0], -1) for m in islice(found, CHUNK)), np.int64)):
            parts.append(part)
        return np.concatenate(parts)

    def match(self, text: str | None, threshold: float) -> list[tuple[int, float]]:
        """(index of the item, coverage) of each leaked item."""
        doc = self._document(text)
        out = []
        for width, (hashes, items, places) in self.widths.items():
            i, own = _shared_seeds(doc, width, hashes)
            # Each distinct seed once, so there are no more rows than the index has.
            distinct = np.unique(own)
            lo, hi = np.searchsorted(hashes, distinct, "left"), np.searchsorted(hashes, distinct, "right")
            n = hi - lo
            if not n.any():
                continue
            row = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item, place = items[row], places[row]
            # Words of each item that some seed covers bound what tiles can cover.
            span = int(place.max()) + width + 1
            covered = np.unique((item[:, None] * span + place[:, None] + np.arange(width)).ravel()) // span
            for k, c in zip(*(x.tolist() for x in np.unique(covered, return_counts=True)), strict=True):
                need = threshold * len(self.words[k])
                if c >= need:
                    total = sum(t[2] for t in tiles(_covered(doc, i[np.isin(own, self.seeds[k])], width), self.words[k], width))
                    if total >= need:
                        out.append((k, total / len(self.words[k])))
        return sorted(out, key=lambda x: (-x[1], self.ids[x[0]] is None, self.ids[x[0]] or 0, x[0]))


def _shared_seeds(doc: np.ndarray, width: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of a document's seeds that are among the ordered ``hashes``, a chunk at a time."""
    places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at in range(0, len(doc) - width + 1, CHUNK):
        part = doc[at : at + CHUNK + width - 1]
        run = np.cumsum(np.concatenate([[0], part >= 0]))
        i = np.flatnonzero(run[width:] - run[:-width] == width)
        own = np.zeros(len(i), np.uint64)
        for k in range(width):
            own = mix(own * np.uint64(0x9E3779B97F4A7C15) + part[i + k].astype(np.uint64) + np.uint64(1))
        near = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        hit = hashes[near] == own
        places.append(i[hit] + at)
        found.append(own[hit])
    return np.concatenate(places), np.concatenate(found)


def _covered(doc: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """The words that seeds at ``places`` cover, runs of them parted by a word that no item has."""
    mark = np.zeros(len(doc) + 1, np.int64)
    np.add.at(mark, places, 1)
    np.add.at(mark, places + width, -1)
    inside = np.cumsum(mark[:-1]) > 0
    ends = inside & ~np.append(inside[1:], False)
    own = np.where(inside, doc, -1)
    return own[inside | np.concatenate([[False], ends[:-1]])]


def _leaks(docs: DataFrame, benchmark: DataFrame, least: int, threshold: float, broadcast_bytes: int) -> tuple[DataFrame, str]:
    """``docs`` (any columns, with text) plus an array of (item_id, coverage), best first, and its column's name."""
    spark = docs.sparkSession
    prepare(spark)
    found = unused("_items", docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("item") + 16), F.lit(0)).alias("n")).first()["n"]
    result = "array<struct<item_id: long, coverage: double>>"
    if size <= broadcast_bytes:
        rows = items.where("item is not null").dropDuplicates(["item_id", "item"]).orderBy("item_id", "item").collect()
        shared = spark.sparkContext.broadcast(Index([(r["item_id"], r["item"]) for r in rows], least))

        leaks = F.pandas_udf(_iterating(shared, threshold), result)
        return docs.withColumn(found, leaks(F.col("text"))), found
    return _joined(docs, items, least, threshold, found), found


def _iterating(shared, threshold: float):
    import pandas as pd

    def each(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = shared.value
        for part in texts:
            yield pd.Series([[{"item_id": index.ids[k], "coverage": c} for k, c in index.match(t, threshold)] for t in part])

    def leaks(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from released(each(texts))

    leaks.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return leaks


def _split(rows: DataFrame, col: str) -> DataFrame:
    """``rows`` plus words: the ``tokens`` of ``col``."""

    def run(batches):
        for batch in batches:
            found = [tokens(t) for t in batch.column(col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], names=[*batch.schema.names, "words"])

    return rows.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in [*rows.dtypes, ("words", "array<string>")]))


def _joined(docs: DataFrame, items: DataFrame, least: int, threshold: float, found: str) -> DataFrame:
    """As above by a shuffle join of seeds; work is per distinct text and item."""
    width = F.least(F.lit(least), F.size("words"))

    def grams(n) -> F.Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, n)))

    keyed = _split(items.select("item_id", "item").where("item is not null"), "item").where(F.size("words") > 0).dropDuplicates(["item_id", "item"])
    wanted = keyed.select("item_id", "item", F.size("words").alias("n"), width.alias("width"), F.explode(grams(width)).alias("seed"))
    texts = docs.select("text").where("text is not null").distinct()
    own = _split(texts, "text")
    sizes = F.array(*[F.lit(k) for k in range(1, least + 1)])
    has = own.select("text", "words", F.explode(F.filter(sizes, lambda k: k <= F.size("words"))).alias("width"))
    has = has.select(F.sha2("text", 256).alias("key"), "width", F.explode(F.array_distinct(grams(F.col("width")))).alias("seed"))
    shared = has.join(wanted, ["width", "seed"]).groupBy("key", "item_id", "item", "n", "width").agg(F.count(F.lit(1)).alias("seeds"))
    # The places of an item that shared seeds have bound what tiles can cover.
    pairs = shared.where(F.col("seeds") * F.col("width") >= threshold * F.col("n")).select("key", "item_id", "item")

    def tile(batches):
        for batch in batches:
            out = []
            for item_id, item, text in zip(batch.column("item_id").to_pylist(), batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = Index([(item_id, item)], least).match(text, threshold)
                out.append(found[0][1] if found else None)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("item_id"), pa.array(out, pa.float64())], names=["key", "item_id", "coverage"])

    sources = texts.withColumn("key", F.sha2("text", 256))
    tiled = pairs.join(sources, "key").mapInArrow(tile, "key string, item_id long, coverage double").where("coverage is not null")
    order = lambda a, b: F.when(a["coverage"] != b["coverage"], F.when(a["coverage"] > b["coverage"], -1).otherwise(1)).when(a["item_id"].eqNullSafe(b["item_id"]), 0).when(b["item_id"].isNull() | (a["item_id"] < b["item_id"]), -1).otherwise(1)
    key = unused("_key", docs)
    best = tiled.groupBy(F.col("key").alias(key)).agg(F.array_sort(F.collect_list(F.struct("item_id", "coverage")), order).alias(found))
    joined = docs.withColumn(key, F.sha2("text", 256)).join(best, key, "left")
    return joined.withColumn(found, F.coalesce(found, F.array().cast("array<struct<item_id: bigint, coverage: double>>"))).drop(key)


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: int = 4, threshold: float = 0.5, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, contaminated, n_items, best_item, coverage (0 if clean) and the leaked items."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found, _ = _leaks(own, benchmark, least, threshold, broadcast_bytes)
    return found.select(
        "doc_id",
        (F.size("_items") > 0).alias("contaminated"),
        F.size("_items").cast("long").alias("n_items"),
        F.get("_items", F.lit(0))["item_id"].alias("best_item"),
        F.coalesce(F.get("_items", F.lit(0))["coverage"], F.lit(0.0)).alias("coverage"),
        F.array_sort(F.col("_items.item_id")).alias("items"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: int = 4, threshold: float = 0.5, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item; columns unchanged."""
    rows, found = _leaks(docs, benchmark, least, threshold, broadcast_bytes)
    return rows.where(F.size(found) == 0).select(*docs.columns)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
