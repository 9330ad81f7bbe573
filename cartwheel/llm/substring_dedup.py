"""Removal of word passages that stand anywhere else, by difference-cover anchors.

Two equal windows of ``width`` words start at word i and j of their documents.  A
difference cover modulo ``period`` has two members at any distance, so some shift
h < period takes both i + h and j + h to positions in the cover: hashing the
``width - period + 1`` words that start there, at cover positions only, both windows get
the same anchor.  So blocks first ask which anchors others have; only windows around an
anchor found twice are then hashed whole, with two independent 64-bit hashes, and asked
for in turn.  A window of which both hashes are found twice takes all its words.

Defined results: windows are judged on the input; a null text has no words; documents
shorter than a window keep all words; equal windows of rows that share a doc_id (or
null) count like any others; an empty table gives an empty result; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import deal, distinct_pairs, each_answered, each_block, found_pairs, hash_rows, member, received, received_pairs, repeated, shared_hashes, shared_pairs
from .common import utf8, window_hashes, word_hashes, words

#: Perfect difference sets, by period.
COVERS = {7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}


def cover_for(width: int) -> tuple[int, tuple[int, ...]]:
    """The largest cover that leaves anchors of at least a third of the window, or every position."""
    fit = [p for p in COVERS if width - p + 1 >= max(3, width // 3)]
    return (max(fit), COVERS[max(fit)]) if fit else (1, (0,))


class _Block:
    """A block's words, with window hashes that stay within documents."""

    def __init__(self, table: pa.Table, width: int):
        data, offsets = utf8(table.column("text"))
        self.starts, self.ends, self.first = words(data, offsets)
        self.data, self.width = data, width
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        self.place = np.arange(len(self.doc)) - self.first[self.doc]
        self.left = self.count[self.doc] - self.place
        self.one = word_hashes(data, self.starts, self.ends, 0)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(word index, hash) at cover positions."""
        period, cover = cover_for(self.width)
        size = self.width - period + 1
        inside = np.zeros(period, bool)
        inside[list(cover)] = True
        at = np.flatnonzero(inside[self.place % period] & (self.left >= size) & (self.count[self.doc] >= self.width))
        hashes = window_hashes(self.one, size)
        return at, hashes[at] if len(at) else np.zeros(0, np.uint64)

    def candidates(self, at: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Starts of windows that hold a hit anchor, within their documents."""
        period, _ = cover_for(self.width)
        n = len(self.doc)
        near = np.zeros(n + 1, np.int64)
        here = at[hit]
        back = np.minimum(self.place[here], period - 1)
        np.add.at(near, here - back, 1)
        np.add.at(near, here + 1, -1)
        return np.flatnonzero((np.cumsum(near[:-1]) > 0) & (self.left >= self.width))

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the windows that start at ``at``."""
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        two = word_hashes(self.data, self.starts, self.ends, 1)
        return window_hashes(self.one, self.width, 0)[at], window_hashes(two, self.width, 1)[at]


def remove_repeats(docs: DataFrame, width: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space)."""
    blocks = deal(docs)
    period, cover = cover_for(width)
    # A word is seldom shorter than three bytes with its space.
    anchor_buckets = blocks.buckets(len(cover) / period / 4)
    window_buckets = blocks.buckets(1 / 8)

    def ask(table: pa.Table) -> pa.Table:
        block = _Block(table, width)
        _, hashes = block.anchors()
        return hash_rows(np.unique(hashes), anchor_buckets, table.column("block")[0].as_py())

    def ask_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return hash_rows(np.zeros(0, np.uint64), window_buckets, 0, np.zeros(0, np.uint64))
        block = _Block(table, width)
        at, hashes = block.anchors()
        hit = member(hashes, received(answers))
        if len(hashes):
            hit |= repeated(hashes)[0]
        one, two = distinct_pairs(*block.windows(block.candidates(at, hit)))
        return hash_rows(one, window_buckets, table.column("block")[0].as_py(), two)

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(table, width)
        at = np.flatnonzero(block.left >= width)
        hit = found_pairs(*block.windows(at), *received_pairs(answers))
        gone = np.zeros(len(block.doc) + 1, np.int64)
        np.add.at(gone, at[hit], 1)
        np.add.at(gone, at[hit] + width, -1)
        gone = np.cumsum(gone[:-1]) > 0
        removed = np.zeros(len(block.count), np.int64)
        np.add.at(removed, block.doc[gone], 1)
        kept = []
        for text, a, b, n in zip(table.column("text").to_pylist(), block.first[:-1].tolist(), block.first[1:].tolist(), removed.tolist(), strict=True):
            own = text.encode().split()  # bytes: the six ASCII spaces only
            if n:
                own = [w for w, g in zip(own, gone[a:b].tolist(), strict=True) if not g]
            kept.append(b" ".join(own).decode())
        return pa.Table.from_arrays([table.column("doc_id"), pa.array(block.count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    asked = each_block(blocks, ask, "bucket int, block long, hashes binary")
    again = each_answered(blocks, shared_hashes(asked), ask_windows, "bucket int, block long, hashes binary, more binary")
    return each_answered(blocks, shared_pairs(again), finish, "doc_id long, n_words long, n_removed long, kept_text string")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT r, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35),
h AS (SELECT win.r, s, md5(array_to_string(list_slice(w, s, s + 34), ' ')) AS h FROM win JOIN d USING (r)),
dup AS (SELECT r, s FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 35)) AS i FROM dup),
flat AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT flat.r, string_agg(word, ' ' ORDER BY flat.i) AS txt, count(*) AS n FROM flat ANTI JOIN gone ON flat.r = gone.r AND flat.i = gone.i GROUP BY flat.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
