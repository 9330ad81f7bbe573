"""Finding hashes that several blocks of documents share.

Documents are dealt to blocks of a few megabytes by a hash of their content, in one
exchange that every later pass reads again.  A pass turns each block into its distinct
hashes, sent in arrays to buckets by hash; a bucket answers each block with those of its
hashes that another block has too.  A key that a third of all documents share costs one
entry a block, so nothing is hot, and a bucket's size is bounded by the count of buckets,
which grows with the bytes measured.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_bytes

BLOCK_BYTES = 4 << 20
#: Hashes that a bucket gets, about.
BUCKET_HASHES = 1 << 19
LEAST_BUCKETS = 64


@dataclass
class Blocks:
    """doc_id, text and block, hash-partitioned by block."""

    df: DataFrame
    bytes: int

    def buckets(self, hashes_per_byte: float) -> int:
        return max(LEAST_BUCKETS, int(self.bytes * hashes_per_byte / BUCKET_HASHES))


def deal(docs: DataFrame, block_bytes: int | None = None) -> Blocks:
    spark = docs.sparkSession
    prepare(spark)
    total = text_bytes(docs)
    count = max(1, -(-total // (block_bytes or BLOCK_BYTES)))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (64 << 20))
    return Blocks(own.repartition(int(parts), "block"), total)


def hash_rows(hashes: np.ndarray, buckets: int, block: int, more: np.ndarray | None = None) -> pa.Table:
    """Rows (bucket, block, hashes, more) of a block's distinct hashes."""
    bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, hashes = bucket[order], hashes[order]
    own, first = np.unique(bucket, return_index=True)
    cuts = np.append(first, len(hashes)).tolist()
    arrays = [pa.array(own.astype(np.int32)), pa.array(np.full(len(own), block, np.int64)), pa.array([hashes[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())]
    names = ["bucket", "block", "hashes"]
    if more is not None:
        more = more[order]
        arrays.append(pa.array([more[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()))
        names.append("more")
    return pa.Table.from_arrays(arrays, names=names)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64)


def _shared(table: pa.Table) -> pa.Table:
    """(block, hashes, more): of each block's hashes in this bucket, those that others have too."""
    sizes = np.array([len(x) // 8 for x in table.column("hashes").to_pylist()])
    hashes = _numbers(table.column("hashes"))
    more = _numbers(table.column("more")) if "more" in table.schema.names else None
    hit = _twice(hashes, more)
    ends = np.cumsum(sizes)
    blocks, out, others = [], [], []
    for block, a, b in zip(table.column("block").to_pylist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
        own = hit[a:b]
        if own.any():
            blocks.append(block)
            out.append(hashes[a:b][own].tobytes())
            others.append(b"" if more is None else more[a:b][own].tobytes())
    return pa.Table.from_arrays([pa.array(blocks, pa.int64()), pa.array(out, pa.binary()), pa.array(others, pa.binary())], names=["block", "hashes", "more"])


def _twice(one: np.ndarray, two: np.ndarray | None) -> np.ndarray:
    """Whether each value, or pair of values, stands twice or more."""
    order = np.argsort(one) if two is None else np.lexsort((two, one))
    same = one[order][1:] == one[order][:-1]
    if two is not None:
        same &= two[order][1:] == two[order][:-1]
    out = np.zeros(len(one), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def shared_hashes(rows: DataFrame) -> DataFrame:
    """Answers (block, hashes) to the rows of ``hash_rows``."""
    return shared_pairs(rows).select("block", "hashes")


def shared_pairs(rows: DataFrame) -> DataFrame:
    """Answers (block, hashes, more): hashes count as shared only if ``more`` is, too."""
    return rows.groupBy("bucket").applyInArrow(_shared, "block long, hashes binary, more binary")


def shared_counts(rows: DataFrame, hot: int) -> DataFrame:
    """Answers (block, hashes, more): shared hashes, and those of them that ``hot`` blocks or more have."""
    return rows.groupBy("bucket").applyInArrow(lambda table: _counted(table, hot), "block long, hashes binary, more binary")


def _counted(table: pa.Table, hot: int) -> pa.Table:
    distinct, count = np.unique(_numbers(table.column("hashes")), return_counts=True)
    often = distinct[count >= hot]
    shared = _shared(table)
    each = [np.frombuffer(x, np.uint64) for x in shared.column("hashes").to_pylist()]
    more = [x[member(x, often)].tobytes() for x in each]
    return pa.Table.from_arrays([shared.column("block"), shared.column("hashes"), pa.array(more, pa.binary())], names=["block", "hashes", "more"])


def received_pairs(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return _numbers(answers.column("hashes")), _numbers(answers.column("more"))


def distinct_pairs(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return one[new], two[new]


def found_pairs(one: np.ndarray, two: np.ndarray, answered: np.ndarray, answered2: np.ndarray) -> np.ndarray:
    """Whether each pair is among the answered ones or stands twice itself."""
    hit = member(one, np.sort(answered))
    if len(one):
        hit |= repeated(one)[0]
    own = np.flatnonzero(hit)
    hit[own] = _twice(np.concatenate([one[own], answered]), np.concatenate([two[own], answered2]))[: len(own)]
    return hit


def received(answers: pa.Table) -> np.ndarray:
    """A block's answered hashes, sorted."""
    return np.sort(_numbers(answers.column("hashes")))


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def repeated(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each value stands twice or more, index of each distinct value's first place)."""
    _, first, inverse, count = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
    return count[inverse] > 1, first


def each_block(blocks: Blocks, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return blocks.df.groupBy("block").applyInArrow(fn, schema)


def each_answered(blocks: Blocks, answers: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn(documents, answers)`` for each block; blocks without answers included."""

    def run(docs: pa.Table, own: pa.Table) -> pa.Table:
        return fn(docs, own)

    return blocks.df.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def texts_of(table: pa.Table) -> Iterator[bytes]:
    for x in table.column("text").to_pylist():
        yield x.encode()
