"""Removal of byte passages that started earlier, by external induced suffix sorting.

A string of ``width`` bytes is told by its minimizer, the least hash among its
``SEED``-byte substrings: equal strings have equal ones.  Blocks ask which minimizers
stand in several places; each run of strings around one that does goes, as one stretch
of bytes, to the shard of that minimizer, so a shard holds every place of every string
in it.  Around a minimizer that very many blocks share, a run is cut by the minimizer's
place and goes where the bytes that the cut's strings all have decide, so that a phrase
that stands everywhere doesn't make one shard of its surroundings.

A shard arrives as a sorted stream (Spark spills it where it must) and is never held:
equal stretches are neighbours, of which the earliest goes on and the others are wholly
repeats; a stretch alone with its minimizer needs no sorting; the rest goes to a text in
a scratch file, which ``induced`` sorts with common prefixes within ``memory``, however
long it is.  Neighbours that share ``width`` bytes are one string, and every place of it
but the first, by (doc_id, start), is removed.

Defined results: texts are UTF-8 bytes, null is empty; strings are judged on the input;
texts shorter than ``width`` stay whole; a null doc_id comes before all others; places in
rows that share a doc_id are compared by their starts, and of equal starts by a hash of
the rows; an empty table gives an empty result; columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import deal, each_answered, each_block, hash_rows, member, received_pairs, repeated, shared_counts
from .common import digests, mix, utf8
from .induced import MEMORY, Budget, suffixes

#: Bytes of a minimizer.
SEED = 32
#: Bytes of text of a block: what a block repeats leaves it once.
BLOCK_TEXT = 8 << 20
#: Bytes of text for which one shard is set up; repeats are a part of them.
SHARD_TEXT = 32 << 20
LEAST_SHARDS = 64
#: Blocks that share a minimizer from which on its runs are cut, into so many cuts.
HOT_BLOCKS, CUTS = 256, 3
#: Bytes of stretches in one row group that a block returns, and spans in one answer.
PIECE, SPANS = 64 << 20, 1 << 16
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_NO_ID = -(1 << 63)


def _seed_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the SEED bytes that start at each place."""
    n = len(data) - SEED + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k, mul in enumerate(_MUL):
        # Eight bytes at every place, unaligned.
        eight = np.ndarray((n,), np.dtype("<u8"), data, offset=8 * k, strides=(1,))
        out += eight * mul
    return mix(out)


def runs(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first string, strings, minimizer's hash, its place from there) of each run of strings with one minimizer."""
    empty = np.zeros(0, np.int64)
    parts = []
    # A few documents at a time: the arrays here are eight times the text.
    at = 0
    while at < len(offsets) - 1:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 20), side="right")) - 1)
        lo, hi = int(offsets[at]), int(offsets[stop])
        if hi - lo >= width:
            parts.append(_runs(data[lo:hi], offsets[at : stop + 1] - lo, width, lo))
        at = stop
    if not parts:
        return empty, empty, empty.astype(np.uint64), empty
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _runs(data: np.ndarray, offsets: np.ndarray, width: int, base: int):
    hashes = _seed_hashes(np.ascontiguousarray(data))
    # The upper bits order, the lower give the place (modulo 2**24, far more than a window).
    low = np.uint64((1 << 24) - 1)
    least = (hashes & ~low) | (np.arange(len(hashes), dtype=np.uint64) & low)
    span, size = width - SEED + 1, 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if span > size:
        rest = span - size
        least = np.minimum(least[: len(least) - rest], least[rest:])
    n = len(data) - width + 1
    start = np.arange(n)
    at = start + ((least & low).astype(np.int64) - start) % (1 << 24)
    doc = np.searchsorted(offsets, start, side="right") - 1
    valid = start + width <= offsets[doc + 1]
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    ends = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True)) + 1
    return first + base, ends - first, hashes[at[first]], at[first] - first


class _Block:
    """A block's documents in an order that their content alone decides."""

    def __init__(self, table: pa.Table):
        self.table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.data, self.offsets = utf8(self.table.column("text"))


def _gather(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of each span, end to end."""
    total = int(size.sum())
    return data[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(total)]


_SCHEMA = pa.schema(
    [("bucket", pa.int32()), ("key", pa.int64()), ("one", pa.int64()), ("two", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("block", pa.int64()), ("row", pa.int32()), ("count", pa.int32()), ("data", pa.binary())]
    # Spans that the block itself found are handed through, a row a block.
    + [(x, pa.binary()) for x in ("rows", "starts", "sizes")]
)
_DDL = "bucket int, key long, one long, two long, doc long, start long, block long, row int, count int, data binary, rows binary, starts binary, sizes binary"
_ORDER = ["bucket", "key", "one", "two", "doc", "start", "block", "row"]
_ANSWER = "block long, rows binary, starts binary, sizes binary"


def _cut(first: np.ndarray, count: np.ndarray, shift: np.ndarray, hot: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(run, first, strings, core's place, core's length) of runs, hot ones cut by the minimizer's place.

    The strings of a cut have the minimizer at places low .. high - 1 and so share the bytes
    from ``low`` before it to ``width - high + 1`` after its start.
    """
    run = np.arange(len(first))
    parts = [(run[~hot], first[~hot], count[~hot], (first + shift)[~hot], np.full(int((~hot).sum()), SEED))]
    edges = np.linspace(0, width - SEED + 1, CUTS + 1).astype(np.int64)
    own = run[hot]
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        # Strings start at first + i with the minimizer at shift - i.
        begin = np.maximum(0, shift[own] - high + 1)
        end = np.minimum(count[own], shift[own] - low + 1)
        some = end > begin
        r, b, e = own[some], begin[some], end[some]
        parts.append((r, first[r] + b, e - b, first[r] + shift[r] - low, np.full(len(r), width - high + 1 + low)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _stretch_rows(table: pa.Table, answers: pa.Table, width: int, shards: int) -> pa.Table:
    """Rows of stretches for the shards, and one for the block itself with repeats found here."""
    if not table.num_rows:
        return _SCHEMA.empty_table()
    block = _Block(table)
    first, count, hashes, shift = runs(block.data, block.offsets, width)
    shared, often = (np.sort(x) for x in received_pairs(answers))
    hit, hot = member(hashes, shared), member(hashes, often)
    if len(hashes):
        hit |= repeated(hashes)[0]
    run, first, count, core, size = _cut(first[hit], count[hit], shift[hit], hot[hit], width)
    key = hashes[hit][run]
    long = size > SEED
    key[long] = digests(block.data, core[long], size[long])[:, 0]
    row = np.searchsorted(block.offsets, first, side="right") - 1
    start = first - block.offsets[row]
    doc = pc.fill_null(block.table.column("doc_id"), _NO_ID).to_numpy()[row]
    bytes_ = count + width - 1
    # Equal stretches: the earliest goes on.
    one, two = digests(block.data, first, bytes_).T if len(first) else np.zeros((2, 0), np.uint64)
    order = np.lexsort((row, start, doc, two, one))
    same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    keep = np.ones(len(first), bool)
    keep[order[1:][same]] = False
    number = table.column("block")[0].as_py()
    pieces = []
    gone = np.flatnonzero(~keep)
    if len(gone):
        spans = [row[gone].astype(np.int32).tobytes(), start[gone].tobytes(), count[gone].astype(np.int64).tobytes()]
        own = {"bucket": (number * 2654435761) % shards, "block": number, **dict(zip(("rows", "starts", "sizes"), spans, strict=True))}
        pieces.append(pa.Table.from_pylist([own], _SCHEMA))
    kept = np.flatnonzero(keep)
    ends = np.cumsum(bytes_[kept])
    at = 0
    while at < len(kept):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, side="right")))
        pick = kept[at:stop]
        data = _gather(block.data, first[pick], bytes_[pick])
        offsets = np.concatenate([[0], np.cumsum(bytes_[pick])]).astype(np.int32)
        signed = lambda x: pa.array(x[pick].view(np.int64))  # noqa: E731, B023
        arrays = [
            pa.array(((key[pick] >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)),
            signed(key),
            signed(np.ascontiguousarray(one)),
            signed(np.ascontiguousarray(two)),
            pa.array(doc[pick]),
            pa.array(start[pick]),
            pa.array(np.full(len(pick), number, np.int64)),
            pa.array(row[pick].astype(np.int32)),
            pa.array(count[pick].astype(np.int32)),
            pa.Array.from_buffers(pa.binary(), len(pick), [None, pa.py_buffer(offsets), pa.py_buffer(data)]),
            *[pa.nulls(len(pick), pa.binary())] * 3,
        ]
        pieces.append(pa.Table.from_arrays(arrays, schema=_SCHEMA))
        at = stop
    return pa.concat_tables(pieces) if pieces else _SCHEMA.empty_table()


def _join(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


_PLACES = ("doc", "start", "block", "row", "count")


class _Shard:
    """One shard as its sorted rows come: what must be sorted goes to files, the rest is answered."""

    def __init__(self, width: int, memory: int):
        self.width, self.budget = width, Budget(memory)
        self.text = tempfile.TemporaryFile(prefix="text-")
        self.files = {c: tempfile.TemporaryFile(prefix="places-") for c in (*_PLACES, "at")}
        self.last: tuple[int, int, int] | None = None  # key and digest of the row before
        self.held: dict | None = None  # a key's first stretch, as long as it is the only one
        self.length = self.n = 0
        self.gone: list[tuple] = []
        self.spans = 0

    def add(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        handed = rows.column("data").is_null()
        if handed.true_count:
            yield pa.Table.from_batches([rows.filter(handed).select(["block", "rows", "starts", "sizes"])])
            rows = rows.filter(pc.invert(handed))
        if not rows.num_rows:
            return
        number = {c: rows.column(c).to_numpy() for c in ("key", "one", "two", *_PLACES)}
        triple = np.stack([number[c] for c in ("key", "one", "two")])
        before = np.concatenate([np.array(self.last or (0, 0, 0), np.int64)[:, None], triple[:, :-1]], axis=1)
        fresh_key, fresh = triple[0] != before[0], (triple != before).any(axis=0)
        if self.last is None:
            fresh_key[0] = fresh[0] = True
        self.last = tuple(int(x) for x in triple[:, -1])
        again = np.flatnonzero(~fresh)
        if len(again):
            self.gone.append(tuple(number[c][again] for c in ("block", "row", "start", "count")))
            self.spans += len(again)
            if self.spans >= SPANS:
                yield self._gone()
        # Distinct stretches; strings of different minimizers differ, so one alone is done.
        lead = np.flatnonzero(fresh)
        new = fresh_key[lead]
        if self.held is not None and len(lead) and not new[0]:
            self._write(self.held["data"], {c: np.array([self.held[c]]) for c in _PLACES}, np.array([len(self.held["data"])]))
        if len(lead):
            self.held = None
        alone = new & np.append(new[1:], True)
        if len(lead) and alone[-1]:  # perhaps not alone: the next batch tells
            k = int(lead[-1])
            self.held = {"data": np.frombuffer(rows.column("data")[k].as_py(), np.uint8), **{c: number[c][k] for c in _PLACES}}
        pick = lead[~alone]
        if len(pick):
            data, offsets = _binary(rows.column("data"))
            size = number["count"][pick].astype(np.int64) + self.width - 1
            self._write(_gather(data, offsets[pick], size), {c: number[c][pick] for c in _PLACES}, size)

    def _write(self, data: np.ndarray, places: dict[str, np.ndarray], size: np.ndarray) -> None:
        """Stretches as symbols 2.., each closed by 1."""
        closed = np.ones(len(data) + len(size), np.int16)
        begin = np.cumsum(size + 1) - (size + 1)
        closed[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(data))] = data.astype(np.int16) + 2
        self.text.write(closed.tobytes())
        for c in _PLACES:
            self.files[c].write(places[c].astype(np.int64).tobytes())
        self.files["at"].write((begin + self.length).astype(np.int64).tobytes())
        self.length += len(closed)
        self.n += len(size)

    def _gone(self) -> pa.Table:
        block, row, start, count = (np.concatenate(x) for x in zip(*self.gone, strict=True))
        self.gone, self.spans = [], 0
        return _spans(block, row, start, count)

    def finish(self) -> Iterator[pa.Table]:
        if self.gone:
            yield self._gone()
        if not self.n:
            return
        self.text.write(np.zeros(1, np.int16).tobytes())
        n, budget = self.length + 1, self.budget
        for file in (self.text, *self.files.values()):
            file.flush()
        text = np.memmap(self.text, np.int16, "r", shape=(n,))
        place = {c: np.memmap(f, np.int64, "r", shape=(self.n,)) for c, f in self.files.items()}
        begins = budget.zeros(n, bool)
        for a, b in budget.parts(self.n):
            count = place["count"][a:b]
            begins[np.repeat(place["at"][a:b] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))] = True
        flagged = budget.zeros(n, bool)
        # The first place of the string that the last batch ended with; the string may go on.
        open_ = np.zeros(0, np.int64)
        for pos, lcp in suffixes(text, self.width, budget):
            group = np.cumsum(lcp < self.width)  # 0: the string that the batch before ended with
            last = group[-1]
            # Strings start at whole places only; others have a separator within the width.
            own = np.flatnonzero(np.asarray(begins[pos]))
            pos, group = np.concatenate([open_, pos[own].astype(np.int64)]), np.concatenate([np.zeros(len(open_), group.dtype), group[own]])
            open_ = np.zeros(0, np.int64)
            if not len(pos):
                continue
            stretch = np.searchsorted(place["at"], pos, side="right") - 1
            start = place["start"][stretch] + pos - place["at"][stretch]
            order = np.lexsort((place["row"][stretch], place["block"][stretch], start, place["doc"][stretch], group))
            later = np.zeros(len(order), bool)
            later[1:] = group[order][1:] == group[order][:-1]
            flagged[pos[order[later]]] = True
            if group[-1] == last:
                open_ = pos[order[np.flatnonzero(~later)[-1:]]]
        for a, b in budget.parts(n):
            at = np.flatnonzero(flagged[a:b]) + a
            if len(at):
                stretch = np.searchsorted(place["at"], at, side="right") - 1
                start = place["start"][stretch] + at - place["at"][stretch]
                yield _spans(np.asarray(place["block"][stretch]), np.asarray(place["row"][stretch]), start, np.ones(len(at), np.int64))


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column and where each value begins."""
    column = column.cast(pa.large_binary())
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(bufs[2], np.uint8), offsets[:-1]


def shard_answers(batches, width: int, memory: int, report: bool = False) -> Iterator[pa.RecordBatch]:
    """Spans (block, rows, starts, sizes) of repeats from rows of shards in ``_ORDER``; or what each shard took."""
    shard, bucket, tables = None, None, iter(())

    def done() -> Iterator[pa.Table]:
        yield from shard.finish()
        if report:
            b = shard.budget
            yield pa.table({"bucket": [bucket], "symbols": [shard.length], "spilled": [b.spilled], "mapped": [b.mapped], "recursions": [b.recursions]})

    for batch in batches:
        if not batch.num_rows:
            continue
        buckets = batch.column("bucket").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if buckets[a] != bucket:
                tables = done() if shard is not None else iter(())
                for t in tables:
                    yield from _told(t, report)
                shard, bucket = _Shard(width, memory), int(buckets[a])
            for t in shard.add(batch.slice(a, b - a)):
                yield from _told(t, report)
    if shard is not None:
        for t in done():
            yield from _told(t, report)


def _told(table: pa.Table, report: bool) -> list[pa.RecordBatch]:
    return table.combine_chunks().to_batches() if ("bucket" in table.schema.names) == report else []


def _spans(b: np.ndarray, r: np.ndarray, s: np.ndarray, n: np.ndarray) -> pa.Table:
    """Rows of a block each from (block, row, start, strings); strings next to each other are one span."""
    order = np.lexsort((s, r, b))
    b, r, s, n = b[order], r[order], s[order], n[order]
    reach = s + n
    fresh = np.ones(len(b), bool)
    fresh[1:] = (b[1:] != b[:-1]) | (r[1:] != r[:-1]) | (s[1:] > reach[:-1])
    lead = np.flatnonzero(fresh)
    if len(lead):
        end = np.maximum.reduceat(reach, lead)
        b, r, s, n = b[lead], r[lead], s[lead], end - s[lead]
    ids, cut = np.unique(b, return_index=True)
    cut = np.append(cut, len(b)).tolist()
    pairs = list(zip(cut, cut[1:], strict=False))
    arrays = [pa.array(ids, pa.int64())] + [pa.array([x[i:j].astype(k).tobytes() for i, j in pairs], pa.binary()) for x, k in ((r, np.int32), (s, np.int64), (n, np.int64))]
    return pa.Table.from_arrays(arrays, names=["block", "rows", "starts", "sizes"])


def _stretches(blocks, width: int, hot_blocks: int) -> DataFrame:
    """Rows of all shards, each shard in one partition and in ``_ORDER``."""
    buckets = blocks.buckets(2 / (width - SEED + 2))
    shards = max(LEAST_SHARDS, blocks.bytes // SHARD_TEXT)

    def ask(table: pa.Table) -> pa.Table:
        block = _Block(table)
        return hash_rows(np.unique(runs(block.data, block.offsets, width)[2]), buckets, table.column("block")[0].as_py())

    asked = each_block(blocks, ask, "bucket int, block long, hashes binary")
    rows = each_answered(blocks, shared_counts(asked, hot_blocks), lambda t, a: _stretch_rows(t, a, width, shards), _DDL)
    return rows.repartitionById(int(shards), "bucket").sortWithinPartitions(*_ORDER)


def _check(width: int) -> None:
    if not SEED <= width < 255:
        raise ValueError(f"width is {SEED} to 254")


def shard_report(docs: DataFrame, width: int = 100, memory: int = MEMORY, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """(bucket, symbols, spilled, mapped, recursions): what sorting each shard took; bytes beyond memory."""
    _check(width)
    schema = "bucket long, symbols long, spilled long, mapped long, recursions long"
    return _stretches(deal(docs, BLOCK_TEXT), width, hot_blocks).mapInArrow(lambda batches: shard_answers(batches, width, memory, True), schema)


def remove_earlier(docs: DataFrame, width: int = 100, memory: int = MEMORY, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_bytes (the remaining bytes)."""
    _check(width)
    blocks = deal(docs, BLOCK_TEXT)

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(table)
        row, start, size = (_join(answers.column(c), k) for c, k in (("rows", np.int32), ("starts", np.int64), ("sizes", np.int64)))
        change = np.zeros(len(block.data) + 1, np.int64)
        at = block.offsets[row] + start
        np.add.at(change, at, 1)
        np.add.at(change, at + size + width - 1, -1)
        gone = np.cumsum(change[:-1]) > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        cuts = block.offsets[:-1][block.offsets[:-1] < len(gone)]
        opens[cuts] = gone[cuts]
        total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[block.offsets])
        raw = block.data[~gone]
        ends = np.concatenate([[0], np.cumsum(~gone)])[block.offsets].tolist()
        kept = [raw[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
        columns = [block.table.column("doc_id"), pa.array(np.diff(block.offsets), pa.int64()), pa.array(total(gone), pa.int64()), pa.array(total(opens), pa.int64()), pa.array(kept, pa.binary())]
        return pa.Table.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_bytes"])

    found = _stretches(blocks, width, hot_blocks).mapInArrow(lambda batches: shard_answers(batches, width, memory), _ANSWER)
    return each_answered(blocks, found, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_bytes binary")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_earlier(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))
