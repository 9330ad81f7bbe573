"""Best-fit packing of tokenised documents after Martello-Toth reduction.

A packing depends only on how many pieces there are of each length, and lengths run
from 1 to the capacity.  So tasks cut documents into pieces and count lengths; the driver
plans over that histogram (a number for each length at any input size), and every piece
looks up its place by its rank among pieces of its length.  Ranks are dealt to parts of
a bounded size, whose counts add up to where each part begins.  A piece as long as a
sequence is one, and needs no rank.

The plan first fixes sets that dominate all other sets with the same largest member
(an item that nothing joins; a pair that fills the bin or that no larger set can beat;
a triple none of whose alternatives is larger in either place), shrinking the
instance, then puts the rest, longest first, where the least room stays.

Defined results: a null or empty text is the end token alone; a null ``doc_id`` and
repeated rows are packed like any others; an empty table packs into nothing; other
columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, written

#: Pieces that are numbered in one part, about, and parts of a length at least.
PART_PIECES, LEAST_PARTS = 1 << 20, 64


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _letters() -> dict[int, str]:
    """Byte-level BPE's letters for a character: each byte's own if it prints, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    letter = {b: chr(0x100 + k) for k, b in enumerate(rest)} | {b: chr(b) for b in plain}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}


class Encoder(dict):
    """Token ids of texts as little-endian bytes; a dictionary of the words met so far.

    The tokenizer drops white space and never joins across it, lower-cases, and cuts
    what is left into words, digits and runs of signs.  Texts of plain Latin letters
    are cut here in the same way, and each part is merged once and remembered.  Other
    texts go to the tokenizer, chunk by chunk.  The dictionary starts anew when full.
    """

    _PLAIN = re.compile("[\n -~À-ÖØ-öø-ÿ]*")
    _PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\n a-zß-öø-ÿ0-9]+")
    _LETTERS = _letters()

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.most = most

    def __missing__(self, part: str) -> bytes:
        # A part's ids come from the model itself, which sees bytes as letters.
        tokens = self.merge(part if part.isascii() else part.translate(self._LETTERS))
        return self._keep(part, [t.id for t in tokens])

    def _keep(self, key: str, ids: list[int]) -> bytes:
        if len(self) >= self.most:
            self.clear()
        self[key] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self._PART.findall(text.lower())))

    def encode(self, text: str) -> bytes:
        if "<|" not in text and self._PLAIN.fullmatch(text):
            return self._plain(text)
        out = []
        for chunk in text.replace("\n", " ").split(" "):
            if "<|" not in chunk and self._PLAIN.fullmatch(chunk):
                out.append(self._plain(chunk))
            else:
                key = " " + chunk
                out.append(self[key] if key in self else self._keep(key, self.tokenizer.encode(chunk, add_special_tokens=False).ids))
        return b"".join(out)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece of each document."""
    prepare(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(tokenizer_path)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for at in range(0, len(texts), 100):
                out = []
                for doc, text in zip(ids[at : at + 100], texts[at : at + 100], strict=True):
                    raw = encoder.encode(text or "") + end
                    n = len(raw) // 4
                    for k, start in enumerate(range(0, n, capacity)):
                        own = raw[4 * start : 4 * (start + capacity)]
                        out.append((doc, k, start, len(own) // 4, zlib.crc32(own), own))
                cols = list(zip(*out, strict=True))
                arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cols[5]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


# --- the plan ----------------------------------------------------------------


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, list[tuple[int, int]]]], dict[int, int]]:
    """Martello-Toth reduction: (copies, [(length, times)]) of fixed bins, and what is left."""
    left = {k: n for k, n in counts.items() if n}
    order = sorted(left)
    fixed: list[tuple[int, list[tuple[int, int]]]] = []

    def take(copies: int, *members: int) -> None:
        own: dict[int, int] = {}
        for x in members:
            own[x] = own.get(x, 0) + 1
        for x, n in own.items():
            left[x] -= n * copies
            if not left[x]:
                del left[x]
                order.pop(bisect_left(order, x))
        fixed.append((copies, sorted(own.items(), reverse=True)))

    def smallest(n: int, a: int) -> list[int]:
        """The n smallest others than one item of length a."""
        out: list[int] = []
        for x in order:
            out += [x] * min(n - len(out), left[x] - (x == a))
            if len(out) == n:
                break
        return out

    def fitting(room: int, used: dict[int, int]) -> int:
        """The largest length of at most ``room`` that is left besides ``used``; 0 if none."""
        i = bisect_left(order, room + 1) - 1
        while i >= 0 and left[order[i]] <= used.get(order[i], 0):
            i -= 1
        return order[i] if i >= 0 else 0

    def copies(*members: int) -> int:
        return min(left[x] // members.count(x) for x in set(members))

    for a in sorted(left, reverse=True):
        while left.get(a):
            room = capacity - a
            k = fitting(room, {a: 1})
            if not k:
                # Alone, and so are its likes: nothing smaller appears later.
                take(left[a] if 2 * a > capacity else 1, a)
                continue
            three = smallest(3, a)
            if k == room or len(three) < 2 or three[0] + three[1] > room:
                take(copies(a, k), a, k)
                continue
            if len(three) == 3 and sum(three) <= room:
                break
            # At most two others join a; the larger is at most k.
            m = fitting(room - k, {a: 1, k: 1} if a != k else {a: 2})
            half = fitting(room // 2, {a: 1})
            if m and m >= half:
                take(copies(a, k, m), a, k, m)
            else:
                break
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, longest first, over counts: bins of the same content are one entry.

    A step either uses up a length or an entry, so entries stay within a small multiple
    of the number of lengths, however many pieces there are.
    """
    rooms: list[int] = []
    entries: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}

    def put(room: int, copies: int, content: list[tuple[int, int]]) -> None:
        if copies:
            if room not in entries:
                insort(rooms, room)
                entries[room] = []
            entries[room].append((copies, content))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                copies, content = entries[room].pop()
                if not entries[room]:
                    del entries[room]
                    rooms.pop(i)
            else:
                room, content = capacity, []
                copies = -(-n // (capacity // length))
            each = room // length
            full = min(copies, n // each)
            rest = n % each if copies > full else 0
            put(room - each * length, full, [*content, (length, each)])
            put(room - rest * length, bool(rest), [*content, (length, rest)])
            put(room, copies - full - bool(rest), content)
            n -= full * each + rest
    return [x for room in rooms for x in entries[room]]


def plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Segments by (length, first rank): the ranks of a length, dealt to runs of sequences."""
    fixed, left = reduce_dominated(counts, capacity)
    rows, used, sequence = [], dict.fromkeys(counts, 0), 0
    for copies, content in [*fixed, *best_fit(left, capacity)]:
        offset = 0
        for length, each in content:
            rows.append((length, used[length], each, sequence, offset))
            used[length] += copies * each
            offset += length * each
        sequence += copies
    if used != {k: counts[k] for k in used}:
        raise AssertionError("the plan doesn't place every piece once")
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "sequence", "offset"), table.T, strict=True))


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece, with sequence_id and offset; at most ``capacity`` tokens a sequence."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer_path or default_tokenizer(), capacity, end_id, with_ids), "pieces")
    parts = max(LEAST_PARTS, cut.count() // PART_PIECES)
    rest = cut.where(F.col("length") < capacity).withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    counted = rest.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n"))
    begins = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = counted.groupBy("length").agg(F.sum("n").alias("n")).collect()  # a row for each length
    shared = spark.sparkContext.broadcast(plan({r["length"]: r["n"] for r in found}, capacity))
    order = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    own = rest.withColumn("_own", F.row_number().over(order) - 1)
    ranked = own.join(counted.select("length", "_part", begins.alias("_begin")), ["length", "_part"])
    ranked = ranked.select(*cut.columns, (F.col("_begin") + F.col("_own")).alias("_rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"

    def place(batches):
        at = shared.value
        # Segments of a length are in order of their first ranks.
        lengths, segment = np.unique(at["length"], return_index=True)
        last = np.append(segment[1:], len(at["length"]))
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            i = np.zeros(len(length), np.int64)
            which = np.searchsorted(lengths, length)
            for k in np.unique(which).tolist():
                mine = which == k
                i[mine] = segment[k] + np.searchsorted(at["first"][segment[k] : last[k]], rank[mine], side="right") - 1
            rank = rank - at["first"][i]
            extra = [at["sequence"][i] + rank // at["each"][i], at["offset"][i] + rank % at["each"][i] * length]
            names = [x for x in batch.schema.names if x[0] != "_"]
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in names] + [pa.array(x, pa.int64()) for x in extra], names=[*names, "sequence_id", "offset"])

    alone = cut.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return ranked.mapInArrow(place, schema).unionByName(alone)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
