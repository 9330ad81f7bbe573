"""Near-duplicate detection with DartMinHash signatures, banded joining and exact checks.

A text is the multiset of its runs of ``shingle`` words (white-space separated, as they
are; a shorter text is one run).  Each shingle's weight region, its count wide, is hit by
darts whose ranks, places and coordinates come from hashes of the shingle: a Poisson
process, the same for every text.  A text keeps the earliest dart of each of
``coordinates`` coordinates, so two texts agree on a coordinate with the probability of
their weighted Jaccard similarity.  Texts that agree on a whole band meet there.

In each band's group all are compared exactly with one member, the centre: that of the
least number, so a text meets few centres over its bands.  Classes are the connected
components of pairs that reach the threshold; then the centre leaves, and groups that
still hold several classes go on with the next, members of the centre's class being
spared.  So small or tight groups are done without all pairs being made.  What groups
hold after ``rounds`` rounds, large and loosely similar, is cut into blocks, and each
block is compared with each of its group's inside a task, which returns only links: every
two texts that meet in a band are of one class or compared exactly.

Equal texts are one node from the start.  With the default 25 bands of 5, two texts of
similarity 0.8 meet with probability 0.99995.

Defined results: null is the empty text; texts without words are near-duplicates only of
equal texts; class_id is the least doc_id of the class (nulls aside, null if all are);
rows that share doc_id and text are one document and share its outcome; an empty table
gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, mix, prepare, released, slices, unused, utf8, window_hashes, word_hashes, words, written
from .components import components

#: Parts into which one band's members are dealt when groups are first counted.
SALT = 16
#: Members of a group that share a join key, about; larger groups have several.
PART = 1 << 14
#: Members and bytes of text of a block, about.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Bytes of keys that may be broadcast, and of one key in memory, about.
BROADCAST, KEY_BYTES = 32 << 20, 64
#: Entries of a dense matrix of shingles.
CELLS = 4 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _step(n: int) -> np.uint64:
    """n times _GOLD, modulo 2**64."""
    return np.uint64(int(_GOLD) * n % (1 << 64))


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each shingle; documents rise."""
    starts, ends, first = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    at = first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    out = np.zeros(len(doc), np.uint64)
    length = np.minimum(n[doc], size)
    for k in np.unique(length).tolist():
        own = length == k
        out[own] = window_hashes(hashes, k)[at[own]]
    return doc, out


def weighted(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, count) of distinct shingles."""
    if not len(doc):
        return doc, hashes, doc
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return doc[at], hashes[at], np.diff(np.append(at, len(doc)))


def _unit(x: np.ndarray) -> np.ndarray:
    """(0, 1] from the upper 53 bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def dart_signatures(doc: np.ndarray, hashes: np.ndarray, weight: np.ndarray, docs: int, k: int, seed: int = 1) -> np.ndarray:
    """The earliest dart's hash for each document and coordinate (documents without shingles: 0)."""
    out = np.zeros((docs, k), np.uint64)
    total = np.bincount(doc, weight, docs)
    limit = np.where(total > 0, k * (np.log(k) + 2.0) / np.maximum(total, 1), 0.0)
    pending = np.flatnonzero(total > 0)
    while len(pending):
        mine = np.isin(doc, pending) if len(pending) < docs else slice(None)
        d, h, w = doc[mine], hashes[mine], weight[mine]
        best = np.full(docs * k, np.inf)
        darts = []
        # Weight columns [0, 1), [1, 2), [2, 4), [4, 8) ...; a dart beyond the weight misses.
        column, low, high = 0, 0, 1
        while len(d):
            base = mix(h + _step(1 + 64 * seed + column))
            row, rank, throw = np.arange(len(d)), np.zeros(len(d)), 0
            while len(row):
                throw += 1
                g = mix(base[row] + _step(throw))
                rank = rank - np.log(_unit(g)) / (high - low)
                alive = rank <= limit[d[row]]
                row, rank, g = row[alive], rank[alive], g[alive]
                if not len(row):
                    break
                g = mix(g)
                hit = np.ones(len(row), bool) if high - low == 1 else low + _unit(mix(g + _GOLD)) * (high - low) <= w[row]
                cell = d[row[hit]] * k + (mix(g[hit] ^ _GOLD) % np.uint64(k)).astype(np.int64)
                darts.append((cell, rank[hit], g[hit]))
                np.minimum.at(best, cell, rank[hit])
            column += 1
            low, high = high, 2 * high
            more = w > low
            d, h, w = d[more], h[more], w[more]
        for cell, rank, g in darts:
            first = rank == best[cell]
            out.ravel()[cell[first]] = g[first]
        # A coordinate that no dart hit yet takes a longer throw, of the same darts and more.
        missing = np.isinf(best.reshape(docs, k)[pending]).any(axis=1)
        pending = pending[missing]
        limit[pending] *= 2
    return out


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    rows = signatures.shape[1] // bands
    parts = signatures.reshape(len(signatures), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, parts.shape[:2]).copy()
    for r in range(rows):
        out = mix(out * _GOLD + parts[:, :, r])
    return out.view(np.int64)


def similarities(left: pa.Array, right: pa.Array, size: int) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    n = len(left)
    sides = []
    for column in (left, right):
        doc, hashes = shingles(*utf8(column), size)
        sides.append(weighted(doc, hashes))
    doc = np.concatenate([s[0] for s in sides])
    hashes = np.concatenate([s[1] for s in sides])
    count = np.concatenate([s[2] for s in sides])
    order = np.lexsort((hashes, doc))
    doc, hashes, count = doc[order], hashes[order], count[order]
    both = np.flatnonzero((doc[1:] == doc[:-1]) & (hashes[1:] == hashes[:-1]))
    common = np.bincount(doc[both], np.minimum(count[both], count[both + 1]), n)
    union = np.bincount(doc, count, n) - common
    return np.where(union > 0, common / np.maximum(union, 1), 0.0)


def common_shingles(left: pa.Array, right: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles of each left text, of each right one, shingles that each two have in common)."""
    sides = [shingles(*utf8(column), size) for column in (left, right)]
    doc = np.concatenate([sides[0][0], sides[1][0] + len(left)])
    hashes = np.concatenate([s[1] for s in sides])
    total = np.bincount(doc, minlength=len(left) + len(right))
    # The k-th of equal shingles of a text meets the k-th of another's.
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    at = np.arange(len(doc))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    order = np.lexsort((nth, hashes))
    doc, hashes, nth = doc[order], hashes[order], nth[order]
    new[1:] = (hashes[1:] != hashes[:-1]) | (nth[1:] != nth[:-1])
    column = np.cumsum(new) - 1
    mine = doc < len(left)
    n = int(column[-1]) + 1 if len(column) else 0
    both = (np.bincount(column[mine], minlength=n) > 0) & (np.bincount(column[~mine], minlength=n) > 0)
    held = both[column]
    doc, mine, column = doc[held], mine[held], (np.cumsum(both) - 1)[column[held]]
    common = np.zeros((len(left), len(right)), np.int64)
    step = max(1, CELLS // max(1, len(left) + len(right)))
    for low in range(0, int(both.sum()), step):
        a, b = np.searchsorted(column, [low, low + step])
        dense = np.zeros((len(left) + len(right), step), np.float32)
        dense[doc[a:b], column[a:b] - low] = 1
        common += (dense[: len(left)] @ dense[len(left) :].T).astype(np.int64)
    return total[: len(left)], total[len(left) :], common


def _signed(texts: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """``texts`` (doc_id, node, text) to (doc_id, node, bytes, bands)."""

    def sign(batches):
        for batch in batches:
            for part in slices(batch):
                data, offsets = utf8(part.column("text"))
                doc, hashes, count = weighted(*shingles(data, offsets, size))
                n = part.num_rows
                keys = band_keys(dart_signatures(doc, hashes, count, n, bands * rows), bands)
                some = np.bincount(doc, minlength=n) > 0
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some) * bands]).astype(np.int32)), pa.array(keys[some].ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), pa.array(np.diff(offsets)), lists], names=["doc_id", "node", "bytes", "bands"])

    return texts.mapInArrow(lambda batches: released(sign(batches)), "doc_id long, node binary, bytes long, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(a, b, la, lb, sim) of (a, b) pairs of nodes with labels."""

    def compare(batches):
        for batch in batches:
            for part in slices(batch, "left"):
                sim = similarities(part.column("left"), part.column("right"), size)
                yield pa.RecordBatch.from_arrays([part.column(x) for x in ("a", "b", "la", "lb")] + [pa.array(sim)], names=["a", "b", "la", "lb", "sim"])

    left = texts.select(F.col("seq").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("seq").alias("b"), F.col("text").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "la", "lb", "left", "right").mapInArrow(lambda batches: released(compare(batches)), "a long, b long, la long, lb long, sim double")


def _several(members: DataFrame) -> DataFrame:
    """(band, part, centre, lb, n, total) of groups that hold several labels, a row for each part of a group."""
    groups = members.groupBy("band").agg(
        F.min("label").alias("lo"),
        F.max("label").alias("hi"),
        F.min(F.struct("seq", "label")).alias("least"),
        F.max("parts").alias("parts"),
        F.count(F.lit(1)).alias("n"),
        F.sum("bytes").alias("total"),
    )
    parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    return groups.where("lo <> hi").select("band", parts, F.col("least.seq").alias("centre"), F.col("least.label").alias("lb"), "n", "total")


def _blocked(members: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """(la, lb) of all linked pairs of one group; ``members`` are (band, seq, label), ``texts`` (seq, text, bands).

    A group's members are dealt to blocks, and a task gets two blocks.  Two texts are
    compared in the first band that they share: if its group is done or one of them was
    a centre there, they are of one class or were compared.
    """
    schema = "la long, lb long"

    def compare(key, table):
        band, first, second = (k.as_py() for k in key)
        block = table.column("block").to_numpy()
        la, lb = [], []

        def parts(own: int):
            for batch in table.filter(pa.array(block == own)).combine_chunks().to_batches():
                for part in slices(batch):
                    bands = part.column("bands").flatten().to_numpy().reshape(part.num_rows, -1)
                    yield part.column("text"), part.column("seq").to_numpy(), part.column("label").to_numpy(), bands

        right = list(parts(second))
        for text, seq, label, bands in parts(first):
            for text2, seq2, label2, bands2 in right:
                wanted = label[:, None] != label2[None, :]
                if first == second:
                    wanted &= seq[:, None] < seq2[None, :]
                i, j = np.nonzero(wanted)
                keep = np.zeros(len(i), bool)
                for at in range(0, len(i), 1 << 16):
                    x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                    keep[at : at + len(x)] = bands[x, (bands[x] == bands2[y]).argmax(axis=1)] == band
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                rows, i = np.unique(i, return_inverse=True)
                columns, j = np.unique(j, return_inverse=True)
                n, n2, common = common_shingles(text.take(pa.array(rows)), text2.take(pa.array(columns)), size)
                met = common[i, j]
                union = n[i] + n2[j] - met
                hit = np.where(union > 0, met / np.maximum(union, 1), 0.0) >= threshold
                la.append(label[rows][i[hit]])
                lb.append(label2[columns][j[hit]])
        pairs = np.unique(np.stack([np.concatenate(x) if x else np.zeros(0, np.int64) for x in (la, lb)]), axis=1)
        return pa.table({"la": pa.array(pairs[0]), "lb": pa.array(pairs[1])})

    # Not more blocks than members: a very long text is a block of its own.
    blocks = F.least(F.col("n"), F.ceil(F.greatest(F.col("n") / BLOCK, F.col("total") / BLOCK_BYTES))).cast("int")
    held = members.join(_several(members), ["band", "part"]).withColumn("blocks", blocks)
    placed = held.withColumn("block", F.pmod(F.xxhash64("seq", F.lit(1)), F.col("blocks")).cast("int"))
    paired = placed.select("band", "seq", "label", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    paired = paired.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "seq", "label")
    return paired.join(texts, "seq").groupBy("band", "i", "j").applyInArrow(compare, schema)


def _merged(labels: DataFrame, links: DataFrame, nodes: int) -> DataFrame:
    """``labels`` of so many nodes after ``links`` (la, lb)."""
    classes_ = components(links.select(F.col("la").alias("a"), F.col("lb").alias("b")), links.count()).select(F.col("node").alias("label"), F.col("label").alias("to"))
    new = written(labels.join(classes_, "label", "left").select("seq", F.coalesce("to", "label").alias("label")), "labels", nodes)
    discard(labels, links)
    return new


def _link(members: DataFrame, texts: DataFrame, threshold: float, size: int, rounds: int, nodes: int) -> DataFrame:
    """(seq, label) of members after linking; ``members`` are (band, part, parts, seq, bytes) of groups.

    A round compares the members of groups that still hold several labels with the group's
    centre, unless their labels are equal, then takes the centre out: a group is done when
    one label is left.  Groups that are not done after ``rounds`` rounds are compared by blocks.
    """
    labels = members.select("seq", F.col("seq").alias("label")).distinct()
    count = members.count()
    active, states = members.withColumn("label", F.col("seq")), []
    for _ in range(rounds):
        state = written(active.join(_several(active), ["band", "part"]).drop("n", "total"), "groups", count)
        discard(*states)
        states = [state]
        if state.isEmpty():
            return labels
        # The same two texts meet in several bands, mostly with the same centre.
        pairs = state.where("label <> lb").select(F.col("seq").alias("a"), F.col("centre").alias("b"), F.col("label").alias("la"), "lb").distinct()
        links = written(_verified(pairs, texts.select("seq", "text"), size).where(F.col("sim") >= threshold), "links")
        if not links.isEmpty():
            labels = _merged(labels, links, nodes)
        active = state.where("seq <> centre").select("band", "part", "parts", "seq", "bytes").join(labels, "seq")
    rest = written(active, "rest", count)
    links = written(_blocked(rest, texts, threshold, size).distinct(), "links", nodes)
    discard(rest, *states)
    return labels if links.isEmpty() else _merged(labels, links, nodes)


def _small(keys: DataFrame, count: int) -> DataFrame:
    """``keys``, to be broadcast if they measure ``BROADCAST`` bytes or less: then no text is shuffled to be looked up."""
    return F.broadcast(keys) if count * KEY_BYTES <= BROADCAST else keys


def classes(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, bands: int = 25, rows: int = 5, rounds: int = 2) -> DataFrame:
    """doc_id, node (digest of the text), class_key, class_id, class_size of every row."""
    prepare(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    source = source.withColumn("node", F.unhex(F.md5("text")))
    signed = _signed(source, shingle, bands, rows)
    merged = signed.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("bytes").alias("bytes"), F.first("bands").alias("bands"))
    nodes = written(merged.withColumn("seq", F.monotonically_increasing_id()), "nodes")
    keys = nodes.select("seq", "bytes", F.explode("bands").alias("band")).withColumn("salt", F.pmod(F.xxhash64("seq"), F.lit(SALT)).cast("int"))
    parts = (F.floor(F.col("n") / PART) + 1).cast("int").alias("parts")
    shared = keys.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", parts, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    part = F.pmod(F.xxhash64("seq", F.lit(2)), F.col("parts")).cast("int").alias("part")
    members = written(keys.join(shared, ["band", "salt"]).select("band", part, "parts", "seq", "bytes"), "members")
    wanted = written(members.select("seq").distinct().join(nodes.select("seq", "node", "least", "bands"), "seq"), "wanted")
    none = F.lit(-(1 << 63)).cast("long")
    keyed = source.select("node", F.coalesce("doc_id", none).alias("_id"), "text")
    keys = wanted.select("node", F.coalesce("least", none).alias("_id"), "seq")
    met = keyed.join(_small(keys, wanted.count()), ["node", "_id"]).dropDuplicates(["seq"])
    texts = met.select("seq", "text").join(wanted.select("seq", "bands"), "seq")
    texts = written(texts, "texts")
    count = nodes.count()
    labels = written(_link(members, texts, threshold, shingle, rounds, count), "classes", count)
    discard(members, texts, wanted)
    labelled = nodes.select("seq", "node", "least", "n").join(labels, "seq", "left")
    labelled = labelled.withColumn("class_key", F.coalesce("label", "seq"))
    sizes = labelled.groupBy("class_key").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    by_node = labelled.select("node", "class_key").join(sizes, "class_key")
    return source.select("doc_id", "node").join(by_node, "node")


def near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """doc_id, class_id, class_size, kept: the row of the class's least doc_id stays."""
    return classes(docs, **params).select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """One row of each class, that of the least doc_id; columns unchanged."""
    none = F.lit(-(1 << 63)).cast("long")
    id_, node, stays = (unused(x, docs) for x in ("_id", "_node", "_stays"))
    found = written(classes(docs, **params).where("class_size > 1"), "several")
    least = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_key").agg(F.min(F.struct(F.coalesce("doc_id", none).alias("id"), F.col("node").alias("node"))).alias("k"))
    each = found.select(F.coalesce("doc_id", none).alias("id"), "node").distinct()
    kept = least.select("k.id", "k.node", F.lit(True).alias("kept"))
    several = written(each.join(kept, ["id", "node"], "left").select(F.col("id").alias(id_), F.col("node").alias(node), F.coalesce("kept", F.lit(False)).alias(stays)), "stays")
    marked = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), none), node: F.unhex(F.md5(F.coalesce("text", F.lit(""))))})
    met = marked.join(_small(several, several.count()), [id_, node], "left")
    # Only rows of classes are shuffled, to leave one of those that tie on doc_id and text.
    alone = met.where(F.col(stays).isNull())
    return alone.unionByName(met.where(F.col(stays)).dropDuplicates([id_, node])).select(*docs.columns)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
