"""Exact deduplication with a log-structured merge index, in DataFrame operations only.

Texts are digested in one pass.  The digests are flushed in bounded slices: a memtable
merges what its slice repeats and writes a sorted run, a row for each digest with the
identifier that stays and a count, and a filter of the run, bitmaps of two bits a digest
in slots.  Compaction merges ``FAN`` runs of a level into one of the next, until one is
left.  A run's digests are probed against the filters of the others that it is merged
with: what none of them may hold is copied, and only the rest, repeats and a few false
alarms, is shuffled and merged.  Hits, digests of several rows, are then verified by their
texts byte by byte (smallest against largest text of a digest); a digest that two texts
share is resolved by the texts themselves.

Filters and hits are broadcast only if they measure ``BROADCAST`` bytes or less; beyond
that they are joined by slot, or by digest dealt to ``SALT`` parts.

Defined results: a null text equals the empty text; a null ``doc_id`` ranks below
all others; of rows that tie on text and ``doc_id`` exactly one stays; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, unused, written

#: Parts into which the rows of one digest are dealt.
SALT = 32
#: Digests of a slice at most, and slices at least; runs that are merged at once.
FLUSH_ROWS, LEAST_FLUSHES, FAN = 1 << 28, 4, 4
#: Bits below the partition's number in ``monotonically_increasing_id``.
_ROW_BITS = 33
#: Bits of a bitmap, and bits of a filter for each digest, about.
SLOT_BITS, DIGEST_BITS = 1 << 15, 16
#: Bytes of a table that may be broadcast.
BROADCAST = 32 << 20
#: Bytes of a digest in memory, about.
DIGEST_BYTES = 64


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@dataclass
class Run:
    """(digest, best, n), a row for each digest, and the filter (slot, bits) of the digests."""

    rows: DataFrame
    filter: DataFrame


def _places(slots: int) -> tuple[Column, Column, Column]:
    """A digest's slot and its two bits there."""
    h = F.xxhash64("digest")
    return F.pmod(h, F.lit(slots)).cast("int"), F.pmod(F.shiftrightunsigned(h, 20), F.lit(SLOT_BITS)), F.pmod(F.shiftrightunsigned(h, 40), F.lit(SLOT_BITS))


def _set(bits: str, place: str) -> Column:
    """Whether a bitmap (null: empty) has the bit at ``place``."""
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(F.col(place) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), F.pmod(F.col(place), F.lit(8))).cast("int")) != 0, F.lit(False))


class MergeIndex:
    """Runs of digests in the shared folder, by level."""

    def __init__(self, spark: SparkSession, rows: int, keep: str = "smallest", flush_rows: int = FLUSH_ROWS, fan: int = FAN):
        if keep not in ("smallest", "largest"):
            raise ValueError("keep is 'smallest' or 'largest'")
        self.spark, self.keep, self.flush_rows, self.fan, self.count = spark, keep, flush_rows, fan, rows
        self.slots = 1 << max(0, (rows * DIGEST_BITS // SLOT_BITS).bit_length())
        self.levels: list[list[Run]] = [[]]

    def _best(self) -> Column:
        return (F.max if self.keep == "largest" else F.min)("best")

    def add(self, rows: DataFrame) -> None:
        """Flush (digest, doc_id, seq) rows, numbered by ``monotonically_increasing_id``, in bounded slices."""
        # (has an id, id, seq) is a total order in which a null id always loses.
        ranked = F.col("doc_id").isNotNull() if self.keep == "largest" else F.col("doc_id").isNull()
        best = F.struct(ranked.alias("ranked"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "seq").alias("best")
        for part in self._slices(rows, max(LEAST_FLUSHES, -(-self.count // self.flush_rows))):
            self.flush(part.select("digest", best, F.lit(1).cast("long").alias("n")))

    def _slices(self, rows: DataFrame, flushes: int) -> list[DataFrame]:
        """Rows by runs of the scan's partitions, which are ranges of ``seq``: a flush reads its own files alone.

        Where there are fewer partitions than flushes, rows are dealt by hash.
        """
        top = rows.agg(F.max("seq")).first()[0] or 0
        parts = (top >> _ROW_BITS) + 1
        if parts < flushes:
            return [rows.where(F.pmod(F.xxhash64("seq"), F.lit(flushes)) == k) for k in range(flushes)]
        edges = [(k * parts // flushes) << _ROW_BITS for k in range(flushes + 1)]
        return [rows.where((F.col("seq") >= a) & (F.col("seq") < b)) for a, b in zip(edges, edges[1:], strict=False)]

    def _merge(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("digest").agg(self._best().alias("best"), F.sum("n").alias("n"))

    def flush(self, rows: DataFrame) -> None:
        """Write a memtable as a sorted run of level 0, with its filter."""
        slot, one, two = _places(self.slots)
        merged = self._merge(rows).withColumn("slot", slot)
        # By slot, so that a bitmap is made in one task and each slot is one stretch of a run.
        run = written(merged.repartition("slot").sortWithinPartitions("slot", "digest"), "run", self.count, DIGEST_BYTES)
        bits = run.select("slot", F.explode(F.array(one, two)).alias("bit"))
        filter_ = written(bits.groupBy("slot").agg(F.bitmap_construct_agg("bit").alias("bits")), "filter", self.slots, SLOT_BITS // 8)
        self.levels[0].append(Run(run.drop("slot"), filter_))
        self.levels[0][-1].rows._cartwheel_path = run._cartwheel_path

    def _probed(self, runs: list[Run]) -> DataFrame:
        """Rows of the runs, and whether the filter of another run has them."""
        slot, one, two = _places(self.slots)
        rows = reduce(DataFrame.unionByName, [r.rows.withColumn("run", F.lit(k)) for k, r in enumerate(runs)])
        filters = reduce(DataFrame.unionByName, [r.filter.withColumn("run", F.lit(k)) for k, r in enumerate(runs)])
        wide = filters.groupBy("slot").agg(*[F.first(F.when(F.col("run") == k, F.col("bits")), ignorenulls=True).alias(f"b{k}") for k, _ in enumerate(runs)])
        if self.slots * SLOT_BITS // 8 * len(runs) <= BROADCAST:
            wide = F.broadcast(wide)
        met = rows.withColumns({"slot": slot, "one": one, "two": two}).join(wide, "slot", "left")
        maybe = reduce(lambda a, b: a | b, [(F.col("run") != k) & _set(f"b{k}", "one") & _set(f"b{k}", "two") for k, _ in enumerate(runs)])
        return met.select("digest", "best", "n", maybe.alias("maybe"))

    def compact(self) -> DataFrame:
        """Merge runs level by level: a row for each digest with the row that stays and its count."""
        level = 0
        while True:
            runs = self.levels[level]
            if len(runs) == 1 and level == len(self.levels) - 1:
                break
            if level == len(self.levels) - 1:
                self.levels.append([])
            for at in range(0, len(runs), self.fan):
                group = runs[at : at + self.fan]
                if len(group) == 1:
                    self.levels[level + 1].append(group[0])
                    continue
                probed = self._probed(group)
                plain = probed.where(~F.col("maybe")).drop("maybe")
                merged = written(plain.unionByName(self._merge(probed.where("maybe"))), "run", self.count, DIGEST_BYTES)
                both = reduce(DataFrame.unionByName, [r.filter for r in group])
                # The last run is not merged any more and needs no filter.
                more = len(runs) > self.fan or level + 1 < len(self.levels) - 1
                made = Run(merged, written(both.groupBy("slot").agg(F.bitmap_or_agg("bits").alias("bits")), "filter", self.slots, SLOT_BITS // 8) if more else both)
                discard(*[x for r in group for x in (r.rows, r.filter)])
                self.levels[level + 1].append(made)
            self.levels[level] = []
            level += 1
        last = self.levels[level][0]
        largest = self.keep == "largest"
        return last.rows.select("digest", F.when(F.col("best.ranked") == F.lit(largest), F.col("best.id")).alias("keep_id"), F.col("best.seq").alias("keep_seq"), F.col("n").alias("group_size"))


def _meet(rows: DataFrame, hits: DataFrame, count: int, key: str, how: str, on: str = "digest") -> DataFrame:
    """``rows`` joined with ``hits`` (a row for each digest) by digest; ``key`` deals equal digests out."""
    if count * DIGEST_BYTES <= BROADCAST:
        return rows.join(F.broadcast(hits), on, how)
    salt = unused("salt", rows, hits)
    copied = hits.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(key), F.lit(SALT)).cast("int")).join(copied, [on, salt], how).drop(salt)


def _resolve(rows: DataFrame, hits: DataFrame, count: int) -> DataFrame:
    """Give each row its group's outcome; a digest that isn't among the hits is its row's alone."""
    joined = _meet(rows, hits, count, "seq", "left")
    single = F.col("group_size").isNull()
    return joined.select(
        "digest",
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("seq") == F.col("keep_seq"))).alias("kept"),
    )


def _indexed(digests: DataFrame, keep: str, **options) -> tuple[DataFrame, DataFrame, int]:
    """Numbered (digest, doc_id, seq) rows, the hits among their digests, and how many."""
    rows = written(digests.withColumn("seq", F.monotonically_increasing_id()), "digests")
    index = MergeIndex(rows.sparkSession, rows.count(), keep, **options)
    index.add(rows)
    compacted = index.compact()
    hits = written(compacted.where("group_size > 1"), "hits", index.count, DIGEST_BYTES)
    discard(*[x for level in index.levels for r in level for x in (r.rows, r.filter)])
    return rows, hits, hits.count()


def exact_dedup(docs: DataFrame, keep: str = "smallest", digest=sha256_digest, **options) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``digest`` maps the text column to a binary digest; equal digests of different
    texts are found by comparing the texts and never merge them.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keyed = source.withColumn("digest", digest(F.col("text")))
    rows, hits, count = _indexed(keyed.select("digest", "doc_id"), keep, **options)
    clashing = _clashes(keyed, hits.select("digest"), count)
    out = _resolve(rows, hits, count)
    if digest is sha256_digest and clashing.isEmpty():
        return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
    return _with_sha(out, keyed, clashing, keep, **options)


def _clashes(keyed: DataFrame, hits: DataFrame, count: int) -> DataFrame:
    """Digests that more than one text has: byte verification of every hit, and of hits alone."""
    texts = _meet(keyed, hits, count, "doc_id", "inner").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
    part = texts.groupBy("digest", "salt").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
    spans = part.groupBy("digest").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return written(spans.where("lo <> hi").select("digest"), "clashes", count, 4096)  # the texts decide the size


def _with_sha(out: DataFrame, keyed: DataFrame, clashing: DataFrame, keep: str, **options) -> DataFrame:
    """Results where the digest isn't the text's SHA-256 or is shared by several texts.

    Clashing digests are grouped anew by the text itself; for the others the text's
    SHA-256 is taken from any text of the digest, all being equal.
    """
    shas = keyed.join(clashing, "digest", "left_anti").groupBy("digest").agg(F.min(F.sha2("text", 256)).alias("text_sha256"))
    plain = out.join(clashing, "digest", "left_anti").join(shas, "digest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    again = keyed.join(clashing, "digest", "left_semi").select(F.col("text").cast("binary").alias("digest"), "doc_id")
    split = _resolve(*_indexed(again, keep, **options))
    return plain.unionByName(split.select("doc_id", "keep_id", "group_size", "kept", F.sha2("digest", 256).alias("text_sha256")))


def drop_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """``docs`` without rows whose text another row has; columns unchanged.

    Rows are told apart by doc_id; of rows that tie on doc_id and text one stays.
    """
    id_, digest, keep_id = (unused(x, docs) for x in ("_id", "_digest", "_keep_id"))
    none = F.lit(-(1 << 63)).cast("long")
    found = exact_dedup(docs, keep).where("kept and group_size > 1")
    stays = written(found.select(F.unhex("text_sha256").alias(digest), F.coalesce("doc_id", none).alias(keep_id)), "stays")
    marked = docs.withColumns({digest: sha256_digest(F.coalesce(F.col("text"), F.lit(""))), id_: F.coalesce(F.col("doc_id").cast("long"), none)})
    met = _meet(marked, stays, stays.count(), id_, "left", digest)
    # Only the rows that stay of groups are shuffled, to leave one of those that tie.
    alone = met.where(F.col(keep_id).isNull())
    grouped = met.where(F.col(keep_id) == F.col(id_)).dropDuplicates([digest])
    return alone.unionByName(grouped).select(*docs.columns)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
