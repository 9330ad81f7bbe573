"""What the corpus operators share: the shared folder, Arrow batches and word hashing.

Nothing here collects rows.  Python state is per batch and bounded by the slice
sizes below, never by the corpus.
"""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on.
SLICE_BYTES = 1 << 20

_LOCAL_DIRS: dict[str, str] = {}


_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Give executors this package, and lower the session's limits of an Arrow batch.

    Plans run after the operator has returned, so the limits stay; they are only ever
    lowered, to what keeps batches small for texts of any length.
    """
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        if not 0 < as_bytes(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="cartwheel-code-")
        atexit.register(shutil.rmtree, folder, True)
        target = f"{folder}/{root.name}.zip"
        with zipfile.ZipFile(target, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        spark.sparkContext.addPyFile(target)  # served by the driver, fetched by each executor
        _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``.  Only a local master, where one
    machine is the whole cluster, falls back to a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_DIRS:
            _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="cartwheel-")
            atexit.register(shutil.rmtree, _LOCAL_DIRS[app], True)
        folder = "file://" + _LOCAL_DIRS[app]
    return folder.rstrip("/")


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cartwheel/{name}-{uuid.uuid4().hex}"


#: Tables of ``written`` that are still there, in order.
_TABLES: list[DataFrame] = []


#: Files of a small table, and bytes of a file of a larger one.
LEAST_FILES, FILE_BYTES = 24, 32 << 20


def written(df: DataFrame, name: str, rows: int | None = None, row_bytes: int = 64) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage.

    The table stays, as a checkpoint does, until it is discarded.  Tables of numbers and
    digests hardly shrink, so only tables with texts are compressed.  Where it is known that
    there are ``rows`` rows at most, of about ``row_bytes``, they go to no more files than
    that takes, however many partitions a shuffle has.
    """
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, rows * row_bytes // FILE_BYTES))
    spark = df.sparkSession
    path = new_table_path(spark, name)
    texts = any("string" in kind for _, kind in df.dtypes)
    df.write.option("compression", "zstd" if texts else "uncompressed").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._cartwheel_path = path
    _TABLES.append(back)
    return back


def tables() -> int:
    """How many tables there are: a mark for ``sweep``."""
    return len(_TABLES)


def sweep(mark: int, *kept: DataFrame) -> None:
    """Discard all tables written since the mark but ``kept``."""
    discard(*[df for df in _TABLES[mark:] if not any(df is k for k in kept)])


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more; other frames are left alone."""
    for df in tables:
        path = getattr(df, "_cartwheel_path", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            _TABLES[:] = [x for x in _TABLES if x._cartwheel_path != path]


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, or with underscores so many that no column of the frames has it."""
    have = {c.lower() for df in frames for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def text_bytes(df: DataFrame, col: str = "text") -> int:
    """Total UTF-8 bytes of a text column (one pass, one row to the driver)."""
    row = df.agg(F.sum(F.octet_length(F.col(col)).cast("long")).alias("n")).first()
    return int(row["n"] or 0)


def released(batches: Iterator) -> Iterator:
    """``batches``; at their end the worker, which other tasks use again, gives back what it has freed."""
    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batch: pa.RecordBatch, col: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``limit`` bytes of text (or one row)."""
    n = batch.num_rows
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column end to end, and n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    if bufs[2] is None or not n:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


# --- hashing -----------------------------------------------------------------

_rng = np.random.default_rng(20240229)
#: Seeds of two independent hashes, and the odd multiplier that both use.
_SEED = _rng.integers(1 << 62, 1 << 63, 2, dtype=np.uint64)
_MUL = np.uint64(0x9E3779B97F4A7C15)
#: Longer words are hashed one by one.
_LONG = 512


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of the bytes of each span, eight at a time through ``mix``; long ones by keyed BLAKE2.

    Nothing here is linear in the bytes, so no pair of texts is known that collides.
    """
    size = ends - starts
    out = mix(size.astype(np.uint64) * _MUL + _SEED[which])
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), np.dtype("<u8"), padded, strides=(1,))
    row, at = np.flatnonzero((size > 0) & (size <= _LONG)), 0
    while len(row):
        rest = size[row] - at
        x = eight[starts[row] + at]
        short = np.flatnonzero(rest < 8)
        x[short] &= (np.uint64(1) << (rest[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[row] = mix(out[row] * _MUL + x)
        at += 8
        row = row[rest > 8]
    long = np.flatnonzero(size > _LONG)
    if len(long):
        out[long] = digests(data, starts[long], size[long])[:, which]
    return out


def window_hashes(values: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` hashes; runs that cross documents are the caller's to drop."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, run, size = None, 0, values, 1
    while True:  # run[i] stands for the values i .. i + size - 1
        if width & size:
            out = run[done : done + n] if out is None else mix(out * _MUL + run[done : done + n] + _SEED[which])
            done += size
        if done == width:
            return out
        run = mix(run[:-size] * _MUL + run[size:] + _SEED[which])
        size *= 2


def digests(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128 bits of BLAKE2 of each span, as two numbers."""
    raw = memoryview(np.ascontiguousarray(data)).cast("B")
    found = [hashlib.blake2b(raw[s : s + n], digest_size=16).digest() for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    return np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of the words ``[^\\x20\\x09-\\x0D]+`` and, per document, its first word's index."""
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    if len(before):
        before[0] = False
    cuts = offsets[1:-1]
    before[cuts[cuts < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    if len(after):
        after[-1] = False
    after[cuts[(cuts > 0)] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)
