"""Helpers that the operators share: Arrow text slices, vectorised words, packed buckets."""

from __future__ import annotations

import ctypes
import hashlib
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles; bounds a worker's memory, not what is processed.
SLICE_BYTES = 1 << 20
#: Odd multipliers of the two lanes of word hashes, and of joined hashes; words from LONG_WORD bytes are digested one by one.
LANE, OTHER_LANE, JOINT, LONG_WORD = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 64
#: Rows of a key from which it may be dealt out, and the share of all rows: so fewer keys than HOT_SHARE are hot, whatever the input.
HOT_ROWS, HOT_SHARE = 1000, 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; in local mode, where none is needed, the JVM's own."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = sc._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"{sc._jvm.java.lang.System.getProperty('java.io.tmpdir')}/docloom-{sc.applicationId}"
    return path.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


#: Spark's bound of an Arrow batch, its default, and the one that takes its place.
BATCH, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 4 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Files of a written table: so many for each core, or at least LEAST_FILES.
FILES_A_CORE, LEAST_FILES = 4, 32


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table into the shared folder and read it back.

    The shuffle files behind it go when it is written. The table goes by `drop`, or with the application.
    A task that writes takes several partitions, one after another, where there are many for each core: without its native
    library Hadoop starts a process of its own for the mode of every file and folder, from within the executor.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.coalesce(max(LEAST_FILES, FILES_A_CORE * spark.sparkContext.defaultParallelism)).write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    system, where = _hadoop(spark, path)
    system.deleteOnExit(where)
    out = spark.read.schema(schema).parquet(path)
    out._docloom_path = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete tables of `materialise` that nothing reads any more."""
    for table_ in tables:
        path = getattr(table_, "_docloom_path", None)
        if path:
            system, where = _hadoop(table_.sparkSession, path)
            system.delete(where, True)


def hot_keys(rows: DataFrame, key: str, least: int = HOT_ROWS) -> DataFrame | None:
    """`key` and `salts` of the keys with over `least` rows and one HOT_SHARE-th of all; None if there are none.

    Fewer than HOT_SHARE rows by construction, so the result may be broadcast. `rows` should be a written table.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("k")).where((F.col("k") > least) & F.col(key).isNotNull())
    limit = max(least, rows.count() // HOT_SHARE)
    hot = counts.where(F.col("k") > limit).withColumn("salts", F.ceil(F.col("k") / limit).cast("int")).select(key, "salts")
    found = hot.collect()
    return rows.sparkSession.createDataFrame(found, hot.schema) if found else None


def join_spread(many: DataFrame, one: DataFrame, key: str, by: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """`many` JOIN `one` on `key`, the rows of `many` with a hot key dealt over its salts by a hash of column `by`."""
    if hot is None:
        return many.join(one, key, how)
    salts = F.broadcast(hot)
    left = many.join(salts, key, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("salts")), F.lit(0).cast("bigint"))).drop("salts")
    right = one.join(salts, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("salts", F.lit(1)).cast("bigint") - 1))).drop("salts")
    return left.join(right, [key, "__salt"], how).drop("__salt")


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow in batches of about BATCH_BYTES, or what the session names: rows of a batch are held several times over, in the JVM and in its worker."""
    if df.sparkSession.conf.get(BATCH) == BATCH_DEFAULT:
        df.sparkSession.conf.set(BATCH, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, across tasks."""
    holder = sys.modules.setdefault("_docloom_worker", types.ModuleType("_docloom_worker"))
    return holder.__dict__.setdefault(name, {})


def large(column: pa.Array, kind: pa.DataType = pa.large_string()) -> pa.Array:
    """The column with 64-bit offsets and no nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(kind).fill_null("" if pa.types.is_large_string(kind) else b"")


def offsets_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]


def data_of(column: pa.Array) -> np.ndarray:
    buffer = column.buffers()[2]
    return np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, row offsets into them) for each slice."""
    column = large(column)
    if not len(column):
        return
    offsets, data = offsets_of(column), data_of(column)
    for lo, hi in row_slices(offsets, limit):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
    give_back()


def give_back() -> None:
    """Let go of what earlier batches took: workers live on, and several share an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def is_space() -> np.ndarray:
    mark = np.zeros(256, dtype=bool)
    mark[[0x20, *range(0x09, 0x0E)]] = True
    return mark


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run of no [\\x20\\x09-\\x0D]) and its row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    space, starts, ends, last = is_space(), [], [], True
    for a in range(0, len(data), SLICE_BYTES):  # by parts, so that a long text takes little beside its words
        b = min(len(data), a + SLICE_BYTES)
        outside = np.empty(b - a + 2, dtype=bool)
        outside[0], outside[1:-1], outside[-1] = last, space[data[a:b]], b == len(data) or space[data[b]]
        before, after = outside[:-2].copy(), outside[2:].copy()
        cut = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
        before[cut] = True
        cut = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "right")] - a
        after[cut - 1] = True
        inside = ~outside[1:-1]
        starts.append(np.flatnonzero(inside & before) + a)
        ends.append(np.flatnonzero(inside & after) + a + 1)
        last = bool(outside[-2])
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def join_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each pair, in order."""
    return mix(mix(a) * np.uint64(JOINT) + b)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word: two lanes, each mixing its 8-byte blocks one after another."""
    out = np.empty(len(starts), dtype=np.uint64)
    masks = np.array([0xFFFFFFFFFFFFFFFF >> (64 - 8 * k) if k else 0 for k in range(9)], dtype=np.uint64)
    a = 0
    while a < len(starts):  # by parts of the bytes, which bounds what is copied
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + SLICE_BYTES, "right")))
        size = ends[a:b] - starts[a:b]
        short = np.flatnonzero(size < LONG_WORD)
        first = int(starts[a])
        last = int(ends[a + short[-1]]) if len(short) else first
        raw = np.zeros(last - first + 8, dtype=np.uint8)
        raw[: last - first] = data[first:last]
        blocks = np.ndarray((last - first + 1,), dtype="<u8", buffer=raw, strides=(1,))
        at, left = starts[a + short] - first, size[short]
        one = left.astype(np.uint64) * np.uint64(LANE)
        two = one ^ np.uint64(OTHER_LANE)
        on = np.arange(len(short))
        while len(on):
            block = blocks[at[on]] & masks[np.minimum(left[on], 8)]
            one[on] = mix(one[on] ^ block)
            two[on] = mix(two[on] + block * np.uint64(OTHER_LANE))
            at, left = at + 8, left - 8
            on = on[left[on] > 0]
        out[a + short] = join_hashes(one, two)
        for k in np.flatnonzero(size >= LONG_WORD).tolist():
            out[a + k] = int.from_bytes(hashlib.blake2b(data[starts[a + k] : ends[a + k]], digest_size=8).digest(), "little")
        a = b
    return out


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each `width` consecutive words, rows not looked at, by doubling."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    out, have, power, size = None, 0, words, 1
    while True:
        if width & size:
            n = len(words) - have - size + 1
            out, have = (power, size) if out is None else (join_hashes(out[:n], power[have : have + n]), have + size)
        if have == width:
            return out
        power = join_hashes(power[:-size], power[size:])
        size *= 2


def in_one_row(rows: np.ndarray, width: int) -> np.ndarray:
    """Which windows of `width` consecutive words lie in one row."""
    return rows[width - 1 :] == rows[: len(rows) - width + 1] if len(rows) >= width else np.zeros(0, bool)


class Buckets:
    """Rows on their way to buckets, sent as one compressed blob for each bucket and flush."""

    def __init__(self, n: int, limit: int, pack: Callable[..., bytes], level: int = 1) -> None:
        self.n, self.limit, self.pack, self.level, self.parts, self.size = n, limit, pack, level, [], 0

    def add(self, keys: np.ndarray, columns: tuple, size: int) -> pa.RecordBatch | None:
        if len(keys):
            self.parts.append((keys, *columns))
            self.size += size
        return self.flush() if self.size >= self.limit else None

    def flush(self) -> pa.RecordBatch | None:
        if not self.parts:
            return None
        keys, *columns = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        order = np.argsort(keys, kind="stable")
        keys, columns = keys[order], [c[order] for c in columns]
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        zip_ = zstandard.ZstdCompressor(level=self.level)
        blobs = [zip_.compress(self.pack(*(c[a:b] for c in columns))) for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(keys[cuts].astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def to_buckets(df: DataFrame) -> DataFrame:
    """Blobs of a bucket meet in one task, sorted, so that a task holds one bucket at a time."""
    return df.repartition(shuffle_partitions(df.sparkSession), "bucket").sortWithinPartitions("bucket")


def bucket_groups(batches: Iterator[pa.RecordBatch], least: int, numbered: bool = False) -> Iterator[list]:
    """Blobs of whole buckets, of several small ones together until they have `least` bytes; with their buckets if `numbered`."""
    unzip, held, size, last = zstandard.ZstdDecompressor(), [], 0, None
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_numpy(), batch.column(1), strict=True):
            if size >= least and bucket != last:
                yield held
                held, size = [], 0
            raw = unzip.decompress(blob.as_py())
            held.append((int(bucket), raw) if numbered else raw)
            size += len(raw)
            last = bucket
    if held:
        yield held
