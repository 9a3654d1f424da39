"""Exact substring dedup by super-k-mer partitioning.

A window is WIDTH consecutive words of one document. The minimiser of a window is the
least hash of its SEED-word runs; consecutive windows that share it form a super-k-mer,
which travels as one packed string to the minimiser's bucket. Equal windows have equal
minimisers, so they meet there; sorting brings them together, and each is compared with
its first occurrence as text, never by hash alone.

Hot groups: a super-k-mer that a flush of a map task holds twice is settled there (the
later one surely repeats the earlier), so a bucket gets any string at most once per flush,
however many copies there are. A minimiser found in very many places is split: one pass counts
minimisers by CELLS hash cells, and windows whose minimiser lies in a cell of over one
HOT_CELLS-th of all super-k-mers go by a second minimiser as well, the least of their runs in another
order. That is decided by the window's own words, so equal windows still meet. Buckets hold blobs, compressed, one bucket in memory at a
time. Documents without a repeated window send nothing to the last join but their text.

The order of occurrences is (doc_id, start), a null doc_id first. Rows are told apart by
(doc_id, text): repeated rows with both equal count as one document and are treated alike.
A null text has no words; extra columns are kept where `dedup` is told so and never looked at; an
empty table gives no rows. A long text is one row of a worker, whose memory grows with its words.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import Buckets, bucket_groups, in_one_row, join_hashes, large, map_arrow, materialise, mix, shuffle_partitions, table, text_slices, to_buckets, window_hashes, word_hashes, words_of

#: Words in a window and in the runs whose least hash is the minimiser.
WIDTH, SEED = 20, 4
#: Buckets for each shuffle partition; bytes of strings that a map task packs at once, and that a reducer takes together.
BUCKETS_A_PARTITION, FLUSH_BYTES, GROUP_BYTES = 8, 14 << 20, 4 << 20
NULL_ID = -(2**63)
#: Cells that minimisers are counted in, and the share of all super-k-mers from which a cell is hot: fewer than HOT_CELLS can be.
CELLS, HOT_CELLS = 1 << 14, 1 << 10


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def cells_of(minimisers: np.ndarray) -> np.ndarray:
    return ((minimisers >> np.uint64(8)) % np.uint64(CELLS)).astype(np.int64)


def super_kmers(data: np.ndarray, offsets: np.ndarray, width: int, seed: int, hot: np.ndarray | None = None):
    """(row, first word in its row, windows, byte start, byte end, minimiser) of each super-k-mer, and the words.

    hot: which cells hold minimisers that a second one splits.
    """
    starts, ends, rows = words_of(data, offsets)
    empty = np.zeros(0, np.int64)
    if len(starts) < width:
        return (empty, empty, empty, empty, empty, np.zeros(0, np.uint64)), (starts, ends, rows)
    runs = window_hashes(word_hashes(data, starts, ends), seed)
    least = sliding_least(runs, width - seed + 1)
    if hot is not None and (split := hot[cells_of(least)]).any():
        least = np.where(split, join_hashes(least, sliding_least(mix(runs ^ np.uint64(CELLS)), width - seed + 1)), least)
    at = np.flatnonzero(in_one_row(rows, width))
    least = least[at]
    if not len(at):
        return (empty, empty, empty, empty, empty, np.zeros(0, np.uint64)), (starts, ends, rows)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]) | (rows[at[1:]] != rows[at[:-1]])]))
    n = np.diff(np.append(new, len(at)))
    first = at[new]
    row = rows[first]
    row_first = np.searchsorted(rows, row, "left")
    return (row, first - row_first, n, starts[first], ends[first + n + width - 2], least[new]), (starts, ends, rows)


def _pack(docs: np.ndarray, hashes: np.ndarray, starts: np.ndarray, strings: np.ndarray) -> bytes:
    sizes = np.fromiter(map(len, strings), dtype=np.int32, count=len(strings))
    return struct.pack("<q", len(docs)) + docs.tobytes() + hashes.tobytes() + starts.astype(np.int32).tobytes() + sizes.tobytes() + b"".join(strings)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    n = struct.unpack_from("<q", blob)[0]
    docs, hashes = (np.frombuffer(blob, np.int64, n, 8 + 8 * k * n) for k in (0, 1))
    starts, sizes = (np.frombuffer(blob, np.int32, n, 8 + 16 * n + 4 * k * n) for k in (0, 1))
    return docs, hashes, starts, sizes, blob[8 + 24 * n :]


SPANS = "doc bigint, text_hash bigint, lo int, hi int, bucket int, blob binary"


def _spans_batch(docs, hashes, lo, hi) -> pa.RecordBatch:
    n = len(docs)
    arrays = [pa.array(docs, pa.int64()), pa.array(hashes, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["doc", "text_hash", "lo", "hi", "bucket", "blob"])


def _blob_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    n = batch.num_rows
    arrays = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), *batch.columns]
    return pa.RecordBatch.from_arrays(arrays, names=["doc", "text_hash", "lo", "hi", "bucket", "blob"])


def hot_cells(documents: DataFrame, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """Which cells hold over one HOT_CELLS-th of all super-k-mers, by a count over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                total += np.bincount(cells_of(super_kmers(data, offsets, width, seed)[0][5]), minlength=CELLS)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "k"])

    counts = documents.select(F.col("text").cast("string")).transform(map_arrow, count, "cell long, k long").groupBy("cell").agg(F.sum("k").alias("k"))
    rows = counts.select("cell", "k", (F.sum("k").over(Window.partitionBy(F.lit(0))) / HOT_CELLS).alias("least")).where("k > least")  # CELLS rows at most
    out = np.zeros(CELLS, dtype=bool)
    out[[r.cell for r in rows.collect()]] = True
    return out


def _partitioner(n_buckets: int, width: int, seed: int, hot: np.ndarray):
    table_ = bytes(32 if c in (9, 10, 11, 12, 13) else c for c in range(256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Buckets(n_buckets, FLUSH_BYTES, _pack, level=3)
        seen: dict[bytes, tuple[int, int, int]] = {}
        twins: dict[tuple[bytes, int, int, int], int] = {}  # rows of another text at a holder's place
        settled: list[tuple[int, int, int, int]] = []

        def drain() -> Iterator[pa.RecordBatch]:
            if settled:
                yield _spans_batch(*zip(*settled, strict=True))
                settled.clear()
            if seen:
                kept = [*seen.values(), *((doc, text, start, bucket) for (_, doc, text, start), bucket in twins.items())]
                strings = np.empty(len(kept), dtype=object)
                strings[:] = [*seen, *(string for string, *_ in twins)]
                docs, hashes, starts, buckets = (np.array(c, dtype=np.int64) for c in zip(*kept, strict=True))
                out.add(buckets, (docs, hashes, starts, strings), 0)
                seen.clear()
                twins.clear()
                blobs = out.flush()
                if blobs is not None:
                    yield _blob_batch(blobs)

        size = 0
        for batch in batches:
            ids = batch.column(0).fill_null(NULL_ID).to_numpy()
            hashes = batch.column(1).to_numpy()
            for lo, _, data, offsets in text_slices(batch.column(2)):
                (row, first, n, a, b, least), _ = super_kmers(data, offsets, width, seed, hot)
                raw = data.tobytes().translate(table_)
                buckets = ((least >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int64)
                docs, texts = ids[row + lo].tolist(), hashes[row + lo].tolist()
                for doc, text, start, count, x, y, bucket in zip(docs, texts, first.tolist(), n.tolist(), a.tolist(), b.tolist(), buckets.tolist(), strict=True):
                    string = raw[x:y]
                    if b"  " in string:
                        string = b" ".join(string.split())
                    old = seen.get(string)
                    if old is None:
                        seen[string] = (doc, text, start, bucket)
                        size += len(string)
                        continue
                    later = (doc, text, start)
                    if (doc, start) < (old[0], old[2]):
                        seen[string], later = (doc, text, start, bucket), old[:3]
                    elif (doc, start) == (old[0], old[2]):  # one place, neither is earlier; a row of another text is posted too
                        if text != old[1] and (string, doc, text, start) not in twins:
                            twins[string, doc, text, start] = bucket
                            size += len(string)
                        continue
                    settled.append((later[0], later[1], later[2], later[2] + count + width - 1))
                if size >= FLUSH_BYTES:
                    yield from drain()
                    size = 0
        yield from drain()

    return run


def _repeats(blobs: list[bytes], width: int) -> Iterator[pa.RecordBatch]:
    """Spans of windows that occur earlier, among the super-k-mers of whole buckets."""
    docs, hashes, first, sizes, texts = zip(*map(_unpack, blobs), strict=True)
    docs, hashes, first, sizes = (np.concatenate(x) for x in (docs, hashes, first, sizes))
    raw = b"".join(texts)
    data = np.frombuffer(raw, dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    starts, ends, rows = words_of(data, offsets)
    windows = window_hashes(word_hashes(data, starts, ends), width)
    at = np.flatnonzero(in_one_row(rows, width))
    key = windows[at]
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    at, key = at[order[keep]], key[keep]
    every = at
    if not len(at):
        return
    row = rows[at]
    start = first[row] + (at - np.searchsorted(rows, row, "left"))
    order = np.lexsort((start, docs[row], key))
    at, key, row, start = at[order], key[order], row[order], start[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    origin = np.flatnonzero(new)[np.cumsum(new) - 1]
    doc = docs[row]
    later = (doc != doc[origin]) | (start != start[origin])
    at, origin_at, row, start = at[later], at[origin][later], row[later], start[later]
    if not len(at):
        return
    order = np.argsort(at, kind="stable")
    at, origin_at, row, start = at[order], origin_at[order], row[order], start[order]
    # runs on one diagonal are compared as text at once
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (origin_at[1:] != origin_at[:-1] + 1) | (row[1:] != row[:-1]) | (rows[origin_at[1:]] != rows[origin_at[:-1]])]))
    n = np.diff(np.append(cut, len(at)))
    a, b = at[cut], origin_at[cut]
    last = n + width - 2
    spans = zip(starts[a].tolist(), ends[a + last].tolist(), starts[b].tolist(), ends[b + last].tolist(), strict=True)
    true = np.fromiter((raw[p:q] == raw[r:s] for p, q, r, s in spans), dtype=bool, count=len(a))
    if not true.all():  # windows of one hash that differ: those of such a run are told apart by their words
        false = np.repeat(~true, n)
        doubt = np.isin(windows[every], np.unique(windows[at[false]]))
        yield _by_words(raw, starts, ends, every[doubt], docs, hashes, first, rows, width)
        sure = ~np.isin(windows[at], np.unique(windows[at[false]]))
        at, row, start = at[sure], row[sure], start[sure]
        cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])])) if len(at) else at
        n = np.diff(np.append(cut, len(at)))
    r, s = row[cut], start[cut]
    yield _spans_batch(docs[r], hashes[r], s, s + n + width - 1)


def _by_words(raw, starts, ends, windows, docs, hashes, first, rows, width: int) -> pa.RecordBatch:
    """Spans of the given windows that repeat an earlier one word for word."""
    held: dict[bytes, list[int]] = {}
    for k in windows.tolist():
        held.setdefault(raw[starts[k] : ends[k + width - 1]], []).append(k)
    found = []
    for same in held.values():
        row = rows[np.array(same)]
        places = [(int(docs[r]), int(first[r] + k - np.searchsorted(rows, r, "left")), int(hashes[r])) for r, k in zip(row.tolist(), same, strict=True)]
        origin = min(p[:2] for p in places)
        found += [(doc, text, at, at + width) for doc, at, text in places if (doc, at) != origin]
    return _spans_batch(*zip(*found, strict=True)) if found else _spans_batch([], [], [], [])


def repeated_spans(documents: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc, text_hash and word ranges [lo, hi) of windows that start earlier elsewhere."""
    n_buckets = BUCKETS_A_PARTITION * shuffle_partitions(documents.sparkSession)
    hot = hot_cells(documents, width, seed)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settled, blobs = [], None

        def split() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                local = batch.column(2).is_valid()
                if local.true_count:
                    settled.append(batch.filter(local).select(["doc", "text_hash", "lo", "hi"]))
                yield batch.filter(batch.column(5).is_valid()).select(["bucket", "blob"])

        for blobs in bucket_groups(split(), GROUP_BYTES):
            for out in _repeats(blobs, width):
                yield out.select(["doc", "text_hash", "lo", "hi"])
            yield from settled
            settled.clear()
        yield from settled

    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.col("text").cast("string"))
    found = rows.transform(map_arrow, _partitioner(n_buckets, width, seed, hot), SPANS)
    dealt = to_buckets(found.withColumn("bucket", F.coalesce("bucket", (F.pmod(F.hash("doc", "lo"), F.lit(n_buckets))).cast("int"))))
    return dealt.transform(map_arrow, reduce, "doc long, text_hash long, lo int, hi int")


def _cutter(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = large(batch.column("text"))
            spans = batch.column("spans").to_pylist()
            kept: list[str | None] = []
            n_words, n_removed = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for lo, hi, data, offsets in text_slices(column):
                starts, ends, rows = words_of(data, offsets)
                raw = data.tobytes()
                bounds = np.searchsorted(rows, np.arange(hi - lo + 1), "left").tolist()
                for i in range(hi - lo):
                    x, y = bounds[i], bounds[i + 1]
                    n_words[lo + i] = y - x
                    stay = np.ones(y - x, dtype=bool)
                    for s in spans[lo + i] or ():
                        stay[s["lo"] : s["hi"]] = False
                    n_removed[lo + i] = y - x - int(stay.sum())
                    if not n_removed[lo + i]:
                        kept.append(b" ".join(raw[int(offsets[i]) : int(offsets[i + 1])].split()).decode())
                    else:
                        at = np.flatnonzero(stay) + x
                        kept.append(b" ".join([raw[p:q] for p, q in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]).decode())
            out = batch.drop_columns(["spans"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(n_words), pa.array(n_removed), pa.array(kept, pa.string())], names=[*out.schema.names, "n_words", "n_removed", "kept"])

    return run


def dedup(documents: DataFrame, width: int = WIDTH, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the columns to keep, n_words, n_removed and kept: the words that stay, joined by one space."""
    # written first, so that the strings' shuffle files go before the texts are dealt out
    spans = materialise(repeated_spans(documents, width, seed), "spans").groupBy("doc", "text_hash").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        *keep,
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"),
    )
    joined = rows.join(spans, ["doc", "text_hash"], "left").select("doc_id", "text", *keep, "spans")
    schema = ", ".join(f"`{n}` {t}" for n, t in joined.drop("spans").dtypes)
    return joined.transform(map_arrow, _cutter(width), f"{schema}, n_words long, n_removed long, kept string")


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, s, array_to_string(w[s + 1 : s + 20], ' ') AS t FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 19, 0))) AS s FROM d)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS k FROM v) WHERE k > 1),
p AS (SELECT doc_id, w[i + 1] AS word, i FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d)),
c AS (SELECT p.doc_id, p.i, p.word, a.s IS NOT NULL AND p.i < a.s + 20 AS gone FROM p ASOF LEFT JOIN r a ON p.doc_id = a.doc_id AND p.i >= a.s),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
