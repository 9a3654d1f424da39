"""N-gram Jaccard self-join by grouped prefixes, and the components of its links.

A document's set is its distinct SHINGLE-word runs (lower case A-Z), as 64-bit hashes; with
fewer words the whole sequence. Sets are ordered rarest first by a count sketch of fixed
size (SKETCH_BITS, 4 MB when broadcast) that covers all documents; the order decides only
what is fast, never what is found. Two sets of Jaccard similarity t share a token among
the first n - ceil(t n) + 1 of each.

Grouped prefix join: equal sets are one class, classes of one prefix and size one group.
A group posts its prefix once; tokens meet in buckets as compressed blobs. Each posting list of two or more groups is a candidate
list; equal lists are kept once. Members of a list are first held against an upper bound of what
they share, the sum of lesser counts over hash cells. Of the pairs that pass, those with one leader of each
list are verified first, LEADERS times with other leaders; components of those links follow; then only
members of different components are compared, so that a large group of near copies never
makes all its pairs, while no link between components is lost. Pairs are verified on whole sets. Nothing is collected on the driver but
the sketch, the number of edges and hot keys, of which there are few by definition.

No task holds a long list: its rows are dealt over salts where it is joined, and the comparison of
components goes by units, a block of the members outside the largest component with a block of all.
Shingles are told apart by 64 bits of a keyed, non-linear hash, classes by 128 bits; group and list keys
that collide only make more candidates.

Null or empty texts have an empty set and link with nothing; a null doc_id takes part but
is never a component's least id unless alone; repeated rows are copies of one another;
other columns are ignored, an empty table gives no rows. A long text is one row of a worker, whose memory
grows with its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Buckets, bucket_groups, drop, hot_keys, in_one_row, join_spread, map_arrow, materialise, shuffle_partitions, table, text_slices, to_buckets, window_hashes, word_hashes, words_of

SHINGLE, PERCENT = 5, 75
#: Cells of the sketch as a power of two, and the blocks it is summed in.
SKETCH_BITS, SKETCH_BLOCKS = 22, 16
BUCKETS_A_PARTITION, FLUSH_BYTES, GROUP_BYTES = 8, 8 << 20, 4 << 20
#: Rounds of leaders before all pairs across components; least cells of the upper bound, as a power of two.
LEADERS, CELL_BITS = 2, 6
#: Members of a block of a list; lists that a task remembers, so as not to send one twice.
BLOCK, REMEMBERED = 512, 1 << 20
#: Below this size two sizes in a group key are exact; above, only the sets tell.
SIZE_CLIP = (1 << 16) - 1


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    for lo, hi, data, offsets in text_slices(column):
        data = lower[data]
        starts, ends, rows = words_of(data, offsets)
        words = word_hashes(data, starts, ends)
        bounds = np.searchsorted(rows, np.arange(hi - lo + 1), "left")
        at = in_one_row(rows, shingle)
        runs = window_hashes(words, shingle)[at]
        cuts = np.searchsorted(rows[: len(at)][at], np.arange(hi - lo + 1), "left").tolist()
        for i in range(hi - lo):
            n = int(bounds[i + 1] - bounds[i])
            if n >= shingle:
                yield lo + i, np.unique(runs[cuts[i] : cuts[i + 1]])
            elif n:
                yield lo + i, window_hashes(words[bounds[i] : bounds[i + 1]], n) ^ np.uint64(n)
            else:
                yield lo + i, np.zeros(0, np.uint64)


def sketch(documents: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """How often tokens of each cell occur, as levels of a power of two in 0..31; a table of fixed size."""
    cells, size = 1 << SKETCH_BITS, (1 << SKETCH_BITS) // SKETCH_BLOCKS

    def blobs(total: np.ndarray) -> pa.RecordBatch:
        zip_ = zstandard.ZstdCompressor(level=1)
        parts = [zip_.compress(total[k * size : (k + 1) * size].tobytes()) for k in range(SKETCH_BLOCKS)]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(SKETCH_BLOCKS, dtype=np.int32)), pa.array(parts, pa.binary())], names=["block", "blob"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, dtype=np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                held = [s for _, s in shingle_sets(batch.column(0).slice(a, 2000), shingle)]
                found, n = np.unique((np.concatenate(held) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), return_counts=True)
                total[found] += n
        if total.any():
            yield blobs(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, sums = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(unzip.decompress(blob.as_py()), dtype=np.int64)
                sums[block] = sums[block] + part if block in sums else part
        zip_ = zstandard.ZstdCompressor(level=1)
        for block, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zip_.compress(total.tobytes())], pa.binary())], names=["block", "blob"])

    kind = "block int, blob binary"
    parts = documents.select(F.col("text").cast("string")).transform(map_arrow, count, kind)
    n = shuffle_partitions(documents.sparkSession)
    parts = parts.repartition(n, "block", F.pmod(F.spark_partition_id(), F.lit(max(1, n // SKETCH_BLOCKS)))).transform(map_arrow, add, kind)
    parts = parts.repartition(min(n, SKETCH_BLOCKS), "block").transform(map_arrow, add, kind)
    levels, unzip = np.zeros(cells, dtype=np.uint8), zstandard.ZstdDecompressor()
    for block, blob in parts.collect():  # SKETCH_BLOCKS rows, of 2 MB together at most a block
        counts = np.frombuffer(unzip.decompress(bytes(blob)), dtype=np.int64)
        levels[block * size : (block + 1) * size] = np.minimum(31, np.ceil(np.log2(counts + 1)))
    return levels


def prefix_of(tokens: np.ndarray, levels: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The rarest tokens of a set, of which a similar set must have one."""
    n = len(tokens)
    if not n:
        return tokens
    size = n - (percent * n + 99) // 100 + 1
    rank = (levels[tokens >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(59)) | (tokens >> np.uint64(5))
    return np.sort(tokens[np.argpartition(rank, size - 1)[:size]]) if size < n else tokens


def group_digest(prefix: np.ndarray, n: int) -> bytes:
    return hashlib.blake2b(prefix.tobytes() + n.to_bytes(8, "little"), digest_size=16).digest()


def group_key(digest: bytes, n: int) -> int:
    """Signed 64-bit key of prefix and size; the size, up to SIZE_CLIP, in its low 16 bits."""
    return (int.from_bytes(digest[:8], "little", signed=True) & ~0xFFFF) | min(n, SIZE_CLIP)


def class_key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def cells_of(tokens: np.ndarray) -> bytes:
    """Tokens counted by hash cells, two to four cells for each token, two cells a byte.

    Were one count over 15, all cells would say 15, which keeps sums of lesser counts an upper bound.
    """
    bits = max(CELL_BITS, int(2 * len(tokens) - 1).bit_length())
    counts = np.bincount((tokens >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    counts = counts.astype(np.uint8) if counts.max() <= 15 else np.full(1 << bits, 15, np.uint8)
    return (counts[::2] | (counts[1::2] << 4)).tobytes()


def open_cells(raw: bytes) -> np.ndarray:
    packed = np.frombuffer(raw, dtype=np.uint8)
    out = np.empty(2 * len(packed), dtype=np.uint8)
    out[::2], out[1::2] = packed & 15, packed >> 4
    return out


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def document_classes(documents: DataFrame, levels: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n (size of the set), cls (key of the set), grp (key of prefix and size), cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls, grp, cells = [], [], [], []
            for _, tokens in shingle_sets(batch.column(2), shingle):
                n.append(len(tokens))
                cells.append(cells_of(tokens) if len(tokens) else None)
                cls.append(class_key(tokens) if len(tokens) else None)
                grp.append(group_key(group_digest(prefix_of(tokens, levels, percent), len(tokens)), len(tokens)) if len(tokens) else None)
            arrays = [pa.array(x, kind) for x, kind in ((n, pa.int64()), (cls, pa.binary()), (grp, pa.int64()), (cells, pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["doc_id", "text_hash", "n", "cls", "grp", "cells"])

    return documents.select(F.col("doc_id").cast("long"), text_hash("text"), F.col("text").cast("string")).transform(map_arrow, run, "doc_id long, text_hash long, n long, cls binary, grp long, cells binary")


def _pack(tokens: np.ndarray, groups: np.ndarray) -> bytes:
    order = np.argsort(tokens)
    return tokens[order].tobytes() + groups[order].tobytes()


def candidate_lists(documents: DataFrame, levels: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """Lists of groups that share a prefix token and whose sizes may fit; each list once."""
    n_buckets = BUCKETS_A_PARTITION * shuffle_partitions(documents.sparkSession)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, posted = Buckets(n_buckets, FLUSH_BYTES, _pack), set()
        for batch in batches:
            for _, tokens in shingle_sets(batch.column(0), shingle):
                if not len(tokens):
                    continue
                prefix = prefix_of(tokens, levels, percent)
                digest = group_digest(prefix, len(tokens))
                if digest in posted:
                    continue
                posted.add(digest)
                key = group_key(digest, len(tokens))
                buckets = ((prefix & np.uint64(0xFFFFFFFF)) % np.uint64(n_buckets)).astype(np.int32)
                blobs = out.add(buckets, (prefix >> np.uint64(16), np.full(len(prefix), key)), 20 * len(prefix))
                if blobs is not None:
                    yield blobs
        blobs = out.flush()
        if blobs is not None:
            yield blobs

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: set[bytes] = set()
        for blobs in bucket_groups(batches, GROUP_BYTES):
            halves = [np.frombuffer(b, dtype=np.uint64).reshape(2, -1) for b in blobs]
            tokens, groups = np.concatenate([h[0] for h in halves]), np.concatenate([h[1] for h in halves]).view(np.int64)
            order = np.argsort(tokens, kind="stable")
            tokens, groups = tokens[order], groups[order]
            same = tokens[1:] == tokens[:-1]
            keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            tokens, groups = tokens[keep], groups[keep]
            sizes = groups & 0xFFFF
            order = np.lexsort((groups, sizes, tokens))
            tokens, groups, sizes = tokens[order], groups[order], sizes[order]
            fresh = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (groups[1:] != groups[:-1])])[: len(tokens)]
            tokens, groups, sizes = tokens[fresh], groups[fresh], sizes[fresh]
            if not len(tokens):
                continue
            # sizes ascend in a list: none across a gap can be similar
            cut = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | ((percent * sizes[1:] > 100 * sizes[:-1]) & (sizes[1:] < SIZE_CLIP))])
            cuts = np.flatnonzero(cut)
            ends = np.append(cuts[1:], len(tokens))
            long = ends - cuts > 1
            found, keys = [], []
            raw = groups.tobytes()
            for a, b in zip(cuts[long].tolist(), ends[long].tolist(), strict=True):
                digest = hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest()
                if digest not in made:
                    made.add(digest)
                    keys.append(int.from_bytes(digest[:8], "little", signed=True))
                    found.append(groups[a:b])
            if len(made) > REMEMBERED:
                made.clear()
            if keys:
                flat = np.concatenate(found)
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["list", "groups"])

    posted = documents.select(F.col("text").cast("string")).transform(map_arrow, post, "bucket int, blob binary")
    return to_buckets(posted).transform(map_arrow, lists, "list long, groups array<long>").dropDuplicates(["list", "groups"])


def with_classes(pairs: DataFrame, classes: DataFrame, *columns: str) -> DataFrame:
    """The pairs with columns of both classes, those of a `<column>_a`; a class of very many pairs is dealt out."""
    out = pairs
    for c, other in ("ab", "ba"):
        own = classes.select(F.col("cls").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in columns))
        out = join_spread(out, own, c, other, hot_keys(pairs, c))
    return out.select("a", "b", *(f"{x}_{c}" for x in columns for c in "ab"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are similar enough; `pairs` is a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (len(both) - common))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return with_classes(pairs, sets, "tokens").transform(map_arrow, run, "a binary, b binary")


def sets_of(documents: DataFrame, classes: DataFrame, needed: DataFrame, shingle: int) -> DataFrame:
    """cls, tokens of the classes needed, from one document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                sets = [s for _, s in shingle_sets(batch.column(0).slice(a, 500), shingle)]
                yield pa.RecordBatch.from_arrays([pa.array([class_key(s) if len(s) else None for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "tokens"])

    ids = classes.join(needed, "cls", "left_semi").select("doc_id")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    same = texts["doc_id"].eqNullSafe(ids["doc_id"])
    found = texts.join(ids, same, "left_semi").select("text").transform(map_arrow, run, "cls binary, tokens binary").where("cls IS NOT NULL")
    return found.dropDuplicates(["cls"])


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component), by alternating large and small stars."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select("v", "u")) if large else e
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = join_spread(both, least, "u", "v", hot_keys(both, "u"))
        if large:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = mark(edges)
    while before[0]:
        half = materialise(star(edges, True), "edges")
        drop(edges)
        edges = materialise(star(half, False), "edges")
        drop(half)
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges


class Members:
    """The classes of one candidate list, or of one unit of it, by size, and what they may share at most."""

    def __init__(self, cls: list[bytes], n: np.ndarray, cells: list[bytes], labels: np.ndarray, percent: int) -> None:
        order = np.argsort(n, kind="stable")
        self.order, self.cls, self.n, self.labels, self.percent = order, [cls[k] for k in order], n[order], labels[order], percent
        own = [open_cells(cells[k]) for k in order]
        self.width = np.array([len(c) for c in own])
        self.tables = {}
        for width in np.unique(self.width).tolist():
            first = int(np.searchsorted(self.width, width))
            self.tables[width] = first, np.stack([c if len(c) == width else np.minimum(c.reshape(width, -1).sum(axis=1, dtype=np.int32), 255).astype(np.uint8) for c in own[first:]])

    def may_link(self, i: int, lo: int, hi: int) -> np.ndarray:
        """Which members in lo..hi, none smaller than member i, may be similar to it."""
        first, table = self.tables[int(self.width[i])]
        shared = np.minimum(table[lo - first : hi - first], table[i - first]).sum(axis=1, dtype=np.int64)
        n = self.n[lo:hi]
        fits = 100 * self.n[i] >= self.percent * n
        bound = (100 + self.percent) * shared >= self.percent * (self.n[i] + n)
        return fits & bound

    def with_partner(self) -> np.ndarray:
        """Which members may be similar to another one of the list."""
        out = np.zeros(len(self.n), dtype=bool)
        for i in range(len(self.n)):
            lo = i + 1
            end = int(np.searchsorted(self.n, 100 * self.n[i] // self.percent, "right"))
            while lo < end and not (out[i] and out[lo:end].all()):
                hi = min(end, lo + 1024)
                good = self.may_link(i, lo, hi)
                out[lo:hi] |= good
                out[i] |= good.any()
                lo = hi
        return out

    def pairs(self, key: int, lists: list[set[int]], outer: np.ndarray, inner: np.ndarray, main: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs of different labels, one of the outer block and one of the inner, whose first common list is this one.

        Members outside the main component stand in both kinds of blocks: of two such the lesser is taken as the outer one.
        """
        for i in range(len(self.n)):
            end = int(np.searchsorted(self.n, 100 * self.n[i] // self.percent, "right"))
            j = slice(i + 1, end)
            wanted = (self.labels[j] != self.labels[i]) & ((outer[i] & inner[j]) | (inner[i] & outer[j]))
            other = np.flatnonzero(wanted) + i + 1
            if len(other):
                lo, hi = int(other[0]), int(other[-1]) + 1
                good = self.may_link(i, lo, hi) & wanted[lo - i - 1 : hi - i - 1]
                for j in (np.flatnonzero(good) + lo).tolist():
                    x, y = (i, j) if self.cls[i] < self.cls[j] else (j, i)
                    fits = outer[x] and inner[y] if not main[i] and not main[j] else True
                    if fits and min(lists[i] & lists[j]) == key:
                        yield i, j


def _lists(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each list, or unit, of rows sorted by `keys`."""
    held: pa.Table | None = None

    def cut(table: pa.Table, whole: bool):
        ids = [np.asarray(table.column(k)) for k in keys]
        new = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in ids], axis=0)])
        cuts = np.flatnonzero(new).tolist()
        for a, b in list(zip(cuts, [*cuts[1:], table.num_rows], strict=True))[: None if whole else -1]:
            yield table.slice(a, b - a)
        return table.slice(0 if whole else cuts[-1])

    for batch in batches:
        if batch.num_rows:
            more = pa.Table.from_batches([batch])
            held = yield from cut(more if held is None else pa.concat_tables([held, more]).combine_chunks(), False)
    if held is not None and held.num_rows:
        yield from cut(held, True)


def _numbered(values: list) -> np.ndarray:
    at = {v: k for k, v in enumerate(dict.fromkeys(values))}
    return np.array([at[v] for v in values], dtype=np.int64)


def live_members(members: DataFrame, percent: int) -> DataFrame:
    """The rows (list, cls) whose class may be similar to another one of the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _lists(batches, ("list",)):
            n = np.asarray(rows.column("n"))
            m = Members(rows.column("cls").to_pylist(), n, rows.column("cells").to_pylist(), np.arange(len(n)), percent)
            cls = [m.cls[k] for k in np.flatnonzero(m.with_partner())]
            if cls:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cls), rows.column("list")[0].as_py())), pa.array(cls, pa.binary())], names=["list", "cls"])

    dealt = members.select("list", "cls", "n", "cells").repartition(shuffle_partitions(members.sparkSession), "list").sortWithinPartitions("list")
    return dealt.transform(map_arrow, run, "list long, cls binary")


def labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("cls"))
    return members.join(labels.select(F.col("u").alias("cls"), F.col("v").alias("label")), "cls", "left").withColumn("label", F.coalesce("label", "cls"))


def leader_pairs(live: DataFrame, hot: DataFrame | None, classes: DataFrame, labels: DataFrame | None, percent: int, seed: int) -> DataFrame:
    """Each member of a list with the list's leader of this round, if their labels differ and they may be similar.

    The leader is the member of least hash, alike in most lists of a group of near copies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "cells_a", "cells_b")), strict=True):
                pair = Members([b"a", b"b"], np.array([n, m]), [x, y], np.array([0, 1]), percent)
                good.append(bool(pair.may_link(0, 1, 2)[0]))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    rows = labelled(live.select("list", "cls"), labels)
    lead = rows.groupBy("list").agg(F.min(F.struct(F.xxhash64("cls", F.lit(seed)).alias("h"), "cls", "label")).alias("lead"))
    pairs = join_spread(rows, lead, "list", "cls", hot).where(F.col("label") != F.col("lead.label"))
    pairs = materialise(pairs.select(F.least("cls", "lead.cls").alias("a"), F.greatest("cls", "lead.cls").alias("b")).distinct(), "led")
    found = with_classes(pairs, classes, "n", "cells")
    found = found.where(F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b"))
    return found.transform(map_arrow, run, "a binary, b binary")


def other_pairs(live: DataFrame, hot: DataFrame | None, classes: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """All pairs of a list that have different labels and may be similar, each pair once.

    A list is cut into units: an outer block of members outside its largest component with an inner block of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _lists(batches, ("list", "o", "i")):
            key, cls = rows.column("list")[0].as_py(), rows.column("cls").to_pylist()
            first = np.unique(_numbered(cls), return_index=True)[1]  # one in both blocks has two rows
            is_outer = {c for c, x in zip(cls, rows.column("outer").to_pylist(), strict=True) if x}
            is_inner = {c for c, x in zip(cls, rows.column("outer").to_pylist(), strict=True) if not x}
            rows = rows.take(pa.array(first))
            cls = rows.column("cls").to_pylist()
            m = Members(cls, np.asarray(rows.column("n")), rows.column("cells").to_pylist(), _numbered(rows.column("label").to_pylist()), percent)
            lists = [set(x) for x in rows.column("lists").take(pa.array(m.order)).to_pylist()]
            outer, inner = (np.array([c in x for c in m.cls]) for x in (is_outer, is_inner))
            main = np.asarray(rows.column("main"))[m.order]
            new = [sorted((m.cls[i], m.cls[j])) for i, j in m.pairs(key, lists, outer, inner, main)]
            if new:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in new], pa.binary()), pa.array([y for _, y in new], pa.binary())], names=["a", "b"])

    rows = labelled(live, labels)
    kinds = rows.groupBy("list", "label").agg(F.count("*").alias("k")).groupBy("list").agg(F.sum("k").alias("m"), F.max(F.struct("k", "label")).alias("top"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = kinds.where("top.k < m").select("list", F.col("top.label").alias("most"), blocks(F.col("m") - F.col("top.k")).alias("outers"), blocks(F.col("m")).alias("inners"))
    rows = join_spread(rows, mixed, "list", "cls", hot).withColumn("main", F.col("label") == F.col("most"))
    of = lambda count, seed: F.pmod(F.xxhash64("cls", F.lit(seed)), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    common = ["list", "cls", "label", "main"]
    inner = rows.select(*common, every("outers").alias("o"), of("inners", 1).alias("i"), F.lit(False).alias("outer"))
    outer = rows.where("NOT main").select(*common, of("outers", 2).alias("o"), every("inners").alias("i"), F.lit(True).alias("outer"))
    lists = live.groupBy("cls").agg(F.collect_set("list").alias("lists"))  # as many as the class has prefix tokens, at most
    dealt = inner.union(outer).join(classes.select("cls", "n", "cells"), "cls").join(lists, "cls")
    dealt = dealt.repartition(shuffle_partitions(live.sparkSession), "list", "o", "i").sortWithinPartitions("list", "o", "i")
    return dealt.transform(map_arrow, run, "a binary, b binary")


def link(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    return linked(documents, shingle, percent).select("doc_id", "n_shingles", "component_id")


def linked(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The same with text_hash and `label`, a key of the component (null: an empty set)."""
    levels = sketch(documents, shingle)
    rows = materialise(document_classes(documents, levels, shingle, percent), "rows")
    classes = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("grp").alias("grp"), F.first("n").alias("n"), F.first("cells").alias("cells"))
    classes = materialise(classes, "classes")
    lists = candidate_lists(documents, levels, shingle, percent)
    shared = classes.groupBy("grp").agg(F.count("*").alias("k")).where("k > 1").select(F.col("grp").alias("list"), F.array("grp").alias("groups"))
    lists = lists.union(shared).select("list", F.explode("groups").alias("grp"))
    members = materialise(join_spread(classes.select("grp", "cls", "n"), lists, "grp", "cls", hot_keys(classes, "grp")).select("list", "cls", "n"), "members")
    hot = hot_keys(members, "list")
    cold = members if hot is None else members.join(F.broadcast(hot), "list", "left_anti")
    live = live_members(cold.join(classes.select("cls", "cells"), "cls"), percent)
    if hot is not None:  # members of long lists need no partner to stay
        live = live.union(members.join(F.broadcast(hot.select("list")), "list", "left_semi").select("list", "cls"))
    live = materialise(live, "live")
    drop(members)
    sets = materialise(sets_of(documents, classes, live.select("cls").distinct(), shingle), "sets")
    labels = None
    for seed in (*range(LEADERS), None):
        found = other_pairs(live, hot, classes, labels, percent) if seed is None else leader_pairs(live, hot, classes, labels, percent, seed)
        pairs = materialise(found, "pairs")
        if pairs.isEmpty():
            continue
        links = materialise(verified(pairs, sets, percent), "links")
        edges = links if labels is None else links.union(labels.select(F.col("u").alias("a"), F.col("v").alias("b")))
        before, labels = labels, components(edges)
        drop(before, pairs, links)
    drop(sets, live)
    named = labelled(classes.select("cls", "doc_id"), labels)
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    hot = hot_keys(labels.select(F.col("v").alias("label")), "label") if labels is not None else None
    named = join_spread(named, least, "label", "cls", hot).select("cls", "component_id", "label")
    full = rows.where("cls IS NOT NULL").select("doc_id", "text_hash", "n", "cls")
    out = join_spread(full, named, "cls", "doc_id", hot_keys(full, "cls")).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "text_hash", "label")
    alone = rows.where("cls IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_hash", F.lit(None).cast("binary").alias("label"))
    return out.union(alone)


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS t FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 0))) AS i FROM d)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM i JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""
