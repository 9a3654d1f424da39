"""Byte-level BPE by DuckDB recursive queries, one database for each Python worker.

Encoding: the pre-tokenizer's matches are looked up among the ranks; words that are no
token become token-position rows in DuckDB. A recursive query joins neighbours with the
merge table and contracts each word's leftmost pair of minimum rank until no pair is left.
Words longer than a block of positions take the same steps, many to a round. A block is twice as long as the
longest token, so no contraction that comes earlier can reach a pair from beyond the block beside its own. Where
the least rank of three blocks is r, all pairs of rank r in the middle one are contracted at once, of overlapping
ones (`aaa`) each second from the left, if no such contraction can make a pair of lesser rank (and, for a run of overlapping
ones, if that holds in all its blocks); otherwise the leftmost alone. Ids are those of one
contraction at a time, after as many rounds as a block takes.

Words are encoded once and kept for the worker's life (at most CACHE_WORDS of them; the
cache is emptied when full, which costs time and changes nothing). Decoding: id-position rows join the
vocabulary and an ordered aggregation puts the bytes together, in slices also within a row.

No shuffle. A null text counts as empty, an empty text has no ids; repeated rows are
encoded apart, a null doc_id stays null, other columns are ignored, an empty table gives no rows. A
long text is split by parts where the pattern is the public one; one match of the pattern is held whole, at some 150
bytes for each of its bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import large, map_arrow, offsets_of, row_slices, table, worker_cache
from docloom.llm.pretokens import PART_CHARS, PATTERN, parts, splitter

CACHE_WORDS = 1_000_000
#: Text that is split at once, bytes of words in one recursive query, ids of one decoding query.
SPLIT_BYTES, QUERY_BYTES, DECODE_IDS = 2 << 20, 400_000, 250_000
#: Rounds of one recursive query over long words, whose rows are all held, and rows of it in all; memory of a worker's database.
ROUNDS, QUERY_ROWS, MEMORY = 16, 4_000_000, "1GB"

MERGE = """
WITH RECURSIVE state(w, pos, tok, done) AS (
  SELECT w, pos, tok, false FROM base
  UNION ALL
  (WITH pairs AS MATERIALIZED (
     SELECT p.w, p.pos, p.tok, m.rank, (m.rank::BIGINT << 44) | (p.pos::BIGINT << 22) | p.next AS place
     FROM (SELECT w, pos, tok, lead(tok) OVER own AS follows, lead(pos) OVER own AS next
           FROM state WHERE NOT done WINDOW own AS (PARTITION BY w ORDER BY pos)) p
     LEFT JOIN merges m ON m.pair = ((p.tok::BIGINT << 24) | p.follows)),
   least AS (SELECT w, min(place) AS best FROM pairs GROUP BY w)
   SELECT p.w, p.pos, CASE WHEN p.place = l.best THEN p.rank ELSE p.tok END, l.best IS NULL
   FROM pairs p JOIN least l ON p.w = l.w
   WHERE l.best IS NULL OR p.pos <> (l.best & 4194303))
)
SELECT w, pos, tok, true AS done FROM state WHERE done
"""
#: The same for words of several blocks: `wild` pairs may make one of lesser rank, `nth` counts overlapping pairs of one rank.
MERGE_LONG = """
WITH RECURSIVE state(w, pos, tok, done, round) AS (
  SELECT w, pos, tok, false, 0 FROM base
  UNION ALL
  (WITH pairs AS MATERIALIZED (
     SELECT p.*, p.pos // {block} AS block, m.rank, m.rank IS NOT NULL AND (coalesce(x.rank, m.rank) < m.rank OR coalesce(y.rank, m.rank) < m.rank OR coalesce(z.rank, m.rank) < m.rank) AS wild
     FROM (SELECT w, pos, tok, round, lag(tok) OVER own AS before, lead(tok) OVER own AS follows, lead(tok, 2) OVER own AS later, lead(pos) OVER own AS next
           FROM state WHERE NOT done AND round < {rounds} WINDOW own AS (PARTITION BY w ORDER BY pos)) p
     LEFT JOIN merges m ON m.pair = ((p.tok::BIGINT << 24) | p.follows)
     LEFT JOIN merges x ON x.pair = ((p.before::BIGINT << 24) | m.rank)
     LEFT JOIN merges y ON y.pair = ((m.rank::BIGINT << 24) | p.later)
     LEFT JOIN merges z ON z.pair = ((m.rank::BIGINT << 24) | m.rank)),
   runs AS (
     SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY pos) AS nth FROM (
       SELECT *, sum(CASE WHEN rank = last_rank THEN 0 ELSE 1 END) OVER own AS run FROM (
         SELECT *, lag(rank) OVER own AS last_rank FROM pairs WINDOW own AS (PARTITION BY w ORDER BY pos))
       WINDOW own AS (PARTITION BY w ORDER BY pos ROWS UNBOUNDED PRECEDING))),
   least AS MATERIALIZED (SELECT w, block, min(2 * rank + (NOT wild)::INT) AS best, min((rank::BIGINT << 40) | pos) AS place FROM pairs GROUP BY w, block),
   near AS (
     SELECT w, block, least(best, lag(best) OVER own, lead(best) OVER own) AS best, least(place, lag(place) OVER own, lead(place) OVER own) AS place
     FROM least WINDOW own AS (PARTITION BY w ORDER BY block)),
   chosen AS MATERIALIZED (
     SELECT w, pos, rank, next FROM (
       SELECT r.w, r.pos, r.rank, r.next, r.nth, ((r.rank::BIGINT << 40) | r.pos) = n.place AND n.best & 1 = 0 AS alone,
         bool_and(n.best = 2 * r.rank + 1) OVER (PARTITION BY r.w, r.run) AS whole
       FROM runs r JOIN near n ON n.w = r.w AND n.block = r.block WHERE r.rank IS NOT NULL)
     WHERE alone OR whole AND nth & 1 = 1),
   over AS (SELECT w FROM least GROUP BY w HAVING max(best) IS NULL)
   SELECT p.w, p.pos, coalesce(c.rank, p.tok), o.w IS NOT NULL, p.round + 1
   FROM pairs p LEFT JOIN chosen c ON c.w = p.w AND c.pos = p.pos LEFT JOIN over o ON o.w = p.w
   WHERE NOT EXISTS (SELECT 1 FROM chosen d WHERE d.w = p.w AND d.next = p.pos))
)
SELECT w, pos, tok, done FROM state WHERE done OR round = {rounds}
"""
DECODE = "SELECT doc, array_to_string(list(bytes ORDER BY pos), '') AS bytes FROM ids JOIN vocabulary USING (id) GROUP BY doc"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class Codec:
    """Encoder and decoder over one rank file and pre-tokenizer pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import duckdb

        self.ranks, self.split, self.words = ranks, splitter(pattern), {}
        self.parts = parts if pattern == PATTERN else lambda text: [text]
        self.block = 2 * max(map(len, ranks))
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        pairs = [(a << 24 | b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self.db.register("pairs", pa.table({"pair": pa.array([p for p, _ in pairs], pa.int64()), "rank": pa.array([r for _, r in pairs], pa.int32())}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM pairs")
        self.db.register("tokens", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array([t.decode("latin-1") for t in ranks], pa.string())}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM tokens")

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet."""
        if len(self.words) + len(words) > CACHE_WORDS:
            self.words.clear()
        batch = []
        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(raw)
            if rank is not None:
                self.words[word] = rank.to_bytes(4, "little")
            else:
                batch.append((word, raw))
        batch.sort(key=lambda x: len(x[1]))  # words of like lengths need like numbers of rounds
        lo, size = 0, 0
        for hi, (_, raw) in enumerate(batch):
            if size and (size + len(raw) > QUERY_BYTES or (len(raw) > self.block) != (len(batch[lo][1]) > self.block)):
                self._merge(batch[lo:hi])
                lo, size = hi, 0
            size += len(raw)
        if batch:
            self._merge(batch[lo:])

    def _merge(self, batch: list[tuple[str, bytes]]) -> None:
        """Contract the words until no pair is left."""
        sizes = np.array([len(raw) for _, raw in batch])
        starts = np.cumsum(sizes) - sizes
        w = np.repeat(np.arange(len(batch), dtype=np.int32), sizes)
        pos = (np.arange(sizes.sum()) - np.repeat(starts, sizes)).astype(np.int32)
        tok = self.byte_ids[np.frombuffer(b"".join(raw for _, raw in batch), dtype=np.uint8)]
        finished: list[tuple[np.ndarray, ...]] = []
        while len(w):
            rounds = max(1, min(ROUNDS, QUERY_ROWS // len(w)))
            self.db.register("base", pa.table({"w": w, "pos": pos, "tok": tok}))
            found = self.db.sql(MERGE_LONG.format(block=self.block, rounds=rounds) if sizes[-1] > self.block else MERGE).to_arrow_table()
            w, pos, tok, done = (found.column(c).to_numpy() for c in ("w", "pos", "tok", "done"))
            finished.append((w[done], pos[done], tok[done]))
            w, pos, tok = w[~done], pos[~done], tok[~done]
        w, pos, tok = (np.concatenate(x) for x in zip(*finished, strict=True))
        order = np.lexsort((pos, w))
        w, ids = w[order], tok[order].astype("<u4").tobytes()
        cuts = 4 * np.searchsorted(w, np.arange(len(batch) + 1))
        for (word, _), a, b in zip(batch, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            self.words[word] = ids[a:b]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit."""
        if any(len(t) > PART_CHARS for t in texts):
            return [b"".join(x for part in self.parts(t) for x in self._encode([part])) for t in texts]
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[bytes]:
        split = self.split(texts)
        new = set().union(*split).difference(self.words)
        if new:
            if len(self.words) + len(new) > CACHE_WORDS:
                new = set().union(*split)
            self.learn(list(new))
        known = self.words.__getitem__
        return [b"".join(map(known, words)) for words in split]

    def decode(self, rows: list[bytes]) -> list[bytes]:
        """The bytes of each row of ids, by slices of DECODE_IDS ids."""
        out: list[list[bytes]] = [[] for _ in rows]
        docs, ids, size = [], [], 0
        for doc, raw in enumerate(rows):
            for a in range(0, len(raw), 4 * DECODE_IDS):
                part = raw[a : a + 4 * DECODE_IDS]
                if size + len(part) > 4 * DECODE_IDS:
                    self._decode(docs, ids, out)
                    docs, ids, size = [], [], 0
                docs.append(doc)
                ids.append(part)
                size += len(part)
        if docs:
            self._decode(docs, ids, out)
        return [b"".join(x) for x in out]

    def _decode(self, docs: list[int], parts_: list[bytes], out: list[list[bytes]]) -> None:
        sizes = np.array([len(r) // 4 for r in parts_])
        ids = np.frombuffer(b"".join(parts_), dtype="<u4").astype(np.int32)
        self.db.register("ids", pa.table({"doc": np.repeat(np.array(docs, dtype=np.int32), sizes), "pos": np.arange(len(ids), dtype=np.int64), "id": ids}))
        found = self.db.sql(DECODE).to_arrow_table()
        for doc, text in zip(found.column("doc").to_pylist(), found.column("bytes").to_pylist(), strict=True):
            out[doc].append(text.encode("latin-1"))


def codec(path: str, pattern: str) -> Codec:
    cache = worker_cache("bpe")
    if (path, pattern) not in cache:
        cache[path, pattern] = Codec(load_ranks(path), pattern)
    return cache[path, pattern]


def encode(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            texts = large(batch.column(1))
            for lo, hi in row_slices(offsets_of(texts), SPLIT_BYTES):
                ids = own.encode(texts.slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(map_arrow, run, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids and their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            ids = large(batch.column(1), pa.large_binary())
            for lo, hi in row_slices(offsets_of(ids), 4 * DECODE_IDS):
                part = ids.slice(lo, hi - lo).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(part, pa.binary()), pa.array(own.decode(part), pa.binary())], names=["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").transform(map_arrow, run, "doc_id long, ids binary, bytes binary")


def round_trip(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids and the bytes decoded from them, in one pass of one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            texts = large(batch.column(1))
            for lo, hi in row_slices(offsets_of(texts), SPLIT_BYTES):
                ids = own.encode(texts.slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(ids, pa.binary()), pa.array(own.decode(ids), pa.binary())], names=["doc_id", "ids", "bytes"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(map_arrow, run, "doc_id long, ids binary, bytes binary")


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    args = tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN
    decoded = round_trip(table(spark, sf_dir, "documents"), *args)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
