"""Packing by power-of-two decomposition.

Each document's ids, with the end id last, are split into binary-length pieces: whole
runs of `size` ids, then one piece for each set bit of the rest, longest first. A piece is
a sequence of its own, its length is its bucket (`bucket`, the power of two), so no sequence crosses documents and
none needs padding. Pieces of one bucket lie together in each batch of output, and `write_buckets`
gives each bucket a folder of its own, from which a batch of equal lengths is read. One pass, no shuffle: `sequence_id` is unique, not dense.

Ids are those of the tokenizer's own library. For a byte-level tokenizer with the public pattern its model is
asked once for each distinct word and worker, as it encodes the pattern's matches apart; a text that holds
an added token (`<|endoftext|>`, which gives that token's id) or another tokenizer's text goes to it whole.

A null or empty text has the end id alone. Repeated rows are packed apart, other columns
are ignored, an empty table gives no rows; a null doc_id stays null. A long text is split into words by
parts; one row's ids are held whole.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import large, map_arrow, offsets_of, row_slices, table, worker_cache
from docloom.llm.pretokens import PATTERN, parts, splitter

#: Sequence length, and the id that ends a document.
SIZE, END_ID = 2048, 1
#: Bytes of text that the tokenizer gets at once.
ENCODE_BYTES = 1 << 20
#: Words that a worker keeps the ids of; the cache is emptied when full, which changes nothing.
CACHE_WORDS = 1_000_000


def pieces(n: int, size: int = SIZE) -> tuple[list[int], list[int]]:
    """Starts and lengths of the binary-length pieces of n ids."""
    lengths = [size] * (n // size) + [1 << k for k in range(size.bit_length() - 1, -1, -1) if (n % size) >> k & 1]
    return [0, *np.cumsum(lengths)[:-1].tolist()][: len(lengths)], lengths


def byte_characters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder:
    """Texts to ids, little-endian unsigned 32-bit, by the tokenizer file's own library."""

    def __init__(self, path: str) -> None:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.own, self.words = Tokenizer.from_file(path), {}
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.by_words = plain and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.split, self.model, self.stand_ins = splitter(PATTERN), self.own.model, byte_characters()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.own.encode_batch(texts, add_special_tokens=False)]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        split = self.split(texts)
        new = list(set().union(*split).difference(self.words))
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words.clear()
            new = list(set().union(*split))
        for word in new:
            tokens = self.model.tokenize(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.stand_ins))
            self.words[word] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        known = self.words.__getitem__
        return [b"".join(map(known, words)) for words in split]

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        plain = [k for k, t in enumerate(texts) if self.by_words and not any(a in t for a in self.added)]
        short = [k for k in plain if len(texts[k]) <= ENCODE_BYTES]
        for k, ids in zip(short, self._by_words([texts[k] for k in short]), strict=True):
            out[k] = ids
        for k in set(plain).difference(short):
            out[k] = b"".join(x for part in parts(texts[k]) for x in self._by_words([part]))
        for k, ids in enumerate(out):
            if ids is None:
                out[k] = self.whole([texts[k]])[0]
        return out


def encoder(path: str) -> Encoder:
    cache = worker_cache("tokenizer")
    if path not in cache:
        cache[path] = Encoder(path)
    return cache[path]


def pack(documents: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, bucket, sequence_id, offset per piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path), np.uint32(end_id).tobytes()
        for batch in batches:
            texts = large(batch.column(1))
            for lo, hi in row_slices(offsets_of(texts), ENCODE_BYTES):
                rows, start, length, total, ids = [], [], [], [], []
                for row, one in enumerate(encode(texts.slice(lo, hi - lo).to_pylist()), lo):
                    one += end
                    n = len(one) // 4
                    s, k = pieces(n, size)
                    start += s
                    length += k
                    rows += [row] * len(s)
                    total += [n] * len(s)
                    ids += [one[4 * a : 4 * (a + b)] for a, b in zip(s, k, strict=True)]
                length = np.array(length, dtype=np.int64)
                order = pa.array(np.argsort(-length, kind="stable"))  # equal lengths together
                bucket = pa.array(np.log2(length).astype(np.int32))
                arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(start, pa.int64()), pa.array(length), pa.array(ids, pa.binary()), pa.array(total, pa.int64()), bucket]
                yield pa.RecordBatch.from_arrays([a.take(order) for a in arrays], names=["doc_id", "start", "length", "ids", "doc_tokens", "bucket"])

    out = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(map_arrow, run, "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int")
    return out.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences by bucket, a folder for each, so that a reader takes equal lengths alone."""
    packed.write.partitionBy("bucket").parquet(path)


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents"), tokenizer_path()))
