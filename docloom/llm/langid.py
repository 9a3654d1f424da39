"""Language identification by string-kernel classification.

The kernel is the blended spectrum over byte n-grams of 1..ORDER (A-Z lower case), by
presence: the number of distinct n-grams two texts share, divided by the geometric mean
of their own numbers. N-grams are hashed to DIMENSION presence bits. Landmarks are
labelled texts; a Nyström approximation with one-versus-rest kernel ridge regression is
solved on the driver, and texts are scored in blocks: presence matrix times landmark
matrix, times coefficients.

Training rows are a bounded sample, SAMPLE rows at most: for each of the LANGS languages of most documents one document in each of SLOTS hash
slots of doc_id (fewer slots where there are many languages), reduced to presence bits before they reach the driver. Scoring covers
every whole text in one pass; of languages with one score the first by name is said. A text that is null or has no letter is `und` with score 0;
so is every text when no label could be learned. Repeated rows score alike, a null doc_id is
never trained on, other columns are ignored, an empty table gives no rows. A long text is one row of presence bits,
gathered by parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import map_arrow, mix, table, text_slices

#: Longest n-gram, presence bits, training documents and landmarks for each language, ridge, rows in a block.
ORDER, DIMENSION, SLOTS, LANDMARKS, RIDGE, BLOCK = 3, 1 << 15, 256, 24, 1e-2, 64
#: Most languages, and most training rows of all.
LANGS, SAMPLE = 64, 2048
#: Bytes of one text that are looked at together.
PART = 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def presence(data: np.ndarray, offsets: np.ndarray, order: int = ORDER, dimension: int = DIMENSION) -> np.ndarray:
    """A row of presence bits for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, dimension), dtype=np.float32)
    if not len(data):
        return out
    if n == 1 and len(data) > PART:  # an n-gram lies in one of two parts that overlap
        for a in range(0, len(data), PART):
            part = data[max(0, a - order + 1) : a + PART]
            out = np.maximum(out, presence(part, np.array([0, len(part)]), order, dimension))
        return out
    flat = out.reshape(-1)
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32)
    codes = lower[data]
    rows = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    gram = np.zeros(len(codes), dtype=np.uint64)
    for k in range(order):
        if k:
            gram, codes, rows_end = gram[:-1], codes[1:], rows[k:]
        gram = (gram << np.uint64(8)) | codes
        place = (mix(gram + np.uint64(k << 32)) >> np.uint64(20)) % np.uint64(dimension)
        at = rows[: len(gram)] * dimension + place.astype(np.int64)
        flat[at if not k else at[rows[: len(gram)] == rows_end]] = 1
    return out


def kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    own = np.sqrt(np.maximum(1, x.sum(axis=1)))[:, None] * np.sqrt(np.maximum(1, landmarks.sum(axis=1)))[None, :]
    return (x @ landmarks.T) / own


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, data, offsets in text_slices(column, 1 << 20):
        for a in range(0, hi - lo, BLOCK):
            b = min(a + BLOCK, hi - lo)
            yield lo + a, lo + b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


class Model:
    def __init__(self, langs: list[str], landmarks: np.ndarray, weights: np.ndarray) -> None:
        self.langs, self.landmarks, self.weights = langs, landmarks, weights

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return kernel(presence(data, offsets), self.landmarks) @ self.weights


def fit(langs: list[str], bits: np.ndarray) -> Model | None:
    """One-versus-rest kernel ridge regression on Nyström features of the landmarks."""
    names = sorted(set(langs))
    if not names:
        return None
    at = np.array([names.index(x) for x in langs])
    chosen = np.concatenate([np.flatnonzero(at == k)[:LANDMARKS] for k in range(len(names))])
    landmarks = bits[chosen]
    among, across = kernel(landmarks, landmarks), kernel(bits, landmarks)
    wanted = np.where(at[:, None] == np.arange(len(names)), 1.0, -1.0)
    share = np.bincount(at, minlength=len(names))[at][:, None] * len(names) / len(at)
    left = across.T @ (across / share) + RIDGE * len(at) / len(chosen) * (among + 1e-6 * np.eye(len(chosen)))
    return Model(names, landmarks, np.linalg.solve(left, across.T @ (wanted / share)).astype(np.float32))


def train(documents: DataFrame) -> Model | None:
    """Learn from text and non-null lang of documents that are not held out."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("doc_id")))
    langs = [r.lang for r in rows.groupBy("lang").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "lang").limit(LANGS).collect()]
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(min(SLOTS, SAMPLE // max(1, len(langs)))))
    slots = rows.where(F.col("lang").isin(langs)).groupBy("lang", slot.alias("slot")).agg(F.min("doc_id").alias("doc_id"))
    chosen = {(r.doc_id, r.lang) for r in slots.collect()}  # SAMPLE at most
    wanted = pa.array(sorted({i for i, _ in chosen}), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            batch = batch.filter(pc.is_in(batch.column(0), wanted))
            batch = batch.filter(pa.array([x in chosen for x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)], pa.bool_()))
            for lo, hi, data, offsets in blocks(batch.column(1)):
                bits = np.packbits(presence(data, offsets).astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([b.tobytes() for b in bits], pa.binary())], names=["doc_id", "lang", "bits"])

    found = rows.transform(map_arrow, run, "doc_id long, lang string, bits binary").groupBy("doc_id", "lang").agg(F.min("bits"))  # of repeated rows one
    found = sorted(found.collect(), key=lambda r: (r[0], r[1]))
    bits = np.array([np.unpackbits(np.frombuffer(r[2], np.uint8)) for r in found], dtype=np.float32).reshape(len(found), DIMENSION)
    return fit([r[1] for r in found], bits)


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ascii_letter = np.zeros(256, dtype=bool)
        ascii_letter[[*range(65, 91), *range(97, 123)]] = True
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                n = hi - lo
                marks = np.concatenate([[0], np.cumsum(ascii_letter[data])])
                letter = marks[offsets[1:]] > marks[offsets[:-1]]
                for i in np.flatnonzero(~letter):
                    letter[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode()))
                langs, score = np.full(n, "und", dtype=object), np.zeros(n)
                if model is not None and n:
                    support = np.clip((model.scores(data, offsets) + 1) / 2, 1e-3, 1)
                    best = support.argmax(axis=1)
                    langs[letter] = np.array(model.langs, dtype=object)[best[letter]]
                    score[letter] = (support.max(axis=1) / support.sum(axis=1))[letter]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(langs.tolist(), pa.string()), pa.array(score.astype(np.float64))], names=["doc_id", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(map_arrow, run, "doc_id long, lang_pred string, score double")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = predict(documents, train(documents))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
