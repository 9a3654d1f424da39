"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

A unit is a word, or a run of single-character words ("i d i o t"). The kernel of two
units compares their subsequences of three characters spread over at most SPAN places,
each weighted DECAY to the power of its spread and normalised by the weight a unit of its
length can have: insults with gaps or inserted characters stay near the plain ones. Landmarks are units of both
classes; the linear machine on their Nyström features is folded into one weight for each
hashed subsequence, which is the same function and scores a text in one pass.

Training is on labelled sentences, which inherit their document's label (a sentence that clean documents have is
clean). A first machine is fitted to them, each unit standing for the sentences of both labels that hold it, by number. Units that it
puts above all but one in CALM of the clean sentences' units, in enough toxic sentences, are what a second machine
is fitted to, beside forms of them with foreign characters put in, against units of clean sentences. A logistic model on a document's hits then gives its score. The
sample is bounded: for each label one document of at most SAMPLE_CHARS characters in each of SLOTS
hash slots of doc_id, and SENTENCES sentences of each label for the first machine. Without labels of both classes every score is 0.

Scoring covers every whole text. A null or empty text has the score of a text without
hits; repeated rows score alike, a null doc_id is never trained on, other columns are ignored, an empty table gives no
rows. Ties among units are broken by spelling. A long text is one row of a worker, whose memory grows with its characters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import map_arrow, mix, table, text_slices, words_of

#: Most places of a subsequence, decay a place, hashed subsequences.
SPAN, DECAY, DIMENSION = 5, 0.6, 1 << 18
#: Training documents for each label, their greatest length, landmarks for each class, negatives in training.
SLOTS, SAMPLE_CHARS, LANDMARKS, NEGATIVES = 1500, 20_000, 160, 6000
#: Sentences of each label for the first machine, and its rounds; a unit it finds has LEAST_SENTENCES toxic ones at least; most of them.
SENTENCES, ROUNDS, LEAST_SENTENCES, CALM, POSITIVES = 10_000, 2, 4, 3000, 400
#: The decision of a unit that shares nothing with any landmark.
BIAS = -0.5
#: A unit is normalised as if it had this many characters at least, so that fragments weigh less.
SHORT = 5
#: Decisions from which a unit counts as a hit, in part and in full.
HIT, FULL = 0.4, 1.0
PLACES = tuple((a, b) for b in range(2, SPAN) for a in range(1, b))


LEAST_NORM = sum(max(0, SHORT + 2 - b) * DECAY ** (2 * b + 2) for _, b in PLACES)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of UTF-8 rows and their offsets."""
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    lower = np.array([ord(c) if len(c := chr(k).lower()) == 1 else k for k in range(0x530)], dtype=np.uint32)
    return np.where(codes < len(lower), lower[np.minimum(codes, len(lower) - 1)], codes), lead[offsets]


def units_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points without white space, unit of each, row of each unit, and start of each unit."""
    starts, ends, rows = words_of(data, offsets)
    codes, _ = code_points(data, offsets)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    size = lead[ends] - lead[starts]
    keep = np.repeat(lead[starts] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    joined = np.zeros(len(starts), dtype=bool)
    joined[1:] = (size[1:] == 1) & (size[:-1] == 1) & (rows[1:] == rows[:-1])
    unit = np.cumsum(~joined) - 1
    firsts = np.flatnonzero(~joined)
    return codes[keep], np.repeat(unit, size), rows[firsts], (np.cumsum(size) - size)[firsts]


def bounded(codes: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The units' characters with a mark before and after each unit."""
    if not len(codes):
        return codes.astype(np.uint64), units
    m = int(units[-1]) + 1
    out = np.full(len(codes) + 2 * m, 2, dtype=np.uint64)
    out[np.arange(len(codes)) + 2 * units + 1] = codes
    size = np.bincount(units, minlength=m) + 2
    out[np.cumsum(size) - 1] = 3
    return out, np.repeat(np.arange(m), size)


def subsequences(codes: np.ndarray, units: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(hashed subsequence, its unit, weight) for each spread of three characters, ends included."""
    c, units = bounded(codes, units)
    for a, b in PLACES:
        if len(c) <= b:
            continue
        inside = units[b:] == units[:-b]
        key = c[:-b][inside] | (c[a : len(c) - b + a][inside] << np.uint64(21)) | (c[b:][inside] << np.uint64(42))
        yield (mix(key) & np.uint64(DIMENSION - 1)).astype(np.int64), units[b:][inside], DECAY ** (b + 1)


def used_by(units: list[str]) -> np.ndarray:
    """Column of each hashed subsequence that occurs in the units; -1 for the others."""
    codes, owner = _joined(units)
    columns = np.full(DIMENSION, -1, dtype=np.int64)
    for key, _, _ in subsequences(codes, owner):
        columns[key] = 0
    columns[columns == 0] = np.arange((columns == 0).sum())
    return columns


def _joined(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32)
    return codes, np.repeat(np.arange(len(units)), [len(u) for u in units])


def features(units: list[str], columns: np.ndarray) -> np.ndarray:
    """Normalised kernel features of units, on the columns asked for."""
    codes, owner = _joined(units)
    out = np.zeros((len(units), int(columns.max()) + 1), dtype=np.float32)
    norm = np.zeros(len(units))
    for key, unit, weight in subsequences(codes, owner):
        at = columns[key]
        np.add.at(out, (unit[at >= 0], at[at >= 0]), weight)
        norm += np.bincount(unit, minlength=len(units)) * weight * weight
    out /= np.sqrt(np.maximum(norm, LEAST_NORM)).astype(np.float32)[:, None]
    return out


def spoilt(unit: str) -> list[str]:
    """The unit with a foreign character put in at each place, and between all."""
    marks = "-.*_1"
    one = [unit[:k] + marks[k % len(marks)] + unit[k:] for k in range(1, len(unit))]
    return [*one, *(m.join(unit) for m in marks[:3])]


class Model:
    """Folded weights of the unit machine and the logistic weights of documents."""

    def __init__(self, weights: np.ndarray, bias: float, logistic: np.ndarray | None) -> None:
        self.weights, self.bias, self.logistic = weights, bias, logistic

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per text: hits, hits against length, greatest decision, length, usual decision; and their products."""
        n = len(offsets) - 1
        codes, units, rows, _ = units_of(data, offsets)
        m = len(rows)
        total, norm, name = np.zeros(m), np.zeros(m), np.zeros(m)
        for key, unit, weight in subsequences(codes, units):
            total += np.bincount(unit, weights=self.weights[key], minlength=m) * weight
            norm += np.bincount(unit, minlength=m) * (weight * weight)
            name += np.bincount(unit, weights=key, minlength=m) * (1 + weight)
        decision = total / np.sqrt(np.maximum(norm, LEAST_NORM)) + self.bias
        count = np.bincount(rows, minlength=n)
        strength = np.clip((decision - HIT) / (FULL - HIT), 0, 1)
        strength[1:][(name[1:] == name[:-1]) & (rows[1:] == rows[:-1])] = 0  # a unit said again at once in a text counts once
        hits = np.bincount(rows, weights=strength, minlength=n)
        most = np.full(n, -1.0)
        np.maximum.at(most, rows, np.clip(decision, -1, 1))
        rate = 30 * hits / (count + 10)
        usual = np.bincount(rows, weights=np.clip(decision, -1, HIT), minlength=n) / np.maximum(count, 1)
        x = np.stack([np.log1p(hits), np.log1p(4 * rate), most, np.log1p(count), 4 * usual], axis=1)
        pairs = [x[:, i] * x[:, j] for i in range(5) for j in range(i, 5)]
        return np.column_stack([x, *pairs, np.ones(n)])

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.logistic is None:
            return np.zeros(len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(self.evidence(data, offsets) @ self.logistic, -30, 30)))


def machine(x: np.ndarray, plus: np.ndarray, minus: np.ndarray, ridge: float = 1e-4, rounds: int = 30) -> np.ndarray:
    """Linear support vector machine with squared hinge and the fixed BIAS, by Newton steps; row k counts plus[k] times as
    toxic and minus[k] times as clean, and the classes weigh alike."""
    plus, minus = plus / max(1e-9, plus.sum()), minus / max(1e-9, minus.sum())
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        decision = x @ w.astype(x.dtype) + BIAS  # the matrix is not copied
        up, down = plus * (decision < 1), minus * (decision > -1)
        active = np.flatnonzero(up + down)
        left, right = ridge * np.eye(len(w)), np.zeros(len(w))
        for k in range(0, len(active), 2048):
            at = active[k : k + 2048]
            left += (x[at] * (up + down)[at][:, None]).T @ x[at].astype(float)
            right += x[at].T @ (up * (1 - BIAS) + down * (-1 - BIAS))[at]
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


class Nystroem:
    """Features of units by a kernel with landmarks, in the landmarks' own directions."""

    def __init__(self, landmarks: list[str]) -> None:
        self.columns = used_by(landmarks)
        phi = features(landmarks, self.columns)
        values, vectors = np.linalg.eigh((phi @ phi.T).astype(float))
        keep = values > 1e-5
        self.ways = phi.T @ (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)

    def __call__(self, units: list[str]) -> np.ndarray:
        out = np.zeros((len(units), self.ways.shape[1]), np.float32)
        for k in range(0, len(units), 100):
            out[k : k + 100] = features(units[k : k + 100], self.columns) @ self.ways
        return out

    def folded(self, w: np.ndarray) -> np.ndarray:
        """The weight of each hashed subsequence."""
        out = np.zeros(DIMENSION)
        used = self.columns >= 0
        out[used] = (self.ways @ w)[self.columns[used]]
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * len(x) * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * len(x) * w)
    return w


def rows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def unit_strings(texts: list[str]) -> list[list[str]]:
    """The units of each text, without marks at their ends."""
    codes, _, rows, starts = units_of(*rows_of(texts))
    whole = codes.astype("<u4").tobytes().decode("utf-32-le")
    bounds = [*starts.tolist(), len(whole)]
    out: list[list[str]] = [[] for _ in texts]
    for row, a, b in zip(rows.tolist(), bounds, bounds[1:], strict=False):
        out[row].append(whole[a:b].strip(".,;:!?\"'()|#*$%&-"))
    return out


def _by_hash(items) -> list[str]:
    return sorted(items, key=lambda t: (zlib.crc32(t.encode()), t))


def _often(counts: Counter) -> list[str]:
    return sorted(counts, key=lambda u: (-counts[u], u))


def held_by(sentences: list[str]) -> Counter:
    """In how many of the sentences each unit occurs."""
    out: Counter = Counter()
    for k in range(0, len(sentences), 2000):
        out.update(u for units in unit_strings(sentences[k : k + 2000]) for u in set(units) if len(u) > 2)
    return out


def found_by_sentences(toxic: Counter, clean: Counter) -> list[str]:
    """Units that a machine fitted to labelled sentences puts above nearly all units of clean ones, the highest first.

    Its landmarks are taken anew in each round, from the units that the round before puts highest, weighed by how
    many toxic sentences have them, so that they come to stand where the classes part.
    """
    units = sorted(u for u in {*toxic, *clean} if toxic[u] + clean[u] > 1)
    if not units:
        return []
    plus, minus = (np.array([c[u] for u in units], dtype=float) for c in (toxic, clean))
    if not plus.any() or not minus.any():
        return []
    rates = plus / plus.sum(), minus / minus.sum()
    worth = rates[0] - rates[1]
    for _ in range(ROUNDS):
        high, low = (sorted(range(len(units)), key=lambda k, side=side: (-side * worth[k], units[k]))[: 2 * LANDMARKS] for side in (1, -1))
        space = Nystroem(list(dict.fromkeys([units[k] for k in (*high, *low)] + _by_hash(units)[:LANDMARKS])))
        x = space(units)
        decision = x @ machine(x, plus, minus).astype(x.dtype) + BIAS
        worth = np.where(decision > 0, rates[0] * decision, rates[1] * decision)
    order = np.argsort(decision, kind="stable")
    above = np.cumsum(minus[order][::-1])[::-1] * CALM > minus.sum()  # clean sentences' units from here upwards are more than one in CALM
    calm = max(0.0, decision[order][above].max(initial=0.0))
    return [units[k] for k in order[::-1] if decision[k] > calm and plus[k] >= LEAST_SENTENCES][:POSITIVES]


def fit(rows: list[tuple[str, int]]) -> Model | None:
    """rows: (text, label) of the bounded sample."""
    toxic, clean = set(), set()
    for text, label in rows:
        (toxic if label else clean).update(s for s in re.split(r"[.!?\n]+\s", text) if s)
    toxic -= clean
    bad, good = held_by(_by_hash(toxic)[:SENTENCES]), held_by(_by_hash(clean)[:SENTENCES])
    if not bad or not good:
        return None
    positive = found_by_sentences(bad, good)
    chosen = set(positive)
    others = Counter({u: n for u, n in held_by(sorted(clean)).items() if u not in chosen})
    mixed = _by_hash(others)
    negative = list(dict.fromkeys([*_often(others)[: NEGATIVES // 3], *mixed]))[:NEGATIVES]
    if not positive or not negative:
        return None
    shown = [*positive, *(v for u in positive[:LANDMARKS] for v in spoilt(u))]
    # clean landmarks: those most like the positives, by shared weight, beside mixed ones
    columns = used_by(positive)
    like = np.concatenate([features(negative[k : k + 100], columns).sum(axis=1) for k in range(0, len(negative), 100)])
    near = [negative[k] for k in np.argsort(-like, kind="stable")[: 2 * LANDMARKS]]
    space = Nystroem(list(dict.fromkeys([*positive[:LANDMARKS], *near, *mixed[:LANDMARKS]])))
    label = np.arange(len(shown) + len(negative)) < len(shown)
    model = Model(space.folded(machine(space([*shown, *negative]), label.astype(float), (~label).astype(float))), BIAS, None)
    x = np.concatenate([model.evidence(*rows_of([t for t, _ in rows[k : k + 200]])) for k in range(0, len(rows), 200)])
    model.logistic = logistic(x, np.array([label for _, label in rows], dtype=float))
    return model


def train(documents: DataFrame, labels: DataFrame) -> Model | None:
    """Learn from labelled rows that are not held out; rows of one text and label count once."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).cast("int").alias("label"))
    marks = marks.where("doc_id IS NOT NULL AND label IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where("doc_id IS NOT NULL").where(F.length("text").between(1, SAMPLE_CHARS)).where(~held_out(F.col("doc_id")))
    sized = rows.select("doc_id").join(marks, "doc_id")
    slots = sized.groupBy("label", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).alias("slot")).agg(F.min("doc_id").alias("doc_id"))
    chosen = {r["doc_id"]: r["label"] for r in slots.collect()}  # 2 * SLOTS at most
    wanted = pa.array(sorted(chosen), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            yield batch.filter(pc.is_in(batch.column(0), wanted))

    found = rows.transform(map_arrow, run, "doc_id long, text string").groupBy("doc_id").agg(F.min("text").alias("text")).collect()  # of repeated rows one
    return fit(sorted({(r["text"], chosen[r["doc_id"]]) for r in found}))


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, predicted; other columns of the documents are kept before them."""
    names = documents.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows)
            for lo, hi, data, offsets in text_slices(batch.column(at), 1 << 18):
                found[lo:hi] = model.scores(data, offsets) if model is not None else 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    schema = ", ".join(f"`{n}` {t}" for n, t in documents.dtypes)
    return documents.transform(map_arrow, run, f"{schema}, score double, predicted int")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents, table(spark, sf_dir, "labels"))
    scored = score(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
