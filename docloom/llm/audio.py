"""Chroma audio fingerprints of media columns, and the alignment of recordings.

Samples become pitch-class frames (windowed FFT, energy of each of twelve classes). An
integral image over (time, class) gives the area sums of 16 filters of WINDOW frames; each
compares two areas, is quantised to two Gray-coded bits, and the 32 bits of a place are
one packed integer. Landmarks are pairs of neighbouring integers. Frames start at every hop
of four PHASES, chosen so that the differences of two phases lie at most six samples apart:
copies that begin between two hops meet at some pair of phases, three samples off at most.
Every landmark of every phase is posted, at its first place in the recording. Two recordings link
if bit errors are few on the segment that matches best at any shift with LEAST_VOTES common landmarks within half a hop.

Recordings of equal samples are one class and align with the earliest of it, however short;
that one alone is compared with others. Links are sought in two passes. First every recording is compared with the
earliest holder of each of its landmarks, whose rows stay linear in the input however many near copies a recording has.
Components of those links follow; then all holders of a landmark that lie in different components are compared, on all
landmarks that they share. As there may be as many of those pairs as the square of the recordings, they are taken in rounds of
growing shares, and components are found anew after each: pairs that a round has joined are not compared in the next.
So every link not returned joins two recordings of one component, and components are those of all links.

An earliest holder of very many recordings is dealt over salts where fingerprints are joined.

A null or empty recording, or a WAV file that can't be read, aligns with nothing, one too short for two integers (under FRAME +
WINDOW * HOP samples) only with those of equal samples; rows of one id count as one recording
(the first by the hash of its samples is aligned); other columns are ignored, an empty table gives no rows. Of shifts with
equal votes the least is taken first. A long recording is one row of a worker, framed by parts.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Buckets, bucket_groups, data_of, drop, hot_keys, join_spread, large, map_arrow, materialise, mix, offsets_of, row_slices, shuffle_partitions, table, to_buckets
from docloom.llm.jaccard import components

#: Samples a second, samples of a frame and between frames, frames that an integer spans, lowest and highest pitch.
RATE, FRAME, HOP, WINDOW, LOW, HIGH = 8000, 512, 64, 12, 60.0, 3500.0
#: Samples by which the frames of a recording are put off: the differences of two are every thirteenth of HOP.
PHASES = (0, 5, 15, 44)
#: The least votes within half a hop of a shift that is compared.
LEAST_VOTES = 2
#: Bit errors at which a segment ends, and with which one still aligns, below LONG_PLACES and from there; its least places.
#: Unrelated texts of sf0.01 differ in 0.345 of their bits (0.01 of their runs of 16 places in under 0.21), copies at any shift in 0.001 (median).
EDGE_ERRORS, SHORT_ERRORS, MOST_ERRORS, LONG_PLACES, LEAST_PLACES = 0.2, 0.05, 0.1, 16, 2
#: Samples and frames handled at once.
SLICE_SAMPLES, CHUNK = 4 << 20, 256
#: Buckets for each shuffle partition; bytes of landmarks that a map task packs at once, and that a reducer takes together.
BUCKETS_A_PARTITION, FLUSH_BYTES, GROUP_BYTES = 8, 64 << 20, 16 << 20
#: Least parts of the pairs that fingerprints are joined to one after another; votes of pairs that are made at once.
PARTS, VOTES = 4, 1 << 20
#: Recordings of a class in the first round of the second pass, at most, and how many classes become one in the next, until all are one.
CLASS_IDS, MERGED = 1 << 14, 4


def decode_wav(raw: bytes, rate: int = RATE) -> np.ndarray:
    """Mono samples in -1..1 of a WAV file of 8 to 32 bits, resampled by linear interpolation; none where it can't be read."""
    try:
        with wave.open(io.BytesIO(raw)) as file:
            width, channels, own, n = file.getsampwidth(), file.getnchannels(), file.getframerate(), file.getnframes()
            data = file.readframes(n)
    except (wave.Error, EOFError, struct.error, ValueError):
        return np.zeros(0, np.float32)
    data = np.frombuffer(data, np.uint8)
    data = data[: len(data) // (width * channels) * width * channels].reshape(-1, width)
    if width == 1:
        samples = (data[:, 0].astype(np.float32) - 128) / 128
    else:  # the bytes at the top of a 32-bit number
        whole = np.zeros((len(data), 4), np.uint8)
        whole[:, 4 - width :] = data
        samples = whole.view("<i4")[:, 0].astype(np.float32) / 2**31
    samples = samples.reshape(-1, channels).mean(axis=1)
    if own == rate or not len(samples) or not own:
        return samples
    at = np.arange(int(len(samples) * rate / own)) * (own / rate)
    return np.interp(at, np.arange(len(samples)), samples).astype(np.float32)


def chroma_matrix(rate: int = RATE, frame: int = FRAME) -> np.ndarray:
    """Share of each FFT bin in the twelve pitch classes."""
    out = np.zeros((frame // 2 + 1, 12), dtype=np.float32)
    for k in range(1, frame // 2 + 1):
        f = k * rate / frame
        if LOW <= f <= HIGH:
            out[k, int(round(12 * np.log2(f / 440))) % 12] = 1
    return out


def filters() -> list[tuple[int, int, int, int]]:
    """(shape, first class, classes, frames) by rule: four shapes over growing areas."""
    return [(k % 4, (5 * k) % 7, 3 + (k // 4) % 3, WINDOW - 2 * (k // 8)) for k in range(16)]


def frames_of(samples: np.ndarray, offsets: np.ndarray, phase: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pitch-class frames of the recordings, the first `phase` samples after their start, and their bounds."""
    n = np.maximum(0, (np.diff(offsets) - phase - FRAME) // HOP + 1)
    bounds = np.concatenate([[0], np.cumsum(n)])
    starts = np.repeat(offsets[:-1] + phase - bounds[:-1] * HOP, n) + np.arange(bounds[-1]) * HOP
    out = np.zeros((len(starts), 12), dtype=np.float32)
    if not len(starts):
        return out, bounds
    view = np.lib.stride_tricks.sliding_window_view(samples, FRAME)
    window, classes = np.hanning(FRAME).astype(np.float32), chroma_matrix()
    for a in range(0, len(starts), CHUNK):
        block = view[starts[a : a + CHUNK]] * window
        spectrum = np.fft.rfft(block, axis=1)
        energy = (spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ classes
        out[a : a + CHUNK] = energy / np.maximum(energy.sum(axis=1, keepdims=True), 1e-6)
    return out, bounds


def integers_of(chroma: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed 32-bit integers of the recordings and their bounds."""
    n = np.maximum(0, np.diff(bounds) - WINDOW + 1)
    out_bounds = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(bounds[:-1] - out_bounds[:-1], n) + np.arange(out_bounds[-1])
    m = max(0, len(chroma) - WINDOW + 1)  # places, also those that span two recordings
    image = np.zeros((13, len(chroma) + 1))
    image[1:, 1:] = chroma.cumsum(axis=0, dtype=np.float64).cumsum(axis=1).T
    out = np.zeros(m, dtype=np.uint32)

    def area(t0, t1, c0, c1):
        return image[c1, t1 : t1 + m] - image[c1, t0 : t0 + m] - image[c0, t1 : t1 + m] + image[c0, t0 : t0 + m]

    for shape, first, classes, width in filters():
        last, half, mid = min(12, first + 2 * classes), width // 2, min(12, first + classes)
        if shape == 0:  # earlier against later
            a, b = area(0, half, first, last), area(half, width, first, last)
        elif shape == 1:  # lower against higher
            a, b = area(0, width, first, mid), area(0, width, mid, last)
        elif shape == 2:  # diagonal against diagonal
            a = area(0, half, first, mid) + area(half, width, mid, last)
            b = area(half, width, first, mid) + area(0, half, mid, last)
        else:  # middle against edges
            third = width // 3
            a = area(third, 2 * third, first, last)
            b = (area(0, third, first, last) + area(2 * third, 3 * third, first, last)) / 2
        value = np.log1p(a) - np.log1p(b)
        step = np.searchsorted([-0.12, 0.0, 0.12], value, "right").astype(np.uint32)
        out = (out << np.uint32(2)) | (step ^ (step >> np.uint32(1)))
    return out[at], out_bounds


def fingerprint(recordings: DataFrame, encoding: str = "wav") -> DataFrame:
    """id, n_frames and fp (little-endian unsigned 32-bit) of recordings (id, audio binary).

    `late` holds the integers of the frames that start at the later PHASES, `content` a hash of
    the samples (null: none). encoding: "wav" files, or "pcm8", unsigned 8-bit mono samples at RATE.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audio = large(batch.column(1), pa.large_binary())
            for lo, hi in row_slices(offsets_of(audio), SLICE_SAMPLES):
                part = audio.slice(lo, hi - lo)
                if encoding == "pcm8":
                    offsets = offsets_of(part)
                    samples = (data_of(part)[offsets[0] : offsets[-1]].astype(np.float32) - 128) / 128
                    offsets = offsets - offsets[0]
                else:
                    decoded = [decode_wav(x) if x else np.zeros(0, np.float32) for x in part.to_pylist()]
                    samples = np.concatenate([*decoded, np.zeros(0, np.float32)])
                    offsets = np.concatenate([[0], np.cumsum([len(d) for d in decoded])]).astype(np.int64)
                prints, n_frames = [], None
                for phase in PHASES:
                    chroma, bounds = frames_of(samples, offsets, phase)
                    n_frames = np.diff(bounds) if n_frames is None else n_frames
                    ints, cuts = integers_of(chroma, bounds)
                    raw, cuts = ints.astype("<u4").tobytes(), (4 * cuts).tolist()
                    prints.append([raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
                cuts = offsets.tolist()
                content = [hashlib.blake2b(samples[a:b], digest_size=16).digest() if b > a else None for a, b in zip(cuts, cuts[1:], strict=False)]
                late = pa.array([list(x) for x in zip(*prints[1:], strict=True)], pa.list_(pa.binary()))
                arrays = [batch.column(0).slice(lo, hi - lo), pa.array(n_frames), pa.array(prints[0], pa.binary()), late, pa.array(content, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_frames", "fp", "late", "content"])

    schema = "id long, n_frames long, fp binary, late array<binary>, content binary"
    return recordings.select(F.col("id").cast("long"), F.col("audio").cast("binary")).transform(map_arrow, run, schema)


def landmarks_of(prints: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct landmark keys of one recording's fingerprints, one a phase, and the first sample of each."""
    keys = [(fp[:-1].astype(np.uint64) << np.uint64(32)) | fp[1:] for fp in prints if len(fp) > 1]
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.concatenate([HOP * np.arange(len(k)) + phase for k, phase in zip(keys, PHASES, strict=False)])
    keys, order = np.concatenate(keys), np.argsort(at, kind="stable")
    found, first = np.unique(keys[order], return_index=True)
    return found, at[order][first]


#: Bits of a landmark's hash that are sent, beside those that choose its bucket.
SENT = 40


def _pack(keys: np.ndarray, places: np.ndarray, *owners: np.ndarray) -> bytes:
    low, high = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), (keys >> np.uint64(32)).astype(np.uint8)
    return struct.pack("<q", len(keys)) + b"".join(x.tobytes() for x in owners) + low.tobytes() + places.astype(np.int32).tobytes() + high.tobytes()


def _unpack(blob: bytes, owners: int) -> tuple[np.ndarray, ...]:
    """Keys, places and columns of owners."""
    n = struct.unpack_from("<q", blob)[0]
    at = 8 + 8 * n * owners
    low, places, high = np.frombuffer(blob, np.uint32, n, at), np.frombuffer(blob, np.int32, n, at + 4 * n), np.frombuffer(blob, np.uint8, n, at + 8 * n)
    return low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)), places, *(np.frombuffer(blob, np.int64, n, 8 + 8 * n * k) for k in range(owners))


def _pack_votes(x: np.ndarray, y: np.ndarray, shift: np.ndarray) -> bytes:
    order = np.lexsort((y, x))  # near numbers together, which compresses
    return struct.pack("<q", len(x)) + np.diff(x[order], prepend=0).tobytes() + y[order].tobytes() + shift[order].tobytes()


def _open_votes(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = struct.unpack_from("<q", blob)[0]
    return np.cumsum(np.frombuffer(blob, np.int64, n, 8)), np.frombuffer(blob, np.int64, n, 8 + 8 * n), np.frombuffer(blob, np.int32, n, 8 + 16 * n)


def class_of(ids: np.ndarray, classes: int) -> np.ndarray:
    return mix(ids.astype(np.uint64)) % np.uint64(classes)


def votes_of(prints: DataFrame, labelled: bool = False, classes: int = 1, done: int = 0) -> DataFrame:
    """id, aligned_id, shifts, votes, need: the pairs and shifts worth a comparison, and as bits the phases of id that it needs.

    A landmark votes for how many samples later it lies in the later of two holders: in its earliest holder and each other
    one or, if `labelled`, in any two of different labels and of one of `classes` of ids, but not of one of the `done` finer
    classes, whose pairs are compared already. Votes go in packed buckets of ids.
    """
    n_buckets = BUCKETS_A_PARTITION * shuffle_partitions(prints.sparkSession)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Buckets(n_buckets, FLUSH_BYTES, _pack)
        for batch in batches:
            for id_, label, phases in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, places = landmarks_of([np.frombuffer(x, "<u4") for x in phases])
                keys = mix(keys)
                buckets = (keys % np.uint64(n_buckets)).astype(np.int64)
                keys = (keys // np.uint64(n_buckets)) & np.uint64((1 << SENT) - 1)
                # by bucket and then key, so that a hash below stands for its bucket too
                own = [np.full(len(keys), x, np.int64) for x in (id_, label)[: 1 + labelled]]
                blobs = out.add(buckets, (keys, places, *own), 12 * len(keys) + 8 * len(keys) * len(own))
                if blobs is not None:
                    yield blobs
        blobs = out.flush()
        if blobs is not None:
            yield blobs

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Buckets(n_buckets, FLUSH_BYTES, _pack_votes)
        for blobs in bucket_groups(batches, GROUP_BYTES, numbered=True):
            parts = [(np.full(len(c[0]), bucket), *c) for bucket, blob in blobs for c in [_unpack(blob, 1 + labelled)]]
            bucket, keys, places, ids, *labels = (np.concatenate(c) for c in zip(*parts, strict=True))
            own = class_of(ids, classes)
            order = np.lexsort((ids, own, keys, bucket))
            bucket, keys, own, places, ids, labels = bucket[order], keys[order], own[order], places[order], ids[order], [x[order] for x in labels]
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (bucket[1:] != bucket[:-1]) | (own[1:] != own[:-1])])
            finer = class_of(ids, done) if done else ids
            for first, later in across(new, labels[0]) if labelled else [to_earliest(new, ids)]:
                fresh = finer[first] != finer[later]
                first, later = first[fresh], later[fresh]
                x, y, shift = ids[later], ids[first], places[later] - places[first]
                if not len(x):
                    continue
                blobs = out.add((mix(x.astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64), (x, y, shift.astype(np.int32)), 20 * len(x))
                if blobs is not None:
                    yield blobs
        blobs = out.flush()
        if blobs is not None:
            yield blobs

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in bucket_groups(batches, GROUP_BYTES):
            x, y, shift = (np.concatenate(c) for c in zip(*map(_open_votes, blobs), strict=True))
            order = np.lexsort((shift, y, x))
            x, y, shift = x[order], y[order], shift[order]
            cut = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
            ends = np.append(cut[1:], len(x))
            wide = LEAST_VOTES - 1  # pairs without so many votes within a hop have no shift below
            near = np.zeros(len(x), bool)
            n = max(0, len(x) - wide)
            near[:n] = (x[wide:] == x[:n]) & (y[wide:] == y[:n]) & (shift[wide:] - shift[:n] <= HOP)
            some = np.logical_or.reduceat(near, cut)
            rows, chosen = [], []
            for a, b in zip(cut[some].tolist(), ends[some].tolist(), strict=True):
                found = best_shifts(shift[a:b])
                if found:
                    rows.append(a)
                    chosen.append(found)
            if rows:
                columns = [pa.array([[f[k] for f in c] for c in chosen], pa.list_(pa.int32())) for k in range(2)]
                need = pa.array([reduce(or_, (1 << phases_of(f[0])[0] for f in c)) for c in chosen], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(x[rows]), pa.array(y[rows]), *columns, need], names=["id", "aligned_id", "shifts", "votes", "need"])

    kind = "bucket int, blob binary"
    posted = prints.select("id", F.col("label") if labelled else F.col("id").alias("label"), "phases")
    votes = to_buckets(posted.transform(map_arrow, post, kind)).transform(map_arrow, meet, kind)
    return to_buckets(votes).transform(map_arrow, choose, "id long, aligned_id long, shifts array<int>, votes array<int>, need int")


def to_earliest(new: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the first holder and of each later one of lists that begin at `new`."""
    origin = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = np.flatnonzero(ids != ids[origin])
    return origin[later], later


def across(new: np.ndarray, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of any two holders of different labels, the earlier first, of lists that begin at `new`; about VOTES at once."""
    lists = np.cumsum(new)
    order = np.lexsort((labels, lists))
    lists, labels = lists[order], labels[order]
    ends = np.append(np.flatnonzero(lists[1:] != lists[:-1]) + 1, len(lists))
    cuts = np.append(np.flatnonzero((lists[1:] != lists[:-1]) | (labels[1:] != labels[:-1])) + 1, len(lists))
    at = np.arange(len(lists))
    after = cuts[np.searchsorted(cuts, at, "right")]  # of each row those of other labels, up to the end of its list
    total = np.concatenate([[0], np.cumsum(ends[np.searchsorted(ends, at, "right")] - after)])
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + VOTES, "right")) - 1)
        one = np.repeat(at[lo:hi], np.diff(total[lo : hi + 1]))
        other = order[after[one] + np.arange(total[lo], total[hi]) - total[one]]
        one = order[one]
        yield np.minimum(one, other), np.maximum(one, other)
        lo = hi


#: The phases of two recordings that meet at a shift, by its rest modulo HOP: of several the first.
MEETING = {(p - q) % HOP: (i, j) for i, p in reversed(list(enumerate(PHASES))) for j, q in reversed(list(enumerate(PHASES)))}


def phases_of(shift: int) -> tuple[int, int, int]:
    """The phases of two recordings that meet at a shift, and how many places later the first then lies."""
    i, j = MEETING[shift % HOP]
    return i, j, (shift - PHASES[i] + PHASES[j]) // HOP


def segment(x: np.ndarray, y: np.ndarray, offset: int) -> tuple[int, int]:
    """Bit errors and places of the run that matches best, x lying `offset` places later than y."""
    a, b = max(0, offset), min(len(x), len(y) + offset)
    if b <= a:
        return 0, 0
    wrong = np.concatenate([[0], np.cumsum(np.bitwise_count(x[a:b] ^ y[a - offset : b - offset]).astype(np.int64))])
    gain = 32 * EDGE_ERRORS * np.arange(len(wrong)) - wrong
    least = np.minimum.accumulate(gain)
    end = int(np.argmax(gain - least))
    start = int(np.argmax(gain[: end + 1] == least[end]))
    return int(wrong[end] - wrong[start]), end - start


def best_shifts(cast: np.ndarray) -> list[tuple[int, int]]:
    """The shifts with LEAST_VOTES votes or more within half a hop, and those votes, the most first."""
    shift, votes = np.unique(cast.astype(np.int64), return_counts=True)
    total = np.concatenate([[0], np.cumsum(votes)])
    near = total[np.searchsorted(shift, shift + HOP // 2, "right")] - total[np.searchsorted(shift, shift - HOP // 2, "left")]
    best = np.lexsort((shift, np.abs(shift), -votes, -near))
    best = best[near[best] >= LEAST_VOTES]
    return list(zip(shift[best].tolist(), near[best].tolist(), strict=True))


def compared(pairs: DataFrame, own: DataFrame, most_errors: float) -> list[DataFrame]:
    """id, aligned_id, shift, votes, bit_errors, bits of the pairs that align, in written tables, one a part; `pairs` is a written table, dropped.

    The later recording goes to a pair without the phases that no shift needs. Those of a part take as many bytes as all of `own` at most, about.
    """

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for k, (shifts, votes) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shifts", "votes")), strict=True)):
                x, y = ([np.frombuffer(p.as_buffer(), "<u4") for p in batch.column(c)[k]] for c in ("x", "y"))
                best = None
                for shift, n in zip(shifts, votes, strict=True):
                    i, j, at = phases_of(shift)
                    wrong, places = segment(x[i], y[j], at)
                    allowed = min(most_errors, SHORT_ERRORS) if places < LONG_PLACES else most_errors
                    if places >= LEAST_PLACES and wrong <= allowed * 32 * places:
                        one = (EDGE_ERRORS * 32 * places - wrong, n, -abs(shift), shift, wrong, 32 * places)
                        best = one if best is None else max(best, one)
                if best:
                    rows.append(k)
                    found.append(best)
            if rows:
                ids = batch.select(["id", "aligned_id"]).take(pa.array(rows)).columns
                numbers = [pa.array([f[k] for f in found], kind) for k, kind in ((3, pa.int32()), (1, pa.int64()), (4, pa.int64()), (5, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*ids, *numbers], names=["id", "aligned_id", "shift", "votes", "bit_errors", "bits"])

    hot, found = hot_keys(pairs, "aligned_id"), []
    sent = pairs.join(own.select("id", "size"), "id").agg(F.sum(F.bit_count("need") * F.col("size"))).first()[0] or 0
    whole = own.agg(F.sum(len(PHASES) * F.col("size"))).first()[0] or 1
    parts = max(PARTS, -(-sent // whole))
    needed = F.expr("transform(phases, (p, i) -> if((shiftright(need, i) & 1) = 1, p, X''))")
    for part in range(parts):  # so that the shuffle files of one part of the pairs lie on disk at a time
        mine = F.pmod(F.xxhash64("id"), F.lit(parts)) == part
        left = pairs.where(mine).join(own.where(mine), "id").withColumn("x", needed).drop("phases", "size")
        other = own.select(F.col("id").alias("aligned_id"), F.col("phases").alias("y"))
        both = join_spread(left, other, "aligned_id", "id", hot).select("id", "aligned_id", "shifts", "votes", "x", "y")
        found.append(materialise(both.transform(map_arrow, errors, "id long, aligned_id long, shift int, votes long, bit_errors long, bits long"), "compared"))
    drop(pairs)
    return found


def align(prints: DataFrame, most_errors: float = MOST_ERRORS, spent: bool = False) -> DataFrame:
    """id, aligned_id, offset, shift, votes, bit_errors, bits: the earlier recordings that a recording lines up with.

    `prints` as `fingerprint` gives them, written to a table, which is dropped when it is `spent`. Sample s of the recording is sample
    s - shift of the aligned one, which is place p - offset for place p, to the nearest place; bits are those of the
    matching segment. A recording of the very samples of an earlier one has one row, with no votes:
    what else it lines up with is what the earliest of its class does. Rows without an alignment are left out; the
    components of the rows are those of all alignments, though two recordings of one component may have no row of their own.
    """
    keyed = prints.where("id IS NOT NULL AND content IS NOT NULL").select("id", "content", F.octet_length("fp").alias("size"))
    single = materialise(keyed.groupBy("id").agg(F.min(F.struct("content", "size")).alias("p")).select("id", "p.content", "p.size"), "contents")
    first = single.groupBy("content").agg(F.min("id").alias("first"))
    copies = join_spread(single, first, "content", "id", hot_keys(single, "content")).where("id > first")
    copies = copies.select("id", F.col("first").alias("aligned_id"), F.lit(0).alias("shift"), F.lit(0).cast("long").alias("votes"), F.lit(0).cast("long").alias("bit_errors"), (8 * F.col("size")).cast("long").alias("bits"))
    ids = first.select(F.col("first").alias("id"), "content")
    phases = F.concat(F.array("fp"), F.col("late")).alias("phases")
    own = materialise(prints.where("octet_length(fp) > 4").join(ids, ["id", "content"], "left_semi").dropDuplicates(["id", "content"]).select("id", phases, F.octet_length("fp").alias("size")), "own-prints")
    if spent:
        drop(prints)
    found = compared(materialise(votes_of(own), "pairs"), own, most_errors)
    n, classes, done = own.count(), 1, 0
    while n > CLASS_IDS * classes:
        classes *= MERGED
    while classes:
        labels = components(reduce(DataFrame.union, found).select(F.col("id").alias("a"), F.col("aligned_id").alias("b")))
        labelled = own.join(labels.select(F.col("u").alias("id"), F.col("v").alias("label")), "id", "left").select("id", F.coalesce("label", "id").alias("label"), "phases")
        pairs = materialise(votes_of(labelled, True, classes, done), "pairs")
        drop(labels)
        found += compared(pairs, own, most_errors)
        classes, done = classes // MERGED, classes
    drop(own)
    out = reduce(DataFrame.union, found).unionByName(copies)
    return out.select("id", "aligned_id", F.floor(F.col("shift") / HOP + 0.5).cast("int").alias("offset"), "shift", "votes", "bit_errors", "bits")


def op1_audio_fingerprint(spark, sf_dir: str) -> DataFrame:
    """The UTF-8 bytes of every text, read as 8-bit samples: no table has sound.

    A row for each alignment of a document, or one without; component_id is the smallest doc_id reachable by alignments.
    """
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("audio"))
    prints = materialise(fingerprint(documents, "pcm8"), "prints")
    rows = materialise(prints.select(F.col("id").alias("doc_id"), "n_frames", (F.octet_length("fp") / 4).cast("long").alias("n_integers"), F.sha2("fp", 256).alias("fp_sha256")), "digests")
    found = materialise(align(prints, spent=True), "aligned")
    labels = components(found.select(F.col("id").alias("a"), F.col("aligned_id").alias("b")))
    rows = rows.join(labels.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id")), "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return rows.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
