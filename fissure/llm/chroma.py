"""Audio fingerprints over pitch classes, and their search and alignment.

A recording (WAV, PCM) becomes frames of 12 pitch-class energies.  16 filters compare areas of a window
of ``WINDOW`` frames, read from an integral image; each gives two Gray-coded bits, so every frame
position has one packed 32-bit integer.  Recordings with equal sequences are one class.  Search is exact:
bits as 1 and -1 make the agreement of two sequences at an offset a scalar product, so blocks of query
classes meet blocks of all classes in one matrix product for each offset.  At a quarter of the bits no
key that two codes must share is selective, so there is none.  Of the offsets of a pair whose overlap and share
of differing bits are accepted, the one with most equal integers is given, then the one with fewest differing bits.

Defined cases: a null, broken, empty or too short recording has an empty sequence, is its own class and
matches nothing; silence has frames of zeros; a null id is left out; rows that share an id are one
recording each and merge in its matches; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fissure.llm import common as C

FRAME, HOP, WINDOW = 1024, 512, 16
EDGE = 0.15
MIN_OVERLAP = 16
# Integers of a block, padded to its longest sequence, and of the sequences that are sorted by length at once.
BLOCK, SORTED = 1 << 13, 1 << 20
# Area filters (kind, lowest pitch class, pitch classes, frames), from a rule.
FILTERS = [(k % 3, (5 * k) % 12, 2 + 2 * (k % 4), (4, 8, 12, 16)[k // 4]) for k in range(16)]


def decode_wav(data: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples from -1 to 1 and the rate; nothing for what can't be read."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
            raw = w.readframes(w.getnframes())
    except (wave.Error, EOFError, ValueError):
        return np.zeros(0, np.float32), 1
    if width not in (1, 2, 4) or not rate:
        return np.zeros(0, np.float32), 1
    raw = raw[: len(raw) // (width * channels) * width * channels]
    x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float32)
    x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(1), rate


_BINS: dict[int, np.ndarray] = {}


def _pitch_classes(rate: int) -> np.ndarray:
    """Weights of spectrum bins in the 12 pitch classes, for 55 to 1760 Hz."""
    if rate not in _BINS:
        f = np.fft.rfftfreq(FRAME, 1 / rate)
        m = np.zeros((len(f), 12), np.float32)
        use = np.flatnonzero((f >= 55) & (f <= 1760))
        m[use, np.round(12 * np.log2(f[use] / 440)).astype(int) % 12] = 1
        _BINS[rate] = m
    return _BINS[rate]


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames by 12, each of length 1 or 0."""
    if len(samples) < FRAME:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * np.hanning(FRAME).astype(np.float32)
    energy = (np.abs(np.fft.rfft(frames, axis=1)) ** 2).astype(np.float32) @ _pitch_classes(rate)
    size = np.sqrt((energy**2).sum(1, keepdims=True))
    return np.where(size > 1e-4, energy / np.maximum(size, 1e-9), 0)


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """One packed integer per window of frames."""
    n = len(frames) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 25))
    image[1:, 1:] = np.cumsum(np.cumsum(np.hstack([frames, frames]), 0), 1)  # pitch classes go round

    def area(t: int, y: int, w: int, h: int) -> np.ndarray:
        a, b = image[t : t + n], image[t + w : t + w + n]
        return b[:, y + h] - a[:, y + h] - b[:, y] + a[:, y]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        if kind == 0:  # later against earlier
            p, q = area(0, y, w // 2, h), area(w // 2, y, w // 2, h)
        elif kind == 1:  # higher against lower
            p, q = area(0, y, w, h // 2), area(0, y + h // 2, w, h // 2)
        else:  # middle against both ends
            q = area(w // 4, y, w // 2, h)
            p = area(0, y, w, h) - q
        v = np.log((1 + p) / (1 + q))
        level = (v > -EDGE).astype(np.uint32) + (v > 0) + (v > EDGE)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return out


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [fingerprint(chroma(*decode_wav(x.as_py()))).astype(np.int32) for x in batch.column("audio")]
        yield pa.RecordBatch.from_pydict(
            {"id": batch.column("id"), "codes": pa.array([c.tolist() for c in codes], pa.list_(pa.int32()))}
        )


def fingerprints(recordings: DataFrame) -> DataFrame:
    """(id, codes) of recordings (id, audio)."""
    rows = recordings.where("id is not null").select(F.col("id").cast("long").alias("id"), "audio")
    return rows.mapInArrow(_sequences, "id bigint, codes array<int>")


def _blocks(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, asked: bool) -> Iterator[dict]:
    """Rows of sequences of about one length."""
    starts, order, at = np.cumsum(sizes) - sizes, np.argsort(sizes, kind="stable"), 0
    while at < len(order):
        padded = sizes[order[at:]] * np.arange(1, len(order) - at + 1)
        some = order[at : at + max(1, int(np.searchsorted(padded, BLOCK, "right")))]
        flat = codes[C.ragged(starts[some], sizes[some])]
        yield {"asked": asked, "ids": ids[some].tobytes(), "sizes": sizes[some].tobytes(), "codes": flat.tobytes()}
        at += len(some)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of all classes, and once more of those that are queries."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        ids, sizes, asked, codes = (np.concatenate(x) for x in zip(*held))
        held.clear()
        rows = [*_blocks(ids, sizes, codes, False), *_blocks(ids[asked], sizes[asked], codes[np.repeat(asked, sizes)], True)]
        yield pa.RecordBatch.from_pylist(rows, pa.schema({"asked": pa.bool_(), "ids": pa.binary(), "sizes": pa.binary(), "codes": pa.binary()}))

    for batch in batches:
        column = batch.column("codes")
        asked = batch.column("asked").to_numpy(zero_copy_only=False).astype(bool)
        flat = column.flatten().to_numpy().astype(np.int32)
        held.append((batch.column("rep").to_numpy(), column.value_lengths().to_numpy().astype(np.int64), asked, flat))
        if sum(len(x[3]) for x in held) >= SORTED:
            yield from flush()
    if held:
        yield from flush()


def _unpacked(ids: bytes, sizes: bytes, codes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, sizes, padded codes, and their bits as 1 and -1, 0 in the padding."""
    n = np.frombuffer(sizes, np.int64)
    flat = np.frombuffer(codes, np.int32)
    there = np.arange(n.max()) < n[:, None]
    padded = np.zeros(there.shape, np.int32)
    padded[there] = flat
    bits = np.zeros((*there.shape, 32), np.float32)
    bits[there] = np.unpackbits(flat.view(np.uint8)).reshape(-1, 32) * np.float32(2) - 1
    return np.frombuffer(ids, np.int64), n, padded, bits.reshape(len(n), -1)


def _aligned(x: tuple, y: tuple, max_bit_error: float) -> dict[str, np.ndarray]:
    """The accepted pairs of two blocks, each at its best accepted offset."""
    (xi, xn, xc, xb), (yi, yn, yc, yb) = x, y
    other = xi[:, None] != yi
    found = []
    for o in range(MIN_OVERLAP - int(xn.max()), int(yn.max()) - MIN_OVERLAP + 1):
        s = max(0, -o)
        w = min(xc.shape[1] - s, yc.shape[1] - s - o)
        if w < MIN_OVERLAP:
            continue
        same = xb[:, 32 * s : 32 * (s + w)] @ yb[:, 32 * (s + o) : 32 * (s + o + w)].T  # equal less differing bits
        n = np.minimum.outer(xn - s, yn - s - o)
        i, j = np.nonzero(same + 1 >= (32 - 64 * max_bit_error) * n)
        keep = (n[i, j] >= MIN_OVERLAP) & other[i, j]
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        n = n[i, j]
        error = (32 * n - np.round(same[i, j]).astype(np.int64)) // 2 / (32.0 * n)
        equal = (xc[i, s : s + w] == yc[j, s + o : s + o + w]) & (np.arange(w) < n[:, None])
        keep = error <= max_bit_error
        found.append([v[keep] for v in (i, j, np.full(len(i), o), equal.sum(1), error)])
    if not found:
        return {}
    i, j, o, votes, error = (np.concatenate(v) for v in zip(*found))
    order = np.lexsort((-o, np.abs(o), error, -votes, j, i))
    i, j, o, votes, error = (v[order] for v in (i, j, o, votes, error))
    best = np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])][: len(i)]
    return {"id": xi[i[best]], "other_id": yi[j[best]], "offset": o[best].astype(np.int32), "votes": votes[best].astype(np.int64), "bit_error": error[best]}


def align_recordings(codes: DataFrame, is_query, max_bit_error: float = 0.25) -> DataFrame:
    """Rows of two kinds: ``member`` (id, other_id: the least id of its class) and ``match`` (classes id and
    other_id with the offset of other_id's frames against id's, votes (equal integers) for it, and the share of bits
    that differ): every pair with an offset that overlaps by ``MIN_OVERLAP`` places or more and differs in at most
    ``max_bit_error`` of its bits.  ``is_query`` is a condition on id.
    """
    C.small_batches(codes.sparkSession)
    keyed = codes.withColumn("k", F.when(F.size("codes") > 0, F.sha2(F.concat_ws(",", "codes"), 256)).otherwise(F.concat(F.lit("id "), "id")))
    keyed = C.cut(keyed)  # decoded once
    classes = keyed.groupBy("k").agg(F.min("id").alias("rep"), F.max(is_query).alias("asked"), F.first("codes").alias("codes"))
    member = keyed.select("id", "k").join(classes.select("k", "rep"), "k").select("id", F.col("rep").alias("other_id"))
    heads = classes.where(F.size("codes") > 0).select("rep", F.coalesce("asked", F.lit(False)).alias("asked"), "codes")
    n_parts = 4 * codes.sparkSession.sparkContext.defaultParallelism
    blocks = C.cut(heads.repartition(n_parts).mapInArrow(_packed, "asked boolean, ids binary, sizes binary, codes binary"))
    asks = blocks.where("asked").select(*(F.col(c).alias(f"q_{c}") for c in ("ids", "sizes", "codes"))).coalesce(max(1, n_parts // 8))

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x, y = ([batch.column(side + c)[row].as_py() for c in ("ids", "sizes", "codes")] for side in ("q_", ""))
                found = _aligned(_unpacked(*x), _unpacked(*y), max_bit_error)
                if found:
                    yield pa.RecordBatch.from_pydict(found)

    pairs = blocks.where("not asked").drop("asked").hint("shuffle_replicate_nl").crossJoin(asks)
    pairs = pairs.mapInArrow(matches, "id bigint, other_id bigint, offset int, votes bigint, bit_error double")
    match = pairs.select(F.lit("match").alias("kind"), "*")
    rest = member.select(
        F.lit("member").alias("kind"),
        "id",
        "other_id",
        F.lit(None).cast("int").alias("offset"),
        F.lit(None).cast("bigint").alias("votes"),
        F.lit(None).cast("double").alias("bit_error"),
    )
    return match.unionByName(rest)


RATE, NOTE = 4000, 512


def render_notes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WAV bytes of a vector's values as notes of one octave: the audio column of tables without one."""
    wheel = np.sin(2 * np.pi * np.outer(220 * 2 ** (np.arange(12) / 12), np.arange(NOTE)) / RATE)
    wheel = (wheel * 12000).astype("<i2")
    for batch in batches:
        out = []
        for v in batch.column("embedding"):
            x = np.array(v.as_py() or [], np.float64)
            x = np.nan_to_num(x)
            note = np.clip(np.round(12 * x) + 6, 0, 11).astype(int)
            with io.BytesIO() as f:
                with wave.open(f, "wb") as w:
                    w.setnchannels(1), w.setsampwidth(2), w.setframerate(RATE)
                    w.writeframes(wheel[note].tobytes())
                out.append(f.getvalue())
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "audio": pa.array(out, pa.binary())})


def recordings_of(vectors: DataFrame) -> DataFrame:
    """(id, audio): each row of embeddings as a recording."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), "embedding")
    # Rows grow 200-fold here: small batches keep a worker's memory low.
    return rows.mapInArrow(_in_parts, "id bigint, audio binary")


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from render_notes(batch.slice(i, 128) for i in range(0, batch.num_rows, 128))
