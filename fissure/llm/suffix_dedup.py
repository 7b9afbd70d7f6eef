"""Exact byte-level dedup: intervals of a Burrows-Wheeler transform, expanded up to a length.

1. Every window of ``min_bytes`` bytes has an anchor value, the least hash of its ``GRAM``-byte grams.
   Neighbouring windows with one value form a segment.  A packed exchange finds the values that occur
   more than once; equal windows have equal values, so the others can't repeat.
2. The segments of those values go to the bucket of their value.  There the distinct segments, each
   with its count, are joined by end marks; their suffix array (prefix doubling) gives the
   transform, and breadth-first backward extension assigns common prefix lengths in increasing order
   and stops at ``min_bytes``.  Neighbours that got no length share ``min_bytes`` bytes or more.
3. Repeated windows return to their documents as runs.

Hot values are combined before each exchange: of the texts packed together (12 MB), an anchor value sends one entry
and a segment one body, and says if it is there twice.  Then the copies are known to repeat, whole, and go on dealt by
document.  So a passage that every document holds is, where it meets, one entry for each 12 MB of text.

Defined cases: a null text is empty; a null doc_id is a row like any other; rows that repeat are
copies of each other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fissure.llm import common as C

GRAM = 64
BUCKET_BYTES = 3 << 20
FEW_BYTES = 1 << 19  # what is hashed at a time: it stays in the cache
WIDE = 64  # intervals over this width are extended by rank, others element by element
FEW = 300  # and so are wide ones of fewer elements for each symbol: a step by rank has a cost of its own


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling, from 7 symbols of 9 bits on; only suffixes that tie are sorted again."""
    n = len(symbols)
    wide = np.zeros(n + 7, C.U64)
    wide[:n] = symbols
    key = np.zeros(n, C.U64)
    for j in range(7):
        key <<= C.U64(9)
        key |= wide[j : j + n]
    order = np.argsort(key).astype(np.int32)  # ties get one rank, in any order
    head = C.group_bounds(key[order])
    size = np.diff(np.r_[head, n])
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(head, size)
    tied = order[np.repeat(size > 1, size)]
    step = 7
    while len(tied):
        after = tied + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        old = rank[tied]
        key = (old.astype(np.int64) << 32) | second
        by = np.argsort(key)
        tied, key, old = tied[by], key[by], old[by]
        group = C.group_bounds(old)
        parts = C.group_bounds(key)
        first = np.repeat(group, np.diff(np.r_[group, len(old)]))
        size = np.diff(np.r_[parts, len(key)])
        rank[tied] = old + np.repeat(parts, size) - first
        tied = tied[np.repeat(size > 1, size)]
        step *= 2
    sa = np.empty(n, np.int32)
    sa[rank] = np.arange(n, dtype=np.int32)
    return sa


def short_prefixes(symbols: np.ndarray, sa: np.ndarray, stop: int) -> np.ndarray:
    """Whether suffix-array neighbours (i - 1, i) share fewer than ``stop`` symbols.

    Level by level, the intervals of strings of one length are extended backward by each symbol; an
    interval whose right edge has no value yet gives it the level, and goes on.
    """
    n = len(symbols)
    bwt = symbols[sa - 1]
    order = np.argsort(bwt, kind="stable").astype(np.int32)
    lf = np.empty(n, np.int32)
    lf[order] = np.arange(n, dtype=np.int32)
    cut = np.searchsorted(bwt[order], np.arange(259))
    chars = [c for c in range(258) if cut[c + 1] > cut[c]]
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    lb, rb = np.zeros(1, np.int32), np.full(1, n, np.int32)
    for _ in range(stop):
        if not len(lb):
            break
        width = rb - lb
        wide = width > WIDE
        if width[wide].sum() < FEW * len(chars):
            wide[:] = False
        lows, highs = [], []
        if wide.any():
            a, b = lb[wide], rb[wide]
            for c in chars:
                where = order[cut[c] : cut[c + 1]]
                i, j = np.searchsorted(where, a), np.searchsorted(where, b)
                some = j > i
                lows.append(cut[c] + i[some])
                highs.append(cut[c] + j[some])
        if not wide.all():
            a, w = lb[~wide], width[~wide]
            at = C.ragged(a, w)
            to = lf[at]
            of = np.repeat(np.arange(len(a)), w)
            if len(to) > len(a):
                by = np.argsort(to)
                to, of = to[by], of[by]
                ch = symbols[sa[to]]
                new = np.ones(len(to), bool)
                new[1:] = (to[1:] != to[:-1] + 1) | (of[1:] != of[:-1]) | (ch[1:] != ch[:-1])
                first = np.flatnonzero(new)
                lows.append(to[first])
                highs.append(to[np.r_[first[1:], len(to)] - 1] + 1)
            else:
                lows.append(to)
                highs.append(to + 1)
        lb, rb = np.concatenate(lows).astype(np.int32), np.concatenate(highs).astype(np.int32)
        fresh = ~known[rb]
        lb, rb = lb[fresh], rb[fresh]
        known[rb] = True
    return known[:n]


def repeated_windows(segments: list[bytes], counts: np.ndarray, stop: int) -> list[np.ndarray]:
    """For each distinct segment, which of its windows of ``stop`` bytes occur twice or more in all.

    Segments are joined by an end mark (1) and closed by a least one (0).  A string of ``stop`` bytes
    within a segment holds no mark, so matches across segments don't count.
    """
    sizes = np.array([len(s) for s in segments], np.int64)
    n = int((sizes + 1).sum()) + 1
    begin = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.empty(n, np.uint16)
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    body = np.ones(n, bool)
    body[begin + sizes] = body[-1] = False
    symbols[body] = np.frombuffer(b"".join(segments), np.uint8).astype(np.uint16) + 2
    symbols[~body] = 1
    symbols[-1] = 0
    sa = suffix_array(symbols)
    head = np.flatnonzero(short_prefixes(symbols, sa, stop))
    times = np.add.reduceat(np.r_[counts[owner], 0][sa], head)
    again = np.empty(n, bool)
    again[sa] = np.repeat(times > 1, np.diff(np.r_[head, n]))
    return [again[b : b + max(0, s - stop + 1)] for b, s in zip(begin.tolist(), sizes.tolist())]


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand and kept for the worker."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, C.U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            more = max(n, 1 << 16) - 1
            inv = C.U64(pow(int(C.BASE), -1, 1 << 64))
            self.up = np.multiply.accumulate(np.r_[C.U64(1), np.full(more, C.BASE, C.U64)])
            self.down = np.multiply.accumulate(np.r_[C.U64(1), np.full(more, inv, C.U64)])
        return self.up[:n], self.down[:n]


_POWERS = _Powers()
_BYTE_CODE = C.mix(np.arange(1, 257, dtype=C.U64) * C.U64(0x9E3779B97F4A7C15))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A rolling hash of the ``GRAM`` bytes at each place.  It only chooses anchors: grams that hash alike by
    chance or by design make segments longer or meet for nothing, and what repeats is decided by the bytes."""
    n = len(data) - GRAM + 1
    up, down = _POWERS.get(len(data) + 1)
    p = np.zeros(len(data) + 1, C.U64)
    np.cumsum(_BYTE_CODE[data] * up[:-1], out=p[1:])
    h = (p[GRAM:] - p[:n]) * down[:n]
    h ^= h >> C.U64(32)
    h *= C.U64(0xD6E8FEB86659FD93)
    return h


def _segments(t: C.Texts, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor value: start, windows, value, whether the value is there twice."""
    parts = [_few_segments(t.data[t.off[a] : t.off[b]], t.off[a : b + 1] - t.off[a], size, t.off[a]) for a, b in t.runs(FEW_BYTES)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _few_segments(data: np.ndarray, off: np.ndarray, size: int, base: int) -> tuple[np.ndarray, ...]:
    length = np.diff(off)
    doc = np.flatnonzero(length >= size)
    n_windows = length[doc] - size + 1
    none = np.zeros(0, np.int64)
    if not len(doc):
        return none, none, none.astype(C.U64), none.astype(bool)
    h = gram_hashes(data)
    least = C.sliding_min(h, size - GRAM + 1)
    at = C.ragged(off[doc], n_windows)
    value = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)
    new[np.cumsum(n_windows)[:-1]] = True
    first = np.flatnonzero(new)
    start, value, wins = at[first], value[first], np.diff(np.r_[first, len(at)])
    grams = wins + size - GRAM
    same = h[C.ragged(start, grams)] == np.repeat(value, grams)
    twice = np.add.reduceat(same, np.cumsum(grams) - grams) > 1
    return start + base, wins, value, twice


def _entries(t: C.Texts, start: np.ndarray, value: np.ndarray, n_buckets: int) -> dict[str, np.ndarray]:
    doc = np.searchsorted(t.off, start, "right") - 1
    return {
        "ids": t.ids(),
        "doc_nk": t.null_keys(),
        "doc": doc,
        "pos": start - t.off[doc],
        "h": value,
        "bucket": (C.mix(value) % C.U64(n_buckets)).astype(np.int64),
    }


def _anchors(size: int, n_buckets: int):
    def entries(batches: Iterator[pa.RecordBatch]):
        for t in C.chunks(batches):
            start, _, value, twice = _segments(t, size)
            yield t, _entries(t, start, value, n_buckets) | {"twice": twice}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in C.gathered(entries(batches)):
            several = _several(e["h"], 1 + e["twice"].astype(np.int64))
            one = np.unique(e["h"], return_index=True)[1]
            sent = ~several
            sent[one] = True
            for at, decided in ((np.flatnonzero(sent), False), (np.flatnonzero(several), True)):
                if not len(at):
                    continue
                part = C.taken(e, at)
                order, cut, row = C.packed(C.spread(part, n_buckets) if decided else part, n_buckets)
                many = several[at[order]]
                row["h"] = C.slices(part["h"][order][: 0 if decided else None], cut)
                row["several"] = pa.array([np.packbits(many[a:b]).tobytes() for a, b in zip(cut, cut[1:])], pa.binary())
                yield pa.RecordBatch.from_pydict(row)

    return run


def _several(values: np.ndarray, times: np.ndarray) -> np.ndarray:
    """For each entry whether its value occurs twice or more in all."""
    order = np.argsort(values)
    head = C.group_bounds(values[order])
    out = np.empty(len(values), bool)
    out[order] = np.repeat(np.add.reduceat(times[order], head) > 1, np.diff(np.r_[head, len(values)]))
    return out


def _repeated(table: pa.Table) -> pa.Table:
    """Entries whose anchor value occurs elsewhere; rows without values are decided."""
    hs, ds, ps, ts, ks, known = [], [], [], [], [], []
    for row, ids, doc, pos in C.unpacked(table):
        known.append(np.full(len(pos), not row["h"]))
        hs.append(np.frombuffer(row["h"], C.U64))
        ks.append(C.unplanes(row["nk"], np.int64)[doc])
        ds.append(ids[doc])
        ps.append(pos.astype(np.int32))
        ts.append(np.unpackbits(np.frombuffer(row["several"], np.uint8), count=len(pos)))
    h, d, p, t, k, out = map(np.concatenate, (hs, ds, ps, ts, ks, known))
    met = np.flatnonzero(~out)
    if len(met):
        out[met] = _several(h, 1 + t[met].astype(np.int64)) & (t[met] == 0)  # the others are among the decided
    return pa.table({"rid": pa.array(d[out], pa.int64()), "nk": pa.array(k[out], pa.int64()), "pos": pa.array(p[out], pa.int32())})


def _bodies(size: int, n_buckets: int):
    def entries(batches: Iterator[pa.RecordBatch]):
        for t in C.chunks(batches):
            start, wins, value, _ = _segments(t, size)
            hits = t.column("pos")
            per = np.asarray(pa.compute.list_value_length(hits).fill_null(0))
            wanted = np.asarray(hits.flatten()).astype(np.int64) + np.repeat(t.off[:-1], per)
            mine = np.isin(start, wanted)
            start, wins, value = start[mine], wins[mine], value[mine]
            sizes = wins + size - 1
            body = t.data[C.ragged(start, sizes)]
            yield t, _entries(t, start, value, n_buckets) | {"doc_tk": t.text_keys(), "wins": wins, "body": body}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in C.gathered(entries(batches)):
            body = e.pop("body")
            sizes = e["wins"] + size - 1
            begin = np.cumsum(sizes) - sizes
            several, sent = _equal_bodies(e["h"], begin, sizes, body)
            for at, decided in ((np.flatnonzero(sent), False), (np.flatnonzero(several), True)):
                if not len(at):
                    continue
                part = C.taken(e, at)
                order, cut, row = C.packed(C.spread(part, n_buckets) if decided else part, n_buckets)
                of = at[order]
                row["sizes"] = pa.array([C.planes(sizes[of[a:b]].astype(np.uint32)) for a, b in zip(cut, cut[1:])], pa.binary())
                row["several"] = pa.array([np.packbits(several[of[a:b]]).tobytes() for a, b in zip(cut, cut[1:])], pa.binary())
                moved = body[C.ragged(begin[of], sizes[of])] if not decided else body[:0]
                row["body"] = C.slices(moved, np.r_[0, np.cumsum(sizes[of])][cut])
                yield pa.RecordBatch.from_pydict(row)

    return run


def _equal_bodies(value: np.ndarray, begin: np.ndarray, sizes: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each body is there twice or more, and which to send: the first of equal ones."""
    again = np.flatnonzero(_several(value, np.ones(len(value), np.int64)))  # equal bodies have equal values
    whole, seen = body.tobytes(), {}
    first = np.arange(len(value))
    for i, a, b in zip(again.tolist(), begin[again].tolist(), (begin + sizes)[again].tolist()):
        first[i] = seen.setdefault(whole[a:b], i)
    return np.bincount(first, minlength=len(value))[first] > 1, first == np.arange(len(value))


def _matches(size: int):
    def run(table: pa.Table) -> pa.Table:
        index: dict[bytes, int] = {}
        seg, ds, ps, ts, ks, many, wins = [], [], [], [], [], [], []
        for row, ids, doc, pos in C.unpacked(table):
            n = C.unplanes(row["sizes"], np.uint32).astype(np.int64)
            body = row["body"]
            edge = np.r_[0, np.cumsum(n)].tolist()
            seg.append([index.setdefault(body[a:b], len(index)) for a, b in zip(edge, edge[1:])] if body else np.full(len(n), -1))
            ds.append(ids[doc])
            ts.append(C.unplanes(row["tk"], np.uint32).astype(np.int64)[doc])
            ks.append(C.unplanes(row["nk"], np.int64)[doc])
            ps.append(pos)
            many.append(np.unpackbits(np.frombuffer(row["several"], np.uint8), count=len(n)))
            wins.append(n - size + 1)
        seg, d, p, t, key, many, wins = map(np.concatenate, (seg, ds, ps, ts, ks, many, wins))
        known = seg < 0  # these repeat whole
        asked = np.flatnonzero(~known & (many == 0))
        out = [(np.flatnonzero(known), np.zeros(int(known.sum()), np.int64), wins[known])]
        if index:
            counts = np.bincount(seg[~known], 1 + many[~known], len(index)).astype(np.int64)
            runs = [_runs(x) for x in repeated_windows(list(index), counts, size)]
            n_runs = np.array([len(a) for a, _ in runs], np.int64)
            base = np.cumsum(n_runs) - n_runs
            starts, lengths = (np.concatenate([r[i] for r in runs]) for i in (0, 1))
            which = C.ragged(base[seg[asked]], n_runs[seg[asked]])
            out.append((np.repeat(asked, n_runs[seg[asked]]), starts[which], lengths[which]))
        of, starts, lengths = (np.concatenate(x) for x in zip(*out))
        return pa.table(
            {
                "rid": pa.array(d[of], pa.int64()),
                "nk": pa.array(key[of], pa.int64()),
                "tk": pa.array(t[of], pa.int64()),
                "start": pa.array((p[of] + starts).astype(np.int32), pa.int32()),
                "n": pa.array(lengths.astype(np.int32), pa.int32()),
            }
        )

    return run


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of true values."""
    edge = np.diff(np.r_[False, flags, False].astype(np.int8))
    start = np.flatnonzero(edge == 1)
    return start, np.flatnonzero(edge == -1) - start


def _rewrite(size: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.chunks(batches):
            spans = t.column("spans")
            per = np.asarray(pa.compute.list_value_length(spans).fill_null(0))
            flat = spans.flatten()
            doc = np.repeat(np.arange(t.n), per)
            mine = np.asarray(flat.field("tk")) == t.text_keys()[doc] if len(doc) else np.zeros(0, bool)
            doc = doc[mine]
            start = np.asarray(flat.field("start"))[mine].astype(np.int64) + t.off[doc]
            gone = C.covered(len(t.data), start, np.asarray(flat.field("n"))[mine].astype(np.int64) + size - 1)
            lost = np.r_[0, np.cumsum(gone)]
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = t.off[:-1][t.off[:-1] < len(gone)]
            begins[inner] |= gone[inner]
            spans_to = np.r_[0, np.cumsum(begins)]
            kept = t.data[~gone].tobytes()
            edge = t.off - lost[t.off]
            bodies = [kept[a:b] for a, b in zip(edge.tolist(), edge[1:].tolist())]
            out = {
                "doc_id": t.column("doc_id"),
                "n_bytes": pa.array(np.diff(t.off), pa.int64()),
                "n_removed": pa.array(np.diff(lost[t.off]), pa.int64()),
                "n_spans": pa.array(np.diff(spans_to[t.off]), pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(b).hexdigest() for b in bodies], pa.string()),
            }
            if keep_text:
                out["kept_bytes"] = pa.array(bodies, pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    return run


def suffix_dedup(docs: DataFrame, min_bytes: int = 200, keep_text: bool = True) -> DataFrame:
    """Bytes covered by a string of ``min_bytes`` bytes that occurs anywhere else as well are removed.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, unless ``keep_text`` is off,
    kept_bytes (the remaining bytes; a cut may split a character).
    """
    if min_bytes < GRAM:
        raise ValueError(f"min_bytes must be {GRAM} or more")
    docs = C.documents(docs).select("*", C.null_key())  # the same columns in both joins: one exchange serves both
    n = C.buckets(C.text_bytes(docs), BUCKET_BYTES)
    hits = (
        docs.select("rid", "nk", "text")
        .mapInArrow(_anchors(min_bytes, n), C.PACKED + ", nk binary, h binary, several binary")
        .groupBy("bucket")
        .applyInArrow(_repeated, "rid bigint, nk bigint, pos int")
        .groupBy("rid", "nk")
        .agg(F.collect_list("pos").alias("pos"))
    )
    runs = (
        docs.join(hits, ["rid", "nk"])
        .select("rid", "nk", "doc_id", "text", C.text_key(), "pos")
        .mapInArrow(_bodies(min_bytes, n), C.PACKED + ", tk binary, nk binary, sizes binary, several binary, body binary")
        .groupBy("bucket")
        .applyInArrow(_matches(min_bytes), "rid bigint, nk bigint, tk bigint, start int, n int")
        .groupBy("rid", "nk")
        .agg(F.collect_list(F.struct("tk", "start", "n")).alias("spans"))
    )
    out = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_bytes binary" * keep_text
    whole = docs.join(runs, ["rid", "nk"], "left").select("rid", "nk", "doc_id", "text", C.text_key(), "spans")
    return whole.mapInArrow(_rewrite(min_bytes, keep_text), out)
