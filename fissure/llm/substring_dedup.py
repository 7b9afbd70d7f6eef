"""Exact substring dedup over words, with fixed-block anchors.

1. *Index*: the non-overlapping blocks of ``block`` words of every document.  *Probe*: the rolling
   windows of ``block`` words of every document, at each start.  Both meet by hash slice in a packed
   exchange; a block is hit where another document probes it.  As ``2 * block <= min_words + 1``, a
   shared window of ``min_words`` words holds a block of each of its documents.
2. *Extend*: the windows of ``min_words`` words around a hit go, as two independent keys of 64 and 32 bits, to
   the bucket of their smallest block hash.  Windows are equal where both keys are.  Equal windows therefore meet,
   neighbours travel together, and runs of matching windows are the maximal exact repeats.  A group of equal
   windows costs its own length: only the smallest id is kept for comparison, so no pairs of documents are formed.
3. The runs return to their documents, which are rewritten.

Hot blocks and windows are combined before each exchange: of the texts packed together (12 MB), a hash value sends
the entries of one document only.  The others are decided there, by that one, and go on dealt by document.
So a passage that every document holds is, where it meets, one document's entries for each 12 MB of text.

Defined cases: null or empty text has no words; a null doc_id counts as the largest possible id, and
stays null; rows that share an id are never each other's duplicates; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fissure.llm import common as C

BUCKET_BYTES = 8 << 20
SPAN = "array<struct<tk: bigint, start: int, n: int>>"


def _anchors(block: int, min_words: int, n_buckets: int):
    def entries(batches: Iterator[pa.RecordBatch]):
        for t in C.chunks(batches):
            wh, first = t.word_hashes()
            count = np.diff(first)
            probes = np.where(count >= min_words, count - block + 1, 0)
            at = C.ragged(first[:-1], probes)  # starts of probes
            h = C.windows(wh, block)[at] if len(at) else np.zeros(0, C.U64)
            yield t, {
                "ids": t.ids(),
                "doc_nk": t.null_keys(),
                "doc": np.repeat(np.arange(t.n), probes),
                "pos": C.ragged(np.zeros(t.n), probes),
                "h": h,
                "bucket": ((h >> C.U64(32)) % C.U64(n_buckets)).astype(np.int64),
            }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in C.gathered(entries(batches)):
            block_at = e["pos"] % block == 0
            e["pos"] -= e["pos"] % block  # only places of blocks are asked for later
            for part, decided in _split_anchors(e, block_at, n_buckets):
                order, cut, row = C.packed(part, n_buckets)
                h = part["h"][order].astype(np.uint32)
                row["h"] = C.slices(h[:0] if decided else h, cut)
                row["what"] = C.slices(part["what"][order], cut)
                yield pa.RecordBatch.from_pydict(row)

    return run


PROBE, BLOCK, SEVERAL, DECIDED = range(4)


def _split_anchors(e: dict[str, np.ndarray], block_at: np.ndarray, n_buckets: int) -> Iterator[tuple[dict[str, np.ndarray], bool]]:
    """Of each hash value one entry, or all blocks if they are of one id; and the blocks that are hit by what is here."""
    order = np.argsort(e["h"]).astype(np.int32)
    head = C.group_bounds(e["h"][order])
    size = np.diff(np.r_[head, len(order)])
    one = order[head]
    several = np.zeros(len(order), bool)
    if (size > 1).any():
        again, size = order[np.repeat(size > 1, size)], size[size > 1]
        rid, head = e["ids"][e["doc"][again]], np.cumsum(size) - size
        several[again] = np.repeat(np.minimum.reduceat(rid, head) != np.maximum.reduceat(rid, head), size)
    del order
    sent = block_at & ~several
    sent[one] = True
    what = np.where(several, SEVERAL, np.where(block_at, BLOCK, PROBE)).astype(np.uint8)
    at = np.flatnonzero(sent)
    yield C.taken(e, at) | {"what": what[at]}, False
    at = np.flatnonzero(block_at & several)
    if len(at):
        yield C.spread(C.taken(e, at), n_buckets) | {"what": np.full(len(at), DECIDED, np.uint8)}, True


def _hits(table: pa.Table) -> pa.Table:
    """Blocks that another id probes."""
    hs, ds, ps, ks, ws = [], [], [], [], []
    for row, ids, doc, pos in C.unpacked(table):
        w = np.frombuffer(row["what"], np.uint8)
        hs.append(np.frombuffer(row["h"], np.uint32) if row["h"] else np.zeros(len(w), np.uint32))
        ks.append(C.unplanes(row["nk"], np.int64)[doc])
        ds.append(ids[doc])
        ps.append(pos.astype(np.int32))
        ws.append(w)
    h, d, p, k, w = map(np.concatenate, (hs, ds, ps, ks, ws))
    hit = w == DECIDED
    met = np.flatnonzero(~hit)
    if len(met):
        order = met[np.argsort(h[met], kind="stable")]
        head = C.group_bounds(h[order])
        least, most = (f.reduceat(d[order], head) for f in (np.minimum, np.maximum))
        several = (least != most) | np.logical_or.reduceat(w[order] == SEVERAL, head)
        hit[order] = np.repeat(several, np.diff(np.r_[head, len(order)])) & (w[order] == BLOCK)
    return pa.table({"rid": pa.array(d[hit], pa.int64()), "nk": pa.array(k[hit], pa.int64()), "pos": pa.array(p[hit], pa.int32())})


def _windows(block: int, min_words: int, n_buckets: int):
    def entries(batches: Iterator[pa.RecordBatch]):
        for t in C.chunks(batches):
            starts, ends, first = t.words()
            wh, check = (C.span_hashes(t.data, starts, ends, seed) for seed in (0, 1))
            count = np.diff(first)
            hits = t.column("pos")
            per = np.asarray(pa.compute.list_value_length(hits).fill_null(0))
            pos = np.asarray(hits.flatten()).astype(np.int64)
            doc = np.repeat(np.arange(t.n), per)
            fits = (count[doc] >= min_words) & (pos + block <= count[doc])
            doc, pos = doc[fits], pos[fits]
            lo = np.maximum(pos - (min_words - block), 0)
            hi = np.minimum(pos, count[doc] - min_words)
            at = np.flatnonzero(C.covered(len(wh), first[doc] + lo, np.maximum(hi - lo + 1, 0)))
            doc = np.searchsorted(first, at, "right") - 1
            none = np.zeros(0, C.U64)
            home = C.sliding_min(C.windows(wh, block), min_words - block + 1)[at] if len(at) else none
            yield t, {
                "ids": t.ids(),
                "doc_tk": t.text_keys(),
                "doc_nk": t.null_keys(),
                "doc": doc,
                "pos": at - first[doc],
                "h": C.windows(wh, min_words)[at] if len(at) else none,
                "g": (C.windows(check, min_words)[at] if len(at) else none).astype(np.uint32),
                "bucket": (C.mix(home + C.U64(1)) % C.U64(n_buckets)).astype(np.int64),
            }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in C.gathered(entries(batches)):
            later = e["ids"][e["doc"]] > _least(e["h"], e["g"], e["ids"][e["doc"]])
            for part, decided in ((C.taken(e, np.flatnonzero(~later)), False), (C.spread(C.taken(e, np.flatnonzero(later)), n_buckets), True)):
                if len(part["doc"]):
                    order, cut, row = C.packed(part, n_buckets)
                    yield pa.RecordBatch.from_pydict(row | {k: C.slices(part[k][order][: 0 if decided else None], cut) for k in ("h", "g")})

    return run


def _least(h: np.ndarray, g: np.ndarray, d: np.ndarray) -> np.ndarray:
    """For each window the least id that holds it."""
    out = np.empty(len(h), np.int64)
    if len(h):
        order = np.argsort(h)
        new = np.ones(len(h), bool)
        new[1:] = h[order[1:]] != h[order[:-1]]
        if (~new[1:] & (g[order[1:]] != g[order[:-1]])).any():  # rarely does one key not tell them apart
            order = np.lexsort((g, h))
            new[1:] = (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]])
        head = np.flatnonzero(new)
        out[order] = np.repeat(np.minimum.reduceat(d[order], head), np.diff(np.r_[head, len(h)]))
    return out


def _runs(table: pa.Table) -> pa.Table:
    """Windows that a smaller id holds, as runs within documents; rows without hashes are decided."""
    hs, gs, ds, ps, ts, ks, rows, known = [], [], [], [], [], [], [], []
    for i, (row, ids, doc, pos) in enumerate(C.unpacked(table)):
        known.append(np.full(len(pos), not row["h"]))
        hs.append(np.frombuffer(row["h"], C.U64))
        gs.append(np.frombuffer(row["g"], np.uint32))
        ds.append(ids[doc])
        ts.append(C.unplanes(row["tk"], np.uint32).astype(np.int64)[doc])
        ks.append(C.unplanes(row["nk"], np.int64)[doc])
        ps.append(pos)
        rows.append((i << 32) + doc)
    h, g, d, p, t, k, r, gone = map(np.concatenate, (hs, gs, ds, ps, ts, ks, rows, known))
    met = np.flatnonzero(~gone)
    gone[met] = d[met] > _least(h, g, d[met])
    out = np.flatnonzero(gone)
    d, p, t, k, r = d[out], p[out], t[out], k[out], r[out]
    new = np.ones(len(p), bool)
    new[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)
    at = np.flatnonzero(new)
    return pa.table(
        {
            "rid": pa.array(d[at], pa.int64()),
            "nk": pa.array(k[at], pa.int64()),
            "tk": pa.array(t[at], pa.int64()),
            "start": pa.array(p[at], pa.int32()),
            "n": pa.array(np.diff(np.r_[at, len(p)]), pa.int32()),
        }
    )


def _rewrite(min_words: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.chunks(batches):
            starts, ends, first = t.words()
            spans = t.column("spans")
            per = np.asarray(pa.compute.list_value_length(spans).fill_null(0))
            flat = spans.flatten()
            doc = np.repeat(np.arange(t.n), per)
            mine = np.asarray(flat.field("tk")) == t.text_keys()[doc] if len(doc) else np.zeros(0, bool)
            at = first[doc[mine]] + np.asarray(flat.field("start"))[mine]
            stay = ~C.covered(len(starts), at, np.asarray(flat.field("n"))[mine].astype(np.int64) + min_words - 1)
            left = np.r_[0, np.cumsum(stay)][first]
            # Kept words side by side, a space before each; a document's first one is left out below.
            size = (ends - starts)[stay] + 1
            body = np.full(int(size.sum()), 32, np.uint8)
            to = np.cumsum(size) - size
            body[C.ragged(to + 1, size - 1)] = t.data[C.ragged(starts[stay], size - 1)]
            body = body.tobytes()
            edge = np.r_[to, len(body)][left].tolist()
            kept = [body[a + 1 : b] for a, b in zip(edge, edge[1:])]
            out = {
                "doc_id": t.column("doc_id"),
                "n_words": pa.array(np.diff(first), pa.int64()),
                "n_removed": pa.array(np.diff(first) - np.diff(left), pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            }
            if keep_text:
                out["kept_text"] = pa.array([k.decode() for k in kept], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return run


def substring_dedup(docs: DataFrame, min_words: int = 50, block: int | None = None, keep_text: bool = True) -> DataFrame:
    """Words that repeat, in runs of ``min_words`` or more, what a smaller doc_id holds are removed.

    Returns doc_id, n_words, n_removed, kept_sha256 and, unless ``keep_text`` is off, kept_text (words
    joined by one space).
    """
    block = block or (min_words + 1) // 2
    if not 1 <= block <= (min_words + 1) // 2:
        raise ValueError("block must be between 1 and (min_words + 1) // 2")
    docs = C.documents(docs).select("*", C.null_key())  # the same columns in both joins: one exchange serves both
    n = C.buckets(C.text_bytes(docs), BUCKET_BYTES)
    packed = C.PACKED + ", nk binary, h binary, what binary"
    hits = (
        docs.select("rid", "nk", "text")
        .mapInArrow(_anchors(block, min_words, n), packed)
        .groupBy("bucket")
        .applyInArrow(_hits, "rid bigint, nk bigint, pos int")
        .groupBy("rid", "nk")
        .agg(F.collect_list("pos").alias("pos"))
    )
    runs = (
        docs.join(hits, ["rid", "nk"])
        .select("rid", "nk", "doc_id", "text", C.text_key(), "pos")
        .mapInArrow(_windows(block, min_words, n), C.PACKED + ", tk binary, nk binary, h binary, g binary")
        .groupBy("bucket")
        .applyInArrow(_runs, "rid bigint, nk bigint, tk bigint, start int, n int")
        .groupBy("rid", "nk")
        .agg(F.collect_list(F.struct("tk", "start", "n")).alias("spans"))
    )
    out = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * keep_text
    whole = docs.join(runs, ["rid", "nk"], "left").select("rid", "nk", "doc_id", "text", C.text_key(), "spans")
    return whole.mapInArrow(_rewrite(min_words, keep_text), out)
