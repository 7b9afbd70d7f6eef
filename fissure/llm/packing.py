"""Best-fit packing of tokenized documents into sequences of bounded length.

Tokenizing runs per task: texts are cut where the pre-tokenizer always cuts, each distinct piece is
encoded once and ids are gathered.  What is
shuffled is a few integers per piece.  Pieces are dealt at random to groups of about
``group_tokens``; a group is packed by bounded-space online best-fit: at most ``open_bins`` bins are
open, a bitset keyed by free space finds the tightest that fits, and when all are taken the fullest
closes.  Pieces arrive in order of their ids' checksum, through a buffer of ``LOOK_AHEAD`` pieces for
each open bin that hands them on longest first.  A group fills about 1000 bins, so most close early.

Defined cases: a null or empty text is the end id alone; documents over ``capacity`` ids, the end id
included, are cut into pieces of ``capacity``; rows that repeat are packed as often as they occur; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fissure.llm import common as C

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
CACHE_PIECES = 800_000
LOOK_AHEAD = 8
JOINED = 50
# Classes of bytes between which a pre-tokenizer that keeps letters, digits and signs apart always
# splits; an apostrophe (contractions), controls and bytes of longer characters are in none.
KIND = np.zeros(256, np.uint8)
KIND[[*range(97, 123)]] = 1
KIND[[*range(48, 58)]] = 2
KIND[[i for i in range(33, 127) if not chr(i).isalnum() and i != 39]] = 3
SEPARATOR = "\x01"


class WordTokenizer:
    """Ids of whole texts by a lower-casing tokenizer that drops white space and splits at signs.

    Each distinct piece between such splits is encoded once and looked up by one hash; a second, independent one
    must agree as well, else the chunk's documents are encoded whole.  A text that
    holds the string of a special token keeps its case and is cut at white space only.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # of the worker that holds it: Spark runs one per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        separator = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.separator = separator[0] if len(separator) == 1 else None
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks, self.starts, self.counts = np.zeros(0, C.U64), np.zeros(0, C.U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _encode_all(self, pieces: list[str], joined: bool) -> list[np.ndarray]:
        if not joined:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]
        glue = f" {SEPARATOR} "
        texts = [glue.join([*pieces[i : i + JOINED], ""]) for i in range(0, len(pieces), JOINED)]
        out = []
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(e.ids, np.uint32)
            cut = np.flatnonzero(ids == self.separator).tolist()
            out += [ids[a + 1 : b] for a, b in zip([-1, *cut], cut)]
        return out

    def _learn(self, keys: np.ndarray, checks: np.ndarray, pieces: list[str], joined: bool) -> None:
        encoded = self._encode_all(pieces, joined)
        counts = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.concatenate(encoded)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        at = np.searchsorted(self.keys, keys)
        self.starts = np.insert(self.starts, at, self.used + np.cumsum(counts) - counts)
        self.counts = np.insert(self.counts, at, counts)
        self.checks = np.insert(self.checks, at, checks)
        self.keys = np.insert(self.keys, at, keys)
        self.used += len(flat)

    def _spans(self, t: C.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
        low = C.lowered(t.data)
        whole = low.tobytes()
        if any(x in whole for x in self.special):
            return t.data, *t.words(), False
        starts, ends, _ = C.word_spans(low, t.off)
        kind = KIND[low]
        edge = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
        edge = edge[~np.isin(edge, t.off)]
        starts, ends = np.sort(np.r_[starts, edge]), np.sort(np.r_[ends, edge])
        return low, starts, ends, np.searchsorted(starts, t.off), SEPARATOR.encode() not in whole

    def encode(self, t: C.Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk, and where each document's begin (n + 1)."""
        data, starts, ends, first, joined = self._spans(t)
        h, check = C.span_hashes(data, starts, ends), C.span_hashes(data, starts, ends, 1)
        keys, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > max(CACHE_PIECES, len(keys)):
            self.clear()
        slot = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(slot, max(0, len(self.keys) - 1))] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            body = data.tobytes()
            pick = at[~known]
            pieces = [body[a:b].decode() for a, b in zip(starts[pick].tolist(), ends[pick].tolist())]
            self._learn(keys[~known], check[pick], pieces, joined and self.separator is not None)
            slot = np.searchsorted(self.keys, keys)
        slot = slot[inverse]
        if not np.array_equal(self.checks[slot], check):
            return self._whole(t)
        count = self.counts[slot]
        return self.ids[C.ragged(self.starts[slot], count)], np.r_[0, np.cumsum(count)][first]

    def _whole(self, t: C.Texts) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.tokenizer.encode(t.text(i).decode(), add_special_tokens=False).ids for i in range(t.n)]
        off = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int64)
        return np.array([x for y in ids for x in y], np.uint32), off


_LOADED: dict[str, WordTokenizer] = {}


def word_tokenizer(definition: str) -> WordTokenizer:
    """One per worker process: later tasks find what earlier ones learned."""
    if definition not in _LOADED:
        _LOADED[definition] = WordTokenizer(definition)
    return _LOADED[definition]


def _pieces(definition, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(definition.value)
        end = np.array([end_id], np.uint32)
        for t in C.chunks(batches):
            ids, off = tokenizer.encode(t)
            total = np.diff(off) + 1
            n = -(-total // capacity)
            doc = np.repeat(np.arange(t.n), n)
            piece = C.ragged(np.zeros(t.n), n)
            start = piece * capacity
            length = np.minimum(capacity, total[doc] - start)
            crc = []
            for d, s, m, whole in zip(doc.tolist(), start.tolist(), length.tolist(), total[doc].tolist()):
                part = ids[off[d] + s : min(off[d] + s + m, off[d + 1])]
                c = zlib.crc32(part.tobytes())
                crc.append(zlib.crc32(end.tobytes(), c) if s + m == whole else c)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": t.column("doc_id").take(pa.array(doc)),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
            )

    return run


def best_fit(lengths: list[int], capacity: int, open_bins: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, in order of arrival."""
    bits, by_free, n_open, n_bins = 0, {}, 0, 0
    bins, offsets = [], []
    for length in lengths:
        fitting = bits >> length
        if fitting:
            free = length + ((fitting & -fitting).bit_length() - 1)
            where = by_free[free].pop()
            if not by_free[free]:
                bits &= ~(1 << free)
            n_open -= 1
        else:
            if n_open >= open_bins:
                fullest = (bits & -bits).bit_length() - 1
                by_free[fullest].pop()
                if not by_free[fullest]:
                    bits &= ~(1 << fullest)
                n_open -= 1
            where, free = n_bins, capacity
            n_bins += 1
        bins.append(where)
        offsets.append(capacity - free)
        if rest := free - length:
            by_free.setdefault(rest, []).append(where)
            bits |= 1 << rest
            n_open += 1
    return bins, offsets


def buffered(lengths: np.ndarray, size: int) -> np.ndarray:
    """The order in which pieces leave a buffer of ``size`` that hands on its longest first, refilled when empty."""
    return np.lexsort((-lengths, np.arange(len(lengths)) // size))


def _pack(capacity: int, open_bins: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("ids_crc32", "doc_id", "piece")])
        table = table.take(buffered(table.column("length").to_numpy(), LOOK_AHEAD * open_bins))
        bins, offsets = best_fit(table.column("length").to_pylist(), capacity, open_bins)
        group = table.column("group")[0].as_py()
        return table.drop_columns(["group"]).append_column(
            "sequence_id", pa.array([(group << 32) + b for b in bins], pa.int64())
        ).append_column("offset", pa.array(offsets, pa.int64()))

    return run


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, open_bins: int = 64, group_tokens: int = 1 << 22
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``tokenizer_path`` names a tokenizers file, on the driver, that lower-cases, drops white space and keeps
    letters, digits and signs apart; its contents (a few MB) are broadcast.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    pieces = C.cut(C.documents(docs).select("doc_id", "text").mapInArrow(_pieces(definition, capacity, end_id), PIECE))
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / group_tokens))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(_pack(capacity, open_bins), PIECE + ", sequence_id bigint, offset bigint")
