"""Benchmark decontamination: BM25 over test items, block-max WAND, overlap check.

The inverted index holds the test items.  Each item's BM25 weights are divided by its score for its own
text, so a passage's score says how much of the item it holds and one threshold suits all items.
Every document is cut into overlapping passages of twice the longest item's words; each passage is a
query.  Evaluation is vectorised over the passages of a chunk:

* WAND: an item's essential terms are the rarest that together weigh ``MARGIN`` more than what may be
  missing; a passage can reach the threshold only if it holds that margin of them.  Other terms are
  looked up for passages that do.
* Block-max: items lie in blocks of ``BLOCK`` neighbours with the largest weight of each term; a
  passage's bound for a block discards it before any item is scored.
* All items above the threshold are then verified: 5-word shingles of the whole item (``min_overlap``)
  and of its question and its answer (``min_part``; 2-word shingles where these have fewer than 10 words, so
  that one changed word leaves enough of them).  An item's last sentence of 5 or more words is its answer,
  else its last quarter.

The index is built and broadcast in parts of at most ``MAX_INDEX_BYTES`` of item text, one at a time; a
larger benchmark takes several passes over the documents.  Document frequencies, the number of items, their
mean length and the passages' length come from the whole benchmark, so parts change no score.

Defined cases: null or empty texts and items match nothing; items of fewer than 5 words are one
shingle; null ids stay null, and item ids keep their type; rows that repeat are reported as often; other columns are ignored; an
empty table or benchmark gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fissure.llm import common as C

BLOCK = 8
MARGIN = 0.3
MAX_INDEX_BYTES = 16 << 20
K1, B = 1.2, 0.75
SHINGLE = 5
KEEP = np.full(256, 32, np.uint8)
KEEP[97:123] = KEEP[65:91] = np.arange(97, 123, dtype=np.uint8)
KEEP[48:58] = np.arange(48, 58, dtype=np.uint8)
KEEP[128:] = np.arange(128, 256, dtype=np.uint8)


def _hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words without signs, and each text's first."""
    plain = KEEP[data]
    starts, ends, first = C.word_spans(plain, off)
    return C.span_hashes(plain, starts, ends), first


def _bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)


def _part(wh: np.ndarray, k: int) -> tuple[int, np.ndarray]:
    """Distinct shingles of k words, fewer if there are not as many."""
    k = min(k, len(wh))
    return k, np.unique(C.windows(wh, k))


def _answer_words(text: str, n_words: int) -> int:
    """Words of the answer: the last sentence if it has 5 or more and leaves a question, else a quarter."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]
    if len(parts) > 1:
        last = len(_hashes(*_bytes([parts[-1]]))[0])
        if SHINGLE <= last <= n_words - SHINGLE:
            return last
    return max(1, n_words // 4)


class Rows:
    """Sparse rows of (term, weight)."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.size = np.array([len(t) for t, _ in rows], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.term = np.concatenate([t for t, _ in rows])
        self.weight = np.concatenate([w for _, w in rows])

    def score(self, passage: np.ndarray, row: np.ndarray, held: np.ndarray, n_terms: int) -> np.ndarray:
        """Weight of a row's terms that its passage holds; ``held`` has sorted passage * n_terms + term."""
        at = C.ragged(self.start[row], self.size[row])
        key = np.repeat(passage, self.size[row]) * n_terms + self.term[at]
        found = np.searchsorted(held, key)
        w = np.where(held[np.minimum(found, len(held) - 1)] == key, self.weight[at], 0.0)
        return np.add.reduceat(w, np.cumsum(self.size[row]) - self.size[row])


class Index:
    """A part of the benchmark; ``terms`` (ascending) and ``df`` are its terms' document frequencies among all
    ``n_items`` items, of ``mean`` words on average and ``longest`` at most."""

    def __init__(self, ids: list, texts: list[str], threshold: float, terms: np.ndarray, df: np.ndarray, n_items: int, mean: float, longest: int):
        wh, first = _hashes(*_bytes(texts))
        keep = [i for i in range(len(texts)) if first[i + 1] > first[i]]
        self.ids = [ids[i] for i in keep]
        words = [wh[first[i] : first[i + 1]] for i in keep]
        self.threshold, self.longest, self.terms, n = threshold, longest, terms, len(words)
        tf = [np.unique(np.searchsorted(self.terms, w), return_counts=True) for w in words]
        idf = np.log(1 + (n_items - df + 0.5) / (df + 0.5))
        rows = []
        for (t, f), w in zip(tf, words):
            x = idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean))
            rows.append((t, x / x.sum()))
        self.items = Rows(rows) if rows else None
        blocks = []
        for lo in range(0, n, BLOCK):
            t = np.concatenate([r[0] for r in rows[lo : lo + BLOCK]])
            x = np.concatenate([r[1] for r in rows[lo : lo + BLOCK]])
            order = np.lexsort((-x, t))
            head = C.group_bounds(t[order])
            blocks.append((t[order][head], x[order][head]))
        self.blocks = Rows(blocks) if blocks else None
        post_term, post_item, post_weight, self.least = [], [], [], np.zeros(n)
        for i, (t, x) in enumerate(rows):
            order = np.argsort(-x, kind="stable")
            need = min(len(t), int(np.searchsorted(np.cumsum(x[order]), min(1.0, 1 - threshold + MARGIN))) + 1)
            mine = order[:need]
            self.least[i] = threshold - (1 - x[mine].sum()) - 1e-9
            post_term.append(t[mine])
            post_item.append(np.full(need, i))
            post_weight.append(x[mine])
        if rows:
            pt = np.concatenate(post_term)
            order = np.argsort(pt, kind="stable")
            self.post_item, self.post_weight = np.concatenate(post_item)[order], np.concatenate(post_weight)[order]
            self.post_start = np.searchsorted(pt[order], np.arange(len(self.terms) + 1))
            self.essential = np.diff(self.post_start) > 0
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.terms & C.U64(0xFFFF)).astype(np.int64)] = True
        self.parts = []
        for i, w in zip(keep, words):
            a = _answer_words(texts[i], len(w))
            k = [SHINGLE if m >= 2 * SHINGLE else 2 for m in (len(w) - a, a)]
            self.parts.append((_part(w, SHINGLE), _part(w[: len(w) - a], k[0]) if a < len(w) else None, _part(w[-a:], k[1])))

    def retrieve(self, wh: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, passage start, item, score) of all passages and items at or above the threshold."""
        none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
        at = np.flatnonzero(self.maybe[(wh & C.U64(0xFFFF)).astype(np.int64)])
        term = np.searchsorted(self.terms, wh[at])
        term[term == len(self.terms)] = 0
        hit = self.terms[term] == wh[at]
        at, term = at[hit], term[hit].astype(np.int64)
        if not len(at):
            return none
        # Passages of 2 * longest words, each half a passage on: word j of a document lies in two.
        halves = np.diff(first) // self.longest + 1
        base = np.cumsum(halves) - halves  # half-passages are numbered through
        doc = np.repeat(np.arange(len(halves)), np.diff(first))[at]
        slot = base[doc] + (at - first[doc]) // self.longest
        later = slot > base[doc]
        nt, n_items = len(self.terms), len(self.ids)

        def pairs(use: np.ndarray) -> np.ndarray:
            more = use & later
            return np.unique(np.r_[slot[use] * nt + term[use], (slot[more] - 1) * nt + term[more]])

        held = pairs(self.essential[term])
        passage, t = held // nt, held % nt
        count = self.post_start[t + 1] - self.post_start[t]
        posts = C.ragged(self.post_start[t], count)
        key = np.repeat(passage, count) * n_items + self.post_item[posts]
        order = np.argsort(key)
        key = key[order]
        head = C.group_bounds(key)
        if not len(head):
            return none
        pair = key[head]
        pair = pair[np.add.reduceat(self.post_weight[posts][order], head) >= self.least[pair % n_items]]
        passage, item = pair // n_items, pair % n_items
        if not len(pair):
            return none
        wanted = np.zeros(int(slot.max()) + 2, bool)
        wanted[passage] = True
        held = pairs(wanted[slot] | (later & wanted[slot - 1]))
        n_blocks = len(self.blocks.size)
        blocks, of = np.unique(passage * n_blocks + item // BLOCK, return_inverse=True)
        bound = self.blocks.score(blocks // n_blocks, blocks % n_blocks, held, nt)[of]
        live = bound >= self.threshold - 1e-9
        passage, item = passage[live], item[live]
        if not len(passage):
            return none
        score = self.items.score(passage, item, held, nt)
        live = score >= self.threshold - 1e-9
        passage, item, score = passage[live], item[live], score[live]
        doc = np.searchsorted(base, passage, "right") - 1
        return doc, (passage - base[doc]) * self.longest, item, score

    def matches(self, t: C.Texts, min_overlap: float, min_part: float) -> list[tuple]:
        """(document, item, score, overlap, question overlap, answer overlap, word), one per pair."""
        wh, first = _hashes(t.data, t.off)
        best: dict[tuple[int, int], tuple] = {}
        for d, start, i, score in zip(*(x.tolist() for x in self.retrieve(wh, first))):
            words = wh[first[d] + start : min(first[d] + start + 2 * self.longest, first[d + 1])]
            whole, question, answer = (self._share(p, words) for p in self.parts[i])
            if whole >= min_overlap and question >= min_part and answer >= min_part:
                row = (score, whole, question, answer, -start)
                best[d, i] = max(best.get((d, i), row), row)
        return [(d, i, *row[:4], -row[4]) for (d, i), row in sorted(best.items())]

    @staticmethod
    def _share(part: tuple[int, np.ndarray] | None, words: np.ndarray) -> float:
        return 1.0 if part is None else float(np.isin(part[1], C.windows(words, part[0])).mean())


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each item with a word: its part, its number of words and its distinct terms."""
    for t in C.chunks(batches):
        wh, first = _hashes(t.data, t.off)
        some = np.flatnonzero(np.diff(first))
        found = [np.unique(wh[first[i] : first[i + 1]]).view(np.int64) for i in some]
        yield pa.RecordBatch.from_pydict(
            {
                "part": t.column("part").take(pa.array(some, pa.int64())),
                "n_words": pa.array(np.diff(first)[some], pa.int64()),
                "terms": pa.array([x.tolist() for x in found], pa.list_(pa.int64())),
            }
        )


def _indexes(benchmark: DataFrame, threshold: float) -> Iterator[Index]:
    """One part of the index after the other."""
    C.small_batches(benchmark.sparkSession)
    items = benchmark.where("text is not null and text <> ''").select("item_id", F.col("text").cast("string").alias("text"))
    parts = C.buckets(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0, MAX_INDEX_BYTES // 2)
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    found = items.select("part", "text").mapInArrow(_item_terms, "part bigint, n_words bigint, terms array<bigint>")
    n_items, mean, longest = found.agg(F.count("*"), F.avg("n_words"), F.max("n_words")).first()
    if not n_items:
        return
    held = C.cut(found.select("part", F.explode("terms").alias("term")).groupBy("part", "term").agg(F.count("*").alias("n")))
    everywhere = held.groupBy("term").agg(F.sum("n").alias("df"))
    held = C.cut(held.join(everywhere, "term").select("part", "term", "df")) if parts > 1 else held.withColumnRenamed("n", "df")
    for k in range(parts):
        rows = items.where(F.col("part") == k).orderBy("item_id", "text").collect()
        known = held.where(F.col("part") == k).select("term", "df").toArrow()
        term, df = known.column("term").to_numpy().view(C.U64), known.column("df").to_numpy()
        order = np.argsort(term)
        index = Index([r["item_id"] for r in rows], [r["text"] for r in rows], threshold, term[order], df[order], n_items, mean, longest)
        if index.ids:
            yield index


def contamination(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, min_overlap: float = 0.8, min_part: float = 0.5
) -> DataFrame:
    """doc_id, item_id, score, overlap, question_overlap, answer_overlap, word (start of the passage):
    the best passage of each document for each item that it holds."""
    spark = docs.sparkSession
    item_type = benchmark.schema["item_id"].dataType
    schema = f"doc_id bigint, item_id {item_type.simpleString()}, score double, overlap double, question_overlap double, answer_overlap double, word bigint"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], schema)
    for index in _indexes(benchmark, threshold):
        shared = spark.sparkContext.broadcast(index)  # at most MAX_INDEX_BYTES of text

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ix = shared.value
            for t in C.chunks(batches):
                found = ix.matches(t, min_overlap, min_part)
                if found:
                    doc, item, *rest = zip(*found)
                    columns = [t.column("doc_id").take(pa.array(doc)), pa.array([ix.ids[i] for i in item], to_arrow_type(item_type))]
                    columns += [pa.array(x, pa.float64()) for x in rest[:4]] + [pa.array(rest[4], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, min_overlap: float = 0.8, min_part: float = 0.5
) -> DataFrame:
    """The rows of ``docs`` that hold no test item, as they are."""
    for index in _indexes(benchmark, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for t in C.chunks(batches):
                clean = np.ones(t.n, bool)
                clean[[m[0] for m in shared.value.matches(t, min_overlap, min_part)]] = False
                yield t.batch.slice(t.lo, t.n).filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
