"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a binary classifier over hashed byte trigrams (letters
only, A-Z lower-cased, anything else one space) weighs the languages with a 1 against those with a 0.
The classifiers are log-odds of smoothed trigram counts over all labelled training rows: counts are
summed per task, then per language, so what is shuffled and what reaches the driver is a table of
fixed size per language (256 KB); the model grows with the languages, not with the rows.  Decoding takes the codeword with the least loss over the bits, each bit's
loss weighted by how far apart it holds its two sides; a small gap to the next codeword is ambiguous.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows with a null
language are never learned from; a null doc_id is not held out; with no training row every text is
``und``; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fissure.llm import common as C

SLOTS = 1 << 15
FEW_BYTES = 1 << 20
SHARP = 4.0

# Bytes as the classifiers see them.
SEEN = np.full(256, 32, np.uint8)
SEEN[97:123] = SEEN[65:91] = np.arange(97, 123, dtype=np.uint8)
SEEN[128:] = np.arange(128, 256, dtype=np.uint8)


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """Whether crc32 of doc_id as text leaves ``rest``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == rest


def _slots(data: np.ndarray) -> np.ndarray:
    """Slot of the trigram that ends at each byte from the third on."""
    x = SEEN[data].astype(np.uint32)
    y = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
    y ^= y >> np.uint32(15)
    return y * np.uint32(0x2C1B3C6D) >> np.uint32(32 - 15)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for t in C.chunks(batches):
        langs = t.column("lang").to_pylist()
        for lo, hi in t.runs(FEW_BYTES):
            s = _slots(t.data[t.off[lo] : t.off[hi]]) if t.off[hi] - t.off[lo] > 2 else np.zeros(0, np.uint32)
            for i in range(lo, hi):
                a, b = t.off[i] - t.off[lo], t.off[i + 1] - t.off[lo] - 2
                if b > a:
                    mine = sums.setdefault(langs[i], np.zeros(SLOTS, np.int64))
                    mine += np.bincount(s[a:b], minlength=SLOTS)
    if sums:
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array(list(sums), pa.string()), "counts": pa.array([C.planes(v) for v in sums.values()], pa.binary())}
        )


def _total(table: pa.Table) -> pa.Table:
    total = np.zeros(SLOTS, np.int64)
    for b in table.column("counts"):
        total += C.unplanes(b.as_py(), np.int64)
    return pa.table({"lang": table.column("lang").slice(0, 1), "counts": pa.array([C.planes(total)], pa.binary())})


def codewords(n: int) -> np.ndarray:
    """n rows of bits: all splits up to 6 languages, else seeded random codes of 10 bits per log2(n) or more."""
    if n <= 1:
        return np.zeros((n, 0), np.int8)
    if n <= 6:
        bits = np.arange(1, 1 << (n - 1))
        return np.vstack([np.zeros(len(bits), np.int8), *(((bits >> j) & 1).astype(np.int8) for j in range(n - 1))])
    rng = np.random.default_rng(n)
    width = int(np.ceil(10 * np.log2(n)))
    best = max((rng.integers(0, 2, (n, width)).astype(np.int8) for _ in range(50)), key=lambda m: _apart(m))
    return best[:, (best.min(0) < best.max(0))]


def _apart(m: np.ndarray) -> int:
    """The least Hamming distance of two rows."""
    sign = m.astype(np.float32) * 2 - 1
    agree = sign @ sign.T
    np.fill_diagonal(agree, -np.inf)
    return int((m.shape[1] - agree.max()) / 2)


class LanguageModel:
    """Codewords and, per bit, a weight for each trigram slot."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * SLOTS)
        weights, side = [], []
        for b in range(self.code.shape[1]):
            one = self.code[:, b] == 1
            w = np.log(share[one].mean(0)) - np.log(share[~one].mean(0))
            mean = share @ w  # what a text of each language is expected to average
            middle = (mean[one].min() + mean[~one].max()) / 2
            spread = max(1e-6, (mean[one].min() - mean[~one].max()) / 2)
            weights.append((w - middle) / spread)
            side.append(spread)
        self.weights = np.array(weights, np.float32).reshape(-1, SLOTS)
        self.side = np.array(side) / max(sum(side), 1e-9) if side else np.zeros(0)

    def decode(self, margins: np.ndarray) -> np.ndarray:
        """Loss of each language for each row of bit margins."""
        zero, one = (np.logaddexp(0.0, SHARP * sign * margins) * self.side for sign in (1, -1))
        return zero @ (1.0 - self.code.T) + one @ self.code.T.astype(np.float64)


def fit_language_model(labelled: DataFrame) -> LanguageModel:
    """Learns from text and lang of all given rows with a language."""
    C.small_batches(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    sums = rows.mapInArrow(_counts, "lang string, counts binary").groupBy("lang").applyInArrow(_total, "lang string, counts binary")
    found = sorted((r["lang"], r["counts"]) for r in sums.collect())
    counts = np.array([C.unplanes(bytes(c), np.int64) for _, c in found], np.float64).reshape(-1, SLOTS)
    return LanguageModel([lang for lang, _ in found], counts)


def _has_letter(t: C.Texts) -> np.ndarray:
    low = C.lowered(t.data)
    seen = np.r_[0, np.cumsum((low >= 97) & (low <= 122))]
    out = np.diff(seen[t.off]) > 0
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in t.text(i).decode())
    return out


def _predict(model, ambiguous_gap: float, extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = np.array([*m.langs, "und"], object)
        for t in C.chunks(batches):
            parts = []
            for lo, hi in t.runs(FEW_BYTES):
                data, off = t.data[t.off[lo] : t.off[hi]], t.off[lo : hi + 1] - t.off[lo]
                s = _slots(data) if len(data) > 2 else np.zeros(0, np.uint32)
                count = np.maximum(np.diff(off) - 2, 0)
                some = np.flatnonzero(count)
                margins = np.zeros((hi - lo, len(m.side)))
                for b, w in enumerate(m.weights):
                    total = np.r_[0.0, np.cumsum(w[s], dtype=np.float64)]
                    margins[some, b] = (total[off[some] + count[some]] - total[off[some]]) / count[some]
                parts.append(m.decode(margins))
            loss = np.concatenate(parts)
            ok = _has_letter(t) & (len(m.langs) > 0)
            if len(m.langs):
                best = loss.argmin(1)
                ranked = np.sort(loss, axis=1)
                gap = ranked[:, 1] - ranked[:, 0] if loss.shape[1] > 1 else np.full(t.n, np.inf)
                p = np.exp(ranked[:, :1] - loss)
                score = np.where(ok, 1.0 / p.sum(1), 0.0)
            else:
                best, gap, score = np.zeros(t.n, int), np.zeros(t.n), np.zeros(t.n)
            picked = np.where(ok, best, len(m.langs))
            yield pa.RecordBatch.from_pydict(
                {c: t.column(c) for c in extra}
                | {
                    "lang_pred": pa.array(names[picked], pa.string()),
                    "score": pa.array(score, pa.float64()),
                    "ambiguous": pa.array(~ok | (gap < ambiguous_gap), pa.bool_()),
                }
            )

    return run


def predict_language(docs: DataFrame, model: LanguageModel, ambiguous_gap: float = 0.05) -> DataFrame:
    """The given rows with lang_pred, score (0 to 1) and ambiguous, which replace columns of these names."""
    docs = docs.drop("lang_pred", "score", "ambiguous")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size per language and bit
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = f"{schema}, lang_pred string, score double, ambiguous boolean"
    return docs.mapInArrow(_predict(shared, ambiguous_gap, docs.columns), out)


def identify_language(docs: DataFrame, ambiguous_gap: float = 0.05) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: learned from rows that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 3, 1).alias("held_out"), "text")
    model = fit_language_model(docs.where(~held_out(F.col("doc_id"), 3, 1)).select("lang", "text"))
    return predict_language(rows, model, ambiguous_gap).drop("text")


def drop_unidentified(docs: DataFrame, ambiguous_gap: float = 0.05) -> DataFrame:
    """The rows of ``docs`` whose language is told without ambiguity, as they are."""
    model = fit_language_model(docs.where(~held_out(F.col("doc_id"), 3, 1)).select("lang", "text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    predict = _predict(shared, ambiguous_gap, [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unclear = [p.column("ambiguous") for p in predict(iter([batch]))]
            if unclear:
                yield batch.filter(pa.compute.invert(pa.chunked_array(unclear).combine_chunks()))

    return docs.mapInArrow(run, docs.schema)
