"""Toxicity by weak supervision.

1. *Voters.*  Over a bounded sample of labelled rows, counts of documents with each word and each word
   beginning (4 to 6 bytes), by label, give the terms that speak for label 1.  They are dealt to
   ``N_LEXICONS`` lexicon voters by hash; pattern voters look at the form of a text (shouting, marks,
   repeated signs, density of terms, terms among the first words).  A voter says 1, 0 or abstains.
2. *Label model.*  A generative model of the votes with a latent label is fitted to them alone by
   expectation maximization (labels only give its prior and tell its two sides apart).  Each voter has an
   accuracy table given the label.  The strongest dependencies that remain given the label form a forest,
   and each of its pairs gets a factor: a voter's table then also depends on its neighbour's vote, and all
   tables are fitted together.  A copy says nothing new once its neighbour is known.
3. *Classifier.*  Logistic regression over the terms is trained on the posterior labels and scores
   every text.

Labels are read for rows that are not held out only; source, lang and ids are never inputs.  What is
gathered is bounded: ``max_per_label`` labelled rows of each label, chosen by hash, and the terms among
these rows' words that pass the tests.

Defined cases: a null or empty text scores as one without any term; a null label is unknown; a null
doc_id is not held out and has no label; several labels for one doc_id count as their maximum; with no
labelled row of either label every score is the prior (0 without any); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fissure.llm import common as C
from fissure.llm.language_id import held_out
from fissure.llm.parity_join import shingle_sets

N_LEXICONS = 12
BEGINNINGS = (4, 5, 6)
MAX_PER_LABEL = 6000
THRESHOLD = 0.3
N_HASHES = 4
MIN_ODDS = 3.0  # log-odds: a term speaks for label 1 about 20 times as often as against it
OPENING = 50
DEPENDENT = 0.2  # correlation given the label from which a pair of voters gets a factor


def _letters(data: np.ndarray) -> np.ndarray:
    low = C.lowered(data)
    return np.where(((low >= 97) & (low <= 122)) | (low >= 128), low, np.uint8(32))


def terms(t: C.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and word beginnings in a chunk, with each one's document, in text order."""
    data = _letters(t.data)
    starts, ends, first = C.word_spans(data, t.off)
    doc = np.repeat(np.arange(t.n), np.diff(first))
    hs, ds = [C.span_hashes(data, starts, ends)], [doc]
    for k in BEGINNINGS:
        long = ends - starts >= k
        hs.append(C.span_hashes(data, starts[long], starts[long] + k, k))
        ds.append(doc[long])
    return np.concatenate(hs), np.concatenate(ds)


def _least_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least hashes of a text's 3-word shingles under ``N_HASHES`` hash functions."""
    for t in C.chunks(batches):
        h, first = shingle_sets(t, 3)
        some = np.flatnonzero(np.diff(first))
        out = {"rid": t.column("rid"), "toxic": t.column("toxic")}
        for k in range(N_HASHES):
            least = C.mix(t.ids().astype(C.U64))
            if len(some):
                least[some] = np.minimum.reduceat(C.mix(h + C.U64(k + 1)), first[:-1][some])
            out[f"m{k}"] = pa.array(least.view(np.int64))
        yield pa.RecordBatch.from_pydict(out)


def _without_copies(rows: DataFrame) -> list[tuple[int, int]]:
    """(rid, toxic) of the sample's rows, one of each group of near copies: copies would make any word
    of theirs look like a sign of their label."""
    found = rows.mapInArrow(_least_shingles, "rid bigint, toxic int, " + ", ".join(f"m{k} bigint" for k in range(N_HASHES)))
    table = np.array([tuple(r) for r in found.distinct().collect()], np.int64).reshape(-1, 2 + N_HASHES)
    table = table[np.argsort(table[:, 0], kind="stable")]
    keep = np.ones(len(table), bool)
    for k in range(2, 2 + N_HASHES):
        first = np.zeros(len(table), bool)
        first[np.unique(table[:, k], return_index=True)[1]] = True
        keep &= first
    return [(int(r[0]), int(r[1])) for r in table[keep]]


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: terms and the numbers of documents of each label that hold them."""
    hs, ys = [], []
    for t in C.chunks(batches):
        label = t.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        h, d = terms(t)
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        hs.append(h[new])
        ys.append(label[d[new]])
    if hs:
        h, y = np.concatenate(hs), np.concatenate(ys)
        keys, at = np.unique(h, return_inverse=True)
        ones = np.bincount(at, weights=y, minlength=len(keys)).astype(np.int64)
        zeros = np.bincount(at, weights=1 - y, minlength=len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"h": pa.array(keys.view(np.int64)), "ones": pa.array(ones), "zeros": pa.array(zeros)})


def _telling_terms(rows: DataFrame, totals: tuple[int, int], min_odds: float) -> DataFrame:
    """(h, odds): terms that speak for label 1, by their counts of documents of each label."""
    counts = rows.mapInArrow(_document_counts, "h bigint, ones bigint, zeros bigint").groupBy("h")
    counts = C.cut(counts.agg(F.sum("ones").alias("a"), F.sum("zeros").alias("b")))
    odds = F.log((F.col("a") + 0.05) / (totals[1] + 1)) - F.log((F.col("b") + 0.05) / (totals[0] + 1))
    share = totals[1] / (totals[0] + totals[1])  # what chance gives label 1; G tests against it, about one term passing by chance
    both = F.col("a") + F.col("b")
    g = sum(2 * F.col(c) * F.log(F.greatest(F.col(c), F.lit(1e-9)) / (both * p)) for c, p in (("a", share), ("b", 1 - share)))
    least = 2 * float(np.log(max(1, counts.count())))
    return counts.where((g >= least) & (odds > min_odds)).select("h", odds.alias("odds"))


class Terms:
    """Known terms: sorted hashes and their log-odds."""

    def __init__(self, hashes: np.ndarray, odds: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.odds = hashes[order], odds[order]

    def __len__(self) -> int:
        return len(self.hashes)


def _found(t: C.Texts, known: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, term) pairs of a chunk, and each document's count of matches in all and in its opening.

    A word counts as one term, of those that it has the one with the highest odds: a beginning that many
    forms share stands for all of them.
    """
    data = _letters(t.data)
    starts, ends, first = C.word_spans(data, t.off)
    doc = np.repeat(np.arange(t.n), np.diff(first))
    if not len(known) or not len(doc):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(t.n, np.int64),) * 2
    best, best_odds = np.zeros(len(starts), np.int64), np.full(len(starts), -np.inf)
    for k in (*BEGINNINGS, 0):
        at = np.flatnonzero(ends - starts >= k) if k else np.arange(len(starts))
        h = C.span_hashes(data, starts[at], starts[at] + k, k) if k else C.span_hashes(data, starts, ends)
        i = np.minimum(np.searchsorted(known.hashes, h), len(known) - 1)
        better = (known.hashes[i] == h) & (known.odds[i] > best_odds[at])
        best[at[better]], best_odds[at[better]] = i[better], known.odds[i[better]]
    hit = np.isfinite(best_odds)
    pair = np.unique(doc[hit] * len(known) + best[hit])
    opening = hit & (np.arange(len(doc)) - first[doc] < OPENING)
    return pair // len(known), pair % len(known), *(np.bincount(doc[x], minlength=t.n) for x in (hit, opening))


PATTERNS = ("terms_3", "density", "first_words", "marks", "shouting", "doubled_signs")


def votes(t: C.Texts, known: Terms, found: tuple[np.ndarray, ...]) -> np.ndarray:
    """Votes of all voters on each document of a chunk: 1, 0, or -1 to abstain."""
    doc, term, count, opening = found
    n_words = np.maximum(1, np.diff(t.words()[2]))
    out = np.full((t.n, N_LEXICONS + len(PATTERNS)), -1, np.int8)
    any_term = np.bincount(doc, minlength=t.n)
    lexicon = (known.hashes[term] >> C.U64(17)) % C.U64(N_LEXICONS)
    out[doc, lexicon.astype(np.int64)] = 1
    out[:, N_LEXICONS] = np.where(any_term >= 3, 1, np.where(any_term == 0, 0, -1))
    rate = count / n_words
    out[:, N_LEXICONS + 1] = np.where(rate > 0.01, 1, np.where(rate == 0, 0, -1))
    out[:, N_LEXICONS + 2] = np.where(opening > 0, 1, np.where(n_words > OPENING, 0, -1))
    ones = [np.r_[0, np.cumsum(m)] for m in ((t.data == 33) | (t.data == 63), (t.data >= 65) & (t.data <= 90))]
    size = np.maximum(1, np.diff(t.off))
    marks, upper = (np.diff(o[t.off]) / size for o in ones)
    out[:, N_LEXICONS + 3] = np.where(marks > 0.01, 1, -1)
    out[:, N_LEXICONS + 4] = np.where(upper > 0.2, 1, -1)
    twice = np.r_[False, (t.data[1:] == t.data[:-1]) & ((t.data[1:] == 33) | (t.data[1:] == 42))] if len(t.data) else np.zeros(0, bool)
    out[:, N_LEXICONS + 5] = np.where(np.diff(np.r_[0, np.cumsum(twice)][t.off]) > 0, 1, -1)
    return out


def _sample_votes(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.chunks(batches):
            found = _found(t, known)
            v = votes(t, known, found)
            doc, term, *_ = found
            cut = np.searchsorted(doc, np.arange(t.n + 1))
            term = term.astype(np.uint32)
            yield pa.RecordBatch.from_pydict(
                {
                    "toxic": t.column("toxic").cast(pa.int32()),
                    "votes": pa.array([x.tobytes() for x in v], pa.binary()),
                    "terms": pa.array([term[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                }
            )

    return run


def _forest(weight: np.ndarray, least: float) -> list[tuple[int, int]]:
    """(voter, parent) in an order in which parents come first; a voter without a dependency has parent -1.

    The pairs form a spanning forest of the greatest weights over ``least``.
    """
    m, out, free = len(weight), [], set(range(len(weight)))
    while free:
        gain = [(weight[j, k], -j, -k) for j in free for k, _ in out if weight[j, k] > least]
        if gain:
            _, j, k = max(gain)
            out.append((-j, -k))
        else:
            out.append((min(free, key=lambda j: (-np.sort(weight[j])[-2:].sum(), j)) if m > 1 else 0, -1))
        free.discard(out[-1][0])
    return out


def label_model(v: np.ndarray, prior: float, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Posterior of label 1 for each row of votes, vote tables (label, voter, vote), correlations given the
    label, and the (voter, parent) pairs that have a factor of their own.

    Starts from the voters' own majority and never sees labels but the prior.  The first half of the rounds
    takes voters as independent given the label; then the forest of dependencies is chosen, and tables of each
    voter given the label and its parent's vote are fitted together.
    """
    n, m = v.shape
    shown = np.stack([v == -1, v == 0, v == 1], 2).astype(np.float64)
    raw = (v == 1).astype(float) - (v == 0)
    raw = (raw - raw.mean(0)) / (raw.std(0) + 1e-9)
    copies = 1.0 / (np.abs(raw.T @ raw / max(1, n)) > 0.8).sum(1).clip(1)  # where it starts, voters that say the same count once
    said = ((v == 1) * copies).sum(1) - ((v == 0) * copies).sum(1)
    q = np.clip(np.where(said > 0, 0.95, prior / 10), 1e-4, 1 - 1e-4)
    corr, pairs = np.eye(m), []
    for step in range(rounds):
        sides = (1 - q, q)
        tables = np.stack([(w[:, None, None] * shown).sum(0) + 0.5 for w in sides])
        tables /= tables.sum(2, keepdims=True)
        if step == rounds // 2:  # the two sides have settled
            mean = sum(w[:, None] * (t[:, 2] - t[:, 1]) for w, t in zip(sides, tables))
            rest = (v == 1).astype(float) - (v == 0) - mean
            rest /= np.sqrt((rest**2).mean(0)) + 1e-9
            corr = rest.T @ rest / n
            pairs = _forest(np.abs(corr) * (1 - np.eye(m)), DEPENDENT)
        odds = np.full(n, np.log(prior / (1 - prior)))
        for j, k in pairs or [(j, -1) for j in range(m)]:
            given = shown[:, k] if k >= 0 else np.ones((n, 1))
            log = []
            for w in sides:
                joint = (w[:, None] * given).T @ shown[:, j] + 0.5
                log.append((given @ np.log(joint / joint.sum(1, keepdims=True)) * shown[:, j]).sum(1))
            share = copies[j] if not pairs else 1.0
            odds += (log[1] - log[0]) * share
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if step > rounds // 2 and np.abs(new - q).max() < 1e-6:
            break
        q = new
    return q, tables, corr, [(j, k) for j, k in pairs if k >= 0]


def logistic(rows: list[np.ndarray], target: np.ndarray, weight: np.ndarray, n: int, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression over sparse 0/1 rows, by accelerated gradient steps."""
    count = np.array([len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), count)
    w, b = np.zeros(n), 0.0
    sq = np.ones(n + 1) * 1e-6
    for _ in range(400):
        z = b + np.bincount(row, weights=w[col], minlength=len(rows))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
        grad = np.bincount(col, weights=g[row], minlength=n) + ridge * w
        sq[:n] += grad**2
        sq[n] += g.sum() ** 2
        w -= 0.5 * grad / np.sqrt(sq[:n])
        b -= 0.5 * g.sum() / np.sqrt(sq[n])
    return w, b


class ToxicityModel:
    def __init__(self, known: Terms, weights: np.ndarray, intercept: float):
        self.known, self.weights, self.intercept = known, weights, intercept


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_per_label: int = MAX_PER_LABEL, min_odds: float = MIN_ODDS) -> ToxicityModel:
    """Fits on at most ``max_per_label`` rows of each label, those with the least hashes of doc_id.

    ``docs`` and ``labels`` must hold rows that may be learned from only.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("rid"))
    known = known.agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return ToxicityModel(Terms(np.zeros(0, C.U64), np.zeros(0)), np.zeros(0), 30.0 if n1 else -30.0)
    pick = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("rid"), "rid").limit(max_per_label) for y in (0, 1)]
    sample = C.cut(pick[0].unionAll(pick[1]))  # at most 2 * max_per_label pairs of integers, broadcast
    texts = C.documents(docs).select("rid", "text")
    single = _without_copies(texts.join(F.broadcast(sample), "rid"))
    sample = docs.sparkSession.createDataFrame(single, "rid bigint, toxic int")
    rows = texts.join(F.broadcast(sample), "rid").select("text", "toxic")
    used = (sum(y == 0 for _, y in single), sum(y == 1 for _, y in single))
    if not min(used):
        return ToxicityModel(Terms(np.zeros(0, C.U64), np.zeros(0)), np.zeros(0), float(np.log((n1 + 0.5) / (n0 + 0.5))))
    found = _telling_terms(rows, used, min_odds).collect()
    terms_ = Terms(np.array([r["h"] for r in found], np.int64).view(C.U64), np.array([r["odds"] for r in found], np.float64))
    for last in (False, True):
        seen = rows.mapInArrow(_sample_votes(terms_), "toxic int, votes binary, terms binary").collect()
        v = np.array([np.frombuffer(bytes(r["votes"]), np.int8) for r in seen])
        y = np.array([r["toxic"] for r in seen])
        sparse = [np.frombuffer(bytes(r["terms"]), np.uint32) for r in seen]
        if last or not len(seen):
            break
        # Where a word has several terms only one counts; terms that speak for label 1 no more go.
        col = np.concatenate(sparse)
        a, b = (np.bincount(col, weights=np.repeat(y == k, [len(x) for x in sparse]), minlength=len(terms_)) for k in (1, 0))
        keep = np.log((a + 0.05) / (used[1] + 1)) - np.log((b + 0.05) / (used[0] + 1)) > min_odds
        keep &= a > 0
        if keep.all():
            break
        terms_ = Terms(terms_.hashes[keep], terms_.odds[keep])
    if not len(seen) or y.min() == y.max():
        return ToxicityModel(Terms(np.zeros(0, C.U64), np.zeros(0)), np.zeros(0), float(np.log((n1 + 0.5) / (n0 + 0.5))))
    q, *_ = label_model(v, float(np.clip(y.mean(), 0.01, 0.99)))
    if q[y == 1].mean() < q[y == 0].mean():
        q = 1 - q
    # The sample holds the labels in other shares than the rows it stands for.
    weight = np.where(y == 1, n1 / max(1, (y == 1).sum()), n0 / max(1, (y == 0).sum()))
    weight = weight / weight.mean()
    w, b = logistic(sparse, q, weight, len(terms_))
    return ToxicityModel(terms_, w, b)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for t in C.chunks(batches):
            doc, term, *_ = _found(t, m.known)
            z = m.intercept + np.bincount(doc, weights=m.weights[term], minlength=t.n)
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": t.column("doc_id"),
                    "held_out": t.column("held_out"),
                    "score": pa.array(score, pa.float64()),
                    "predicted": pa.array((score >= THRESHOLD).astype(np.int32), pa.int32()),
                }
            )

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, max_per_label: int = MAX_PER_LABEL) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= 0.3) of every text."""
    rest = held_out(F.col("doc_id"), 4, 2)
    model = fit_toxicity(docs.where(~rest).select("doc_id", "text"), labels.where(~rest).select("doc_id", "toxic"), max_per_label)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # hashes and weights of terms of the sample
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), rest.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(shared), "doc_id bigint, held_out boolean, score double, predicted int")
