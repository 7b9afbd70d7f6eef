"""Exact n-gram Jaccard join with parity sketches.

A document's distinct word shingles are dealt by hash to the k blocks of a sketch; a block is the XOR
of its shingles' 64-bit codes, so each shingle flips parity bits of one block only.  Two sets whose
symmetric difference is d differ in at most d blocks.  A finer sketch gives each shingle one parity bit of
a few thousand; its Hamming distance is a lower bound too, and nearly equal to d.  Sets are joined per size
band: in a band the threshold allows at most D differing shingles, so
with k = D + 1 + e blocks at least e + 1 agree (pigeonhole).  A block with very few shingles is a weak
key and is left out, unless a set has more than e of these: then it sends them all.

Candidates are verified exactly, in three rounds.  First each document meets the least document that it
shares a block with; groups of near copies fall together at the cost of one pair per document.  Then
blocks that still hold documents of different groups compare the Hamming distances of their fine
sketches and give a forest of pairs that would join these groups; last, what still lies apart there
gives every pair that the distance allows.  Equal sets are one node throughout.  No link is lost and no
group is expanded into all its pairs.

Defined cases: a null or empty text has no shingles, links with nothing and is its own component; fewer words than a shingle
has are one shingle; rows that share a doc_id are one document with several texts; null doc_ids are
one document as well, the largest (as is 2**63 - 1, if there is such an id); ids stay as they are; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fissure.llm import common as C
from fissure.llm.components import components

BUCKET_BYTES = 6 << 20
GATHER_BYTES = 8 << 20  # of text whose keys are packed together
BAND = 1.25
BROADCAST_IDS = 250_000  # 2 MB
HOT_ROWS = 1000  # rows with one set from which on its least id is broadcast
PAIRS = 256  # pairs verified at a time
PAIRS_A_TASK = 1000
OPEN_ROWS = 10_000  # entries of blocks with several groups that are compared in one task


def _shingles(wh: np.ndarray, first: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a chunk, and each one's document; fewer words are one shingle."""
    count = np.diff(first)
    doc, h = [], []
    for n in range(1, words + 1):
        mine = np.flatnonzero(count >= words if n == words else count == n)
        if len(mine):
            each = count[mine] - n + 1
            doc.append(np.repeat(mine, each))
            hashes = C.windows(wh, n)[C.ragged(first[:-1][mine], each)]
            h.append(hashes if n == words else C.mix(hashes + C.U64(n)))
    if not h:
        return np.zeros(0, C.U64), np.zeros(0, C.U64)
    return np.concatenate(h), np.concatenate(doc).astype(C.U64)


def shingle_sets(t: C.Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each document, and where each document's begin."""
    h, doc = _shingles(*t.word_hashes(C.lowered(t.data)), words)
    bits = max(1, int(t.n).bit_length())
    key = (doc << C.U64(64 - bits)) | (h >> C.U64(bits))
    order = np.argsort(key, kind="stable")
    key = key[order]
    keep = np.ones(len(key), bool)
    keep[1:] = key[1:] != key[:-1]
    order = order[keep]
    return h[order], np.searchsorted(doc[order], np.arange(t.n + 1, dtype=C.U64))


def _set_keys(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that stand for a whole set."""
    out = []
    for salt in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        total = np.zeros(len(h) + 1, C.U64)
        np.cumsum(C.mix(h ^ C.U64(salt)), out=total[1:])
        out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return out[0], out[1]


class Bands:
    """Size bands and the blocks of a sketch in each, for a threshold num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.weak = 2 if 100 * num >= 85 * den else 1
        self.lows, self.blocks, self.spare = [-(-num // (den - num))], [], []
        self._add()

    def _add(self) -> None:
        low = self.lows[-1]
        high = max(low + 1, int(low * BAND))
        d = (self.den - self.num) * (high - 1) // self.num
        e = 1
        for _ in range(20):  # a fixed point: e of k blocks are weak, with 3 deviations to spare
            lam = low / (d + 1 + e)
            p = np.exp(-lam) * (1 + lam if self.weak == 2 else 1)
            k = d + 1 + e
            e = int(np.ceil(k * p + 3 * np.sqrt(k * p)))
            e = min(e, 2 * (d + 1))
        self.lows.append(high)
        self.blocks.append(d + 1 + e)
        self.spare.append(e)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        """Band of each size; -1 where only equal sets link."""
        while len(sizes) and self.lows[-1] <= sizes.max():
            self._add()
        return np.searchsorted(self.lows, sizes, "right") - 1


def fine_sketch(h: np.ndarray) -> bytes:
    """Parity bits of a set, 4 or more per shingle; their number is a power of two, so that the longer of
    two sketches folds to the length of the other."""
    bits = 256
    while bits < 4 * len(h):
        bits *= 2
    flips = np.bincount((C.mix(h) & C.U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    words = [np.frombuffer(x, C.U64) for x in sketches]
    size = min(map(len, words))
    return np.stack([np.bitwise_xor.reduce(w.reshape(-1, size), axis=0) for w in words])


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.chunks(batches):
            h, first = shingle_sets(t, words)
            a, b = _set_keys(h, first)
            yield pa.RecordBatch.from_pydict(
                {
                    "rid": t.column("rid"),
                    "doc_id": t.column("doc_id"),
                    "n": pa.array(np.diff(first), pa.int64()),
                    "s1": pa.array(a),
                    "s2": pa.array(b),
                }
            )

    return run


def _fines(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.chunks(batches):
            h, first = shingle_sets(t, words)
            fine = [fine_sketch(h[x:y]) for x, y in zip(first, first[1:])]
            yield pa.RecordBatch.from_pydict(
                {"rid": t.column("rid"), "n": pa.array(np.diff(first), pa.int64()), "fine": pa.array(fine, pa.binary())}
            )

    return run


def _blocks(words: int, num: int, den: int, n_buckets: int):
    def entries(batches: Iterator[pa.RecordBatch]):
        bands = Bands(num, den)
        for t in C.chunks(batches):
            h, first = shingle_sets(t, words)
            sizes = np.diff(first)
            ids = t.ids()
            a, b = _set_keys(h, first)
            order = np.lexsort((ids, b, a))  # of equal sets in the chunk the least id goes on
            once = np.ones(t.n, bool)
            once[order[1:]] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
            band = bands.of(sizes)
            highs = np.array(bands.lows[1:])
            keys, docs = [], []
            for down in (0, 1):
                j = band - down
                use = once & (j >= 0)
                if down:  # also with the band below, if the largest set there can link with this one
                    use &= den * (highs[np.maximum(j, 0)] - 1) >= num * sizes
                doc = np.flatnonzero(use)
                if not len(doc):
                    continue
                j = j[doc]
                k = np.array(bands.blocks)[j]
                base = np.cumsum(k) - k
                at = C.ragged(first[:-1][doc], sizes[doc])
                of = np.repeat(np.arange(len(doc)), sizes[doc])
                block = (((h[at] >> C.U64(32)) * k[of].astype(C.U64)) >> C.U64(32)).astype(np.int64)
                slot = base[of] + block
                head = C.group_bounds(slot)
                filled = slot[head]
                parity = np.zeros(int(k.sum()), C.U64)
                parity[filled] = np.bitwise_xor.reduceat(C.mix(h[at] + C.U64(0x8EBC6AF09C88C6E3)), head)
                count = np.zeros(int(k.sum()), np.int64)
                count[filled] = np.diff(np.r_[head, len(slot)])
                owner = np.repeat(np.arange(len(doc)), k)
                weak = count < bands.weak
                n_weak = np.bincount(owner[weak], minlength=len(doc))
                send = ~weak | (n_weak > np.array(bands.spare)[j])[owner]
                name = (j[owner] * 1_000_003 + np.arange(len(owner)) - base[owner]).astype(C.U64)
                keys.append(C.mix(parity + C.mix(name + C.U64(1)))[send])
                docs.append(doc[owner[send]])
            key = np.concatenate(keys) if keys else np.zeros(0, C.U64)
            doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
            yield t, {
                "ids": ids,
                "doc": doc,
                "pos": np.zeros(len(doc), np.int64),
                "h": key,
                "bucket": ((key & C.U64(0xFFFFFFFF)) % C.U64(n_buckets)).astype(np.int64),
            }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in C.gathered(entries(batches), GATHER_BYTES):
            by = np.argsort(e["doc"], kind="stable")
            e |= {k: e[k][by] for k in ("doc", "h", "bucket")}
            order, cut, row = C.packed(e, n_buckets)
            # The bucket's slice of the hash space and 32 bits more: what meets by chance is verified anyway.
            yield pa.RecordBatch.from_pydict(row | {"h": C.slices((e["h"][order] >> C.U64(32)).astype(np.uint32), cut)})

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Entries of keys that two or more ids hold, each with the least of these ids."""
    hs, ds = [], []
    for row, ids, doc, _ in C.unpacked(table):
        hs.append(np.frombuffer(row["h"], np.uint32).astype(np.int64) | (row["bucket"] << 32))
        ds.append(ids[doc])
    h, d = np.concatenate(hs), np.concatenate(ds)
    order = np.argsort(h, kind="stable")
    h, d = h[order], d[order]
    head = C.group_bounds(h)
    size = np.diff(np.r_[head, len(h)])
    least, most = np.minimum.reduceat(d, head), np.maximum.reduceat(d, head)
    out = np.repeat(least < most, size)
    return pa.table(
        {
            "key": pa.array(h[out], pa.int64()),
            "rid": pa.array(d[out], pa.int64()),
            "center": pa.array(np.repeat(least, size)[out], pa.int64()),
        }
    )


def close_pairs(ids: np.ndarray, sizes: np.ndarray, label: np.ndarray, fine: np.ndarray, num: int, den: int, forest: bool):
    """Pairs of different labels whose distance allows a link; with ``forest`` only as many as join labels."""
    order = np.argsort(ids, kind="stable")
    ids, sizes, label, fine = ids[order], sizes[order], label[order].copy(), fine[order]
    a, b = [], []
    for i in range(len(ids)):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        rest = rest[(den * np.minimum(sizes[rest], sizes[i]) >= num * np.maximum(sizes[rest], sizes[i]))]
        if not len(rest):
            continue
        away = np.bitwise_count(fine[rest] ^ fine[i]).sum(1, dtype=np.int64)
        near = rest[away * (den + num) <= (sizes[rest] + sizes[i]) * (den - num)]
        if forest and len(near):
            _, first = np.unique(label[near], return_index=True)
            near = near[first]
            label[np.isin(label, label[near])] = label[i]
        a += [int(ids[i])] * len(near)
        b += ids[near].tolist()
    return a, b


def _across(num: int, den: int, forest: bool):
    def run(entries: pa.Table, sketches: pa.Table) -> pa.Table:
        fine = {(r, n): f for r, n, f in zip(*(sketches.column(c).to_pylist() for c in ("id", "size", "fine")))}
        key = entries.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        head = np.r_[C.group_bounds(key[order]), len(key)]
        ids, sizes, label = (entries.column(c).to_numpy() for c in ("rid", "n", "label"))
        out: set[tuple[int, int]] = set()
        for lo, hi in zip(head, head[1:]):
            at = order[lo:hi]
            held = [fine[r, n] for r, n in zip(ids[at].tolist(), sizes[at].tolist())]
            a, b = close_pairs(ids[at], sizes[at], label[at], _folded(held), num, den, forest)
            out.update(zip(b, a))
        pairs = sorted(out)
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([y for _, y in pairs], pa.int64())})

    return run


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=1)
    for t in C.chunks(batches):
        yield pa.RecordBatch.from_pydict(
            {"rid": pa.array(t.ids(), pa.int64()), "z": pa.array([z.compress(t.text(i)) for i in range(t.n)], pa.binary())}
        )


def _links(words: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for lo in range(0, batch.num_rows, PAIRS):
                part = batch.slice(lo, PAIRS)
                both = zip(part.column("za"), part.column("zb"))
                texts = [z.decompress(x.as_py()).decode() for pair in both for x in pair]
                whole = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.large_string())})
                for t in C.chunks([whole], size=1 << 62):
                    linked = _linked(t, words, num, den)
                mask = pa.array(linked)
                yield pa.RecordBatch.from_pydict({"a": part.column("a").filter(mask), "b": part.column("b").filter(mask)})

    return run


def _linked(t: C.Texts, words: int, num: int, den: int) -> np.ndarray:
    """Whether texts 2i and 2i + 1 link.  Shingles are equal where two independent 64-bit hashes are."""
    low = C.lowered(t.data)
    starts, ends, first = t.words()
    (h, doc), (g, _) = (_shingles(C.span_hashes(low, starts, ends, seed), first, words) for seed in (0, 1))
    order = np.lexsort((g, h, doc))
    h, g, doc = h[order], g[order], doc[order].astype(np.int64)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    h, g, doc = h[new], g[new], doc[new]
    sizes = np.bincount(doc, minlength=t.n)
    order = np.lexsort((g, h, doc // 2))
    h, g, pair = h[order], g[order], doc[order] // 2
    same = (h[1:] == h[:-1]) & (g[1:] == g[:-1]) & (pair[1:] == pair[:-1])
    common = np.bincount(pair[1:][same], minlength=t.n // 2)
    total = sizes[0::2] + sizes[1::2] - common
    return (total > 0) & (den * common >= num * total)


def _of_ids(docs: DataFrame, ids: DataFrame, n_ids: int) -> DataFrame:
    """The rows of some ids, by a broadcast if these are few."""
    return docs.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, "rid", "left_semi")


def _verify(pairs: DataFrame, n_pairs: int, docs: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, int]:
    """The pairs (a, b), a checkpoint, that link, and their number.  Texts are first cut down to those of the
    pairs; then each join moves a text once per pair, and hot centres are split by AQE."""
    ids = C.cut(C.few_parts(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), 2 * n_pairs))
    texts = _of_ids(docs, ids, ids.count()).mapInArrow(_squeeze, "rid bigint, z binary")
    a = texts.select(F.col("rid").alias("a"), F.col("z").alias("za"))
    b = texts.select(F.col("rid").alias("b"), F.col("z").alias("zb"))
    both = C.few_parts(C.few_parts(pairs.join(a, "a"), n_pairs, PAIRS_A_TASK).join(b, "b"), n_pairs, PAIRS_A_TASK)
    links = C.cut(both.select("a", "b", "za", "zb").mapInArrow(_links(words, num, den), "a bigint, b bigint"))
    C.drop_cut(ids)
    return links, links.count()


def _least_of_equal_sets(sets: DataFrame) -> DataFrame:
    """(rid, doc_id, n, rep): rep is the least id with an equal set, null for an empty one.

    Sets that very many rows have get theirs by a broadcast of at most ``BROADCAST_IDS`` of them.
    """
    n_docs = sets.count()
    found = sets.where("n > 0").groupBy("s1", "s2").agg(F.min("rid").alias("rep"), F.count("*").alias("m"))
    reps = C.cut(C.few_parts(found, n_docs))
    hot = reps.where(F.col("m") > max(HOT_ROWS, n_docs // BROADCAST_IDS)).drop("m")
    keyed = sets.join(F.broadcast(hot.withColumnRenamed("rep", "hot")), ["s1", "s2"], "left")
    rest = C.few_parts(keyed.where("hot is null").drop("hot").join(reps.drop("m"), ["s1", "s2"], "left"), n_docs)
    columns = ("rid", "doc_id", "n", "rep")
    rows = C.cut(rest.select(*columns).unionAll(keyed.where("hot is not null").withColumnRenamed("hot", "rep").select(*columns)))
    C.drop_cut(reps)
    return rows


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable by links).

    Documents link when den * |intersection| >= num * |union| of their sets of ``words``-word shingles,
    A-Z lower-cased.  Sets meet those of their own size band and the next, so thresholds under 1 / ``BAND``,
    where sets further apart can link, are refused.
    """
    if not 0 < num < den:
        raise ValueError("the threshold must lie between 0 and 1")
    if num * BAND < den:
        raise ValueError(f"the threshold must be {1 / BAND} or more")
    docs = C.documents(docs)
    n_buckets = C.buckets(C.text_bytes(docs), BUCKET_BYTES)
    sets = C.cut(docs.mapInArrow(_sets(words), "rid bigint, doc_id bigint, n bigint, s1 bigint, s2 bigint"))
    rows = _least_of_equal_sets(sets)
    C.drop_cut(sets)
    docs = docs.select("rid", "text")
    n_rows = rows.count()
    nodes = C.few_parts(rows.where("rep = rid").select("rid", "n").distinct(), n_rows)

    shared = docs.mapInArrow(_blocks(words, num, den, n_buckets), C.PACKED + ", h binary")
    shared = shared.groupBy("bucket").applyInArrow(_shared, "key bigint, rid bigint, center bigint")
    # Many rows, so a compressed cache and no checkpoint: what a lost executor held is made again.
    cached = shared.join(nodes, "rid").select("rid", "key", "center", "n").persist(StorageLevel.DISK_ONLY)
    n_members = cached.count()
    members = C.few_parts(cached, n_members)

    firsts = C.few_parts(members.where("rid <> center").groupBy(F.col("rid").alias("a")).agg(F.min("center").alias("b")), n_members)
    firsts = C.cut(firsts)
    links, n_links = _verify(firsts, firsts.count(), docs, words, num, den)
    C.drop_cut(firsts)
    several = C.few_parts(rows.where("rep is not null").groupBy("rid").agg(F.min("rep").alias("b"), F.max("rep").alias("a")), n_rows)
    several = C.cut(several.where("a <> b"))  # ids whose rows have different sets: one document all the same
    if n_several := several.count():
        own = rows.join(several.select("rid", "b"), "rid").select(F.col("rep").alias("a"), "b").where("a <> b")
        links, n_links = links.unionAll(C.cut(own)), n_links + n_several
    final = components(links, n_links)
    for forest in (True, False):
        named = C.few_parts(members.join(final, members.rid == final.node, "left"), n_members)
        named = named.select("key", "rid", "n", F.coalesce("label", "rid").alias("label"))
        code = F.xxhash64("rid", "n")
        held_by = [F.count("*").alias("m"), *(F.sum(x).alias(f"c{i}") for i, x in enumerate((code.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(code, 32))))]
        apart = C.few_parts(named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), *held_by).where("lo < hi"), n_members)
        # Blocks that the same documents hold need one comparison.
        apart = C.few_parts(apart.groupBy("lo", "hi", "m", "c0", "c1").agg(F.min("key").alias("key")), n_members).select("key")
        still = C.few_parts(named.join(apart, "key"), n_members).persist(StorageLevel.DISK_ONLY)
        n_still = still.count()
        if not n_still:
            still.unpersist()
            break
        # A sketch goes once to each part that compares blocks of its document.
        parts = C.buckets(n_still, OPEN_ROWS)
        dealt = still.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(parts)))
        asked = C.few_parts(dealt.select("g", "rid", "n").distinct(), n_still)
        ids = C.few_parts(still.select("rid").distinct(), n_still)
        fine = _of_ids(docs, ids, ids.count()).mapInArrow(_fines(words), "rid bigint, n bigint, fine binary").distinct()
        sketches = C.few_parts(asked.join(fine, ["rid", "n"]), n_still, OPEN_ROWS).select("g", "rid", "n", "fine").toDF("part", "id", "size", "fine")
        across = dealt.groupBy("g").cogroup(sketches.groupBy("part")).applyInArrow(_across(num, den, forest), "a bigint, b bigint")
        across = C.cut(C.few_parts(across.coalesce(parts).distinct(), n_still))
        more, n_more = _verify(across, across.count(), docs, words, num, den)
        links, n_links = links.unionAll(more), n_links + n_more
        C.drop_cut(across)
        still.unpersist()
        final = components(links, n_links)
    cached.unpersist()
    out = rows.join(final, rows.rep == final.node, "left")
    least = F.coalesce("label", "rep", "rid")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(least == C.NULL_ID, F.col("doc_id")).otherwise(least).alias("component_id"),
    )


def keep_first_of_components(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that ``found`` links with a lesser doc_id."""
    lost = C.cut(found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_lost")).distinct())
    if lost.count() <= BROADCAST_IDS:
        lost = F.broadcast(lost)
    return docs.join(lost, docs.doc_id.eqNullSafe(lost._lost), "left_anti")
