"""Corpus operators against brute force on small tables: nulls, empty and long texts, ties, repeated
rows, empty tables, extra columns whose names clash."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fissure.llm import common as C
from fissure.llm import decontamination
from fissure.llm import substring_dedup as substring_dedup_module
from fissure.llm import suffix_dedup as suffix_dedup_module
from fissure.llm.chat_format import HEAD, chat_digests, format_chats, read_chats
from fissure.llm.chroma import align_recordings, chroma, decode_wav, fingerprint, fingerprints, recordings_of
from fissure.llm.components import components
from fissure.llm.decontamination import contamination, drop_contaminated
from fissure.llm.language_id import LanguageModel, codewords, drop_unidentified, identify_language
from fissure.llm.line_dedup import _neighbours, common_prefixes, drop_repeated_lines, line_dedup
from fissure.llm.packing import LOOK_AHEAD, WordTokenizer, best_fit, buffered, pack_documents
from fissure.llm.parity_join import Bands, close_pairs, fine_sketch, jaccard_components
from fissure.llm.queries import HOSTILE, word_bpe_path
from fissure.llm.substring_dedup import substring_dedup
from fissure.llm.suffix_dedup import repeated_windows, short_prefixes, suffix_array, suffix_dedup
from fissure.llm.toxicity import N_LEXICONS, PATTERNS, Terms, _found, label_model, score_toxicity, votes

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, rid int, pos string, bucket int, score string, label int, _rid int"
NULL_LAST = 1 << 63


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}{rng.choice(['', '', '.', ',', 'É'])}" for _ in range(n)]


def corpus(seed=0, n=40):
    """(doc_id, text) rows: random texts, copies, shared passages, periodic and odd texts."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 70))
    base = [words(rng, rng.randrange(1, 200)) for _ in range(n)]
    rows = []
    for i, w in enumerate(base):
        kind = i % 8
        text = "\n".join(" ".join(w[j : j + 12]) for j in range(0, len(w), 12))
        if kind == 1:
            text += " " + passage
        if kind == 2 and i > 8:
            text = rows[i - 2][1]
        if kind == 3 and i > 8:
            near = rows[i - 4][1].split(" ")
            near[len(near) // 2] = "changed"
            text = " ".join(near)
        rows.append((i, text))
    odd = [None, "", " \t\n\x0b ", "a", "ab " * 120, "x" * 900, "x" * 450, "one two", "One TWO", "é" * 300, "tail " + "é" * 300, passage]
    rows += [(100 + i, t) for i, t in enumerate(odd)]
    rows += [(None, passage + " end"), (None, None), (3, rows[3][1]), (5, "another text with the id five " * 20), (77, " ".join(words(rng, 4000)))]
    return rows


def table(spark, rows, parts=3):
    full = [(i, t, "xx", "s", len(t or ""), 7, "p", 1, "s", 0, 9) for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


def split_words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def order(i):
    return NULL_LAST if i is None else i


def same(found, expected):
    key = repr
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("parts", [1, 24])
def test_substring_dedup(spark, parts):
    rows = corpus()
    first = {}
    for i, t in rows:
        w = split_words(t)
        for j in range(len(w) - 49):
            k = tuple(w[j : j + 50])
            first[k] = min(first.get(k, NULL_LAST), order(i))
    expected = []
    for i, t in rows:
        w = split_words(t)
        gone = [False] * len(w)
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < order(i):
                gone[j : j + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        expected.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    assert any(e[2] for e in expected)
    same(substring_dedup(table(spark, rows, parts)).collect(), expected)
    assert substring_dedup(table(spark, []).limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring_dedup(table(spark, rows), min_words=50, block=26)


def batches_of(rows):
    texts = pa.table({"rid": [i for i, _ in rows], "nk": [0] * len(rows), "tk": [zlib.crc32(t.encode()) for _, t in rows], "text": [t for _, t in rows]})
    return texts.to_batches(max_chunksize=50)


def met(rows, key):
    """Times that a hash value occurs among entries that must meet others."""
    values = [v for batch in rows for row in batch.to_pylist() for v in key(row)]
    return Counter(values)


def test_hot_blocks_are_combined_before_they_meet():
    rng = random.Random(31)
    shared = words(rng, 200)
    rows = [(i, " ".join(words(rng, rng.randrange(30)) + shared + words(rng, 9, 10**6))) for i in range(600)]
    anchors = list(substring_dedup_module._anchors(25, 50, 1)(iter(batches_of(rows))))
    assert max(met(anchors, lambda row: np.frombuffer(row["h"], np.uint32).tolist()).values()) <= len(anchors)
    decided = [row for batch in anchors for row in batch.to_pylist() if not row["h"]]
    assert sum(len(row["what"]) for row in decided) > 600 * 5  # blocks of all documents
    hot = [b.append_column("pos", pa.array([[50, 75, 100]] * len(b), pa.list_(pa.int32()))) for b in batches_of(rows)]
    found = list(substring_dedup_module._windows(25, 50, 1)(iter(hot)))
    assert max(met(found, lambda row: np.frombuffer(row["h"], np.uint64).tolist()).values()) <= len(found)


def test_hot_segments_are_combined_before_they_meet():
    rng = random.Random(37)
    shared = " ".join(words(rng, 300))
    rows = [(i, f"{rng.random()} {shared} {rng.random()}") for i in range(600)]
    anchors = list(suffix_dedup_module._anchors(200, 1)(iter(batches_of(rows))))
    assert max(met(anchors, lambda row: np.frombuffer(row["h"], np.uint64).tolist()).values()) <= len(anchors)

    def bodies(row):
        edge = np.r_[0, np.cumsum(C.unplanes(row["sizes"], np.uint32))].tolist() if row["body"] else []
        return [row["body"][a:b] for a, b in zip(edge, edge[1:])]

    asked = [b.append_column("pos", pa.array([list(range(2000))] * len(b), pa.list_(pa.int32()))) for b in batches_of(rows)]
    found = list(suffix_dedup_module._bodies(200, 1)(iter(asked)))
    assert max(met(found, bodies).values()) <= len(found)


@pytest.mark.parametrize("parts", [1, 24])
def test_suffix_dedup(spark, parts):
    rows = corpus(1)
    times = {}
    for _, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - 199):
            times[b[j : j + 200]] = times.get(b[j : j + 200], 0) + 1
    expected = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 199):
            if times[b[j : j + 200]] > 1:
                gone[j : j + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        expected.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    assert any(e[2] for e in expected)
    same(suffix_dedup(table(spark, rows, parts), keep_text=False).collect(), expected)
    assert suffix_dedup(table(spark, []).limit(0)).count() == 0


def test_interval_expansion():
    rng = random.Random(2)
    for _ in range(30):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(4, 60))) for _ in range(4)]
        text = np.array([s + 2 for p in parts for s in [*p, -1]] + [0], np.uint16)
        sa = suffix_array(text)
        assert [text[i:].tolist() for i in sa] == sorted(text[i:].tolist() for i in range(len(text)))
        known = short_prefixes(text, sa, 4)
        for i in range(1, len(sa)):
            assert known[i] == (text[sa[i - 1] :][:4].tolist() != text[sa[i] :][:4].tolist())
        flags = repeated_windows(parts, np.ones(4, np.int64), 4)
        every = [p[j : j + 4] for p in parts for j in range(len(p) - 3)]
        for p, f in zip(parts, flags):
            assert f.tolist() == [every.count(p[j : j + 4]) > 1 for j in range(len(p) - 3)]


def shingles(text, n):
    low = [w.decode() for w in split_words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    return {tuple(low[i : i + n]) for i in range(max(1, len(low) - n + 1))} if low else set()


def by_brute_force(rows, n, num, den):
    """Ids and set sizes with the least id reachable; an id with several texts is one document."""
    parent = {order(i): order(i) for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(order(i), shingles(t, n)) for i, t in rows]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if (a or b) and den * len(a & b) >= num * len(a | b):
                r, s = sorted((root(i), root(j)))
                parent[s] = r
    back = lambda x: None if x == NULL_LAST else x
    return [(back(i), len(a), back(root(i)) if a else back(i)) for i, a in sets]


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80)])
def test_jaccard_components(spark, n, num):
    rng = random.Random(3)
    rows = corpus(3)
    line = words(rng, 300)
    for i in range(60):  # a chain of near copies, some of which are too far from the first
        rows.append((200 + i, " ".join(line)))
        for _ in range(3):
            line[rng.randrange(len(line))] = f"new{i}"
    expected = by_brute_force(rows, n, num, 100)
    assert len({e[2] for e in expected}) < len(expected) - 20
    same(jaccard_components(table(spark, rows), n, num, 100).collect(), expected)
    assert jaccard_components(table(spark, []).limit(0)).count() == 0


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(4)
    for n in (3, 60, 700):
        a = rng.integers(0, 1 << 63, n).astype(C.U64)
        b = np.r_[a[n // 10 + 1 :], rng.integers(0, 1 << 63, n // 10).astype(C.U64)]
        apart = len(set(a.tolist()) ^ set(b.tolist()))
        x, y = (np.frombuffer(fine_sketch(v), np.uint8) for v in (a, b))
        if len(x) == len(y):
            assert np.bitwise_count(x ^ y).sum() <= apart
    bands = Bands(90, 100)
    j = bands.of(np.array([8, 9, 500, 20000]))
    assert j[0] == -1 and j[1] == 0 and all(bands.blocks[i] > (bands.lows[i + 1] - 1) // 9 + bands.spare[i] for i in j[1:])
    ids, sizes = np.arange(4), np.full(4, 10)
    fine = np.zeros((4, 1), C.U64)
    assert len(close_pairs(ids, sizes, ids.copy(), fine, 90, 100, True)[0]) == 3
    assert len(close_pairs(ids, sizes, ids.copy(), fine, 90, 100, False)[0]) == 6


def thue_morse(a, b, n=10):
    """Two words that every polynomial hash modulo a power of two takes for one."""
    x, y = a, b
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


def test_no_texts_are_alike_by_construction(spark):
    rng = random.Random(14)
    for a, b in (("a", "b"), ("0", "1"), ("ab", "cd"), ("abcdefgh", "hgfedcba")):
        x, y = thue_morse(a, b)
        data = np.frombuffer((x + y).encode(), np.uint8)
        for lo, hi in ((0, 256), (0, 64), (0, len(x))):
            spans = np.array([lo, len(x) + lo]), np.array([hi, len(x) + hi])
            assert len(set(C.span_hashes(data, *spans).tolist())) == 2
    u, v = (np.array([{"a": 5, "b": 9}[c] for c in w], C.U64) for w in thue_morse("a", "b"))
    assert all(C.windows(u, k)[0] != C.windows(v, k)[0] for k in (2, 3, 50, 64, 1024))
    assert C.windows(u, 50).tolist() == [C.windows(u[i : i + 50], 50)[0] for i in range(len(u) - 49)]
    x, y = thue_morse("x", "y")
    rest = words(rng, 49)
    rows = [(1, " ".join([x, *rest])), (2, " ".join([y, *rest]))]
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup(table(spark, rows)).collect()} == {1: 0, 2: 0}
    many = [(1, " ".join([x] * 3 + rest[:3])), (2, " ".join([y] * 3 + rest[5:8]))]
    assert {r["doc_id"]: r["component_id"] for r in jaccard_components(table(spark, many), 3, 90, 100).collect()} == {1: 1, 2: 2}
    path = word_bpe_path()
    t = WordTokenizer(open(path, encoding="utf-8").read()).tokenizer
    for r in pack_documents(table(spark, [(1, x), (2, y)]), path).collect():
        ids = t.encode({1: x, 2: y}[r["doc_id"]], add_special_tokens=False).ids + [1]
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_a_wrong_piece_is_never_served():
    import pyarrow as pa

    w = WordTokenizer(open(word_bpe_path(), encoding="utf-8").read())
    for text in ("some words here", "and more words"):
        for t in C.chunks([pa.RecordBatch.from_pydict({"text": pa.array([text])})]):
            w.checks = w.checks ^ C.U64(1)  # as if other pieces had come first with these hashes
            ids, _ = w.encode(t)
            assert ids.tolist() == w.tokenizer.encode(text, add_special_tokens=False).ids


def test_many_rows_without_an_id(spark):
    rng = random.Random(23)
    shared = " ".join(words(rng, 60))
    rows = [(7, shared)] + [(None, f"{shared} {' '.join(words(rng, 5))}") for _ in range(300)] + [(None, shared)] * 3
    found = substring_dedup(table(spark, rows)).collect()
    assert sorted(r["n_removed"] for r in found) == [0] + [60] * 303
    assert sorted(r["n_removed"] > 0 for r in suffix_dedup(table(spark, rows)).collect()) == [True] * 304


def test_the_largest_id_stays(spark):
    top = (1 << 63) - 1
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(top, text), (4, text + " and so on"), (None, text), (top - 1, None)]
    ids = sorted((i for i, _ in rows), key=repr)
    for found in (substring_dedup(table(spark, rows)), suffix_dedup(table(spark, rows)), jaccard_components(table(spark, rows))):
        assert sorted((r["doc_id"] for r in found.collect()), key=repr) == ids
    removed = {r["doc_id"]: r["n_removed"] for r in substring_dedup(table(spark, rows)).collect()}
    assert removed == {top: 60, 4: 0, None: 60, top - 1: 0}
    alone = jaccard_components(table(spark, rows[:1] + rows[2:3])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in alone} == {(top, top), (None, None)}


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(50, 90)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(20)] + [(7, 7)]
    parent = {}
    for a, b in pairs:
        parent.setdefault(a, {a}), parent.setdefault(b, {b})
        both = parent[a] | parent[b]
        for x in both:
            parent[x] = both
    found = components(spark.createDataFrame(pairs, "a bigint, b bigint"))
    got = {r["node"]: r["label"] for r in found.collect()}
    assert all(got.get(x, x) == min(s) for x, s in parent.items())


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_line_dedup(spark, m):
    rng = random.Random(6)
    pool = [f"line {i}" for i in range(6)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for i in range(30)]
    rows += [(90, None), (91, ""), (92, "\n\n"), (None, "line 1\nline 2\nline 1\nline 2"), (93, "\n".join(f"l{i}" for i in range(5000)))]
    rows += [(94, rows[-1][1] + "\nmore")]
    seen, expected = set(), []
    for i, t in sorted(rows, key=lambda r: order(r[0])):
        if t is None:
            expected.append((i, 0, 0, 0, None))
            continue
        lines = t.split("\n")
        at = [p for p, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
        gone, mine = set(), []
        for j in range(len(at) - m + 1):
            k = tuple(lines[p] for p in at[j : j + m])
            if k in seen:
                gone |= set(at[j : j + m])
            seen.add(k)
        kept = "\n".join(x for p, x in enumerate(lines) if p not in gone)
        runs = sum(p in gone and (n == 0 or at[n - 1] not in gone) for n, p in enumerate(at))
        expected.append((i, len(lines), len(gone), runs, hashlib.sha256(kept.encode()).hexdigest()))
    same(line_dedup(table(spark, rows), m).collect(), expected)
    if m == 2:
        assert set(drop_repeated_lines(table(spark, rows)).columns) == {*table(spark, rows).columns, "n_lines", "n_removed", "n_runs"}
        assert line_dedup(table(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("m", [1, 2, 3])
def test_common_prefixes_are_all_found(spark, m):
    """Every suffix and depth whose prefix stands elsewhere, with its first occurrence."""
    from pyspark.sql import functions as F

    rng = random.Random(15)
    docs = [[rng.choice("abc") for _ in range(rng.randrange(1, 30))] for _ in range(12)]
    docs += [docs[0] * 2, docs[1], [*"xyz"] * 11]
    depths = [m * 2**k for k in range(8)]
    places = {}
    for d, x in enumerate(docs):
        for i in range(len(x)):
            for n in depths:
                if i + n <= len(x):
                    places.setdefault((n, tuple(x[i : i + n])), []).append((d, i))
    expected = {(d, i, n, p[0]) for (n, _), p in places.items() if len(p) > 1 for d, i in p}
    rows = spark.createDataFrame([(d, "\n".join(x)) for d, x in enumerate(docs)], "rid bigint, text string").withColumn("tk", F.xxhash64("text"))
    found = common_prefixes(_neighbours(rows, 0), m).collect()
    assert {(r["rid"], r["i"], r["depth"], (r["first"]["rid"], r["first"]["i"])) for r in found} == expected
    assert len(found) == len(expected) and max(r["depth"] for r in found) >= 16


def test_line_dedup_keeps_other_columns(spark):
    rows = [(1, "a\nb", 42, "x", [1], 5, None), (2, "q\na\nb", 43, "y", None, 6, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, rid int, lines string, runs array<int>, n_lines int, tk int")
    found = drop_repeated_lines(df)
    assert [c for c in found.columns if c in df.columns] == ["doc_id", "rid", "lines", "runs", "tk", "text", "n_lines"]
    got = {r["doc_id"]: (r["rid"], r["lines"], r["runs"], r["tk"], r["text"], r["n_lines"]) for r in found.collect()}
    assert got == {1: (42, "x", [1], None, "a\nb", 2), 2: (43, "y", None, 7, "q", 3)}


@pytest.mark.parametrize("m", [1, 2, 3])
def test_line_dedup_takes_equal_rows_as_one_document(spark, m):
    rows = [(1, "p\nq\nr"), *[(2, "a\nb\nc")] * 2, *[(3, "d\ne\n\nf")] * 3, *[(None, "p\nq\nr\ng\nh")] * 2, *[(None, "k\nl\nm")] * 3]
    found = drop_repeated_lines(table(spark, rows), m).select("doc_id", "text", "n_removed")
    expected = [(i, t.replace("p\nq\nr\n", ""), 3) if "g" in t else (i, t, 0) for i, t in rows]
    same(found.collect(), expected)


def test_long_single_lines_are_runs(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 12), ("b", 10), ("c", 9)))
    rows = [(1, f"x\n{a}\ny"), (2, f"{a}\nz"), (3, f"u\n\n{b}\n{c}\n{b}"), (4, a), (5, f"v\n{c}\nx\n{a}"), (6, f"u\t\n{a} \nw"), (7, " ".join("short" * 20))]
    rows += [(8, rows[6][1]), *[(9, f"p\n{b}\nq")] * 2, (None, f"{a} \n{c}"), (10, None)]
    gone = {2: "z", 3: f"u\n\n{b}\n{c}", 5: f"v\n{c}", 9: "p\nq", None: c}
    left = [(i, gone.get(i, t)) for i, t in rows if i not in (4, 8)]
    same(corpus_pipeline.lines(spark, table(spark, rows), "").select("doc_id", "text").collect(), left)


def test_packing_is_exact(spark):
    rows = corpus(7) + [(300, "<|endoftext|> A.b"), (301, "don't stop'S 12,x")]
    path = word_bpe_path()
    found = pack_documents(table(spark, rows), path, capacity=64, group_tokens=5000).collect()
    t = WordTokenizer(open(path, encoding="utf-8").read()).tokenizer
    expected = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 64)):
            part = ids[a : a + 64]
            expected.append((i, k, a, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    same([tuple(r)[:5] for r in found], expected)
    bins = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    least = -(-sum(e[3] for e in expected) // 64)
    assert len(bins) <= least * 1.1 + 5
    assert pack_documents(table(spark, []).limit(0), path).count() == 0


def test_best_fit_is_bounded():
    assert best_fit([6, 5, 4, 3, 2], 10, 9) == ([0, 1, 0, 1, 1], [0, 0, 6, 5, 8])
    assert best_fit([6, 5, 9, 4], 10, 2) == ([0, 1, 2, 1], [0, 0, 0, 5])  # the fullest of two closes for the third


def test_tokenizer_pieces_equal_whole_texts():
    import pyarrow as pa

    w = WordTokenizer(open(word_bpe_path(), encoding="utf-8").read())
    rng = random.Random(8)
    signs = [*"abcXYZ 019'.,-<>|\n\t", "é", "É", "İ", "́", "̸", "=", "<|endoftext|>", "'s", "'LL", "—", "\x01", "\x0b", "漢", "😀", " ", "K"]
    for r in range(60):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(20)]
        for t in C.chunks([pa.RecordBatch.from_pydict({"text": pa.array(texts)})]):
            ids, off = w.encode(t)
            for i, x in enumerate(texts):
                assert ids[off[i] : off[i + 1]].tolist() == w.tokenizer.encode(x, add_special_tokens=False).ids


def test_chat_formatting(spark):
    rows = [
        (1, 2, "assistant", "b" + HOSTILE), (1, 1, "user", "a\\l#<"), (1, 3, "assistant", None), (1, 0, "system", ""),
        (2, 0, None, "x"), (2, None, "user", "first"), (None, 0, "as:\n<s", "é\\b"), (3, 1, "user", "t"), (3, 1, "user", "t"),
        (4, 0, "assistant", "one"), (4, 1, "assistant", "<more>"), (4, 2, "assistant", "</turn>\n### user:\n"),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, turns string, formatted int")
    out = format_chats(df)
    back = {r["conv_id"]: r for r in read_chats(out).collect()}
    convs = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    for c, turns in convs.items():
        assert [tuple(t) for t in back[c]["turns"]] == turns
        assert back[c]["loss_text"] == "".join(x for r, x in turns if r == "assistant")
    assert back[4]["formatted"].count(HEAD) == 1  # one block for one role
    digest = {r["conv_id"]: r for r in chat_digests(out).collect()}
    said = "".join(f"{r}\n{x}\n" for r, x in convs[1])
    assert digest[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and digest[1]["n_turns"] == 4
    assert chat_digests(format_chats(df.limit(0))).count() == 0


def sentences(rng, stems, n):
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randrange(1, 4))) for _ in range(n))


STEMS = {"aa": ["the", "ing", "er", "th"], "bb": ["ung", "sch", "ein", "ü"], "cc": ["que", "eau", "é", "ou"], "dd": ["ción", "ado", "ra", "ñ"]}


def test_language_id(spark):
    rng = random.Random(9)
    rows = [(i, sentences(rng, STEMS[lang], rng.randrange(5, 60)), lang) for i, lang in enumerate(list(STEMS) * 60)]
    odd = [(900, None, "aa"), (901, "123 !!", "aa"), (902, "", None), (None, sentences(rng, STEMS["bb"], 20), None), (903, "漢字", None)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows + odd], "doc_id bigint, text string, lang string, score int, ambiguous string")
    found = {r["doc_id"]: r for r in identify_language(df).collect()}
    for i, _, lang in rows:
        assert found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= found[i]["score"] <= 1
    assert np.mean([found[i]["lang_pred"] == lang for i, _, lang in rows if found[i]["held_out"]]) > 0.98
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (900, 901, 902))
    assert found[903]["lang_pred"] in STEMS and found[None]["lang_pred"] == "bb" and not found[None]["held_out"]
    kept = {r["doc_id"] for r in drop_unidentified(df).collect()}
    assert not kept & {900, 901, 902} and len(kept) > 0.98 * len(rows)
    none = identify_language(df.where("lang is null"))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert identify_language(df.limit(0)).count() == 0
    for n in (2, 4, 9):
        m = codewords(n)
        assert len({tuple(r) for r in m.tolist()}) == n and all(0 < c.sum() < n for c in m.T)


def test_toxicity(spark):
    rng = random.Random(10)
    bad = ["idiot", "scum", "loweient", "loweiung", "loweisch", "moron"]
    rows, labels = [], []
    for i in range(1200):
        w = sentences(rng, STEMS[rng.choice(list(STEMS))], rng.randrange(8, 60)).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), toxic))
        labels.append((i, 0, int(toxic)))
    docs = spark.createDataFrame([(i, t, "x", 3, 4) for i, t, _ in rows] + [(5000, None, "x", 3, 4), (5001, "", "x", 3, 4), (None, "loweinew", "x", 3, 4)],
                                 "doc_id bigint, text string, score string, toxic int, label int")
    marks = spark.createDataFrame(labels + [(5001, 0, None), (None, 0, 1), (3, 0, 0)], "doc_id bigint, quality int, toxic int")
    found = {r["doc_id"]: r for r in score_toxicity(docs, marks).collect()}
    assert len(found) == len(rows) + 3
    held = [(found[i]["predicted"], int(t)) for i, _, t in rows if found[i]["held_out"]]
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert np.mean([p == y for p, y in held]) > 0.97
    assert found[5000]["score"] == found[5001]["score"] < 0.3 and found[None]["score"] > 0.3  # an unseen ending
    flipped = marks.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    again = {r["doc_id"]: r["score"] for r in score_toxicity(docs, flipped).collect()}
    assert again == {i: r["score"] for i, r in found.items()}  # held-out labels are never read
    assert score_toxicity(docs, marks.limit(0)).where("score > 0.01").count() == 0
    assert score_toxicity(docs.limit(0), marks).count() == 0


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(11)
    y = rng.random(4000) < 0.3
    v = np.stack([np.where(rng.random(4000) < a, y, ~y).astype(np.int8) for a in (0.95, 0.9, 0.9, 0.6)], 1)
    v = np.c_[v, v[:, 3], v[:, 3]]
    q, tables, corr, pairs = label_model(v, 0.3)
    assert ((q > 0.5) == y).mean() > 0.95
    assert corr[3, 4] > 0.9 and abs(corr[0, 1]) < 0.3
    assert len(pairs) == 2 and {x for p in pairs for x in p} == {3, 4, 5}  # the copies, and nothing else
    alone, *_ = label_model(v[:, :4], 0.3)
    assert np.abs(q - alone).mean() < 0.01  # copies change no posterior
    assert tables[1, 0, 2] > 0.85 > tables[1, 3, 2]


def test_label_model_recovers_dependent_voters():
    """Votes drawn from a model with a pair of dependent voters: its tables are found, and posteriors follow them."""
    rng = np.random.default_rng(22)
    y = rng.random(20000) < 0.3
    right = (0.92, 0.9, 0.88, 0.85, 0.85, 0.8, 0.75)
    v = np.stack([np.where(rng.random(len(y)) < a, y, ~y).astype(np.int8) for a in right], 1)
    follows = np.where(rng.random(len(y)) < 0.7, v[:, 6], np.where(rng.random(len(y)) < 0.6, y, ~y)).astype(np.int8)
    v = np.c_[v, follows]
    q, tables, _, pairs = label_model(v, 0.3)
    assert pairs in ([(7, 6)], [(6, 7)])
    logit = np.log(0.3 / 0.7)
    for j, a in enumerate(right):
        assert abs(tables[1, j, 2] - a) < 0.03 and abs(tables[0, j, 1] - a) < 0.03
        logit = logit + np.where(v[:, j] == 1, 1, -1) * np.log(a / (1 - a))
    stay = {(x, z): 0.7 + 0.3 * (0.6 if x == z else 0.4) for x in (0, 1) for z in (0, 1)}
    for x in (0, 1):
        for z in (0, 1):
            given = [stay[x, y1] if z == x else 1 - stay[x, y1] for y1 in (0, 1)]
            logit += np.where((v[:, 6] == x) & (v[:, 7] == z), np.log(given[1] / given[0]), 0)
    assert np.abs(q - 1 / (1 + np.exp(-logit))).mean() < 0.02


def test_opening_voter_counts_first_words():
    import pyarrow as pa

    bad = "scum"
    texts = [f"{bad} " + "word " * 80, "word " * 80 + bad, "word " * 80, "word", f"word {bad}"]
    (t,) = C.chunks([pa.RecordBatch.from_pydict({"text": pa.array(texts)})])
    known = Terms(C.span_hashes(np.frombuffer(bad.encode(), np.uint8), np.array([0]), np.array([4])), np.ones(1))
    v = votes(t, known, _found(t, known))
    assert v[:, N_LEXICONS + PATTERNS.index("first_words")].tolist() == [1, 0, 0, -1, 1]


def test_decontamination(spark):
    rng = random.Random(12)
    items = [(i, " ".join(words(rng, rng.randrange(14, 60), 3000)) + ". " + " ".join(words(rng, 6, 3000)) + ".") for i in range(30)]
    items += [(90, None), (91, ""), (92, "only three words")]
    rows = [(i, " ".join(words(rng, rng.randrange(0, 400), 3000))) for i in range(60)]
    expected = set()
    for i in range(0, 60, 3):
        w = rows[i][1].split(" ")
        k = rng.randrange(30)
        text = items[k][1].upper().replace("É", "É") if i % 2 else items[k][1]
        at = rng.randrange(len(w) + 1)
        rows[i] = (i, " ".join([*w[:at], text if i % 2 == 0 else items[k][1].replace(",", " ,"), *w[at:]]))
        expected.add((i, k))
    rows += [(70, None), (71, ""), (72, "here only three words stand"), (None, items[2][1]), (73, items[3][1][: len(items[3][1]) // 2])]
    expected |= {(72, 92), (None, 2)}
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    found = contamination(table(spark, rows), bench)
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert got == expected
    clean = drop_contaminated(table(spark, rows), bench)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in expected}
    assert clean.columns == table(spark, rows).columns
    assert contamination(table(spark, rows), bench.limit(0)).count() == 0
    assert contamination(table(spark, rows).limit(0), bench).count() == 0


def by_exhaustive_bm25(rows, items, threshold):
    """(doc, passage start, item) whose BM25 score, as a share of the item's own, reaches the threshold."""

    def tokens(text):
        return ["".join(c for c in w) for w in re.sub(r"[^a-z0-9\x80-\U0010ffff]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")).split()]

    import math

    held = {i: w for i, t in items if (w := tokens(t))}
    mean, longest = sum(map(len, held.values())) / len(held), max(map(len, held.values()))
    df = {}
    for w in held.values():
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    weight = {}
    for i, w in held.items():
        raw = {x: math.log(1 + (len(held) - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x in set(w)}
        weight[i] = {x: v / sum(raw.values()) for x, v in raw.items()}
    out = {}
    for d, t in rows:
        w = tokens(t)
        for start in range(0, len(w), longest):
            passage = set(w[start : start + 2 * longest])
            for i, x in weight.items():
                if (score := sum(v for k, v in x.items() if k in passage)) >= threshold:
                    out[d, start, i] = score
    return out


def test_retrieval_equals_exhaustive_bm25(spark):
    import pyarrow as pa

    from fissure.llm.decontamination import _indexes

    rng = random.Random(16)
    items = [(i, " ".join(words(rng, rng.randrange(1, 40), 120))) for i in range(50)] + [(60, "only"), (61, "!?"), (62, "")]
    rows = [(i, " ".join(words(rng, rng.randrange(0, 300), 120))) for i in range(40)]
    for i in range(0, 40, 2):
        w = rows[i][1].split(" ")
        at = rng.randrange(len(w) + 1)
        some = rng.choice(items)[1].split(" ")
        rows[i] = (i, " ".join([*w[:at], *some[: rng.randrange(1, len(some) + 1)], *w[at:]]))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    (index,) = _indexes(bench, 0.6)
    (t,) = C.chunks([pa.RecordBatch.from_pydict({"text": pa.array([x for _, x in rows])})])
    wh, first = decontamination._hashes(t.data, t.off)
    got = {(d, s, index.ids[i]): x for d, s, i, x in zip(*(v.tolist() for v in index.retrieve(wh, first)))}
    expected = by_exhaustive_bm25(rows, items, 0.6)
    # The last half passage has no words of its own where the one before ends with the text.
    assert set(got) == set(expected) and len(got) > 20
    assert all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_parts_of_the_benchmark_change_no_score(spark, monkeypatch):
    rng = random.Random(18)
    items = [(f"item {i}", " ".join(words(rng, rng.randrange(10, 40), 300)) + ". " + " ".join(words(rng, 6, 300)) + ".") for i in range(40)]
    rows = [(i, " ".join(words(rng, 100, 300)) + " " + items[i][1]) for i in range(30)]
    w = items[30][1].split(" ")
    w[-3] = "changed"  # one word of a short answer
    rows.append((30, " ".join(w)))
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = [sorted(map(tuple, contamination(table(spark, rows), bench).collect()))]
    monkeypatch.setattr(decontamination, "MAX_INDEX_BYTES", 4000)
    found.append(sorted(map(tuple, contamination(table(spark, rows), bench).collect())))
    assert [r[:3] for r in found[0]] == [r[:3] for r in found[1]] and {(r[0], r[1]) for r in found[0]} >= {(i, items[i][0]) for i in range(31)}
    assert [r[3:] for r in found[0]] == [r[3:] for r in found[1]]


def test_many_languages(spark):
    rng = random.Random(19)
    stems = [[f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{k}q" for k in "xyz"] for i in range(300)]
    rows = [(i, " ".join(rng.choice(stems[i % 300]) for _ in range(30)), f"l{i % 300}") for i in range(1200)]
    found = identify_language(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).where("held_out").collect()
    assert np.mean([r["lang_pred"] == f"l{r['doc_id'] % 300}" for r in found]) > 0.9


def test_decoding_equals_a_loop():
    rng = np.random.default_rng(20)
    model = LanguageModel(list("abcde"), rng.integers(0, 50, (5, 1 << 15)).astype(float))
    margins = rng.normal(0, 1, (30, len(model.side)))
    for row, loss in zip(margins, model.decode(margins)):
        for code, x in zip(model.code, loss):
            assert abs(x - sum(w * np.log1p(np.exp(-4.0 * (1 if bit else -1) * m)) for bit, w, m in zip(code, model.side, row))) < 1e-9


def test_bins_close_at_production_size():
    rng = np.random.default_rng(21)
    lengths = np.minimum(4096, rng.lognormal(6.5, 1, 5000).astype(int) + 1)
    lengths = lengths[buffered(lengths, LOOK_AHEAD * 64)].tolist()
    bins, offsets = best_fit(lengths, 4096, 64)
    last = {b: i for i, b in enumerate(bins)}
    first = {b: i for i, b in reversed(list(enumerate(bins)))}
    used = np.bincount(bins, weights=lengths)
    for i in range(0, len(bins), 50):  # bins in use on both sides of a moment are open then
        assert sum(first[b] <= i < last[b] for b in last) <= 64
    assert best_fit(lengths, 4096, 1 << 30)[0] != bins and used.max() <= 4096
    assert max(bins) + 1 <= 1.01 * -(-sum(lengths) // 4096)


def test_chroma_search(spark):
    rng = np.random.default_rng(13)
    base = rng.normal(0, 0.25, (40, 64))
    rows = [(i, v) for i, v in enumerate(base)]
    rows += [(100 + i, base[i] + rng.normal(0, 0.003, 64)) for i in range(20)]  # near copies
    rows += [(200 + i, np.r_[base[i][8:], rng.normal(0, 0.25, 8)]) for i in range(20)]  # eight notes later
    rows += [(300, base[0]), (301, []), (302, None)]
    df = spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "vec_id bigint, embedding array<float>")
    codes = fingerprints(recordings_of(df)).cache()
    seq = {r["id"]: np.array(r["codes"], np.int64).astype(np.uint32) for r in codes.collect()}
    from pyspark.sql import functions as F

    found = align_recordings(codes, F.col("id") < 40).collect()
    rep = {r["id"]: r["other_id"] for r in found if r["kind"] == "member"}
    assert rep[300] == 0 and set(rep) == {i for i, _ in rows}
    got = {(r["id"], r["other_id"]): r for r in found if r["kind"] == "match"}
    close = set()
    for q in range(40):
        for r in {*rep.values()} - {q, 301, 302}:
            for shift in range(-32, 33):
                a, b = seq[q][max(0, -shift) :], seq[r][max(0, shift) :]
                n = min(len(a), len(b))
                if n >= 16 and np.bitwise_count(a[:n] ^ b[:n]).sum() <= 0.15 * 32 * n:
                    close.add((q, r))
    assert len(close & set(got)) >= 0.9 * len(close) and len(close) >= 30
    assert all(r["offset"] == -8 for (q, o), r in got.items() if 200 <= o < 220 and o == q + 200)
    assert align_recordings(codes.limit(0), F.col("id") < 40).count() == 0


def test_jaccard_refuses_thresholds_it_would_lose_links_at(spark):
    for num in (50, 79):
        with pytest.raises(ValueError):
            jaccard_components(table(spark, [(1, "a b c")]), 1, num, 100)
    jaccard_components(table(spark, [(1, "a b c")]), 1, 80, 100)


def test_chroma_search_is_exact(spark):
    """Sequences of several lengths against brute force: most pairs share no integer at all."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(17)
    base = rng.integers(0, 1 << 32, 90, np.uint64)
    seq = {}
    for i in range(60):
        a = rng.integers(0, 40)
        part = base[a : a + rng.integers(10, 51)]
        noise = (rng.random((len(part), 32)) < rng.choice([0.1, 0.2, 0.25, 0.3])) @ (1 << np.arange(32, dtype=np.uint64))
        seq[i] = (part ^ noise.astype(np.uint64)).astype(np.uint32)
    seq[60], seq[61] = seq[0][:0], np.r_[seq[1][:20], seq[2], seq[1]]
    codes = spark.createDataFrame([(i, c.astype(np.int32).tolist()) for i, c in seq.items()], "id bigint, codes array<int>")
    expected = {}
    for q in range(0, 62, 3):
        for r in set(seq) - {q}:
            good = []
            for o in range(-len(seq[q]), len(seq[r])):
                a, b = seq[q][max(0, -o) :], seq[r][max(0, o) :]
                n = min(len(a), len(b))
                if n >= 16 and (e := np.bitwise_count(a[:n] ^ b[:n]).sum() / (32 * n)) <= 0.25:
                    good.append((-int((a[:n] == b[:n]).sum()), e, abs(o), -o))
            if good:
                votes, e, _, o = min(good)
                expected[q, r] = (-o, -votes, e)
    found = align_recordings(codes, F.col("id") % 3 == 0).where("kind = 'match'").collect()
    assert {(r["id"], r["other_id"]): (r["offset"], r["votes"], r["bit_error"]) for r in found} == expected
    assert len(found) == len(expected) and sum(v == 0 for _, v, _ in expected.values()) > 20


def test_broken_audio():
    assert len(decode_wav(None)[0]) == len(decode_wav(b"RIFF junk")[0]) == 0
    assert len(fingerprint(chroma(np.zeros(0, np.float32), 4000))) == 0
    silent = fingerprint(chroma(np.zeros(20000, np.float32), 4000))
    assert len(silent) and len(set(silent.tolist())) == 1


def test_word_spans_stay_in_their_documents():
    data = np.frombuffer(b"ab cdef g", np.uint8)
    starts, ends, first = C.word_spans(data, np.array([0, 5, 5, 9]))
    assert [data[a:b].tobytes() for a, b in zip(starts, ends)] == [b"ab", b"cd", b"ef", b"g"]
    assert first.tolist() == [0, 2, 2, 4]
