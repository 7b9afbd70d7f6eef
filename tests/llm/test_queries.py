"""Corpus queries against their SQL on the smallest tables, and the pipeline's stages on planted rows."""

import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from fissure.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs_and_equals_its_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in queries.oracle_sql():
        assert rows or name.startswith("op3")
        return
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    expected = [tuple(str(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    assert sorted(tuple(str(r[c]) for c in columns) for r in rows) == sorted(expected)


def test_pipeline_stages_equal_brute_force(spark):
    """Stages on texts with nulls, empty ones, repeated rows, groups of copies and of near copies."""
    from test_corpus import by_brute_force, corpus, split_words

    rng = random.Random(4)
    rows = corpus(5)
    base = " ".join(f"b{rng.randrange(300)}" for _ in range(150)).split(" ")
    for i in range(120):  # near copies, of which many are too far from each other
        w = list(base)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(len(w))] = f"c{rng.randrange(500)}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, " ".join(base)) for i in range(100)] + [(2000, " ".join(base)), (None, " ".join(base))]
    items = [(i, " ".join(f"t{rng.randrange(900)}" for _ in range(30)) + f". Then {i} is what the {i} answer says.") for i in range(5)]
    rows += [(3000 + i, f"before it {t} and after") for i, t in items]
    full = [(i, t, None, "s", len(t or "")) for i, t in rows]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(full, schema).repartition(3)
    once = lambda df: sorted(map(tuple, df.collect()), key=repr)

    least = {}
    for (i, _), (_, _, c) in zip(rows, by_brute_force(rows, 5, 80, 100)):
        least.setdefault(i, c)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert once(kept) == sorted((r for r in full if least[r[0]] == r[0]), key=repr) and kept.columns == docs.columns

    folder = corpus_pipeline.Folder(spark, "test")
    folder.write(spark.createDataFrame(items, "item_id bigint, text string"), "benchmark.parquet")
    clean = corpus_pipeline.benchmark(spark, docs, folder.path)
    held = [" ".join(x.decode().lower() for x in split_words(t)) for _, t in items]
    assert once(clean) == sorted((r for r in full if not any(h in (r[1] or "").lower() for h in held)), key=repr)

    packed = corpus_pipeline.packing(spark, docs, "").collect()
    assert sorted({r["doc_id"] for r in packed}, key=repr) == sorted({i for i, _ in rows}, key=repr)
    assert sum(r["piece"] == 0 for r in packed) == len(rows)

    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), folder.path)
        assert empty.count() == 0 and (name == "packing" or empty.columns == docs.columns)
        some = stage(spark, docs.where("doc_id < 12").withColumns({"rid": docs.doc_id, "tk": docs.text}), folder.path)
        assert name == "packing" or some.columns == docs.columns
    folder.drop("benchmark.parquet")


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).checkpoint()
    last = corpus_pipeline.packing(spark, docs, SF)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, last.collect()))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(1)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    some = sorted(i for i, t in texts.items() if len(t.split()) > 100 and "\n" in t)[:3]
    near = texts[some[1]].split(" ")
    near[rng.randrange(len(near))] = "odd"
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    planted = [
        (90001, texts[some[0]]), (90002, " ".join(near).replace("\n", " ")), (90003, texts[some[2]] + " " + item),
        (90004, "12 34 !"), (90005, None), (90006, ""),
    ]
    more = spark.createDataFrame([(i, t, None, "x", len(t or "")) for i, t in planted], docs.schema)
    now = docs.unionByName(more)
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF).checkpoint()
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
        left[name] = {r["doc_id"] for r in now.collect()}
    assert not left["language"] & {90004, 90005, 90006} and {90001, 90002, 90003} <= left["language"]
    assert 90001 not in left["lines"]  # a whole copy: nothing of it is left
    assert 90003 not in left["benchmark"]
    packed = corpus_pipeline.packing(spark, now, SF)
    assert {r["doc_id"] for r in packed.collect()} == left["benchmark"]
