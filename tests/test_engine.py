"""Operators of the engine: fixed graphs, edge cases, agreement of access paths."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fissure.functions.scalars import density, runtime_seconds
from fissure.operators import clustering, cracking, index, runs, tables
from fissure.plans import access, ranking, results, traversal
from fissure.sources import files, generators, graphs

# A well-known example graph of 11 pages and its ranks.
PAGES = [(2, 3), (3, 2), (4, 1), (4, 2), (5, 2), (5, 4), (5, 6), (6, 2), (6, 5), (7, 2), (7, 5), (8, 2), (8, 5), (9, 2), (9, 5), (10, 5), (11, 5)]
PAGE_RANKS = [0.02534, 0.29696, 0.26549, 0.03022, 0.06253, 0.03022, 0.01250, 0.01250, 0.01250, 0.01250, 0.01250]


def edges_of(spark, rows):
    return spark.createDataFrame(rows, tables.EDGE)


def column(df, name):
    return sorted(r[name] for r in df.collect())


def numbers(spark, values, name="id"):
    return spark.createDataFrame([(v,) for v in values], f"{name} bigint")


@pytest.mark.parametrize("variant", access.VARIANTS)
def test_pagerank_of_the_example(spark, variant):
    got = ranking.pagerank(numbers(spark, range(1, 12)), edges_of(spark, PAGES), 50, 0.001, variant)
    ranks = [r["rank"] for r in got.orderBy("id").collect()]
    assert ranks == pytest.approx(PAGE_RANKS, abs=0.001)
    assert sum(ranks) == pytest.approx(0.77325, abs=1e-3)


def test_pagerank_counts_updates(spark):
    v, e = numbers(spark, range(1, 12)), edges_of(spark, PAGES)
    by_steps = ranking.last_steps(v, e, 3, 12)[-1].orderBy("id").collect()
    assert ranking.pagerank(v, e, 2).orderBy("id").collect() == by_steps


def test_ranks_ignore_unknown_ends_and_lose_mass(spark):
    got = ranking.personrank(numbers(spark, [10, 20, 30]), edges_of(spark, [(10, 20), (10, 20), (10, 99), (77, 20), (30, 30)]), 0)
    ranks = {r["id"]: r["rank"] for r in got.collect()}
    third = 1 / 3
    assert ranks[10] == pytest.approx(0.05)
    assert ranks[20] == pytest.approx(0.05 + 0.85 * 2 * third / 3)
    assert ranks[30] == pytest.approx(0.05 + 0.85 * third)


@pytest.mark.parametrize("variant", access.VARIANTS)
@pytest.mark.parametrize("n", [2, 30])
def test_bfs_reaches_every_tree_node(spark, variant, n):
    tree = generators.random_tree(spark, n, seed=n)
    assert column(traversal.bfs_reach(tree, 1, variant), "node") == list(range(1, n + 1))


# Start and level sizes of six regression trees.
TREES = {
    "l_side_i_longer": (7, [1, 1, 5, 5, 8, 4, 2, 4]),
    "h_side_i_longer_overlap": (9, [1, 1, 2, 4, 3, 7, 3, 5, 4]),
    "h_side_h_longer": (25, [1, 1, 6, 6, 6, 8, 2]),
    "h_side_i_longer": (33, [1, 1, 5, 17, 14, 9, 3]),
    "h_side_i_longer_overlap_2": (12, [1, 1, 7, 5, 4, 7, 4, 1]),
    "l_side_i_longer_tessellating": (1, [1, 1, 3, 2, 16, 6, 1]),
}


def tree_of(start, sizes):
    """A tree over 1..n, edges in both directions, whose levels from start have the given sizes."""
    n = sum(sizes)
    ids = [start, *(i for i in range(n, 0, -1) if i != start)]
    levels, rows = [], []
    for size in sizes:
        levels.append([ids.pop(0) for _ in range(size)])
        if len(levels) > 1:
            for i, node in enumerate(levels[-1]):
                to = levels[-2][i * i % len(levels[-2])]
                rows += [(node, to), (to, node)]
    return rows


@pytest.mark.parametrize("variant", access.VARIANTS)
def test_regression_trees(spark, variant):
    for start, sizes in TREES.values():
        found = traversal.bfs_levels(edges_of(spark, tree_of(start, sizes)), start, variant).collect()
        assert sorted(r["node"] for r in found) == list(range(1, sum(sizes) + 1))
        assert [sum(r["level"] == k for r in found) for k in range(len(sizes))] == sizes


def test_large_graphs_take_the_distributed_plans(spark, monkeypatch):
    tree, graph = generators.random_tree(spark, 60, seed=1), generators.random_graph(spark, 40, 3, seed=2)
    v = numbers(spark, range(38))

    def results_():
        return [
            sorted(map(tuple, traversal.bfs_levels(tree, 3).collect())),
            sorted(map(tuple, traversal.bfs_levels(tree, 3, "preclustered_rle", 2).collect())),
            sorted(map(tuple, traversal.bfs_multi(graph, [0, 7, 99]).collect())),
            *([(r["id"], round(r["rank"], 12)) for r in ranking.pagerank(v, graph, 9, eps, name).orderBy("id").collect()] for eps in (None, 0.01) for name in ("unoptimised", "compactive")),
        ]

    in_one = results_()
    monkeypatch.setattr("fissure.plans.in_task.EDGES", -1)
    assert results_() == in_one


def test_a_second_select_reads_the_piece_that_the_first_one_left(spark):
    rows = spark.range(10000).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b")).coalesce(2)
    for policy in ("plain", "recognitive"):
        t = cracking.CrackedTable(rows, "a", policy)
        assert column(t.select(5000, "b"), "b") == [10000]
        assert column(t.select(7000, "b"), "b") == [14000] and column(t.select(7500, "b"), "b") == [15000]
        plan = t.select(7400, "b")
        assert column(plan, "b") == [14800]
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryTableScan" in text
        held = {(b, p.count()) for (p, _), b in zip(t._pieces, [0, *t._bounds])}
        assert (7001, 399) in held and (7401, 99) in held and (5001, 1999) in held
        t.close()
        assert not t._kept_pieces


def test_batches_read_the_pieces_of_their_keys(spark):
    rows = spark.range(8000).select((F.col("id") % 800).alias("a"), F.col("id").alias("b"))
    for policy in ("recognitive", "compactive"):
        t = cracking.CrackedTable(rows, "a", policy)
        t.crack_at_quantiles(rows.select("a"))
        keys = numbers(spark, [3, 5, 790], "node")
        found = t.select_many(keys, "b")
        assert column(found, "b") == sorted(x for k in (3, 5, 790) for x in range(k, 8000, 800))
        assert len(t.touched) == 2 and len(t._bounds) == 7
        t.close()


def test_scale_folders():
    assert graphs.scale_dir("/data", "0.01") == "/data/sf0.01"
    with pytest.raises(ValueError):
        graphs.scale_dir("/data", "7")


def test_insert_and_declare(spark):
    rows = spark.createDataFrame([(0, 1), (1, 2)], "pos bigint, a bigint")
    more = spark.createDataFrame([(0, 3)], "pos bigint, a bigint")
    three = spark.createDataFrame([(i, i * 5) for i in range(3)], "pos bigint, value bigint")
    got = tables.insert(rows, more, {"b": three}).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [(0, 1, 0), (1, 2, 5), (2, 3, 10)]
    assert tables.insert(rows, more).count() == 3
    assert tables.insert(rows, None, {"b": three.where("pos < 2")}).count() == 2
    for bad in ((rows, more, {"b": three.where("pos < 2")}), (rows, None, {"b": three}), (rows, more, {"a": three}), (rows, more.withColumnRenamed("a", "c"), None)):
        with pytest.raises(ValueError):
            tables.insert(*bad)
    assert tables.declare(tables.empty(spark), w="double").columns == ["src", "dst", "w"]
    with pytest.raises(ValueError):
        tables.declare(tables.empty(spark), src="bigint")
    with pytest.raises(ValueError):
        tables.declare(rows, w="bigint")


def test_bfs_edge_cases(spark):
    e = edges_of(spark, [(1, 2), (1, 2), (2, 2), (0, 5), (9, 1)])
    levels = {r["node"]: r["level"] for r in traversal.bfs_levels(e, 9).collect()}
    assert levels == {9: 0, 1: 1, 2: 2}
    assert column(traversal.bfs_reach(e, 42), "node") == [42]
    assert column(traversal.bfs_reach(e, 0, "compactive"), "node") == [0, 5]
    assert column(traversal.bfs_reach(tables.empty(spark), 3), "node") == [3]
    many = traversal.bfs_multi(e, [9, 2, 2])
    assert sorted((r["start"], r["node"]) for r in many.collect()) == [(2, 2), (9, 1), (9, 2), (9, 9)]
    assert traversal.bfs_until(e, 9, 60) == 3


@pytest.mark.parametrize("n,d", [(2, 1), (20, 5)])
def test_generated_graphs(spark, n, d):
    rows = [(r["src"], r["dst"]) for r in generators.random_graph(spark, n, d, seed=3).collect()]
    assert all(a != b for a, b in rows)
    assert {x for r in rows for x in r} == set(range(n))
    assert len(rows) % 2 == 0 and len(rows) >= d * n
    tree = [(r["src"], r["dst"]) for r in generators.random_tree(spark, 50, seed=3).collect()]
    assert len(tree) == 98 and set(tree) == {(b, a) for a, b in tree}
    assert generators.uniform_column(spark, 100, 0.3).agg(F.max("value")).first()[0] <= 3


@pytest.mark.parametrize("policy", cracking.POLICIES)
def test_selects_answer_alike(spark, policy):
    rows = [(v, i) for i, v in enumerate([5, 1, 5, 5, 9, 1, 3, 5])]
    t = cracking.CrackedTable(edges_of(spark, rows), "src", policy)
    for x in (5, 1, 4, 0, 10, 9, 5, 12, 5):
        assert column(t.select(x, "dst"), "dst") == sorted(d for v, d in rows if v == x)
    assert column(t.select_range(1, 5, "dst", low_in=False), "dst") == sorted(d for v, d in rows if 1 < v <= 5)
    assert t.select_range(5, 4).count() == 0
    assert column(t.select_granular(4, 3, "dst"), "dst") == sorted(d for v, d in rows if v // 3 == 1)
    assert sorted(map(tuple, t.rows().collect())) == sorted(rows)
    many = t.select_many(numbers(spark, [1, 9, 77, 1], "k"), "dst")
    assert sorted(map(tuple, many.collect())) == sorted((v, d) for v, d in rows if v in (1, 9))
    t.append(edges_of(spark, [(4, 100)]))
    assert column(t.select(4, "dst"), "dst") == [100]
    t.crack_on("dst")
    assert column(t.select(100, "src"), "src") == [4]


def test_catalogue_counts_values_below(spark):
    e = edges_of(spark, [(v, v) for v in (5, 1, 5, 9)])
    t = cracking.CrackedTable(e, "src")
    assert len(t.catalogue()) == 0
    t.select(5)
    t.select(5)
    assert t.hits == 1
    assert t.catalogue().keys() == [5, 6]
    assert [t.catalogue().get(k) for k in (5, 6)] == [1, 3]
    for x in range(20):
        t.select(x)
    assert column(t.select(9, "dst"), "dst") == [9]
    got = cracking.crack_three_counts(e, "src", [5, 7])
    assert sorted(map(tuple, got.collect())) == [(5, 1, 3), (7, 3, 3)]
    with pytest.raises(ValueError):
        cracking.CrackedTable(e, "nothing")


@pytest.mark.parametrize("policy", cracking.POLICIES)
def test_empty_and_uniform_tables(spark, policy):
    assert cracking.CrackedTable(tables.empty(spark), "src", policy).select(1).count() == 0
    t = cracking.CrackedTable(edges_of(spark, [(7, i) for i in range(300)]), "src", policy)
    assert t.select(7).count() == 300 and t.select(8).count() == 0 and t.select(6).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 99)), max_size=30), st.integers(-2, 33))
def test_index_bounds(entries, k):
    ix = index.CrackerIndex()
    for key, pos in entries:
        ix.insert(key, pos)
    last = dict(entries)
    below, above = [x for x in last if x <= k], [x for x in last if x >= k]
    assert ix.lower_bound(k) == (last[max(below)] if below else None)
    assert ix.upper_bound(k) == (last[min(above)] if above else None)
    assert ix.min_pair() == ((min(last), last[min(last)]) if last else None)
    assert ix.max_pair() == ((max(last), last[max(last)]) if last else None)
    ix.shift_above(k, 5)
    assert all(ix.get(x) == p - 5 * (x > k) for x, p in last.items())
    ix.delete(k)
    assert k not in ix and ix.get(k, -1) == -1


def test_index_tables_match_the_driver_side_index(spark):
    ix = index.CrackerIndex({10: 1, 20: 5, 30: 9})
    df = ix.to_df(spark)
    probes = [5, 10, 15, 30, 31]
    for f, g in ((index.lower_bound, ix.lower_bound), (index.upper_bound, ix.upper_bound)):
        assert dict(map(tuple, f(df, numbers(spark, probes, "x")).collect())) == {x: g(x) for x in probes}
    assert tuple(index.min_max(df).first()) == (10, 1, 30, 9)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_runs(spark, values):
    from itertools import groupby

    rows = spark.createDataFrame(list(enumerate(values)), "pos bigint, v bigint")
    expected, at = [], 0
    for v, g in groupby(values):
        n = len(list(g))
        expected.append((v, at, n))
        at += n
    old, runs.SLICE = runs.SLICE, 4
    try:
        found = runs.rle_runs(rows, "v")
        assert sorted((r["value"], r["start"], r["len"]) for r in found.collect()) == sorted(expected)
        ends = {(p, v, n) for v, s, n in expected for p in (s, s + n - 1)}
        assert {(r["pos"], r["value"], r["run_length"]) for r in runs.rle_markers(rows, "v").collect()} == ends
        parts = runs.split_runs(found, 2).collect()
        assert sum(r["len"] for r in parts) == len(values) and all(r["len"] <= 2 for r in parts)
    finally:
        runs.SLICE = old


def test_positions_and_gathers(spark):
    e = tables.with_pos(edges_of(spark, [(3, 1), (1, 2), (1, 1), (3, 1)]))
    rows = {r["pos"]: (r["src"], r["dst"]) for r in e.collect()}
    assert rows == {0: (1, 1), 1: (1, 2), 2: (3, 1), 3: (3, 1)}
    wanted = spark.createDataFrame([(0, 3), (1, 0), (2, 3)], "ord int, pos bigint")
    assert sorted(map(tuple, tables.gather(e, wanted, ["dst"]).collect())) == [(0, 1), (1, 1), (2, 1)]
    assert tables.rearrange(e, wanted).count() == 3
    wide = tables.add_column(e, e.select("pos", (F.col("pos") * 2).alias("w")), "w")
    assert column(wide, "w") == [0, 2, 4, 6]
    for bad in (lambda: tables.append(e, e.drop("src")), lambda: tables.add_column(e, e.limit(1).select("pos", F.lit(1).alias("w")), "w"),
                lambda: tables.add_column(e, e, "dst")):
        with pytest.raises(ValueError):
            bad()
    assert tables.with_pos(tables.empty(spark)).count() == 0
    assert [r["src"] for r in clustering.sort_values(e, "src").orderBy("pos").collect()] == [1, 1, 3, 3]


def test_files_round_trip(spark, tmp_path):
    people = spark.createDataFrame([(1, "Ann"), (2, "Bo")], "id bigint, name string")
    files.write_people(people, f"{tmp_path}/p")
    assert sorted(map(tuple, files.read_people(spark, f"{tmp_path}/p").collect())) == [(1, "Ann", "-"), (2, "Bo", "-")]
    (tmp_path / "k.csv").write_text("Person.id|Person.id|creationDate\n1|2|x\n2|1|y\n")
    assert sorted(map(tuple, files.read_edges(spark, f"{tmp_path}/k.csv").collect())) == [(1, 2), (2, 1)]
    (tmp_path / "bad.csv").write_text("id|firstName|lastName|gender|birthday|creationDate|locationIP|browserUsed\nx|a|b|c|d|e|f|g\n")
    with pytest.raises(Exception):
        files.read_people(spark, f"{tmp_path}/bad.csv").collect()
    files.write_graphviz(edges_of(spark, [(1, 2)]), f"{tmp_path}/g")
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/g").collect()) == ["1 -> 2;", "digraph {", "}"]


def test_results(spark):
    texts = spark.createDataFrame([("PT0.5S",), (None,)], "t string").select(runtime_seconds(F.col("t")).alias("s"))
    assert sorted([r["s"] for r in texts.collect()], key=str) == [0.5, None]
    left = spark.createDataFrame([(1, 2.0, 3.0), (2, 5.0, 6.0)], "k int, a double, b double")
    right = spark.createDataFrame([(1, None, 9.0)], "k int, a double, c double")
    assert sorted(map(tuple, results.merge(left, right, ["k"]).collect())) == [(1, None, 3.0, 9.0), (2, 5.0, 6.0, None)]
    assert spark.range(1).select(density(F.lit(6), F.lit(3)).alias("d")).first()["d"] == 1.0
    assert results.in_range(left, "a", 2, 5, ("b",)).columns == ["k", "a"]
