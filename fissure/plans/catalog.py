"""The engine's own queries over the star-schema tables, and the SQL that says what each must return."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fissure.functions.scalars import density, runtime_seconds, vector_text
from fissure.operators import clustering, cracking, index, runs, tables
from fissure.plans import access, ranking, results, traversal
from fissure.plans.lineage import cut, shared_dir
from fissure.sources import files, generators, graphs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Views that the SQL texts use, each as a common table expression.
VIEWS = {
    "e": "SELECT a.l_partkey + 1 AS src, b.l_partkey + 1 AS dst FROM lineitem a JOIN lineitem b "
    "ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1",
    "ep": "SELECT row_number() OVER (ORDER BY src, dst) - 1 AS pos, src, dst FROM e",
    "v": "SELECT p_partkey + 1 AS id FROM part",
    "k": "SELECT src * 7 + 13 AS src, dst * 7 + 13 AS dst FROM (SELECT o_custkey AS src, "
    "lead(o_custkey) OVER (ORDER BY o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL",
    "p": "SELECT c_custkey * 7 + 13 AS id, c_name AS name FROM customer",
    "ix": "SELECT b.x AS key, (SELECT count(*) FROM e WHERE src < b.x) AS pos FROM (VALUES (50::BIGINT), (51), (120), (121)) b(x)",
    "by_dst": "SELECT row_number() OVER (ORDER BY dst, src) - 1 AS pos, src FROM e",
    "isl": "SELECT *, pos - row_number() OVER (PARTITION BY src ORDER BY pos) AS g FROM by_dst",
}
NEEDS = {"ep": ("e",), "ix": ("e",), "by_dst": ("e",), "isl": ("e", "by_dst")}
STARTS = "SELECT 1::BIGINT UNION SELECT e.dst FROM r JOIN e ON r.node = e.src"
INDEX_KEYS = [50, 51, 120, 121]
UPDATES = 5


def _with(views: str, sql: str, recursive: str = "") -> str:
    names: list[str] = []
    for v in views.split():
        names += [x for x in (*NEEDS.get(v, ()), v) if x not in names]
    parts = [f"{n} AS ({VIEWS[n]})" for n in names] + ([recursive] if recursive else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {sql}" if parts else sql


def query(name: str, oracle: str | None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


def _wanted(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(0, 5), (1, 1), (2, 5), (3, 0)], "ord int, pos bigint")


# --- tables


@query("edge_table", _with("e", "SELECT src, dst FROM e"))
def edge_table(s, d):
    return tables.edge_table(graphs.co_edges(s, d))


@query("table_append", _with("e", "SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e"))
def table_append(s, d):
    e = graphs.co_edges(s, d)
    return tables.append(e, e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@query("table_add_column", _with("ep", "SELECT src, dst, pos AS w FROM ep"))
def table_add_column(s, d):
    e = tables.with_pos(graphs.co_edges(s, d))
    return tables.add_column(e, e.select("pos", F.col("pos").alias("w")), "w").select("src", "dst", "w")


@query("project_col", _with("e", "SELECT dst FROM e"))
def project_col(s, d):
    return graphs.co_edges(s, d).select("dst")


@query(
    "gather_col",
    _with("ep", "SELECT i.o AS ord, ep.dst FROM (SELECT unnest([5, 1, 5, 0]) AS pos, unnest([0, 1, 2, 3]) AS o) i JOIN ep USING (pos)"),
)
def gather_col(s, d):
    return tables.gather(tables.with_pos(graphs.co_edges(s, d)), _wanted(s), ["dst"])


@query(
    "gather_rows",
    _with("ep", "SELECT i.o AS ord, ep.src, ep.dst FROM (SELECT unnest([5, 1, 5, 0]) AS pos, unnest([0, 1, 2, 3]) AS o) i JOIN ep USING (pos)"),
)
def gather_rows(s, d):
    return tables.gather(tables.with_pos(graphs.co_edges(s, d)), _wanted(s))


@query("rearrange_rows", _with("ep", "SELECT row_number() OVER (ORDER BY pos DESC) - 1 AS pos, src, dst FROM ep"))
def rearrange_rows(s, d):
    e = tables.with_pos(graphs.co_edges(s, d))
    back = tables.with_place(e.select("pos"), [F.col("pos").desc()], "ord")
    return tables.rearrange(e, back)


@query("count_col_eq", _with("e", "SELECT count(*) AS n FROM e WHERE src = 50"))
def count_col_eq(s, d):
    return tables.count_equal(graphs.co_edges(s, d), "src", 50)


@query("column_at", _with("ep", "SELECT dst FROM ep WHERE pos = 7"))
def column_at(s, d):
    return tables.value_at(tables.with_pos(graphs.co_edges(s, d)), "dst", 7)


# --- selection


def _select(variant: str) -> Query:
    def run(s, d):
        t = cracking.CrackedTable(graphs.co_edges(s, d), "src", variant)
        t.select(50, "dst")
        return t.select(50, "dst").unionAll(t.select(120, "dst"))

    return run


for _policy in ("plain", "recognitive", "compactive", "underswap", "overswap"):
    query(f"select_{_policy}", _with("e", "SELECT dst FROM e WHERE src IN (50, 120)"))(_select(_policy))


@query("select_range", _with("e", "SELECT src, dst FROM e WHERE src >= 50 AND src < 60"))
def select_range(s, d):
    return cracking.CrackedTable(graphs.co_edges(s, d), "src").select_range(50, 60, high_in=False)


@query("select_granular", _with("e", "SELECT src, dst FROM e WHERE src // 10 = 5"))
def select_granular(s, d):
    return cracking.CrackedTable(graphs.co_edges(s, d), "src").select_granular(50, 10)


@query(
    "crack_three_counts",
    _with(
        "e",
        "SELECT b.x AS key, (SELECT count(*) FROM e WHERE src < b.x) AS pos_lo, (SELECT count(*) FROM e WHERE src <= b.x) AS pos_hi "
        "FROM (VALUES (50::BIGINT), (120)) b(x)",
    ),
)
def crack_three_counts(s, d):
    return cracking.crack_three_counts(graphs.co_edges(s, d), "src", [50, 120])


def _by_dst(s: SparkSession, d: str) -> DataFrame:
    return clustering.precluster(graphs.co_edges(s, d), "dst")


@query("rle_runs", _with("isl", "SELECT src AS value, min(pos) AS start, count(*) AS len FROM isl GROUP BY src, g"))
def rle_runs(s, d):
    return runs.rle_runs(_by_dst(s, d), "src")


@query(
    "rle_markers",
    _with(
        "isl",
        "SELECT pos, src AS value, count(*) OVER (PARTITION BY src, g) AS run_length FROM isl "
        "QUALIFY pos = min(pos) OVER (PARTITION BY src, g) OR pos = max(pos) OVER (PARTITION BY src, g)",
    ),
)
def rle_markers(s, d):
    return runs.rle_markers(_by_dst(s, d), "src")


@query("compact_column", _with("ep", "SELECT src AS key, min(pos) AS ofs, count(*) AS len FROM ep GROUP BY src"))
def compact_column(s, d):
    return runs.compact(tables.with_pos(graphs.co_edges(s, d)), "src")


@query("decompress_values", _with("ep", "SELECT dst FROM ep WHERE src = 50"))
def decompress_values(s, d):
    base = tables.with_pos(graphs.co_edges(s, d))
    return runs.decompress(runs.compact(base, "src").where("key = 50"), base, ["dst"])


@query("decompress_rows", _with("ep", "SELECT src, dst FROM ep WHERE src = 50"))
def decompress_rows(s, d):
    base = tables.with_pos(graphs.co_edges(s, d))
    return runs.decompress(runs.compact(base, "src").where("key = 50"), base, ["src", "dst"])


# --- ordered index


def _index(s: SparkSession, d: str) -> DataFrame:
    return index.index_of(graphs.co_edges(s, d), "src", INDEX_KEYS)


def _numbers(s: SparkSession, values: list[int], name: str) -> DataFrame:
    return s.createDataFrame([(v,) for v in values], f"{name} bigint")


@query("index_build", _with("ix", "SELECT key, pos FROM ix"))
def index_build(s, d):
    return _index(s, d)


@query("index_get_or", _with("ix", "SELECT x AS key, coalesce(pos, -1) AS pos FROM (VALUES (50::BIGINT), (77)) t(x) LEFT JOIN ix ON key = x"))
def index_get_or(s, d):
    return index.get_or(_index(s, d), _numbers(s, [50, 77], "key"), -1)


@query("index_delete", _with("ix", "SELECT key, pos FROM ix WHERE key <> 51"))
def index_delete(s, d):
    return index.delete(_index(s, d), _numbers(s, [51], "key"))


@query(
    "index_lower_bound",
    _with("ix", "SELECT x, (SELECT max_by(pos, key) FROM ix WHERE key <= x) AS pos FROM (VALUES (49::BIGINT), (60), (121)) t(x)"),
)
def index_lower_bound(s, d):
    return index.lower_bound(_index(s, d), _numbers(s, [49, 60, 121], "x"))


@query(
    "index_upper_bound",
    _with("ix", "SELECT x, (SELECT min_by(pos, key) FROM ix WHERE key >= x) AS pos FROM (VALUES (49::BIGINT), (60), (122)) t(x)"),
)
def index_upper_bound(s, d):
    return index.upper_bound(_index(s, d), _numbers(s, [49, 60, 122], "x"))


@query("index_shift", _with("ix", "SELECT key, CASE WHEN key > 51 THEN pos - 10 ELSE pos END AS pos FROM ix"))
def index_shift(s, d):
    return index.shift_above(_index(s, d), 51, 10)


@query(
    "index_minmax",
    _with("ix", "SELECT min(key) AS kmin, min_by(pos, key) AS pmin, max(key) AS kmax, max_by(pos, key) AS pmax FROM ix"),
)
def index_minmax(s, d):
    return index.min_max(_index(s, d))


# --- layouts


@query("precluster_src", _with("e", "SELECT row_number() OVER (ORDER BY src, dst) - 1 AS pos, src, dst FROM e"))
def precluster_src(s, d):
    return clustering.precluster(graphs.co_edges(s, d), "src")


@query("precluster_dst", _with("e", "SELECT row_number() OVER (ORDER BY dst, src) - 1 AS pos, src, dst FROM e"))
def precluster_dst(s, d):
    return clustering.precluster(graphs.co_edges(s, d), "dst")


@query("sort_values", _with("e", "SELECT row_number() OVER (ORDER BY src) - 1 AS pos, src FROM e"))
def sort_values(s, d):
    return clustering.sort_values(graphs.co_edges(s, d), "src")


@query("sorted_lookup", _with("ep", "SELECT dst FROM ep WHERE src = 50"))
def sorted_lookup(s, d):
    return clustering.equal_range(clustering.clustered(graphs.co_edges(s, d), "src"), "src", 50, "dst")


@query("adjacency_list", _with("e", "SELECT src, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS dsts FROM e GROUP BY src"))
def adjacency_list(s, d):
    return clustering.adjacency_list(graphs.co_edges(s, d)).select("src", F.array_join(F.col("dsts").cast("array<string>"), ",").alias("dsts"))


@query("adjacency_lookup", _with("e", "SELECT dst FROM e WHERE src = 50"))
def adjacency_lookup(s, d):
    return clustering.adjacency_lookup(clustering.adjacency_list(graphs.co_edges(s, d)), 50)


# --- traversal


@query("frontier_step", _with("e", "SELECT DISTINCT dst AS node FROM e WHERE src IN (1, 2, 3) AND dst NOT IN (1, 2, 3)"))
def frontier_step(s, d):
    at = _numbers(s, [1, 2, 3], "node")
    return traversal.frontier_step(graphs.co_edges(s, d), at, at)


def _bfs(variant: str) -> Query:
    return lambda s, d: traversal.bfs_reach(graphs.co_edges(s, d), 1, variant)


for _variant in access.VARIANTS:
    query(f"bfs_reach_{_variant}", _with("e", "SELECT node FROM r", f"r(node) AS ({STARTS})"))(_bfs(_variant))


@query(
    "bfs_levels",
    _with(
        "e",
        "SELECT node, min(lvl) AS level FROM r GROUP BY node",
        "r(node, lvl) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, lvl + 1 FROM r JOIN e ON r.node = e.src WHERE lvl < 8)",
    ),
)
def bfs_levels(s, d):
    return traversal.bfs_levels(graphs.co_edges(s, d), 1)


@query(
    "bfs_multi",
    _with(
        "e",
        "SELECT start, count(*) AS reached FROM r GROUP BY start",
        "r(start, node) AS (SELECT unnest([1, 2, 3])::BIGINT, unnest([1, 2, 3])::BIGINT "
        "UNION SELECT r.start, e.dst FROM r JOIN e ON r.node = e.src)",
    ),
)
def bfs_multi(s, d):
    return traversal.bfs_multi(graphs.co_edges(s, d), [1, 2, 3]).groupBy("start").agg(F.count("*").alias("reached"))


@query("bfs_query_count", _with("e", "SELECT count(*) AS selects FROM r", f"r(node) AS ({STARTS})"))
def bfs_query_count(s, d):
    return s.createDataFrame([(traversal.bfs_until(graphs.co_edges(s, d), 1, 3600.0, "recognitive"),)], "selects bigint")


@query(
    "bfs_geo_tree",
    "SELECT id AS node FROM (SELECT 1::BIGINT AS id UNION ALL SELECT r_regionkey + 2 FROM region "
    "UNION ALL SELECT n_nationkey + 7 FROM nation UNION ALL SELECT c_custkey + 32 FROM customer)",
)
def bfs_geo_tree(s, d):
    return traversal.bfs_reach(graphs.geo_tree(s, d), 1, "preclustered_rle")


# --- ranking


def _chain(vertices: str, edges: str, n: str, updates: int = UPDATES) -> str:
    """Common table expressions r0 to r<updates>."""
    parts = [
        f"d AS (SELECT src, count(*) AS deg FROM {edges} GROUP BY src)",
        f"r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM {vertices}) AS r FROM {vertices})",
    ]
    for i in range(updates):
        parts.append(
            f"r{i + 1} AS MATERIALIZED (SELECT x.id, 0.15::DOUBLE / ({n}) + 0.85::DOUBLE * coalesce(s, 0) AS r FROM {vertices} x "
            f"LEFT JOIN (SELECT g.dst, sum(q.r / d.deg) AS s FROM {edges} g JOIN d USING (src) JOIN r{i} q ON q.id = g.src GROUP BY g.dst) y "
            "ON y.dst = x.id)"
        )
    return ", ".join(parts)


def _ranked(views: str, chain: str, sql: str) -> str:
    head = _with(views, "")
    return f"{head.rstrip()}, {chain} {sql}"


PAGERANK_CHAIN = _chain("v", "e", "(SELECT count(*) FROM v) + 1")
PERSONRANK_CHAIN = _chain("p", "k", "SELECT count(*) FROM p")


def _rounded(ranks: DataFrame) -> DataFrame:
    return ranks.select("id", F.round("rank", 10).alias("rank"))


def _pagerank(variant: str) -> Query:
    return lambda s, d: _rounded(ranking.pagerank(graphs.co_vertices(s, d), graphs.co_edges(s, d), UPDATES - 1, None, variant))


def _personrank(variant: str) -> Query:
    return lambda s, d: _rounded(ranking.personrank(graphs.persons(s, d), graphs.knows(s, d), UPDATES - 1, variant))


for _variant in access.VARIANTS:
    query(f"pagerank_{_variant}", _ranked("e v", PAGERANK_CHAIN, f"SELECT id, round(r, 10) AS rank FROM r{UPDATES}"))(_pagerank(_variant))
    if _variant != "preclustered_rle":
        query(f"personrank_{_variant}", _ranked("k p", PERSONRANK_CHAIN, f"SELECT id, round(r, 10) AS rank FROM r{UPDATES}"))(
            _personrank(_variant)
        )


EPSILON_UPDATES = 51
EPSILON = _ranked(
    "e v",
    _chain("v", "e", "(SELECT count(*) FROM v) + 1", EPSILON_UPDATES)
    + ", deltas AS ("
    + " UNION ALL ".join(f"SELECT {k} AS k, sqrt(sum(power(a.r - b.r, 2))) AS delta FROM r{k - 1} a JOIN r{k} b USING (id)" for k in range(1, EPSILON_UPDATES + 1))
    + f"), done AS (SELECT coalesce(min(k) FILTER (delta < 0.001), {EPSILON_UPDATES}) AS k FROM deltas), every AS ("
    + " UNION ALL ".join(f"SELECT {k} AS k, id, r FROM r{k}" for k in range(1, EPSILON_UPDATES + 1))
    + ")",
    "SELECT id, round(r, 10) AS rank FROM every JOIN done USING (k)",
)


@query("pagerank_epsilon", EPSILON)
def pagerank_epsilon(s, d):
    return _rounded(ranking.pagerank(graphs.co_vertices(s, d), graphs.co_edges(s, d), 50, 0.001))


@query(
    "rank_delta",
    _ranked("e v", PAGERANK_CHAIN, f"SELECT round(sqrt(sum(power(a.r - b.r, 2))), 10) AS delta FROM r{UPDATES - 1} a JOIN r{UPDATES} b USING (id)"),
)
def rank_delta(s, d):
    v = graphs.co_vertices(s, d)
    steps = ranking.last_steps(v, graphs.co_edges(s, d), UPDATES, v.count() + 1)
    return ranking.rank_delta(*steps).select(F.round("delta", 10).alias("delta"))


@query("personrank_agree", "SELECT * FROM (VALUES " + ", ".join(f"('{v}', true)" for v in access.VARIANTS if v not in ("preclustered", "preclustered_rle")) + ") t(variant, agrees)")
def personrank_agree(s, d):
    people, edges = graphs.persons(s, d), graphs.knows(s, d)
    sure = ranking.personrank(people, edges, UPDATES - 1, "preclustered").withColumnRenamed("rank", "sure")
    out = None
    for v in access.VARIANTS:
        if v in ("preclustered", "preclustered_rle"):
            continue
        both = sure.join(ranking.personrank(people, edges, UPDATES - 1, v), "id", "full")
        close = F.coalesce(F.abs(F.col("rank") - F.col("sure")) <= 1e-5, F.lit(False))
        one = both.agg(F.lit(v).alias("variant"), F.min(close).alias("agrees"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "inherit_sum",
    _with(
        "e v",
        "SELECT dst AS id, round(sum((1.0::DOUBLE / (SELECT count(*) FROM v)) / deg), 10) AS inherited FROM e "
        "JOIN (SELECT src, count(*) AS deg FROM e GROUP BY src) USING (src) GROUP BY dst",
    ),
)
def inherit_sum(s, d):
    e, v = graphs.co_edges(s, d), graphs.co_vertices(s, d)
    links = e.join(ranking.out_degree(e), "src")
    got = ranking.inherit(links, ranking.initial_ranks(v, v.count()))
    return got.select("id", F.round("inherited", 10).alias("inherited"))


@query("out_degree", _with("e", "SELECT src, count(*) AS degree FROM e GROUP BY src"))
def out_degree(s, d):
    return ranking.out_degree(graphs.co_edges(s, d))


@query("out_degree_vertices", _with("k p", "SELECT p.id, count(k.src) AS degree FROM p LEFT JOIN k ON k.src = p.id GROUP BY p.id"))
def out_degree_vertices(s, d):
    return ranking.out_degree_of(graphs.persons(s, d), graphs.knows(s, d))


@query(
    "graph_density",
    _with("e v", "SELECT round(ne::DOUBLE / (nv * (nv - 1)), 12) AS density FROM (SELECT (SELECT count(*) FROM e) AS ne, (SELECT count(*) FROM v) AS nv)"),
)
def graph_density(s, d):
    n = graphs.co_vertices(s, d).agg(F.count("*").alias("nv"))
    m = graphs.co_edges(s, d).agg(F.count("*").alias("ne"))
    return m.crossJoin(n).select(F.round(density(F.col("ne"), F.col("nv")), 12).alias("density"))  # one row each


# --- sources, sinks, results


def _folder(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s).rstrip('/')}/fissure-{name}-{uuid.uuid4().hex}"


@query("src_person_csv", _with("p", "SELECT id, name FROM p"))
def src_person_csv(s, d):
    path = _folder(s, "people")
    files.write_people(graphs.persons(s, d), path)
    return files.read_people(s, path).select("id", F.col("first_name").alias("name"))


@query("src_knows_csv", _with("k", "SELECT src, dst FROM k"))
def src_knows_csv(s, d):
    path = _folder(s, "knows")
    files.write_friendships(graphs.knows(s, d), path)
    return files.read_edges(s, path)


@query("graphviz_lines", _with("e", "SELECT concat(src, ' -> ', dst, ';') AS line FROM e"))
def graphviz_lines(s, d):
    return files.graphviz_lines(graphs.co_edges(s, d))


@query("bench_parse", "SELECT v AS raw, substr(v, 3, length(v) - 3)::DOUBLE AS secs FROM (VALUES ('PT0.5S'), ('PT12.25S')) t(v)")
def bench_parse(s, d):
    return s.createDataFrame([("PT0.5S",), ("PT12.25S",)], "raw string").select("raw", runtime_seconds(F.col("raw")).alias("secs"))


def _bench_rows(s: SparkSession) -> DataFrame:
    texts = ["PT0.5S", "PT12.25S"]
    rows = [(n, 2 * n - 2, 0.5, *([texts[i]] * len(files.BENCH_VARIANTS))) for i, n in enumerate((10, 20))]
    return s.createDataFrame(rows, files.BENCH)


@query(
    "bench_load",
    "SELECT n AS nodes, 2 * n - 2 AS edges, 0.5::DOUBLE AS density, x AS unoptimised, x AS overswaprle "
    "FROM (VALUES (10::BIGINT, 0.5::DOUBLE), (20, 12.25)) t(n, x)",
)
def bench_load(s, d):
    path = _folder(s, "bench")
    files.write_bench(_bench_rows(s), path)
    out = results.parse_runtimes(files.read_bench(s, path))
    return out.select("nodes", "edges", "density", "unoptimised", F.col("overswapRLE").alias("overswaprle"))


@query("bench_upsert", "SELECT * FROM (VALUES (10::BIGINT, 0.5::DOUBLE), (20, 12.25), (10, 0.5), (20, 12.25)) t(nodes, secs)")
def bench_upsert(s, d):
    path = _folder(s, "results")
    rows = results.parse_runtimes(_bench_rows(s)).select("nodes", F.col("unoptimised").alias("secs"))
    files.upsert(rows, path)
    files.upsert(rows, path)
    return s.read.parquet(path)


@query(
    "bench_merge",
    "SELECT nodes, edges, density, coalesce(r.a, l.a) AS a, r.b FROM (VALUES (10::BIGINT, 18::BIGINT, 0.5::DOUBLE, 1.0::DOUBLE), (20, 38, 0.5, 2.0)) "
    "l(nodes, edges, density, a) LEFT JOIN (VALUES (10::BIGINT, 18::BIGINT, 0.5::DOUBLE, 7.0::DOUBLE, 8.0::DOUBLE)) r(nodes, edges, density, a, b) "
    "USING (nodes, edges, density)",
)
def bench_merge(s, d):
    left = s.createDataFrame([(10, 18, 0.5, 1.0), (20, 38, 0.5, 2.0)], "nodes bigint, edges bigint, density double, a double")
    right = s.createDataFrame([(10, 18, 0.5, 7.0, 8.0), (10, 18, 0.5, 9.0, 9.0)], "nodes bigint, edges bigint, density double, a double, b double")
    return results.merge(left, right, ["nodes", "edges", "density"])


@query("bench_drop", "SELECT * FROM (VALUES (10::BIGINT), (20)) t(nodes)")
def bench_drop(s, d):
    return results.drop_columns(_bench_rows(s), "edges", "density", *files.BENCH_VARIANTS)


@query("bench_range", "SELECT nodes FROM (VALUES (10::BIGINT), (20), (30)) t(nodes) WHERE nodes BETWEEN 10 AND 20")
def bench_range(s, d):
    return results.in_range(_numbers(s, [10, 20, 30], "nodes"), "nodes", 10, 20)


def _graph_props(edges: DataFrame, start: int) -> DataFrame:
    """Counts of a generated graph; ends are united for reach, so connectivity is weak."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    reached = traversal.bfs_reach(edges.unionAll(back), start).agg(F.count("*").alias("reached"))
    loops = F.count_if(F.col("src") == F.col("dst")).alias("loops")
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).agg(
        F.count_distinct("id").alias("nodes"), F.min("id").alias("least"), F.max("id").alias("most")
    )
    return edges.agg(F.count("*").alias("edges"), loops).crossJoin(ids).crossJoin(reached)  # one row each


@query("gen_tree_props", "SELECT 198::BIGINT AS edges, 0::BIGINT AS loops, 100::BIGINT AS nodes, 1::BIGINT AS least, 100::BIGINT AS most, 100::BIGINT AS reached")
def gen_tree_props(s, d):
    return _graph_props(generators.random_tree(s, 100, seed=7), 1)


@query("gen_graph_props", "SELECT 100::BIGINT AS edges, 0::BIGINT AS loops, 20::BIGINT AS nodes, 0::BIGINT AS least, 19::BIGINT AS most, 20::BIGINT AS reached")
def gen_graph_props(s, d):
    return _graph_props(generators.random_graph(s, 20, 5, seed=7), 0)


@query("shuffle_pairs", _with("e", "SELECT row_number() OVER (ORDER BY src, dst) - 1 AS place, src, dst, true AS moved FROM e"))
def shuffle_pairs(s, d):
    """Places are dealt anew, each once, and few rows keep theirs; the bag is as it was."""
    e = graphs.co_edges(s, d)
    dealt = generators.shuffled_pairs(e, 5)
    stays = tables.with_pos(e).join(dealt, ["pos", "src", "dst"]).agg(F.count("*").alias("stays"))
    places = dealt.agg(F.count_distinct("pos").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("m"))
    good = (F.col("stays") < 100) & (F.col("n") == F.col("m")) & (F.col("lo") == 0) & (F.col("hi") == F.col("m") - 1)
    moved = stays.crossJoin(places).select(good.alias("moved"))  # one row each
    return tables.with_place(dealt.select("src", "dst"), ["src", "dst"], "place").select("place", "src", "dst").crossJoin(F.broadcast(moved))


@query("deal", "SELECT 1000::BIGINT AS n, 1000::BIGINT AS places, 0::BIGINT AS least, 999::BIGINT AS most, 499500::BIGINT AS total, true AS shuffled, true AS seeded")
def deal(s, d):
    one, other = generators.deal(s, 1000, 1), generators.deal(s, 1000, 2).withColumnRenamed("value", "again")
    both = one.join(other, "pos")
    return both.agg(
        F.count("*").alias("n"), F.count_distinct("value").alias("places"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.sum("value").alias("total"), (F.count_if(F.col("pos") == F.col("value")) < 50).alias("shuffled"),
        (F.count_if(F.col("value") == F.col("again")) < 50).alias("seeded"),
    )


@query(
    "table_insert",
    _with("ep", "SELECT pos, src, dst, pos * 10 AS w FROM ep UNION ALL SELECT (SELECT count(*) FROM ep) + pos, dst, src, ((SELECT count(*) FROM ep) + pos) * 10 FROM ep WHERE pos < 3"),
)
def table_insert(s, d):
    rows = tables.with_pos(graphs.co_edges(s, d))
    more = rows.where("pos < 3").select("pos", F.col("dst").alias("src"), F.col("src").alias("dst"))
    values = s.range(rows.count() + 3).select(F.col("id").alias("pos"), (F.col("id") * 10).alias("value"))
    return tables.insert(rows, more, {"w": values}).select("pos", "src", "dst", "w")


@query("table_declare", _with("e", "SELECT src, dst, NULL::BIGINT AS w FROM e"))
def table_declare(s, d):
    return tables.append(tables.declare(tables.empty(s), w="bigint"), graphs.co_edges(s, d).withColumn("w", F.lit(None).cast("bigint")))


@query("sort_by_comparator", _with("e", "SELECT row_number() OVER (ORDER BY src % 10 DESC, src) - 1 AS pos, src FROM e"))
def sort_by_comparator(s, d):
    return clustering.sort_by(graphs.co_edges(s, d), "src", (F.col("src") % 10).desc())


@query("vector_text", "SELECT x AS line FROM (VALUES ('1.25 0.3333 2.0000'), ('7.0'), ('')) t(x)")
def vector_text_lines(s, d):
    rows = s.createDataFrame([([1.25, 1 / 3, 2.0],), ([7.0],), ([],)], "v array<double>")
    return rows.select(vector_text(F.col("v")).alias("line"))


@query("results_load", "SELECT 15.0::DOUBLE AS nodes, 6.375::DOUBLE AS unoptimised")
def results_load(s, d):
    path = _folder(s, "kept")
    results.parse_runtimes(_bench_rows(s)).write.parquet(f"{path}/value")
    return results.mean_of(results.load(s, path, "value")["value"], "nodes", "unoptimised")


@query("bench_saved", "SELECT * FROM (VALUES ('sf', 'a', 0.5::DOUBLE), ('sf', 'b', 2.0)) t(sf, name, seconds)")
def bench_saved(s, d):
    path = _folder(s, "saved")
    files.upsert(results.bench_rows(s, '{"sf": "sf", "queries": {"b": 2, "a": 0.5}, "unit": "sec"}'), path)
    return s.read.parquet(path)


@query("bench_reorder", "SELECT 0.5::DOUBLE AS d, n AS v, 2 * n - 2 AS e FROM (VALUES (10::BIGINT), (20)) t(n)")
def bench_reorder(s, d):
    rows = _bench_rows(s).select("nodes", "edges", "density")
    merged = results.merge(rows, rows.withColumn("extra", F.lit(1)), ["nodes", "edges", "density"], ["density", "nodes", "edges"])
    return results.parse_runtimes(merged, ["d", "v", "e"])


@query("select_pruned", _with("e", "SELECT src AS key, dst, 1 AS touched FROM e WHERE src IN (1, 2)"))
def select_pruned(s, d):
    """A batch of low keys on a table cracked at quantiles reads one piece of it."""
    e = graphs.co_edges(s, d)
    table = cracking.CrackedTable(e, "src", "recognitive")
    table.crack_at_quantiles(e.select("src"))
    found = cut(table.select_many(_numbers(s, [1, 2], "node"), "dst")).withColumn("touched", F.lit(len(table.touched)))
    table.close()
    return found


@query(
    "uniform_tighten",
    "SELECT 100000::BIGINT AS n, true AS spread, true AS narrow",
)
def uniform_tighten(s, d):
    """A select on a uniform column: its piece is about the asked share, and nothing else."""
    rows = generators.uniform_column(s, 100_000, 0.01, seed=3)
    table = cracking.CrackedTable(rows, "value", "recognitive")
    found = table.select(1).agg(F.count("*").alias("k"), F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    table.close()
    values = rows.agg(F.count("*").alias("n"), (F.count_distinct("value") == 100).alias("spread"))
    return values.withColumn("narrow", F.lit(found["lo"] == found["hi"] == 1 and 800 < found["k"] < 1200))
