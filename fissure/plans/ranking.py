"""Link analysis: synchronous PageRank over explicit vertices.

Graphs of bounded size run all steps in one task (``in_task``).  Larger ones take a plan for each step: edges
meet their source's out-degree once and are kept, dealt by source, like the vertices; a step is one join, one
aggregation and one left join, and every ``CUT`` steps end in a checkpoint.  Mass of vertices without
out-edges is lost, parallel edges count, edges with an end outside the vertices are ignored.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fissure.plans import in_task
from fissure.plans.access import AccessPath
from fissure.plans.lineage import cut

DAMPING = 0.85
CUT = 4


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


def out_degree_of(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree) of all vertices, 0 without out-edges; other sources are ignored."""
    degree = out_degree(edges).withColumnRenamed("src", "id")
    return vertices.select("id").join(degree, "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("bigint")).alias("degree"))


def initial_ranks(vertices: DataFrame, n: int) -> DataFrame:
    return vertices.select("id", F.lit(1.0 / n).alias("rank"))


def inherit(links: DataFrame, ranks: DataFrame) -> DataFrame:
    """(id, inherited): the sum of rank / degree over in-edges; links are (src, dst, degree)."""
    shares = links.join(ranks.withColumnRenamed("id", "src"), "src")
    return shares.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("degree")).alias("inherited"))


def rank_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """The length of the difference of two rank vectors."""
    both = old.select("id", F.col("rank").alias("a")).join(new.select("id", F.col("rank").alias("b")), "id")
    return both.agg(F.sqrt(F.sum(F.pow(F.col("a") - F.col("b"), 2))).alias("delta"))


def last_steps(
    vertices: DataFrame,
    edges: DataFrame,
    updates: int,
    base_n: int | None = None,
    variant: str = "unoptimised",
    epsilon: float | None = None,
    path: AccessPath | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The last two rank tables (id, rank); ``base_n`` divides the base share (default: |V|).

    With ``epsilon``, stops after the step that moved less than it.  Edges are read from ``path``, or from a
    path of the variant that is made for this call.
    """
    vertices = vertices.select("id").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    own = path is None
    path = path or AccessPath(edges, variant, key="dst")
    n = vertices.count()
    base = (1 - DAMPING) / (base_n or max(n, 1))
    rows = path.edges()
    if in_task.fits(path.size()):
        out = in_task.run(rows, vertices, in_task.ranks(updates, DAMPING, base, epsilon), "step int, id bigint, rank double")
        out = cut(out)
        last = out.agg(F.max("step")).first()[0] or 0
        steps = tuple(out.where(F.col("step") == k).select("id", "rank") for k in (max(0, last - 1), last))
    else:
        steps = _distributed(vertices, rows, n, updates, base, epsilon)
    vertices.unpersist()
    if own:
        path.close()
    return steps


def _distributed(vertices: DataFrame, edges: DataFrame, n: int, updates: int, base: float, epsilon: float | None) -> tuple[DataFrame, DataFrame]:
    links = edges.join(vertices.withColumnRenamed("id", "src"), "src", "left_semi")
    links = links.join(out_degree(links), "src").persist(StorageLevel.MEMORY_AND_DISK)
    before = now = initial_ranks(vertices, max(n, 1))
    for done in range(1, updates + 1):
        got = vertices.join(inherit(links, now), "id", "left")
        before, now = now, got.select("id", (F.lit(base) + DAMPING * F.coalesce("inherited", F.lit(0.0))).alias("rank"))
        if epsilon is not None or done % CUT == 0 or done >= updates - 1:
            now = cut(now)
        if epsilon is not None and (rank_delta(before, now).first()["delta"] or 0.0) < epsilon:
            break
    links.unpersist()
    return before, now


def pagerank(
    vertices: DataFrame, edges: DataFrame, max_iterations: int, epsilon: float | None = None, variant: str = "unoptimised", base_n: int | None = None
) -> DataFrame:
    """At most ``max_iterations`` + 1 updates; the base share is divided by |V| + 1 unless ``base_n`` is given."""
    n = base_n or vertices.select("id").distinct().count() + 1
    return last_steps(vertices, edges, max_iterations + 1, n, variant, epsilon)[-1]


def personrank(vertices: DataFrame, edges: DataFrame, max_iterations: int, variant: str = "unoptimised", path: AccessPath | None = None) -> DataFrame:
    """``max_iterations`` + 1 updates over explicit ids; the base share is divided by |V|."""
    return last_steps(vertices, edges, max_iterations + 1, None, variant, None, path)[-1]
