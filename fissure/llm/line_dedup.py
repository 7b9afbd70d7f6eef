"""Repeated line runs, by a suffix array over line ids; DataFrame functions only.

A document is the sequence of its non-blank lines' ids (64-bit hashes, which are also their order).
Prefix doubling ranks the suffixes by their first ``min_lines``, then twice, four times ... as many lines:
the distinct pairs of ranks are range-partitioned and sorted, and their places become the ranks of twice
the depth, so ranks keep the suffix array's order.  A suffix whose prefix occurs once has its final place
and leaves; doubling ends when all ranks are unique.  Equal ranks at a depth are an interval of suffixes
whose longest common prefix is at least that long.  Of each interval the first occurrence (by doc_id,
line) stays and the others are later copies; copies that touch or overlap merge into the maximal runs
that are deleted.  With ``long_line``, a single line of that many words or more is a run as well.  The
first occurrence of a line is in no later copy, so unique text stays.

Ranks are made from distinct pairs, counted before they are shuffled; rows meet them in a join whose
hot keys adaptive execution splits.  The number of rounds follows the longest repeated run.

Defined cases: a null text stays null and has no lines; blank lines (white space only) are never
removed and don't interrupt a run; a null doc_id counts as the largest; rows with one doc_id and equal
text are one document, with other text they are told apart; an empty table gives an empty result; of
other columns, those called n_lines, n_removed or n_runs are replaced and all others stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fissure.llm import common as C

BLANKS = " \t\r\x0b\x0c"


def _is_filled(line: Column) -> Column:
    return F.length(F.translate(line, BLANKS, "")) > 0


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column through a generator, so that no later expression evaluates it again."""
    return rows.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def _n_words(line: Column) -> Column:
    return F.size(F.filter(F.split(F.translate(line, BLANKS, " " * len(BLANKS)), " "), lambda w: w != ""))


def _neighbours(docs: DataFrame, long_line: int) -> DataFrame:
    """(rid, tk, i, a, b, long): the ids of each non-blank line and of the next one; whether the line is a run alone."""

    def line(x: Column) -> Column:
        long = (F.length(x) >= 2 * long_line - 1) & (_n_words(x) >= long_line) if long_line else F.lit(False)
        return F.struct(F.xxhash64(x).alias("a"), long.alias("long"))

    filled = F.filter(F.split("text", "\n", -1), _is_filled)
    rows = _once(docs.where("text is not null"), "ids", F.transform(filled, line)).select("rid", "tk", "ids")
    rows = rows.select("rid", "tk", "ids", F.posexplode("ids").alias("i", "line"))
    return rows.select("rid", "tk", "i", "line.a", F.get("ids", F.col("i") + 1)["a"].alias("b"), "line.long")


def _ranked(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys occur at two places or more, with order-preserving 64-bit ranks of the distinct keys and
    each key's first occurrence."""
    place = F.struct("rid", "tk", "i")
    distinct = rows.groupBy(*keys).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")
    order = distinct.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranks = C.cut(order.withColumn("rank", F.monotonically_increasing_id()))  # fixed before it is used
    return rows.join(ranks, list(keys)).select("rid", "tk", "i", "rank", "first")


def common_prefixes(rows: DataFrame, min_lines: int) -> DataFrame:
    """(rid, tk, i, first, depth): for each suffix its intervals of depth ``min_lines``, 2 * ``min_lines``, ...
    whose common prefix is that long, and the interval's first occurrence.  ``rows`` as _neighbours gives."""
    near = Window.partitionBy("rid", "tk").orderBy("i")
    ranked = _ranked(rows, "a") if min_lines == 1 else _ranked(rows.where("b is not null"), "a", "b")
    depth, out, old = min(2, min_lines), None, []
    while True:
        ranked = C.cut(ranked)
        if not (n := ranked.count()):
            break
        if depth >= min_lines:
            level = ranked.select("rid", "tk", "i", "first", F.lit(depth).alias("depth"))
            out = level if out is None else out.unionAll(level)
        step = depth if depth >= min_lines else min(depth, min_lines - depth)
        ranked = C.few_parts(ranked, n)
        once = ranked.withColumn("before", F.lag("i").over(near)).where("before is null or before <> i")  # rows of one document
        both = once.select("rid", "tk", "i", F.col("rank").alias("a"), F.lead("rank", step).over(near).alias("b"), F.lead("i", step).over(near).alias("j"))
        both = C.cut(C.few_parts(both.where(F.col("j") == F.col("i") + step).drop("j"), n))
        old.append(both)
        ranked = C.few_parts(_ranked(both, "a", "b"), n)
        depth += step
    for done in old:
        C.drop_cut(done)
    return rows.sparkSession.createDataFrame([], "rid bigint, tk bigint, i int, first struct<rid: bigint, tk: bigint, i: int>, depth int") if out is None else out


def removed_runs(docs: DataFrame, min_lines: int, long_line: int = 0) -> DataFrame:
    """(rid, tk, runs): maximal runs of non-blank lines (from, to) that are later copies.

    ``docs`` has rid, text and tk, a hash of the text.
    """
    rows = C.cut(_neighbours(docs, long_line))
    later = F.struct("rid", "tk", "i") > F.col("first")
    copies = common_prefixes(rows, min_lines).where(later).select("rid", "tk", "i", (F.col("i") + F.col("depth")).alias("end"))
    if long_line and min_lines > 1:
        alone = _ranked(rows.where("long"), "a").where(later)
        copies = copies.unionAll(alone.select("rid", "tk", "i", (F.col("i") + 1).alias("end")))
    copies = copies.groupBy("rid", "tk", "i").agg(F.max("end").alias("end"))
    near = Window.partitionBy("rid", "tk").orderBy("i")
    reach = F.max("end").over(near.rowsBetween(Window.unboundedPreceding, -1))
    flagged = copies.withColumn("new", F.when(F.col("i") <= reach, 0).otherwise(1))
    runs = flagged.withColumn("run", F.sum("new").over(near)).groupBy("rid", "tk", "run").agg(F.min("i").alias("from"), F.max("end").alias("to"))
    return runs.groupBy("rid", "tk").agg(F.collect_list(F.struct("from", "to")).alias("runs"))


def drop_repeated_lines(docs: DataFrame, min_lines: int = 2, long_line: int = 0) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any other columns) with later copies removed from text,
    and n_lines, n_removed and n_runs (null text: 0).  With ``long_line``, later copies of single lines of that
    many words or more are removed, too.
    """
    if min_lines < 1:
        raise ValueError("min_lines must be 1 or more")
    text = F.col("row.text").cast("string")
    keyed = docs.select(F.struct(*docs.columns).alias("row"))
    keyed = keyed.select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(C.NULL_ID)).alias("rid"), F.xxhash64(text).alias("tk"))
    runs = removed_runs(keyed.select("rid", "tk", text.alias("text")), min_lines, long_line)
    found = F.col("runs").isNotNull()
    whole = keyed.join(runs, ["rid", "tk"], "left").select("row", "runs")
    whole = _once(whole, "lines", F.when(found, F.split(text, "\n", -1)))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    whole = _once(whole, "filled", F.when(found, F.filter(every, lambda i: _is_filled(F.get("lines", i)))))
    gone = F.flatten(F.transform("runs", lambda r: F.transform(F.sequence(r["from"], r["to"] - 1), lambda j: F.get("filled", j))))
    whole = _once(whole, "kept", F.when(found, F.array_except(every, gone)))
    n_lines = F.length(text) - F.length(F.translate(text, "\n", "")) + 1
    out = {
        "text": F.when(found, F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n")).otherwise(text),
        "n_lines": F.when(text.isNull(), 0).when(found, F.size("lines")).otherwise(n_lines).cast("bigint"),
        "n_removed": F.when(found, F.size("lines") - F.size("kept")).otherwise(0).cast("bigint"),
        "n_runs": F.when(found, F.size("runs")).otherwise(0).cast("bigint"),
    }
    whole = whole.select("row", F.struct(*(v.alias(k) for k, v in out.items())).alias("out"))
    return whole.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in out), *(F.col("out")[c].alias(c) for c in out))


def line_dedup(docs: DataFrame, min_lines: int = 2) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, kept_sha256 (of the remaining text; null for a null text)."""
    rows = drop_repeated_lines(docs.select("doc_id", "text"), min_lines)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_removed", "n_runs", F.sha2("text", 256).alias("kept_sha256"))
