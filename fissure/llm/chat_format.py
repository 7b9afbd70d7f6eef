"""Chat formatting with Spark expressions only.

A conversation's rows are collected as structs and sorted; adjacent turns of one role form one block:

    ### user:⏎first text<more>second text</turn>⏎

Texts and roles hold no raw ``\\``, ``#`` or ``<``: these are written ``\\b``, ``\\h``, ``\\l`` (and a
line feed in a role ``\\n``), so control strings can't occur in them and reading back is exact.
Blocks come from one pass over the sorted array in which each turn looks at the one before: a fold that appends
to an array would copy it at every turn.  ``loss_spans`` lists the byte spans of the assistant texts in the UTF-8 form of the output.

Defined cases: a null text or role is empty; turns sort by (turn, role, text), nulls first; a null
conv_id is one conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
HEAD, HEAD_END, MORE, END = "### ", ":\n", "<more>", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\n"))


def _escape(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for raw, code in pairs:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def _unescape(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for raw, code in reversed(pairs):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def _running_sum(values: Column) -> Column:
    """Inclusive prefix sums of an array, by doubling: n log n, where appending would be n squared."""
    n = F.size(values)
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)))).cast("int"))

    def double(acc: Column, k: Column) -> Column:
        step = F.pow(F.lit(2.0), k).cast("int")
        return F.transform(acc, lambda x, i: x + F.when(i >= step, F.get(acc, i - step)).otherwise(F.lit(0).cast("bigint")))

    return F.aggregate(rounds, values, double)


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array of start, n in bytes)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def opens(t: Column, i: Column) -> Column:
        return (i == 0) | (F.get("turns", i - 1)["role"] != t["role"])

    def lead(t: Column, i: Column) -> Column:
        head = F.concat(F.lit(HEAD), _escape(t["role"], ROLE_ESCAPES), F.lit(HEAD_END))
        return F.when(opens(t, i), F.concat(F.when(i == 0, "").otherwise(END), head)).otherwise(MORE)

    parts = convs.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t, i: F.struct(
                lead(t, i).alias("lead"), _escape(t["text"], ESCAPES).alias("body"), (t["role"] == "assistant").alias("learn")
            ),
        ).alias("parts"),
    )
    sized = parts.select(
        "conv_id",
        "parts",
        _running_sum(
            F.transform("parts", lambda p: (F.octet_length(p["lead"]) + F.octet_length(p["body"])).cast("bigint"))
        ).alias("ends"),
    )
    spans = F.transform(
        "parts",
        lambda p, i: F.struct(
            p["learn"].alias("learn"),
            (F.get("ends", i) - F.octet_length(p["body"])).alias("start"),
            F.octet_length(p["body"]).cast("bigint").alias("n"),
        ),
    )
    return sized.select(
        "conv_id",
        F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["lead"], p["body"])), ""), F.lit(END)).alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["learn"]), lambda s: F.struct(s["start"].alias("start"), s["n"].alias("n"))).alias(
            "loss_spans"
        ),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """Adds turns (array of role, text) read back from the template, and loss_text from the spans."""
    blocks = F.slice(F.split("formatted", HEAD, -1), 2, 1 << 30)

    def texts(block: Column) -> Column:
        role = F.substring_index(block, HEAD_END, 1)
        body = F.substr(block, F.length(role) + len(HEAD_END) + 1, F.length(block) - F.length(role) - len(HEAD_END + END))
        return F.transform(
            F.split(body, MORE, -1),
            lambda x: F.struct(_unescape(role, ROLE_ESCAPES).alias("role"), _unescape(x, ESCAPES).alias("text")),
        )

    raw = F.encode("formatted", "UTF-8")
    cut = F.transform(
        "loss_spans",
        lambda s: _unescape(F.decode(F.substr(F.col("_raw"), (s["start"] + 1).cast("int"), s["n"].cast("int")), "UTF-8"), ESCAPES),
    )
    return (
        formatted.withColumn("turns", F.flatten(F.transform(blocks, texts)))
        .withColumn("_raw", raw)
        .withColumn("loss_text", F.array_join(cut, ""))
        .drop("_raw")
    )


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what reading the output back gives."""
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_chats(formatted).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
