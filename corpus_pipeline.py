"""A training-data pipeline over ``documents``: stages that hand on what they keep.

Stages, each (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of documents.

1. language: documents whose language can't be told without ambiguity go.
2. lines: later copies of runs of repeated lines, and of single lines of 10 or more words, go; a document of which nothing is left goes as well,
   and n_chars follows the text.
3. near_duplicates: of documents linked by five-word shingles at a similarity of 0.8 or more, the one
   with the least doc_id stays.
4. benchmark: documents that hold a benchmark item go.
5. packing: what remains is tokenized and packed into sequences of at most 4096 tokens.

Rows that share a doc_id stay or go together in stage 3; null doc_ids count as one document there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fissure.llm.common import Folder
from fissure.llm.decontamination import drop_contaminated
from fissure.llm.language_id import drop_unidentified
from fissure.llm.line_dedup import drop_repeated_lines
from fissure.llm.packing import pack_documents
from fissure.llm.parity_join import jaccard_components, keep_first_of_components
from fissure.llm.queries import word_bpe_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Words from which a line that is repeated between unlike neighbours is no accident.
LONG_LINE = 10


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_unidentified(docs.select(*COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = drop_repeated_lines(docs.select(*COLUMNS), long_line=LONG_LINE)
    left = (F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return rows.where(left).withColumn("n_chars", n_chars).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    return keep_first_of_components(docs, jaccard_components(docs, words=5, num=80, den=100))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, word_bpe_path())


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("packing", packing),
]

# Language models and subword tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's output but the last's is written once and goes when the next one's is there."""
    docs, folder, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Folder(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = folder.write(stage(spark, docs, sf_dir), name)
        if before:
            folder.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
