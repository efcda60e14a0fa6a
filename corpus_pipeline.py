"""Clean a corpus in five stages, each one operator of ``wayloom.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's result as Parquet to the shared folder and reads it again, so
a lost executor costs no earlier stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm import decontaminate, jaccard, lines, pieces, toxicity
from wayloom.session import materialize

#: The toxicity model is trained by gradient steps and ids come from a tokenizer, which SQL can't state; the
#: tests compare the stages with brute force.
ORACLE_SQL = None

#: Bytes of rows that are sent to a Python worker at a time. Spark counts 10 000 rows to a batch, which are tens of MB
#: of text; executor and worker both hold what they send and what they get.
BATCH_BYTES = "8m"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _small_batches(stage: Stage) -> Stage:
    """``stage`` with batches of bounded bytes. Its rows are read after it returns, so the session keeps the setting."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _aside(docs: DataFrame, read: set[str]) -> DataFrame:
    """Columns that a stage doesn't read get names that no operator uses."""
    return docs.select([F.col(f"`{c}`").alias(c if c in read else f"__aside_{c}") for c in docs.columns])


def _back(rows: DataFrame, docs: DataFrame, read: set[str]) -> DataFrame:
    return rows.select([F.col(f"`{c if c in read else f'__aside_{c}'}`").alias(c) for c in docs.columns])


@_small_batches
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    read = {"doc_id", "text"}
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return _back(toxicity.score(_aside(docs, read), model).filter("predicted = 0"), docs, read)


@_small_batches
def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; n_chars follows the text. Copies of a text count
    once, so that the next stage finds one of them with its text."""
    read = {"text", "source"}
    cleaned = _back(lines.drop_boilerplate(_aside(docs, read), copies_once=True), docs, read)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@_small_batches
def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id."""
    return jaccard.deduplicate(docs)


@_small_batches
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    read = {"doc_id", "text"}
    found = decontaminate.find(_aside(docs, read), _table(spark, sf_dir, "benchmark"))
    return _back(found.filter(~F.col("contaminated")), docs, read)


@_small_batches
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids by document and chunk, with a check that they decode to the text."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_boilerplate),
    ("jaccard_join", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("sentencepiece", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
