"""The corpus pipeline: documents in, token ids out, in five stages that each write a table.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept, and all but the last
return the columns that they got.  Extra columns, whatever their names, pass through every stage.  Rows with
null ids, repeated ids and repeated rows are documents of their own, except that the second stage keeps one row
of equal and of near texts.  Empty tables stay empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrapunto.llm import bpe, decontaminate, near, pii, toxicity
from contrapunto.llm.common import free, table
from contrapunto.llm.queries import tokenizer
from contrapunto.session import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the table's labels, does not call toxic.

    Null and empty texts are scored like any other (as texts without words) and mostly stay; without labels of
    both kinds nothing is dropped.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word similarity 0.8 or more): the one with the least id.

    SimHash links come first, each confirmed by the similarity; MinHash adds those that lie beyond its distance.
    Null ids come last.  All texts without words, nulls among them, are one group.
    """
    table(spark, sf_dir, "documents")  # makes the package known to the workers
    return near.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with its error budget; null and empty texts hold none."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def hide_persons(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms; ``n_chars``, where there is one, follows the text (null stays null)."""
    out = pii.pseudonymised(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every column but the text, and the whole text's token ids with their number as ``ids`` and ``n_tokens``.

    Null and empty texts have no ids.  Where a column has such a name already, the new one gets an underscore.
    """
    table(spark, sf_dir, "documents")
    names = [c for c in docs.columns if c != "text"]
    own = docs.select(F.col("`text`").alias("text"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    out = bpe.encode(own, *tokenizer(), keep=[f"c{k}" for k in range(len(names))])
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], F.col("ids").alias(free("ids", names)), F.size("ids").cast("long").alias(free("n_tokens", names)))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("personal_data", hide_persons),
    ("tokens", tokenize),
]

#: No stage but the fourth could be said in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
