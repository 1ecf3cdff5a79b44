"""What the operators share: tables, durable cuts of lineage, Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrapunto.session import shared_dir, ship_package


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables; also makes the package known to the Python workers."""
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the folder of ``spark.checkpoint.dir``; sets one only where none is set."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def wanted(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra ones (whatever their names) never reach an operator."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def free(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores after it until no column of ``taken`` is called so (in any case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of an Arrow column; null reads as empty."""
    return [t if t is not None else "" for t in column.to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that a task never holds many long texts as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
