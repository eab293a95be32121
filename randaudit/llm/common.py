"""Helpers shared by the training-data operators: scratch tables, bounded Arrow batches, input normalisation."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from randaudit.sources.scratch import shared_dir

#: Rows of an Arrow batch that Spark hands to Python at once, and its bytes where Spark knows that setting.
BATCH_ROWS = 1000
BATCH_BYTES = "16m"


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts may be very long, and a batch is held whole by a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


#: What clears the caches that operators keep in a Python worker between their tasks.
KEPT: list[Callable[[], None]] = []


def forget() -> None:
    """Clear what other operators keep in this worker. Workers outlive stages, and an executor's memory is for the stage that runs."""
    for clear in KEPT:
        clear()
    pa.default_memory_pool().release_unused()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, text, and more columns if named; whatever else the table carries is left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def local_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def appended(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], ddl: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """df without the columns named in drop, followed by the columns of ddl.

    make() is called once in each task and gives the function that turns an Arrow batch into the new columns,
    a list of values for each. Kept columns pass through as they are, nulls and large integers included.
    """
    new = StructType.fromDDL(ddl)
    kept = [f for f in df.schema.fields if f.name not in drop]
    names, types = [f.name for f in kept], to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = make()
        for batch in batches:
            made = [pa.array(values, type=field.type) for values, field in zip(columns(batch), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + made, names=[*names, *types.names])

    return df.mapInArrow(run, StructType([*kept, *new.fields]))
