"""Intermediate tables of iterative jobs in the folder that driver and executors share; spreading of small inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder in local mode; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table and read again: lineage ends here, and a lost executor takes nothing with it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Buckets:
    """Stored tables bucketed and sorted by keys, with as many buckets as joins have partitions, for the time of a loop.

    Rounds that join such a table on these keys shuffle only the other side; a union of tables with the same keys is bucketed too.
    At the end of the loop the tables leave the catalog; their files stay in the shared folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []
        self.n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def __enter__(self) -> Buckets:
        return self

    def __exit__(self, *error: object) -> None:
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def store(self, df: DataFrame, name: str, *keys: str, dealt: bool = False) -> tuple[DataFrame, str]:
        """df as such a table, and the folder of its files. dealt tells that its partitions follow the keys already."""
        table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
        path = f"{shared_dir(self.spark)}/{table}"
        own = df if dealt else df.repartition(self.n, *keys)
        own.write.bucketBy(self.n, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table), path


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for scans that cost far more than a shuffle of their input.

    A table of many files has more partitions than that and isn't touched; a single small file would keep one core busy.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
