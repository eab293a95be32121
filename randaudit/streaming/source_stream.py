"""Source detection over contracts that keep arriving: the batch operators on a file stream.

Scans are stateless, so a stream needs no watermark; each micro-batch appends its hits exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from randaudit.operators.source_scan import combined_hits, token_hits
from randaudit.sources.contracts import from_bytes

FILE = "path string, modificationTime timestamp, length bigint, content binary"


def contract_stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """Contracts as read_contracts gives them, for .sol files that appear below path."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).option("pathGlobFilter", "*.sol")
    return from_bytes(files.option("maxFilesPerTrigger", per_trigger).load(path).select("path", "content"))


def hits(contracts: DataFrame) -> DataFrame:
    """Token and combined hits of a stream of contracts; state variables need a last-wins choice and stay a batch job."""
    return token_hits(contracts).unionByName(combined_hits(contracts))


def write_hits(contracts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append hits as Parquet for all files there now; called again, it goes on where it stopped."""
    writer = hits(contracts).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
