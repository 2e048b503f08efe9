"""Inspection of packages as they arrive in a folder: an extension, stateless per package."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliograph.plans import inspection
from foliograph.plans.config import Config
from foliograph.sources import decks


def inspect_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str, config: Config) -> StreamingQuery:
    """Appends the findings of new packages to `out`; a batch that runs again replaces its own folder. Ends when all are read."""
    files = spark.readStream.format("binaryFile").schema("path STRING, modificationTime TIMESTAMP, length LONG, content BINARY").option("pathGlobFilter", "*.[pP][pP][tT][xX]").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def batch(df, number: int) -> None:
        found = inspection.inspect(decks.decks(df), config)["findings"]
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return named.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
