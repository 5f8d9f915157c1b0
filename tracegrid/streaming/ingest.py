"""Directory ingest: new image files of a folder are digitised as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tracegrid.sources.images import SUFFIXES, pixels, read_images


def digitize_stream(spark: SparkSession, folder: str, checkpoint: str, digitise: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], per_batch: int = 100) -> StreamingQuery:
    """Each micro-batch's new files are read as images, digitised and handed to sink(curves, batch id), which should be idempotent."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").option("maxFilesPerTrigger", per_batch).load(folder).select("path")

    def batch(new: DataFrame, number: int) -> None:
        paths = [r["path"] for r in new.collect()]  # at most per_batch names
        if paths:
            sink(digitise(pixels(read_images(spark, paths))), number)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
