"""Files as they arrive: each micro-batch runs the batch plan.

A file is whole inside one micro-batch, so results equal those of a batch; no watermark is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.text import Extraction, extract

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, path: str, glob: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.col("path").alias("doc"), "content")


def ingest(files: DataFrame, checkpoint: str, sink: Callable[[Extraction, int], None], password: str | None = None, once: bool = True) -> StreamingQuery:
    """Run ``sink(extraction, batch_id)`` on each micro-batch. ``checkpoint`` must be a folder the
    cluster shares; a batch may come again after a failure, with the same id."""

    def work(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            sink(extract(batch, password), batch_id)
        finally:
            batch.unpersist()

    w = files.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="10 seconds")).start()


def text_sink(folder: str) -> Callable[[Extraction, int], None]:
    """Write plain text, spans and errors of each batch under ``folder``; a batch that comes again replaces itself."""

    def sink(e: Extraction, batch_id: int) -> None:
        for name, df in (("plain", e.plain), ("spans", e.spans), ("errors", e.errors)):
            df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")

    return sink
