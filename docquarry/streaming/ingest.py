"""Streaming ingest (beyond batch parity): new files are ingested as they appear."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docquarry.sources.files import Parser
from docquarry.store import DocStore


def ingest_stream(store: DocStore, path: str, parser: Parser, checkpoint: str, pattern: str = "*.pdf", once: bool = False, max_files: int = 200) -> StreamingQuery:
    """Watch a folder; each micro-batch of at most `max_files` new files is one ingest. Batches
    are idempotent, as ingesting a file replaces whatever it had brought before."""
    stream = store.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", str(max_files)).load(path)

    def each(batch: DataFrame, _: int) -> None:
        paths = [r["path"] for r in batch.select("path").distinct().collect()]  # at most max_files names
        if paths:
            store.ingest_files(paths, parser, pattern)

    writer = stream.select("path", F.col("modificationTime")).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
