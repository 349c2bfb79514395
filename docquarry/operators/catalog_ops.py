"""Document lifecycle on tables: upsert, removal, statistics, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`new` replaces rows of `old` with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def remove(table: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def document_stats(chunks: DataFrame) -> DataFrame:
    """Chunks and table chunks per document."""
    kinds = F.col("chunk_type").isin("register_map", "bitfield_definition", "memory_map")
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.count_if(kinds).alias("n_tables"))


def status(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Files with the doc_id of the document of the same filename, if it is indexed."""
    known = documents.groupBy("filename").agg(F.max("doc_id").alias("doc_id"))
    return files.join(known, "filename", "left")
