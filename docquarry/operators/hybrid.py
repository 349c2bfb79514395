"""Fusion of keyword and semantic results, hydration and register lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.operators import inverted, literal, semantic
from docquarry.operators.keyword import keyword_search, normalise_scores
from docquarry.operators.semantic import semantic_search

#: Priority of chunk types for register lookup; all others come after.
PRIORITY = ["bitfield_definition", "register_map"]


def fuse(keyword: DataFrame, semantic: DataFrame, keyword_weight: float = 0.4, semantic_weight: float = 0.6, both: float = 1.2) -> DataFrame:
    """Weighted sum of both sides' scores; chunks on both sides are boosted, whatever
    their scores."""
    k = keyword.select("chunk_id", F.col("score").alias("keyword_score"))
    s = semantic.select("chunk_id", F.col("score").alias("semantic_score"))
    joined = k.join(s, "chunk_id", "full_outer")
    total = keyword_weight * F.coalesce("keyword_score", F.lit(0.0)) + semantic_weight * F.coalesce("semantic_score", F.lit(0.0))
    boost = F.when(F.col("keyword_score").isNotNull() & F.col("semantic_score").isNotNull(), both).otherwise(1.0)
    return joined.select("chunk_id", "keyword_score", "semantic_score", (total * boost).alias("score"))


def hybrid_search(chunks: DataFrame, vectors: DataFrame, query: str, query_vector, top_k: int = 5, doc_filter: str | None = None, keyword_weight: float = 0.4, semantic_weight: float = 0.6, overfetch: bool = False) -> DataFrame:
    """Top chunks of both searches (2 * top_k candidates each), hydrated with the chunk's
    columns. Ids without a chunk are dropped before the limit; ties go by id."""
    wide = 2 * top_k
    keyword = normalise_scores(keyword_search(chunks, query, wide, doc_filter))
    near = semantic_search(vectors, query_vector, wide, chunks, doc_filter, overfetch)
    fused = fuse(keyword, near, keyword_weight, semantic_weight).select("chunk_id", "score")
    # at most 4 * top_k candidates (overfetch: 200 more): the broadcast side is bounded
    return chunks.join(F.broadcast(fused), "chunk_id").orderBy(F.desc("score"), "chunk_id").limit(top_k)


def hybrid_search_stored(chunks: DataFrame, vectors: DataFrame, index: inverted.Index, pivots: list, query: str, query_vector, top_k: int = 5, doc_filter=None, keyword_weight: float = 0.4, semantic_weight: float = 0.6) -> DataFrame:
    """hybrid_search off stored tables: postings, clustered vectors and, of the chunks, only
    the candidates' rows."""
    wide = 2 * top_k
    keyword = normalise_scores(inverted.search(index, chunks, query, wide, doc_filter))
    if doc_filter is None:
        near = semantic.nearest_clustered(vectors, pivots, query_vector, wide).select("chunk_id", semantic.V.similarity("distance").alias("score"))
    else:
        near = semantic_search(vectors, query_vector, wide, chunks, doc_filter)
    fused = fuse(keyword, near, keyword_weight, semantic_weight).select("chunk_id", "score")
    return hydrated(chunks, fused).orderBy(F.desc("score"), "chunk_id").limit(top_k)


def hydrated(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """The chunks of a top-k table (chunk_id, score), named in the scan of the chunks."""
    rows = found.collect()
    held = found.sparkSession.createDataFrame(rows, found.schema)
    return chunks.filter(literal.named("chunk_id", [r["chunk_id"] for r in rows])).join(F.broadcast(held), "chunk_id")


def explode_registers(chunks: DataFrame) -> DataFrame:
    """One row per register of a chunk's structured data, always derived, so never stale."""
    return chunks.select("chunk_id", "doc_id", "chunk_type", F.col("structured_data.peripheral").alias("peripheral"), F.explode("structured_data.registers").alias("r")).select("chunk_id", "doc_id", "chunk_type", "peripheral", F.col("r.name").alias("name"), F.col("r.address").alias("address"), F.col("r.offset").alias("offset"))


def find_register(registers: DataFrame, name: str, peripheral: str | None = None) -> DataFrame:
    """The one best chunk for a register name (exact, case-sensitive); an empty peripheral
    is no filter."""
    rows = registers.filter(F.col("name") == name)
    if peripheral:
        rows = rows.filter(F.col("peripheral") == peripheral)
    return rows.orderBy(priority("chunk_type"), "chunk_id").limit(1)


def priority(chunk_type: str):
    rank = F.lit(len(PRIORITY))
    for i, kind in reversed(list(enumerate(PRIORITY))):
        rank = F.when(F.col(chunk_type) == kind, i).otherwise(rank)
    return rank


def best_register(registers: DataFrame) -> DataFrame:
    """The best chunk for every (name, peripheral), by one partial aggregation."""
    return registers.groupBy("name", "peripheral").agg(F.min_by("chunk_id", F.struct(priority("chunk_type"), F.col("chunk_id"))).alias("chunk_id"))
