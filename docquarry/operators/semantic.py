"""Exact vector search: squared distances, clamped cosine scores, document filters, and an
index of clustered vectors that prunes by the triangle inequality."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import vectors as V


def nearest(vectors: DataFrame, query, top_k: int, id_col: str = "chunk_id") -> DataFrame:
    """(chunk_id, distance) of the top_k smallest squared distances; fewer rows if there
    are fewer vectors. A per-partition heap and one merge, no full sort."""
    distance = V.squared_distance("embedding", V.literal(query))
    return vectors.filter(F.col("embedding").isNotNull()).select(F.col(id_col).alias("chunk_id"), distance.alias("distance")).orderBy("distance", "chunk_id").limit(top_k)


def semantic_search(vectors: DataFrame, query, top_k: int, chunks: DataFrame | None = None, doc_filter: str | None = None, overfetch: bool = False, doc_col: str = "doc_id", id_col: str = "chunk_id") -> DataFrame:
    """(chunk_id, score), score being the clamped cosine. With a filter the vectors are
    narrowed first, which is exact; `overfetch` instead takes min(12 k, 200) nearest ones
    (at least k) and narrows those, which may give fewer or more than k rows."""
    if not doc_filter:
        return nearest(vectors, query, top_k, id_col).select("chunk_id", V.similarity("distance").alias("score"))
    mine = chunks.filter(F.col(doc_col) == doc_filter).select(F.col(id_col).alias("chunk_id"))
    if overfetch:
        near = nearest(vectors, query, max(min(12 * top_k, 200), top_k), id_col)
        return near.join(mine, "chunk_id", "left_semi").select("chunk_id", V.similarity("distance").alias("score"))
    some = vectors.withColumnRenamed(id_col, "chunk_id").join(mine, "chunk_id", "left_semi")
    return nearest(some, query, top_k).select("chunk_id", V.similarity("distance").alias("score"))


def checked(vectors: DataFrame, dimension: int) -> DataFrame:
    """The vectors, with an error for one of another length; null ones pass."""
    size = F.size("embedding")
    told = F.format_string("vector of %d numbers; the index holds %d", size, F.lit(dimension))
    return vectors.withColumn("embedding", F.when(F.col("embedding").isNull() | (size == dimension), F.col("embedding")).otherwise(F.raise_error(told)))


def add_vectors(index: DataFrame | None, vectors: DataFrame, dimension: int | None = None) -> DataFrame:
    """The index with new vectors; one vector per chunk_id, the new one winning. dimension:
    what every new vector must have."""
    if dimension is not None:
        vectors = checked(vectors, dimension)
    if index is None:
        return vectors.dropDuplicates(["chunk_id"])
    return index.join(vectors.select("chunk_id").distinct(), "chunk_id", "left_anti").unionByName(vectors.dropDuplicates(["chunk_id"]))


# -- clustered vectors ---------------------------------------------------------------

#: Pivots of an index, and those whose clusters a query reads first.
PIVOTS, FIRST = 64, 2
#: Added to every bound, beyond the rounding of distances.
SLACK = 1e-6


def pick_pivots(vectors: DataFrame, pivots: int = PIVOTS, id_col: str = "chunk_id") -> list[list[float]]:
    """The different vectors of smallest hash; a bounded sample that need not be good for
    results to be exact."""
    order = F.xxhash64(F.col(id_col), F.lit(17))
    rows = vectors.filter(F.col("embedding").isNotNull()).select(order.alias("h"), "embedding").orderBy("h", "embedding").limit(pivots).collect()
    return [list(x) for x in dict.fromkeys(tuple(float(v) for v in r["embedding"]) for r in rows)]


def clustered(vectors: DataFrame, pivots: list[list[float]]) -> DataFrame:
    """The vectors with the number of their nearest pivot, `cluster`, and the distance to it,
    `radius`. Sorted by both, they are the index. Null vectors have nulls there."""
    centres = np.array(pivots, np.float64)

    @F.pandas_udf("cluster int, radius double")
    def nearest_pivot(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame({"cluster": pd.array([None] * len(batch), "Int32"), "radius": np.nan})
            there = np.flatnonzero(batch.notna().to_numpy())
            if len(there) and len(centres):
                x = np.stack(batch.iloc[there].to_numpy()).astype(np.float64)
                near = ((x**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
                out.loc[there, "cluster"] = near
                out.loc[there, "radius"] = np.sqrt(((x - centres[near]) ** 2).sum(1))
            yield out

    return vectors.withColumn("at", nearest_pivot("embedding")).withColumn("cluster", F.col("at.cluster")).withColumn("radius", F.col("at.radius")).drop("at")


def near_rows(pivot_distance: list[float], reach: float) -> Column:
    """A filter on (cluster, radius), which the file reader gets, that every vector within
    `reach` of the query passes: none whose distance to its pivot differs by more from the
    query's distance to it, and no cluster whose border to the nearest pivot is farther."""
    least = min(pivot_distance)
    open_ones = [(c, d) for c, d in enumerate(pivot_distance) if (d - least) / 2 <= reach + SLACK]
    return F.expr(" OR ".join(f"(cluster = {c} AND radius BETWEEN {V.number(d - reach - SLACK)} AND {V.number(d + reach + SLACK)})" for c, d in open_ones))


def nearest_clustered(index: DataFrame, pivots: list[list[float]], query, top_k: int, id_col: str = "chunk_id", told: dict | None = None) -> DataFrame:
    """nearest() off clustered vectors: the clusters around the query give a distance within
    which the top_k lie, and only vectors that may be within it are read. `told` learns how
    many vectors there were and were read."""
    if not pivots or len(query) != len(pivots[0]):
        return nearest(index, query, top_k, id_col)
    away = [math.dist(query, p) for p in pivots]
    home = sorted(range(len(away)), key=lambda c: (away[c], c))[:FIRST]
    first = nearest(index.filter(F.col("cluster").isin(home)), query, top_k, id_col).collect()
    rows = index.filter(near_rows(away, math.sqrt(max(first[-1]["distance"], 0.0)))) if len(first) == top_k and top_k else index
    if told is not None:
        told |= {"vectors": index.count(), "read": rows.count(), "first": index.filter(F.col("cluster").isin(home)).count()}
    return nearest(rows, query, top_k, id_col)
