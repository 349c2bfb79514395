"""Literal search: texts that contain every word, ASCII case ignored, % and _ being wild.

The trigram index has a row (gram, chunk_id) for each different run of three characters of a
chunk's lowered text; two end marks follow the text, so that every place begins a trigram and
one or two characters are a range of trigrams. A dictionary beside it counts the chunks of each
trigram. A query looks its trigrams up there, intersects the chunks of the rarest ones and
holds the words against the texts of those chunks alone.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import text as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "\x00\x00"
#: Trigrams that a query intersects; the texts decide afterwards.
MOST = 8
#: Up to so many candidates are named in the scan's filter, ten a list (Spark hands longer
#: lists to the file reader as one range); more are joined.
NAMED, LIST = 200, 10


def lowered(text) -> Column:
    """ASCII letters in lower case, all others as they are."""
    return F.when(T.is_ascii(text), F.lower(T.col(text))).otherwise(F.translate(T.col(text), UPPER, LOWER))


def lower_word(word: str) -> str:
    return word.translate(str.maketrans(UPPER, LOWER))


def gram_rows(chunks: DataFrame, id_col: str = "chunk_id", keep: list[str] | None = None) -> DataFrame:
    """(chunk_id, gram), each pair once. Halves of characters beyond 16 bits may begin further
    trigrams, which no query asks for."""
    places = F.regexp_extract_all(F.concat(lowered(F.coalesce("text", F.lit(""))), F.lit(END)), F.lit("(?s)(?=(.{3}))"), F.lit(1))
    return chunks.select(F.col(id_col).alias("chunk_id"), *(keep or []), F.explode(F.array_distinct(places)).alias("gram"))


def gram_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("gram").agg(F.count("*").alias("n"))


def needed(words: list[str]) -> list[str]:
    """What a text must have of trigrams: whole ones, or the beginnings of some. Empty where
    the words are nothing but wildcards."""
    runs = {r for w in words for r in re.split("[%_]", lower_word(w)) if r}
    return sorted({r[i : i + 3] for r in runs for i in range(max(1, len(r) - 2))})


def _has(gram: str) -> Column:
    return F.col("gram") == gram if len(gram) == 3 else F.col("gram").startswith(gram)


def matches(words: list[str]) -> Column:
    """All words are in the text; a backslash stands for itself."""
    low = lowered("text")
    return reduce(Column.__and__, [F.like(low, F.lit("%" + lower_word(w).replace("\\", "\\\\") + "%")) for w in words])


def hits(words: list[str]) -> Column:
    """How many of the words are in the text as they are, % and _ included."""
    low = F.lower("text")
    return reduce(Column.__add__, [F.when(F.contains(low, F.lit(w.lower())), 1).otherwise(0) for w in words]).cast("double")


def scan(chunks: DataFrame, words: list[str], top_k: int, id_col: str = "chunk_id") -> DataFrame:
    """(chunk_id, score) from the texts: the most words, then the smallest id."""
    return chunks.filter(matches(words)).select(F.col(id_col).alias("chunk_id"), hits(words).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(top_k)


def candidates(grams: DataFrame, counts: DataFrame, words: list[str]) -> DataFrame | None:
    """(chunk_id) of the chunks that have the rarest trigrams of the words; None where the
    words restrict nothing. counts: (gram, n), which may hold several rows a gram."""
    wanted = needed(words)
    if not wanted:
        return None
    # one row: a number for each wanted trigram
    known = counts.filter(reduce(Column.__or__, map(_has, wanted))).agg(*[F.coalesce(F.sum(F.when(_has(g), F.col("n"))), F.lit(0)).alias(f"n{i}") for i, g in enumerate(wanted)]).first()
    rarest = [g for _, g in sorted(zip(known, wanted, strict=True))[:MOST]]
    if not min(known):
        return grams.select("chunk_id").limit(0)
    rows = grams.filter(reduce(Column.__or__, map(_has, rarest)))
    every = reduce(Column.__and__, [F.bool_or(_has(g)) for g in rarest])
    return rows.groupBy("chunk_id").agg(every.alias("all")).filter("all").select("chunk_id")


def named(column: str, values: list) -> Column:
    """The column has one of some values, in lists that the file reader gets as they are."""
    values = sorted(values)
    lists = [F.col(column).isin(values[i : i + LIST]) for i in range(0, len(values), LIST)]
    return reduce(Column.__or__, lists, F.lit(False))


def only(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose column is one of some keys, a table of one column: a few keys are named
    in the scan, many are joined."""
    few = [r[0] for r in keys.limit(NAMED + 1).collect()]
    if len(few) > NAMED:
        return rows.join(keys.toDF(column), column, "left_semi")
    return rows.filter(named(column, few))


def search(chunks: DataFrame, grams: DataFrame, counts: DataFrame, words: list[str], top_k: int, id_col: str = "chunk_id") -> DataFrame:
    """The same as `scan`, off the index: of the texts only those of the candidates are
    compared."""
    some = candidates(grams, counts, words)
    if some is None:
        return scan(chunks, words, top_k, id_col)
    return scan(only(chunks, id_col, some), words, top_k, id_col)
