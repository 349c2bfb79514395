"""Keyword search: postings, BM25 and the literal fallback.

Query grammar: words are joined by AND. A literal word (see functions.text.is_literal) is
a phrase of its tokens; `alpha*` matches a prefix, `^alpha` a first token. Words that the
grammar forbids make the query match nothing, as do phrases without a token.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.functions import text as T
from docquarry.operators import literal

K1, B = 1.2, 0.75
#: Lower bound of a term's weight.
LEAST_IDF = 1e-6
_FORBIDDEN = re.compile(r"[?',+$=|#{}&;!%<>@~`\\]")
_OPERATORS = {"AND", "OR", "NOT"}


@dataclass(frozen=True)
class Part:
    """One ANDed part of a query."""

    tokens: tuple[str, ...]
    prefix: bool = False
    first: bool = False


def query_words(query: str) -> list[str]:
    return query.split()


def is_literal_word(word: str) -> bool:
    return re.search(T.LITERAL, word) is not None


def fold_word(word: str) -> list[str]:
    return [t for t in re.split(r"[\W_]+", T.fold_python(word)) if t]


def parse_query(query: str) -> list[Part] | None:
    """Parts of a query, or None if the grammar rejects it or it can match nothing."""
    parts = []
    for word in query_words(query):
        if is_literal_word(word):
            parts.append(Part(tuple(fold_word(word))))
        elif word in _OPERATORS or _FORBIDDEN.search(word):
            return None
        else:
            first, word = word.startswith("^"), word.removeprefix("^")
            prefix, word = word.endswith("*"), word.removesuffix("*")
            if "*" in word or "^" in word or '"' in word:
                return None
            parts.append(Part(tuple(fold_word(word)), prefix, first))
    return parts if parts and all(p.tokens for p in parts) else None


def _runs(words: Column, entry) -> Column:
    """Over a sorted array of structs with `t`: what `entry` makes of each run of one `t`, given
    the array, where the run begins and how long it is. A let by lambda, so that nothing is
    worked out twice."""
    def let(value: Column, body) -> Column:
        return F.transform(F.array(value), body)[0]

    def over(s: Column) -> Column:
        marked = F.transform(s, lambda x, i: F.when((i == 0) | (x["t"] != F.get(s, i - 1)["t"]), i).otherwise(-1))
        ends = lambda starts, k: F.coalesce(F.get(starts, k + 1), F.size(s))
        return let(F.filter(marked, lambda i: i >= 0), lambda starts: F.transform(starts, lambda b, k: entry(s, b, ends(starts, k) - b)))

    return let(words, over)


def postings(chunks: DataFrame, id_col: str = "chunk_id", keep: list[str] | None = None) -> DataFrame:
    """(chunk_id, term, dl, positions), positions counted from 0, dl being the chunk's
    length in tokens. Each row's postings are made from the row alone, nothing is exchanged;
    where an id has several rows, `merged` makes one of them."""
    placed = F.sort_array(F.transform(T.tokens("text"), lambda t, i: F.struct(t.alias("t"), i.alias("i"))))

    def entry(s: Column, begin: Column, n: Column) -> Column:
        return F.struct(F.get(s, begin)["t"].alias("term"), F.size(s).alias("dl"), F.slice(s, begin + 1, n)["i"].alias("positions"))

    rows = chunks.select(F.col(id_col).alias("chunk_id"), *(keep or []), F.explode(_runs(placed, entry)).alias("p"))
    return rows.select("chunk_id", *(keep or []), "p.term", "p.dl", "p.positions")


def merged(postings: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One posting per id and term, for ids with several rows."""
    return postings.groupBy("chunk_id", *(keep or []), "term").agg(F.first("dl").alias("dl"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))


def repeats(chunks: DataFrame, id_col: str = "chunk_id") -> bool:
    """Whether an id has several rows; reads ids alone."""
    return not chunks.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def term_counts(chunks: DataFrame, id_col: str = "chunk_id", sign: int = 1, many: bool | None = None) -> DataFrame:
    """Signed (term, df, tf) of some chunks, counted within each row and added up before the
    exchange, which gets a task's different terms and no postings. many: whether an id may have
    several rows, where that is known."""
    if repeats(chunks, id_col) if many is None else many:
        rows = merged(postings(chunks, id_col)).select("term", F.size("positions").alias("n"))
    else:
        words = F.sort_array(F.transform(T.tokens("text"), lambda t: F.struct(t.alias("t"))))
        entry = lambda s, begin, n: F.struct(F.get(s, begin)["t"].alias("term"), n.alias("n"))
        rows = chunks.select(F.explode(_runs(words, entry)).alias("p")).select("p.term", "p.n")
    return rows.groupBy("term").agg((F.count("*") * sign).alias("df"), (F.sum("n") * sign).cast("long").alias("tf"))


def lengths(chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    return chunks.select(F.col(id_col).alias("chunk_id"), F.size(T.tokens("text")).alias("dl"))


def index_sizes(chunks: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_chunks, n_tokens): what the statistics of all chunks are summed from."""
    return chunks.groupBy(doc_col).agg(F.count("*").alias("n_chunks"), F.sum(F.size(T.tokens("text"))).cast("long").alias("n_tokens"))


def term_table(chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(term, df, tf): chunks and occurrences per term."""
    return term_counts(chunks, id_col)


def _matches(tokens: Column, part: Part) -> Column:
    """Occurrences of a part in a token array."""
    k = len(part.tokens)

    def same(word: Column, wanted: str, last: bool) -> Column:
        return F.startswith(word, F.lit(wanted)) if last and part.prefix else word == wanted

    def starts(word: Column, i: Column) -> Column:
        hit = same(word, part.tokens[0], k == 1)
        for step, wanted in enumerate(part.tokens[1:], 1):
            hit = hit & same(F.coalesce(F.get(tokens, i + step), F.lit("")), wanted, step == k - 1)
        return hit & (i == 0) if part.first else hit

    return F.size(F.filter(tokens, starts))


def _bm25(f: Column, n: Column) -> Column:
    """A part's share of the score from its frequency, the chunks that have it and the
    columns dl, n_all and avgdl."""
    raw = F.ln((F.col("n_all") - n + 0.5) / (n + 0.5))
    return F.when(raw <= 0, LEAST_IDF).otherwise(raw) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def _scored(counts: DataFrame, stats: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """The score is null unless every part occurs. Filtering on it, not on the counts, lets
    both sides read one exchange of the counts."""
    every = reduce(Column.__and__, [F.col(n) > 0 for n in names])
    total = reduce(Column.__add__, [_bm25(F.col(n), F.col(f"n_{n}")) for n in names])
    rows = counts.crossJoin(F.broadcast(stats)).select("chunk_id", *keep, F.when(every & (F.col("n_all") > 0), total).alias("score"))  # one row of sums
    return rows.filter("score is not null")


def score_bm25(chunks: DataFrame, parts: list[Part], id_col: str = "chunk_id", keep: list[str] | None = None) -> DataFrame:
    """(chunk_id, score) of the chunks that have every part. Statistics are those of all
    chunks. Texts are read once: counts, a few numbers a chunk, are exchanged and read by
    the sums and by the scores; only the single row of sums is broadcast."""
    names, keep = [f"f{i}" for i in range(len(parts))], keep or []
    bound = F.transform(F.array(T.tokens("text")), lambda words: F.struct(F.size(words).alias("dl"), *[_matches(words, p).alias(n) for p, n in zip(parts, names, strict=True)]))[0]
    counts = chunks.select(F.col(id_col).alias("chunk_id"), *keep, bound.alias("c")).select("chunk_id", *keep, "c.*")
    counts = counts.repartition("chunk_id", *keep)
    stats = counts.agg(F.count("*").alias("n_all"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(n) > 0).alias(f"n_{n}") for n in names])
    return _scored(counts, stats, names, keep)


def search_index(index: DataFrame, sizes: DataFrame, parts: list[Part], keep: list[str] | None = None) -> DataFrame:
    """Like score_bm25, but off postings: only those of the query's words are read, and `sizes`
    (rows of n_chunks and n_tokens) for the statistics."""
    names, keep = [f"f{i}" for i in range(len(parts))], keep or []

    def same(part: Part, k: int) -> Column:
        word = part.tokens[k]
        return F.col("term").startswith(word) if part.prefix and k == len(part.tokens) - 1 else F.col("term") == word

    def places(part: Part, k: int) -> Column:
        """Where the part would begin, by its k-th word."""
        return F.flatten(F.collect_list(F.when(same(part, k), F.transform("positions", lambda x: x - k))))

    def times(part: Part) -> Column:
        begin = reduce(F.array_intersect, [places(part, k) for k in range(len(part.tokens))])
        return F.size(F.filter(begin, lambda x: x == 0) if part.first else begin)

    wanted = reduce(Column.__or__, [same(p, k) for p in parts for k in range(len(p.tokens))])
    counts = index.filter(wanted).groupBy("chunk_id", *keep).agg(F.first("dl").alias("dl"), *[times(p).alias(n) for p, n in zip(parts, names, strict=True)])
    found = counts.agg(*[F.count_if(F.col(n) > 0).alias(f"n_{n}") for n in names])
    whole = sizes.agg(F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_all"), (F.sum("n_tokens") / F.sum("n_chunks")).alias("avgdl"))
    return _scored(counts, found.crossJoin(F.broadcast(whole)), names, keep)


def keyword_search(chunks: DataFrame, query: str, top_k: int = 10, doc_filter: str | None = None, id_col: str = "chunk_id", doc_col: str = "doc_id") -> DataFrame:
    """Top chunks by BM25 over a scan of the texts, by descending score, then id. The filter
    narrows the result, not the statistics. Where BM25 finds nothing and a word is literal, the
    texts with all words are the result. inverted.search is the same off stored tables."""
    words = query_words(query)
    parts = parse_query(query)
    mine = F.col(doc_col) == doc_filter if doc_filter else F.lit(True)
    keep = [doc_col] if doc_filter and doc_col != id_col else []
    found = chunks.select(F.col(id_col).alias("chunk_id"), F.lit(0.0).alias("score")).limit(0)
    if parts:
        found = score_bm25(chunks, parts, id_col, keep).filter(mine).select("chunk_id", "score").orderBy(F.desc("score"), "chunk_id").limit(top_k)
    if not any(map(is_literal_word, words)):
        return found
    rest = literal.scan(chunks.filter(mine), words, top_k, id_col)
    both = found.withColumn("way", F.lit(0)).unionByName(rest.withColumn("way", F.lit(1)))
    first = F.min("way").over(Window.partitionBy(F.lit(0)))  # over two top-k tables
    return both.withColumn("first", first).filter("way = first").select("chunk_id", "score").orderBy(F.desc("score"), "chunk_id")


def normalise_scores(hits: DataFrame) -> DataFrame:
    """Scores over the largest one, where that is positive. hits is a top-k table, so one
    window over it is bounded, and it is worked out once."""
    top = F.max("score").over(Window.partitionBy(F.lit(0)))
    return hits.withColumn("top", top).select("chunk_id", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(F.col("score")).alias("score"))
