"""Stored inverted index: postings in blocks with upper bounds, and a term dictionary.

The chunks of one build are dealt into blocks of about `BLOCK` chunks of like length; a row
holds a term's postings within a block, its largest frequency and its smallest chunk length,
which bound what the term can add to a score there, whatever the average length is by then.
Rows are sorted by term and block, so a query reads pages of its own terms.

Plain words: the bounds are read first, without postings; the most promising blocks give the
k-th best score, and only blocks that can reach it are read beside them. Phrases, prefixes and
first words need every posting of their words to know how rare they are, and read those.

A whole collection's blocks are built by dealing its texts, not their postings: a text goes to
the task of its block, once, and a file holds the blocks of some `FILE` tokens, sorted by term.

The dictionary (term, df, tf) and the sizes (n_chunks, n_tokens) are signed counts that are
added up: what a removal takes away is a negative row. No query sums postings to get them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators import keyword, literal

#: Chunks of a block, blocks that are read first, and blocks that are named in a scan's filter.
BLOCK, FIRST, NAMED = 128, 16, 200
#: Tokens of a file of blocks, about; few enough that a task sorts them in memory.
FILE = 2_000_000
#: Blocks whose bounds the driver looks at, best first.
HEADS = 4096
TERMS = "term string, df long, tf long"
SIZES = "n_chunks long, n_tokens long"
GRAM_COUNTS = "gram string, n long"


def blocks_schema(chunk_id: str = "string", doc_id: str = "string") -> str:
    return f"block long, term string, n int, most int, least int, ids array<{chunk_id}>, docs array<{doc_id}>, dls array<int>, tfs array<int>, places array<array<int>>"


# -- building ------------------------------------------------------------------------


def length_classes(lengths: DataFrame) -> list:
    """(kind, n, tokens) of the classes of like length; some hundred rows at most."""
    return lengths.groupBy(_kind().alias("kind")).agg(F.count("*").alias("n"), F.sum("dl").cast("long").alias("tokens")).collect()


def _kind() -> Column:
    return F.floor(F.log2(F.col("dl") + F.lit(1.0)) * 4).cast("long")


def block_numbers(lengths: DataFrame, block: int = BLOCK) -> Column:
    """The block of a chunk by its length `dl` and id: classes of like length, each dealt into
    as many blocks as it needs. The driver reads one count a class, some hundred at most."""
    return _block_numbers(length_classes(lengths), block)


def _block_numbers(classes: list, block: int) -> Column:
    if not classes:
        return F.lit(0).cast("long")
    parts = F.create_map(*[F.lit(x) for r in classes for x in (r["kind"], math.ceil(r["n"] / block))])
    return _kind() * F.lit(1 << 40) + F.pmod(F.xxhash64("chunk_id"), parts[_kind()])


def files_of(classes: list, rows: DataFrame) -> int:
    """How many files, and tasks, the blocks are dealt over."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(sum(r["tokens"] for r in classes) / FILE))


def blocks_of_chunks(chunks: DataFrame, classes: list, block: int = BLOCK) -> DataFrame:
    """The blocks of whole chunks (chunk_id, doc_id, text), each id once; classes: their
    length_classes. The texts are exchanged, a task makes the postings of one block after the
    other. Texts without a word have blocks of their own, class 0, which give no rows; a filter
    here would split every text once more."""
    kinds = dict(chunks.dtypes)
    numbered = chunks.select("chunk_id", "doc_id", "text", F.size(T.tokens("text")).alias("dl")).select("chunk_id", "doc_id", "text", _block_numbers(classes, block).alias("block"))
    dealt = numbered.repartition(files_of(classes, chunks), "block").sortWithinPartitions("block", "chunk_id")
    return dealt.select("block", "chunk_id", "doc_id", T.tokens("text").alias("tokens")).mapInArrow(_packed_blocks, blocks_schema(kinds["chunk_id"], kinds["doc_id"]))


def _packed_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one block become its terms' rows; holds one block at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        numbers = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1), len(numbers)]
        for begin, end in zip(cuts, cuts[1:]):
            if begin == end or not numbers[begin] >> 40:
                continue
            if held and held[0].column("block")[0].as_py() != numbers[begin]:
                yield _packed(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(begin, end - begin))
    if held:
        yield _packed(pa.Table.from_batches(held))


def _packed(rows: pa.Table) -> pa.RecordBatch:
    """A row per term of one block's chunks (block, chunk_id, doc_id, tokens), as block_rows."""
    ids, docs, tokens = (pa.concat_arrays(rows.column(c).chunks) for c in ("chunk_id", "doc_id", "tokens"))
    dl = tokens.value_lengths().to_numpy()
    words = tokens.flatten().dictionary_encode()
    code = words.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    code, chunk = code[order], np.repeat(np.arange(len(dl)), dl)[order]
    place = (np.arange(len(code)) - np.repeat(np.cumsum(dl) - dl, dl))[order]
    first = np.flatnonzero(np.r_[True, (np.diff(code) != 0) | (np.diff(chunk) != 0)])  # of each posting
    tf, who = np.diff(np.r_[first, len(code)]), chunk[first]
    row = np.flatnonzero(np.r_[True, np.diff(code[first]) != 0])  # each term's first posting
    ends = pa.array(np.r_[row, len(first)], pa.int32())

    def ints(values) -> pa.Array:
        return pa.array(values, pa.int32())

    def lists(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(ends, values)

    places = pa.ListArray.from_arrays(ints(np.r_[first, len(code)]), ints(place))
    made = {
        "block": pa.array(np.full(len(row), rows.column("block")[0].as_py()), pa.int64()),
        "term": words.dictionary.take(pa.array(code[first[row]])),
        "n": ints(np.diff(np.r_[row, len(first)])),
        "most": ints(np.maximum.reduceat(tf, row)),
        "least": ints(np.minimum.reduceat(dl[who], row)),
        "ids": lists(ids.take(pa.array(who))),
        "docs": lists(docs.take(pa.array(who))),
        "dls": lists(ints(dl[who])),
        "tfs": lists(ints(tf)),
        "places": lists(places),
    }
    return pa.RecordBatch.from_arrays(list(made.values()), names=list(made))


def block_rows(postings: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of postings (chunk_id, doc_id, term, dl, positions)."""
    number = block_numbers(postings.select("chunk_id", "dl").distinct(), block)
    entry = F.struct("chunk_id", "doc_id", "dl", F.size("positions").alias("tf"), "positions")
    rows = postings.select("term", number.alias("block"), entry.alias("e")).groupBy("block", "term").agg(F.sort_array(F.collect_list("e")).alias("e"))
    return rows.select("block", "term", F.size("e").alias("n"), F.array_max("e.tf").alias("most"), F.array_min("e.dl").alias("least"), F.col("e.chunk_id").alias("ids"), F.col("e.doc_id").alias("docs"), F.col("e.dl").alias("dls"), F.col("e.tf").alias("tfs"), F.col("e.positions").alias("places"))


def term_counts(postings: DataFrame, sign: int = 1) -> DataFrame:
    """Signed (term, df, tf) of some postings."""
    return postings.groupBy("term").agg((F.count("*") * sign).alias("df"), (F.sum(F.size("positions")) * sign).cast("long").alias("tf"))


def block_term_counts(blocks: DataFrame) -> DataFrame:
    """(term, df, tf) of stored blocks."""
    tf = F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)
    return blocks.groupBy("term").agg(F.sum("n").cast("long").alias("df"), F.sum(tf).alias("tf"))


def size_counts(chunks: DataFrame, sign: int = 1) -> DataFrame:
    """Signed (n_chunks, n_tokens), one row."""
    return chunks.agg((F.count("*") * sign).alias("n_chunks"), (F.coalesce(F.sum(F.size(T.tokens("text"))), F.lit(0)) * sign).cast("long").alias("n_tokens"))


# -- reading -------------------------------------------------------------------------


def postings_of(blocks: DataFrame) -> DataFrame:
    """Blocks as single postings, other columns kept."""
    flat = F.explode(F.arrays_zip("ids", "docs", "dls", "places")).alias("e")
    arrays = ("n", "most", "least", "ids", "docs", "dls", "tfs", "places")
    kept = [c for c in blocks.columns if c not in arrays]
    return blocks.select(*kept, flat).select(*kept, F.col("e.ids").alias("chunk_id"), F.col("e.docs").alias("doc_id"), F.col("e.dls").alias("dl"), F.col("e.places").alias("positions"))


@dataclass(frozen=True)
class Index:
    """The stored tables. visible: drops the postings of chunks that are no longer there;
    it gets postings with the blocks' own columns, `segment` among them."""

    blocks: DataFrame
    terms: DataFrame
    sizes: DataFrame
    grams: DataFrame
    gram_counts: DataFrame
    visible: object = staticmethod(lambda rows: rows)

    def postings(self, words: Column | None = None) -> DataFrame:
        blocks = self.blocks if words is None else self.blocks.filter(words)
        return self.visible(postings_of(blocks))


def dictionary(index: Index) -> DataFrame:
    """(term, df, tf) of the chunks that are there."""
    return index.terms.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).filter("df > 0")


def prefix_terms(index: Index, prefix: str) -> DataFrame:
    """The dictionary's entries that begin alike: a range of the sorted table."""
    return dictionary(Index(index.blocks, index.terms.filter(F.col("term").startswith(prefix)), index.sizes, index.grams, index.gram_counts))


def _statistics(index: Index, words: list[str]) -> tuple[int, float, dict[str, int]]:
    """Chunks, average length, and df of each word; a few rows, read by one job."""
    sizes = index.sizes.agg(F.lit(None).cast("string").alias("term"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("a"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("b"))
    terms = index.terms.filter(F.col("term").isin(words)).groupBy("term").agg(F.sum("df").alias("a"), F.lit(0).cast("long").alias("b"))
    found = {r["term"]: r for r in sizes.unionByName(terms).collect()}
    n_all, n_tokens = found.pop(None)[1:]
    return n_all, n_tokens / n_all if n_all else 0.0, {t: r["a"] for t, r in found.items()}


def _weighted(words: list[str], n_all: int, avgdl: float, df: dict[str, int], f: Column, dl: Column) -> Column:
    """A term's share of the score, by the column `term`; see keyword._bm25."""
    idf = {w: math.log((n_all - df[w] + 0.5) / (df[w] + 0.5)) for w in words}
    weight = reduce(lambda rest, w: F.when(F.col("term") == w, F.lit(max(idf[w], 0) or keyword.LEAST_IDF)).otherwise(rest), words, F.lit(0.0))
    return weight * f * (keyword.K1 + 1) / (f + keyword.K1 * (1 - keyword.B + keyword.B * dl / avgdl))


def top_words(index: Index, words: list[str], top_k: int, doc_filter=None, first: int = FIRST, told: dict | None = None) -> list[tuple]:
    """(chunk_id, score) of the best chunks, top_k at most, that have all of some different
    plain words.
    `told` learns how many blocks of postings there were and were read."""
    n_all, avgdl, df = _statistics(index, words)
    if top_k < 1 or any(df.get(w, 0) <= 0 for w in words):
        return []
    key = [c for c in ("segment", "block") if c in index.blocks.columns]
    mine = index.blocks.filter(F.col("term").isin(words))
    bound = _weighted(words, n_all, avgdl, df, F.col("most"), F.col("least"))
    # bounds are compared with scores that were added up in another order
    heads = mine.select(*key, "term", bound.alias("bound")).groupBy(*key).agg(F.count("*").alias("terms"), (F.sum("bound") * (1 + 1e-9)).alias("bound")).filter(F.col("terms") == len(words))

    def scored(blocks: DataFrame) -> DataFrame:
        rows = index.visible(postings_of(blocks))
        if doc_filter is not None:
            rows = rows.filter(F.col("doc_id") == doc_filter)
        own = _weighted(words, n_all, avgdl, df, F.size("positions"), F.col("dl"))
        parts = [F.max(F.when(F.col("term") == w, own)) for w in words]  # one each, added in the words' order
        total = reduce(Column.__add__, parts)
        return rows.groupBy("chunk_id").agg(total.alias("score")).filter("score is not null")

    def named(blocks: list) -> Column:
        def one(row) -> Column:
            return reduce(Column.__and__, [F.col(c) == row[c] for c in key])

        if key == ["block"]:
            return F.col("block").isin([r["block"] for r in blocks])
        return reduce(Column.__or__, map(one, blocks), F.lit(False))

    def best_of(blocks: DataFrame) -> list[tuple]:
        return [(r["chunk_id"], r["score"]) for r in scored(blocks).orderBy(F.desc("score"), "chunk_id").limit(top_k).collect()]

    ordered = heads.orderBy(F.desc("bound"), *key)
    near = ordered.limit(HEADS).collect()  # all of them, for most words
    while True:
        start = best_of(mine.filter(named(near[:first])))
        if len(start) == top_k or len(near) <= first or first > NAMED:
            break
        first *= 4
    least = start[-1][1] if len(start) == top_k else -math.inf
    others = [r for r in near[first:] if r["bound"] >= least]
    if len(others) <= NAMED and (len(near) < HEADS or len(others) < len(near[first:])):
        rest = best_of(mine.filter(named(others))) if others else []
    else:
        reach = heads.filter(F.col("bound") >= least).filter(~named(near[:first])).select(*key)
        rest = best_of(mine.join(reach, key, "left_semi"))
    if told is not None:
        told |= {"blocks": heads.count() * len(words), "read": (len(near[:first]) + heads.filter(F.col("bound") >= least).filter(~named(near[:first])).count()) * len(words)}
    return sorted(start + rest, key=lambda r: (-r[1], r[0]))[:top_k]


def scores(index: Index, parts: list[keyword.Part]) -> DataFrame:
    """(chunk_id, doc_id, score) of all chunks that have every part, from the postings of the
    parts' words."""
    def same(word: str, prefix: bool) -> Column:
        return F.col("term").startswith(word) if prefix else F.col("term") == word

    words = reduce(Column.__or__, [same(w, p.prefix and k == len(p.tokens) - 1) for p in parts for k, w in enumerate(p.tokens)])
    return keyword.search_index(index.postings(words), index.sizes, parts, ["doc_id"])


def search(index: Index, chunks: DataFrame, query: str, top_k: int = 10, doc_filter=None, id_col: str = "chunk_id", doc_col: str = "doc_id") -> DataFrame:
    """keyword.keyword_search off the index: the best chunks are found first, at most top_k
    rows; texts are read only where there are none and a word is literal."""
    words, parts = keyword.query_words(query), keyword.parse_query(query)
    empty = chunks.select(F.col(id_col).alias("chunk_id"), F.lit(0.0).alias("score")).limit(0)
    found = []
    if parts:
        plain = [p.tokens[0] for p in parts if len(p.tokens) == 1 and not p.prefix and not p.first]
        if len(plain) == len(parts) == len(set(plain)):
            found = top_words(index, plain, top_k, doc_filter)
        else:
            ranked = scores(index, parts).filter(F.lit(True) if doc_filter is None else F.col("doc_id") == doc_filter).select("chunk_id", "score").orderBy(F.desc("score"), "chunk_id").limit(top_k)
            found = [(r["chunk_id"], r["score"]) for r in ranked.collect()]
    if not found and any(map(keyword.is_literal_word, words)):
        mine = chunks if doc_filter is None else chunks.filter(F.col(doc_col) == doc_filter)
        return literal.search(mine, index.grams, index.gram_counts, words, top_k, id_col)
    return chunks.sparkSession.createDataFrame(found, empty.schema).orderBy(F.desc("score"), "chunk_id") if found else empty
