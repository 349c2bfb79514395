"""Audit of how far the sources of a language diverge in their use of words.

Terms are runs of ASCII letters and of characters beyond ASCII; only A-Z are lower-cased. A
language keeps the terms that at least `min_docs` of its documents have. A group, a source
of a language, gives a kept term the share p = 1 + floor(10^9 (count + 2) / (N + 2 V)) with N
the group's kept words and V the kept terms. Two groups differ in a term by
floor((p - q)^2 / (p + q)); a pair's value is the sum over all kept terms.

That sum is split. Heavy terms, those which many groups have, fill dense tiles: a matrix of
shares, one column a group, from which all pairs are summed. For light terms most groups
have no count, so every pair starts from the difference of the two groups' shares at count 0,
once a term; a posting (term, group, count) then corrects the pairs of its group by what its
own share changes, and two postings of one term correct their pair for what those two
corrections miss together. All three are sums of integers, so the parts add up exactly.

Work is dealt in units of (language, bucket of terms, tile of groups) that hold about `CELLS`
postings; a unit reads its own groups' totals from marker rows, so nothing is broadcast. The
result has a row per ordered pair of sources of a language, which bounds the sources that
anyone can ask for; a term's posting list has one entry a source.

Defined cases: null text, lang or source -> ''. A group without terms has only count 0. A
language without kept terms has the value 0 for all pairs. Every row is a document of its
own, repeated rows and repeated doc_ids included. Ties are ranked by the item's UTF-8 bytes.
A text of any length is read in pieces cut between terms. An empty table gives no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.llm.common import Scratch

ONE = 1_000_000_000
#: Postings of a unit, groups of a tile, shares of one numpy step.
CELLS, TILE, STEP = 250_000, 1024, 2_000_000
#: A term is heavy if this share of the language's sources has it.
HEAVY = 0.4
#: Entries that a task counts before it passes them on, bytes of text read at once.
ENTRIES, PIECE = 400_000, 1_000_000

_TERM, _GAP = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
COUNTS = "lang string, source string, term string, tf long, df long"
RESULT = "lang string, source string, part string, item string, value long"


# -- counting ------------------------------------------------------------------------


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about PIECE bytes, cut between terms."""
    start = 0
    while len(text) - start > PIECE:
        gap = _GAP.search(text, start + PIECE)
        end = gap.start() if gap else len(text)
        yield text[start:end]
        start = end
    yield text[start:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def emit():
        for (lang, source), tf in words.items():
            terms, df = list(tf), docs[lang, source]
            if terms:
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(lang), len(terms)), pa.repeat(pa.scalar(source), len(terms)), pa.array(terms, pa.binary()).cast(pa.string()),
                     pa.array(list(tf.values()), pa.int64()), pa.array([df[t] for t in terms], pa.int64())],
                    ["lang", "source", "term", "tf", "df"],
                )
        words.clear()
        docs.clear()

    for batch in batches:
        for text, lang, source in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True):
            tf, df = words.setdefault((lang, source), Counter()), docs.setdefault((lang, source), Counter())
            own: set[bytes] = set()
            for piece in pieces(text.encode().lower()):
                found = _TERM.findall(piece)
                tf.update(found)
                own.update(found)
            df.update(own)
        if sum(map(len, words.values())) > ENTRIES:
            yield from emit()
    yield from emit()


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, posts): the count of every source that has the term. Counts are summed
    in the tasks, then by group and term, so no term's rows meet before they are few."""
    counts = docs.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    terms = counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("source", "tf")).alias("posts"))
    return terms.filter(F.col("df") >= min_docs).select("lang", "term", "posts")


# -- shares and differences ----------------------------------------------------------


def shares(count: np.ndarray, total, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), exactly; total: a number or an array."""
    bottom = np.asarray(total) + 2 * terms
    if count.size and int(count.max()) > 9_000_000_000:  # beyond 64 bits
        top = (count.astype(object) + 2) * ONE
        return (top // bottom.astype(object) + 1).astype(np.int64)
    return (count + 2) * ONE // bottom + 1


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def dense_sums(count: np.ndarray, totals: np.ndarray, terms: int, first: int, last: int) -> np.ndarray:
    """(groups of the tile, groups): sums over the terms, the rows of `count`, of a column a
    group; only of pairs with the smaller group first."""
    out = np.zeros((last - first, len(totals)), np.int64)
    rows = max(1, STEP // max(1, len(totals)))
    for at in range(0, len(count), rows):
        p = shares(count[at : at + rows], totals, terms)
        for a in range(first, last):
            out[a - first, a + 1 :] += differences(p[:, a, None], p[:, a + 1 :]).sum(0)
    return out


def sparse_sums(term: np.ndarray, group: np.ndarray, count: np.ndarray, n_terms: int, totals: np.ndarray, terms: int, first: int, last: int) -> np.ndarray:
    """The same for n_terms light terms from their postings, sorted by term."""
    none = shares(np.zeros(len(totals), np.int64), totals, terms)
    base = differences(none[first:last, None], none[None])
    out = n_terms * base
    p = shares(count, totals[group], terms)

    # each posting against groups without the term; those alike in group and count at once
    kinds, times = np.unique(np.stack([group, p]), axis=1, return_counts=True)
    for g, share, n in zip(*kinds, times, strict=True):
        if first <= g < last:
            out[g - first] += n * (differences(share, none) - base[g - first])
        below = slice(0, max(0, min(last, g) - first))  # pairs in which it is the second
        out[below, g] += n * (differences(none[first:last][below], share) - base[below, g])

    # two postings of one term: what the corrections above miss together
    reach = 1
    while True:
        both = np.flatnonzero(term[:-reach] == term[reach:]) if reach < len(term) else np.zeros(0, np.int64)
        if not len(both):
            break
        a, b = both, both + reach
        a, b = np.where(group[a] < group[b], a, b), np.where(group[a] < group[b], b, a)
        mine = (group[a] >= first) & (group[a] < last)
        a, b = a[mine], b[mine]
        ga, gb = group[a], group[b]
        miss = differences(p[a], p[b]) - differences(p[a], none[gb]) - differences(none[ga], p[b]) + differences(none[ga], none[gb])
        np.add.at(out, (ga - first, gb), miss)
        reach += 1
    return np.where(np.arange(len(totals))[None] > np.arange(first, last)[:, None], out, 0)


# -- units ---------------------------------------------------------------------------


def _unit(rows: pa.Table, ranks: int) -> pa.Table:
    """Partial sums of a unit's pairs and the best terms of its groups."""
    lang, tile = rows["lang"][0].as_py(), rows["tile"][0].as_py()
    marks = rows.filter(pc.is_null(rows["term"])).sort_by("source")
    body = rows.filter(pc.is_valid(rows["term"])).sort_by("term").combine_chunks()
    names, totals = marks["source"].combine_chunks(), marks["n"].to_numpy()
    terms, first = marks["v"][0].as_py(), tile * TILE
    last, size = min(first + TILE, len(names)), len(body)
    posts = body["posts"].combine_chunks() if size else pa.array([], body.schema.field("posts").type)
    posts = posts.chunk(0) if isinstance(posts, pa.ChunkedArray) else posts
    flat, edge = posts.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(posts).to_numpy(zero_copy_only=False).astype(np.int64))])
    group = pc.index_in(flat.field("source"), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
    count = flat.field("tf").to_numpy(zero_copy_only=False).astype(np.int64)
    term = np.repeat(np.arange(size), np.diff(edge))

    heavy = np.diff(edge) >= HEAVY * len(names)
    number = np.cumsum(heavy) - 1
    dense = np.zeros((int(heavy.sum()), len(names)), np.int64)
    in_dense = heavy[term]
    dense[number[term[in_dense]], group[in_dense]] = count[in_dense]
    light = ~in_dense
    sums = dense_sums(dense, totals, terms, first, last) + sparse_sums(term[light], group[light], count[light], int((~heavy).sum()), totals, terms, first, last)
    a, b = np.nonzero(np.arange(len(names))[None] > np.arange(first, last)[:, None])
    pairs = [names.take(pa.array(a + first)), pa.repeat(pa.scalar("pair"), len(a)), names.take(pa.array(b)), pa.array(sums[a, b])]

    # the groups' most overused terms, in the order of value and term
    whole = np.zeros(size, np.int64)
    np.add.at(whole, term, count)
    p, q = shares(count, totals[group], terms), shares(whole, int(totals.sum()), terms)[term]
    over = np.flatnonzero((p > q) & (count > 0) & (group >= first) & (group < last))
    value = differences(p[over], q[over])
    order = np.lexsort((term[over], -value, group[over]))
    over, value = over[order], value[order]
    start = np.flatnonzero(np.diff(group[over], prepend=-1))
    place = np.arange(len(over)) - np.repeat(start, np.diff(np.append(start, len(over))))
    over, value = over[place < ranks], value[place < ranks]
    best = [names.take(pa.array(group[over])), pa.repeat(pa.scalar("term"), len(over)), body["term"].combine_chunks().take(pa.array(term[over])) if size else pa.array([], pa.string()), pa.array(value)]
    columns = [pa.concat_arrays([_plain(x), _plain(y)]) for x, y in zip(pairs, best, strict=True)]
    return pa.table([pa.repeat(pa.scalar(lang), len(columns[0])), *columns], names=["lang", "source", "part", "item", "value"])


def _plain(column) -> pa.Array:
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def divergence(docs: DataFrame, min_docs: int = 10, ranks: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: all pairs of a language's sources, and of each
    group the `ranks` terms that it overuses most against its language."""
    tables = Scratch(docs.sparkSession, "source-divergence")
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = tables.stored(kept_terms(docs, min_docs), "terms")
    totals = kept.select("lang", F.explode("posts").alias("post")).groupBy("lang", F.col("post.source").alias("source")).agg(F.sum("post.tf").alias("n"))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))
    groups = tables.stored(groups, "groups")
    sizes = groups.groupBy("lang").agg(F.count("*").alias("s"), F.max("v").alias("v"))
    parts = sizes.select("lang", F.greatest(F.lit(1), F.ceil(F.col("v") * F.col("s") / CELLS)).cast("int").alias("buckets"), F.ceil(F.col("s") / TILE).cast("int").alias("tiles"))
    tile = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile")
    marks = groups.join(parts, "lang").select("lang", "source", "n", "v", "tiles", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket")).select("lang", "bucket", tile, "source", "n", "v")
    units = kept.join(parts, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"), tile, "term", "posts").unionByName(marks, allowMissingColumns=True)
    found = tables.stored(units.groupBy("lang", "bucket", "tile").applyInArrow(lambda rows: _unit(rows, ranks), RESULT), "sums")

    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).withColumn("part", F.lit("pair"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    best = found.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= ranks)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return both.withColumn("rank", rank).select(*columns).unionByName(best.select(*columns))
