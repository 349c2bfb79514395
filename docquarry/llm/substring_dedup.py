"""Substring deduplication by level-wise doubling.

All windows of a short length are looked up first. Only windows that repeat there are
extended: a window of twice the length (at most the wanted one) is a candidate where both
its ends repeat. The candidates of each length are looked up in the same way, and so on
until the wanted length is reached; where no candidate survives, nothing more is asked.

Documents are dealt into chunks. A chunk asks about each of its distinct windows once: at
the shorter lengths by 40 bits of a hash within one of many hash ranges, as false candidates
do no harm, at the last by a 96-bit name and the chunk's smallest doc_id that has it. A range
sees the questions of all chunks and answers with a bit for each: whether another chunk has
the window too, or, at the last, has it in a smaller doc_id. A window of a third of all
documents is so one entry per chunk. The texts are exchanged once, by chunk; all levels read
that exchange. Memory is bounded by a chunk and by a range, whose number grows with the texts.

Exact copies are settled before: all but those with the smallest doc_id of a text lose
every word, so their windows are not asked about.
`bytes.split()` takes just the six blanks that end words here.

Defined cases: null text has no words. Words are kept as they are. A document shorter
than the window loses nothing. Rows that share a doc_id are judged one by one; neither
makes the other lose a word. A null doc_id neither loses words nor takes any. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import U64, Scratch, Words, map_batches, salted_join, shuffle_partitions, window_hashes

WINDOW = 13
#: A first level shorter than this would repeat everywhere.
SHORTEST = 5
#: Windows that a range's task holds, and bytes of text in a chunk (more in proportion to
#: the ranges, so that a chunk has many windows for each).
RANGE_WINDOWS = 2_000_000
CHUNK_TEXT, CHUNK_TEXT_MOST = 1 << 19, 1 << 23
#: Fewest ranges and chunks; above, their numbers follow the texts, not the partitions.
FEWEST = 32
_LOW = U64((1 << 40) - 1)

ROW = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"
QUESTION = "range long, chunk long, packed binary"
NOTE = "chunk long, level int, a long, b long, bits binary"


def levels(window: int = WINDOW, shortest: int = SHORTEST) -> list[int]:
    """Lengths from the first to the wanted one, each at most twice the one before."""
    out = [window]
    while (half := -(-out[0] // 2)) >= shortest:
        out.insert(0, half)
    return out


def _utf8(texts) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _finish(words: list[bytes], covered: np.ndarray | None = None) -> tuple[int, int, str, str]:
    """n_words, n_removed, kept text and its sha256."""
    kept = words if covered is None else [w for w, gone in zip(words, covered.tolist(), strict=True) if not gone]
    data = b" ".join(kept)
    return len(words), len(words) - len(kept), data.decode("utf-8", "surrogatepass"), hashlib.sha256(data).hexdigest()


class Block:
    """The documents of a chunk, and for each of their words whether a candidate window
    starts there."""

    def __init__(self, docs: pd.DataFrame, notes: pd.DataFrame, lengths: list[int], ranges: int):
        docs = docs.sort_values(["doc_id", "row_key"], kind="stable")
        self.ids, self.lengths, self.ranges = docs["doc_id"].to_numpy(), lengths, ranges
        copies = set(notes.loc[notes["level"] == 0, ["a", "b"]].itertuples(index=False, name=None))
        self.copy = [key in copies for key in zip(self.ids.tolist(), docs["row_key"].tolist(), strict=True)]
        self.texts = _utf8(docs["text"])
        self.words = Words([b"" if copy else t for t, copy in zip(self.texts, self.copy, strict=True)])
        self.hashes = self.words.hashes()
        self.end = np.repeat(self.words.first[1:], self.words.counts)  # of each word's document
        long_enough = np.repeat(self.words.counts >= lengths[-1], self.words.counts)
        self.alive = long_enough & (np.arange(len(self.end)) + lengths[0] <= self.end)
        self.notes = notes

    def entries(self, level: int):
        """The distinct candidate windows of a level in the order in which they are asked:
        (range, packed value), first and last document number of each, and each candidate's
        place among them."""
        n = self.lengths[level]
        at = np.flatnonzero(self.alive)
        own = self.ids[self.words.row[at]]
        a = window_hashes(self.hashes, n)[at]
        span = (a >> U64(40)) % U64(self.ranges)
        if level < len(self.lengths) - 1:
            names, first, place = np.unique(span << U64(40) | (a & _LOW), return_index=True, return_inverse=True)
            packed = np.ascontiguousarray((names & _LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
            span = (names >> U64(40)).astype(np.int64)
        else:
            b = (window_hashes(self.words.hashes(1), n, 1)[at] >> U64(32)).astype(np.uint32)
            order = np.lexsort((b, a, span))
            new = np.ones(len(at), bool)
            new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
            place = np.empty(len(at), np.int64)
            place[order] = np.cumsum(new) - 1
            first = order[new]  # stable: the smallest place of each, so the smallest doc_id
            packed = np.zeros(len(first), [("a", "<u8"), ("b", "<u4"), ("least", "<i8")])
            packed["a"], packed["b"], packed["least"] = a[first], b[first], own[first]
            packed = packed.view(np.uint8).reshape(len(first), packed.itemsize)
            span = span[first].astype(np.int64)
        last = np.empty(len(first), np.int64)
        last[place] = own  # candidates are in ascending order of doc_id
        return at, own, span, packed, own[first], last, place

    def answers(self, level: int, span: np.ndarray) -> np.ndarray:
        """The answered bit of each entry of a level; ranges without an answer say no."""
        said = {a: bits for a, bits in self.notes.loc[self.notes["level"] == level + 1, ["a", "bits"]].itertuples(index=False, name=None)}
        out = np.zeros(len(span), bool)
        ranges, begin, size = np.unique(span, return_index=True, return_counts=True)
        for r, i, n in zip(ranges.tolist(), begin.tolist(), size.tolist(), strict=True):
            if r in said:
                out[i : i + n] = np.unpackbits(np.frombuffer(said[r], np.uint8), count=n)
        return out

    def climb(self, levels: int) -> None:
        """Take the answers to the first levels: what repeats at one length is extended."""
        for level in range(levels):
            at, _, span, _, first, last, place = self.entries(level)
            again = np.zeros(len(self.alive), bool)
            again[at] = (self.answers(level, span) | (last > first))[place]
            step = self.lengths[level + 1] - self.lengths[level]
            where = np.arange(max(len(again) - step, 0))
            self.alive = np.zeros(len(again), bool)
            self.alive[where] = again[where] & again[step:] & (where + self.lengths[level + 1] <= self.end[where])

    def questions(self, level: int, chunk: int) -> pd.DataFrame:
        self.climb(level)
        _, _, span, packed, *_ = self.entries(level)
        ranges, begin, size = np.unique(span, return_index=True, return_counts=True)
        return pd.DataFrame({"range": ranges, "chunk": np.full(len(ranges), chunk), "packed": [packed[i : i + n].tobytes() for i, n in zip(begin.tolist(), size.tolist(), strict=True)]})

    def results(self, with_text: bool) -> pd.DataFrame:
        """The rows of all documents."""
        top, window = len(self.lengths) - 1, self.lengths[-1]
        self.climb(top)
        at, own, span, _, first, _, place = self.entries(top)
        gone = self.answers(top, span)[place] | (own > first[place])
        change = np.zeros(len(self.alive) + 1, np.int64)
        np.add.at(change, at[gone], 1)
        np.add.at(change, at[gone] + window, -1)
        covered = np.cumsum(change)[:-1] > 0
        rows = []
        for i, (text, copy) in enumerate(zip(self.texts, self.copy, strict=True)):
            words = text.split()
            if copy:
                rows.append(_finish(words, np.full(len(words), len(words) >= window)))
            else:
                part = covered[self.words.first[i] : self.words.first[i + 1]]
                rows.append(_finish(words, part if part.any() else None))
        return _rows(self.ids, rows, with_text)


def _rows(ids, rows: list[tuple], with_text: bool) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept", "kept_sha256"])
    if not with_text:
        out["kept"] = None
    out.insert(0, "doc_id", ids)
    return out


def _answer(rows: list[tuple], level: int, last: bool) -> list[tuple]:
    """rows: (chunk, packed) of one range. Notes for the chunks that get a yes."""
    size = [len(packed) // (20 if last else 5) for _, packed in rows]
    data = np.frombuffer(b"".join(packed for _, packed in rows), np.uint8)
    if last:
        entry = data.view([("a", "<u8"), ("b", "<u4"), ("least", "<i8")])
        order = np.lexsort((entry["b"], entry["a"]))
        a, b, least = entry["a"][order], entry["b"][order], entry["least"][order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        smallest = np.repeat(np.minimum.reduceat(least, new), np.diff(new, append=len(a)))
        yes = least > smallest
    else:
        value = np.zeros((len(data) // 5, 8), np.uint8)
        value[:, :5] = data.reshape(-1, 5)
        value = value.view("<u8")[:, 0]
        order = np.argsort(value, kind="stable")
        same = value[order][1:] == value[order][:-1]
        yes = np.zeros(len(value), bool)
        yes[1:] |= same
        yes[:-1] |= same
    bit = np.empty(len(yes), bool)
    bit[order] = yes
    edge = np.cumsum([0, *size])
    return [(chunk, bit[i:j]) for (chunk, _), i, j in zip(rows, edge[:-1].tolist(), edge[1:].tolist(), strict=True) if bit[i:j].any()]


def answers(questions: DataFrame, level: int, last: bool) -> DataFrame:
    """The ranges' answers to a level's questions, as notes."""
    parts = shuffle_partitions(questions.sparkSession)
    dealt = questions.repartition(parts, "range").sortWithinPartitions("range", "chunk")

    def run(batches):
        now, rows = None, []

        def settle():
            said = _answer(rows, level, last) if rows else []
            return pd.DataFrame([(chunk, level + 1, now, 0, np.packbits(bits).tobytes()) for chunk, bits in said], columns=["chunk", "level", "a", "b", "bits"])

        for batch in batches:
            for span, chunk, packed in zip(batch["range"], batch["chunk"], batch["packed"], strict=True):
                if span != now:
                    yield settle()
                    now, rows = span, []
                rows.append((chunk, packed))
        yield settle()

    return dealt.mapInPandas(run, NOTE).repartition(parts, "chunk")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, shortest: int = SHORTEST, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept (null unless with_text) and kept_sha256 per row."""
    spark, lengths = docs.sparkSession, levels(window, shortest)
    scratch, parts = Scratch(spark, "substring-dedup"), shuffle_partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text")
    counted = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    known = rows.filter(counted)

    # exact copies, from narrow rows
    keys = known.select("doc_id", "row_key", F.xxhash64(F.lit(7), "text").alias("twin"), F.octet_length("text").alias("size"))
    same = scratch.stored(keys.groupBy("row_key", "twin").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.sum("size").alias("size"), F.max("size").alias("each")), "texts")
    total, distinct = same.agg(F.sum("size"), F.sum("each")).first()
    ranges = max(FEWEST, (distinct or 0) // 4 // RANGE_WINDOWS)
    chunks = max(FEWEST, (total or 0) // min(max(CHUNK_TEXT, 400 * ranges), CHUNK_TEXT_MOST))

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("chunk", F.pmod(F.xxhash64(F.lit(3), "doc_id", "row_key"), F.lit(chunks)))

    copies = salted_join(keys, same.filter("first < last").select("row_key", "twin", "first"), ["row_key", "twin"], ["doc_id"]).filter("doc_id > first").select("doc_id", "row_key").distinct()
    noted = scratch.stored(placed(copies).select("chunk", F.lit(0).alias("level"), F.col("doc_id").alias("a"), F.col("row_key").alias("b"), F.lit(b"").alias("bits")), "copies")

    dealt = placed(known).repartition(parts, "chunk")

    def asker(level: int):
        def ask(left, right):
            return Block(left, right, lengths, ranges).questions(level, left["chunk"].iloc[0]) if len(left) else pd.DataFrame(columns=["range", "chunk", "packed"])

        return ask

    for level in range(len(lengths)):
        asked = dealt.groupBy("chunk").cogroup(noted.groupBy("chunk")).applyInPandas(asker(level), QUESTION)
        noted = noted.unionByName(answers(asked, level, level == len(lengths) - 1))

    def finish(left, right):
        return Block(left, right, lengths, ranges).results(with_text) if len(left) else pd.DataFrame(columns=[c.split()[0] for c in ROW.split(", ")])

    found = dealt.groupBy("chunk").cogroup(noted.groupBy("chunk")).applyInPandas(finish, ROW)

    def plain(batches):
        for batch in batches:
            yield _rows(batch["doc_id"].to_numpy(), [_finish(t.split()) for t in _utf8(batch["text"])], with_text)

    return found.unionByName(map_batches(rows.filter(~counted).select("doc_id", "text"), plain, ROW))
