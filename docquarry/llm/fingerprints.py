"""Document fingerprints by locally consistent parsing.

A text is a sequence of symbols (UTF-8 bytes at first). Runs of equal symbols are named
as one; on the rest, deterministic coin tossing compares each symbol with its left
neighbour and keeps the lowest bit in which they differ, with its value; four rounds
leave six labels, and local maxima of the labels start new phrases. A phrase's name is a
hash of its symbols; names are the symbols of the next level. Where a phrase starts
depends on a few neighbours only, so equal substrings share all interior names whatever
their offset.

The fingerprint holds, for levels 1 to 4, the number of distinct phrase names and the 24
smallest name hashes (32 bits each). Likeness of two fingerprints is the bottom-k
estimate of the Jaccard similarity of the names at the highest level on which both have
enough of them.

Defined cases: null text is empty text. Two empty texts have likeness 1, an empty and
another one 0. The next document is the next row by descending doc_id, nulls last, rows of
one id (and those without) by descending xxhash64 of their text; after the last comes the first (a
single row follows itself). Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import CHUNK_BYTES, _BYTES, _LANES, U64, map_batches, mix, shuffle_partitions

LEVELS = 4
SKETCH = 24


def _toss_table(labels: int) -> np.ndarray:
    """New label for each (own, left) pair of labels: twice the lowest differing bit,
    plus the own bit there; 0 where they are equal."""
    own, left = np.meshgrid(np.arange(labels), np.arange(labels), indexing="ij")
    differ = own ^ left
    bit = np.zeros_like(own)
    for k in range(labels.bit_length() - 1, -1, -1):
        bit[(differ >> k) & 1 == 1] = k
    return np.where(differ == 0, 0, 2 * bit + ((own >> bit) & 1)).astype(np.uint8).ravel()


_ROUNDS = [(128, _toss_table(128)), (16, _toss_table(16)), (8, _toss_table(8))]


def _labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6 that differ between neighbours of one text; `first` marks where
    texts begin."""
    left = np.empty_like(names)
    left[1:] = names[:-1]
    left[first] = ~names[first]
    low = names ^ left
    low &= -low
    label = (np.bitwise_count(low - U64(1)) << 1).astype(np.uint8)
    label |= (names & low) != 0
    for size, table in _ROUNDS:
        pair = label.astype(np.uint16) * size
        pair[1:] += label[:-1]
        pair[first] = label[first].astype(np.uint16) * size + (label[first] ^ 1)
        label = table[pair]
    return label


def parse(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: (phrase names, where each text begins among them)."""
    fresh = np.ones(len(names), bool)
    fresh[1:] = names[1:] != names[:-1]
    fresh[first] = True
    if not fresh.all():  # runs of one symbol become one
        at = np.flatnonzero(fresh)
        length = np.diff(at, append=len(names))
        names = names[at]
        long = length > 1
        names = np.where(long, mix(names + length.astype(U64) * U64(0x632BE59BD9B4E019)), names)
        first = np.searchsorted(at, first)
    label = _labels(names, first)
    starts = np.zeros(len(names), bool)
    starts[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    starts[first[1:] - 1] = False  # a text's last symbol has no right neighbour
    starts[first] = True
    at = np.flatnonzero(starts)
    up, down = _LANES[0].get(len(names) + 1)
    total = np.zeros(len(names) + 1, U64)
    np.cumsum(names * up[: len(names)], out=total[1:])
    ends = np.append(at[1:], len(names))
    return mix((total[ends] - total[at]) * down[at]), np.searchsorted(at, first)


def phrase_levels(texts: list[bytes]) -> list[list[np.ndarray]]:
    """For each level, each text's phrase names in order. Texts may be empty."""
    full = [i for i, t in enumerate(texts) if t]
    out = [[np.zeros(0, U64)] * len(texts) for _ in range(LEVELS)]
    if not full:
        return out
    names = _BYTES[0][np.frombuffer(b"".join(texts[i] for i in full), np.uint8)]
    first = np.cumsum([0, *[len(texts[i]) for i in full[:-1]]])
    for level in out:
        names, first = parse(names, first)
        for i, part in zip(full, np.split(names, first[1:]), strict=True):
            level[i] = part
    return out


def sketches(texts: list[bytes]) -> list[str]:
    """The fingerprint of each text."""
    levels = []
    for level in phrase_levels(texts):
        row = np.repeat(np.arange(len(texts), dtype=np.uint64), [len(p) for p in level])
        # row number above, 32 bits of the name's hash below: one sort serves all texts
        keys = np.unique(row << U64(32) | (mix(np.concatenate(level)) >> U64(32))) if len(row) else np.zeros(0, U64)
        bounds = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << U64(32))
        low = (keys & U64(0xFFFFFFFF)).astype(">u4")
        levels.append([(int(b - a), low[a : min(b, a + SKETCH)].tobytes().hex()) for a, b in zip(bounds, bounds[1:], strict=False)])
    return ["/".join(f"{n}:{names}" for n, names in of) for of in zip(*levels, strict=True)]


def likeness(one: str, other: str) -> float:
    """0 to 1: estimated share of phrase names that two fingerprints have in common."""
    if one == other:
        return 1.0
    a = [part.split(":") for part in one.split("/")]
    b = [part.split(":") for part in other.split("/")]
    for level in range(LEVELS - 1, -1, -1):
        n = min(int(a[level][0]), int(b[level][0]))
        if n >= SKETCH or level == 0:
            x, y = ({h[k : k + 8] for k in range(0, len(h), 8)} for h in (a[level][1], b[level][1]))
            least = sorted(x | y)[:SKETCH]
            return sum(h in x and h in y for h in least) / len(least) if least else 0.0
    return 0.0


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row."""

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fingerprint": [s for part in _parts(texts) for s in sketches(part)]})

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fingerprint string")


def _parts(texts: list[bytes]):
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > CHUNK_BYTES // 2:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


# -- each document beside the next one -----------------------------------------------


#: Sampled keys per bucket, from which the buckets' bounds are taken.
SAMPLE = 60


def _literal(values: list[int]) -> Column:
    """An array column from one literal, however many values."""
    return F.lit(np.array(values, np.int64))


def _bucket(rank: Column, key: Column, bounds: list[tuple[int, int]]) -> Column:
    """Number of bounds at or below (rank, key), by bisection."""
    if not bounds:
        return F.lit(0)
    ranks, keys = (_literal(list(v)) for v in zip(*bounds, strict=True))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])

    def halve(at: Column, step: Column) -> Column:
        to = at + step - 1
        below = (F.get(ranks, to) < rank) | (F.get(ranks, to) == rank) & (F.get(keys, to) <= key)
        return F.when((to < len(bounds)) & below, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), halve)


def in_order(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) in partitions sorted by descending doc_id, then by text hash, one
    bucket of neighbours each; behind each bucket's rows stands a copy (halo = 1) of the row
    that follows them, the first row of the next bucket. One exchange of the texts. The
    bounds come from a sample of narrow keys: they shape the buckets, not the result."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    text = F.coalesce("text", F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("rank"), F.xxhash64(text).alias("key"))
    count = rows.count()
    share = min(1.0, SAMPLE * parts / max(count, 1))
    sample = sorted((r[0], r[1]) for r in rows.select("rank", "key").sample(share, 5).collect())  # about SAMPLE * parts
    bounds = sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []
    rows = rows.withColumn("bucket", _bucket(F.col("rank"), F.col("key"), bounds))
    tops = sorted((r[0], *r[1]) for r in rows.groupBy("bucket").agg(F.max(F.struct("rank", "key"))).collect())  # a row per bucket
    halos = [(rank, key, above[0]) for (_, rank, key), above in zip(tops, [*tops[1:], tops[0]] if tops else [], strict=True)]
    halo = spark.createDataFrame(halos, "rank long, key long, bucket int")
    copies = rows.drop("bucket").join(F.broadcast(halo), ["rank", "key"]).withColumn("halo", F.lit(1))
    every = rows.withColumn("halo", F.lit(0)).unionByName(copies)
    return every.repartition(parts, "bucket").sortWithinPartitions("bucket", "halo", F.desc("rank"), F.desc("key"), "text").select("bucket", "halo", "doc_id", "text")


def with_next(docs: DataFrame) -> DataFrame:
    """For each row its fingerprint, that of its edited text (the last third replaced
    by as many characters of the next document's start) and their likeness."""

    def run(batches):
        pending: list[tuple] = []  # rows whose successor has not come yet, and the rows before them
        size = 0
        for batch in batches:
            for row in zip(batch["bucket"], batch["halo"], batch["doc_id"], batch["text"], strict=True):
                pending.append(row)
                size += len(row[3])
                if size > CHUNK_BYTES // 3:
                    yield _compare(pending)
                    pending, size = pending[-1:], len(row[3])
        yield _compare(pending)

    return map_batches(in_order(docs), run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _compare(rows: list[tuple]) -> pd.DataFrame:
    """Results of all rows but the last and but halo copies."""
    own = [r[3].encode("utf-8", "surrogatepass") for r in rows]
    pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
    edited = []
    for i in pairs:
        text, k = rows[i][3], len(rows[i][3]) // 3
        edited.append((text[: len(text) - k] + rows[i + 1][3][:k]).encode("utf-8", "surrogatepass"))
    marks = [s for part in _parts(own + edited) for s in sketches(part)]
    out = []
    for n, i in enumerate(pairs):
        a, b, after = marks[i], marks[len(own) + n], marks[i + 1]
        out.append((rows[i][2], len(rows[i][3]), hashlib.sha256(edited[n]).hexdigest(), a, b, likeness(a, b), likeness(a, after)))
    return pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
