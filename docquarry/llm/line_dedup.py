"""Line deduplication over levelled sorted runs of line hashes.

A run is a table bucketed and sorted by line hash: for each line key the number of
documents that hold it and the largest doc_id among them. A new batch is reduced to
one row per key, merge-anti-joined with the runs (keys that a run already settles are
not written again) and added as a run of level 0. When a level has `fanout` runs they
are merged into one run of the next level. Lines are dropped by a last join with the
merged runs.

Only DataFrame functions run here. Hot lines are pre-aggregated before each shuffle; the
join that marks occurrences deals a hot line over several tasks. Runs are dropped when they
are merged.

Defined cases: null or empty text is one empty line. Rows with a null doc_id neither
count as holders nor lose lines. Repeated rows of one doc_id count as one document and
each loses the same lines. Lines whose key is shorter than `min_chars` always stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import Scratch, fresh, salted_join, shuffle_partitions

_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(_BLANKS)), _UPPER, _LOWER)


class LineRuns:
    """Levelled runs of (a, b): two independent 64-bit hashes of a line key."""

    def __init__(self, spark: SparkSession, scratch: Scratch, min_docs: int = 3, fanout: int = 2):
        self.spark, self.scratch, self.min_docs, self.fanout = spark, scratch, min_docs, fanout
        self.buckets = shuffle_partitions(spark)
        self.levels: list[list[tuple[str, DataFrame]]] = []
        self.made = 0

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (doc_id, a, b); a document's lines must be in one batch.

        A key is settled for this batch if a run already counts `min_docs` documents
        and a doc_id at least as large as the batch's: nothing could change for it."""
        run = lines.groupBy("a", "b").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("last"))
        for old in self.runs():
            settled = old.filter(F.col("n") >= self.min_docs).select(F.col("a").alias("a_"), F.col("b").alias("b_"), F.col("last").alias("last_"))
            run = run.join(settled, (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_")) & (F.col("last_") >= F.col("last")), "left_anti")
        self._put(run, 0)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for _, run in level]

    def _put(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(self._write(run))
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(self._merge([run for _, run in full]), level + 1)
            self.scratch.drop(*[name for name, _ in full])

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        """Runs are merged in pairs by a merge join of their sorted buckets."""

        def pair(one: DataFrame, other: DataFrame) -> DataFrame:
            right = other.select("a", "b", F.col("n").alias("n_"), F.col("last").alias("last_"))
            total = F.coalesce("n", F.lit(0)) + F.coalesce("n_", F.lit(0))
            return one.join(right, ["a", "b"], "full_outer").select("a", "b", total.alias("n"), F.greatest("last", "last_").alias("last"))

        return reduce(pair, runs)

    def _write(self, run: DataFrame) -> tuple[str, DataFrame]:
        self.made += 1
        name = f"run{self.made}x"
        return name, self.scratch.bucketed(run, name, self.buckets, ["a", "b"])

    def repeated(self) -> DataFrame | None:
        """Keys with at least `min_docs` documents, and the largest doc_id of each."""
        runs = self.runs()
        return self._merge(runs).filter(F.col("n") >= self.min_docs).select("a", "b", "last") if runs else None


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = 3, fanout: int = 2, into: str = "line_dedup") -> DataFrame:
    """`docs` with all its columns and, first, a struct column named by `into` with n_lines,
    n_dropped and kept (the text left)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    row_key, lines, drop = fresh(docs, "row_key"), fresh(docs, "lines"), fresh(docs, "drop")
    keyed = F.transform(text_lines(F.col("text")), lambda line, i: F.struct((i + 1).alias("pos"), line_key(line).alias("key")))
    long_enough = F.filter(keyed, lambda x: F.length(x["key"]) >= min_chars)
    hashed = F.transform(long_enough, lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["key"]).alias("a"), F.xxhash64(F.lit(7), x["key"]).alias("b")))
    keys = scratch.stored(docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), hashed.alias("keys")), "line-keys")

    runs = LineRuns(spark, scratch, min_docs, fanout)
    for lower, upper in _ranges(keys, batches):  # the largest ids first, so that runs settle early
        batch = keys.filter((F.col("doc_id") > lower) & (F.col("doc_id") <= upper))
        runs.add(batch.select("doc_id", F.explode("keys").alias("k")).select("doc_id", "k.a", "k.b"))
    repeated = runs.repeated()
    if repeated is None:
        drops = spark.createDataFrame([], "doc_id long, row_key long, drop array<int>")
    else:
        seen = keys.select("doc_id", "row_key", F.explode("keys").alias("k")).select("doc_id", "row_key", "k.pos", "k.a", "k.b")
        settled = scratch.stored(repeated, "repeated-lines")
        scratch.drop(*[name for level in runs.levels for name, _ in level])
        hit = salted_join(seen, settled, ["a", "b"], ["doc_id", "pos"]).filter(F.col("doc_id") < F.col("last"))
        drops = hit.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set("pos")).alias("drop"))

    drops = drops.select(F.col("doc_id").alias(f"{drop}_id"), F.col("row_key").alias(row_key), F.col("drop").alias(drop))
    joined = docs.join(drops, (F.col("doc_id").cast("long") == F.col(f"{drop}_id")) & (F.xxhash64("text") == F.col(row_key)), "left")
    found = joined.withColumn(lines, text_lines(F.col("text")))
    kept = F.when(F.col(drop).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(_without(F.col(lines), F.col(drop)), "\n"))
    result = F.struct(F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))
    return found.select(result.alias(into), *[F.col(f"`{c}`") for c in docs.columns])


def _ranges(keys: DataFrame, batches: int) -> list[tuple[int, int]]:
    """Descending (lower, upper] ranges of doc_id with about as many documents each."""
    ends = keys.agg(F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()
    if ends[0] is None:
        return []
    cuts = sorted({ends[0] - 1, *(ends[2] or []), ends[1]}, reverse=True)
    return [(low, high) for high, low in zip(cuts, cuts[1:], strict=False)]


def _without(lines: Column, drop: Column) -> Column:
    """The lines but those at the ascending 1-based positions `drop`: the stretches
    between them, each sliced out once, so the work is linear in the lines."""

    def cut(bound: Column) -> Column:
        starts = F.concat(F.array(F.lit(1)), F.transform(drop, lambda p: p + 1))
        ends = F.concat(F.transform(drop, lambda p: p - 1), F.array(F.size(bound)))
        return F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(bound, s, F.greatest(e - s + 1, F.lit(0)))))

    # binds the array once; inlined into the lambda it would be split anew per stretch
    return F.element_at(F.transform(F.array(lines), cut), 1)


def rewrite(docs: DataFrame, **options) -> DataFrame:
    """`docs` with the same columns, each text without its dropped lines and n_chars,
    where there is one, brought up to date."""
    into = fresh(docs, "line_dedup")
    out = dedup_lines(docs, into=into, **options)
    kept = F.col(f"{into}.kept")
    new = {"text": kept, "n_chars": F.length(kept).cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
