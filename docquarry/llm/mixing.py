"""Mixing sources to target weights by temperature.

Source s with token share p_s gets the weight w_s = p_s**a / sum(p**a). The exponent a
is bisected: it is the largest one, from 1 (natural shares) down to 0 (uniform), at which
the weights reach the target entropy, but never so small that a source would be repeated
more than `max_epochs` times. The budget is the smallest at which every source is seen
at least once.

The weights are realised as budgeted block permutations: in each epoch a source's
documents are permuted by a hash of (seed, epoch, doc_id); whole epochs are followed by
the longest prefix of one more permutation that fits the source's remaining budget. The
prefix sums need no source in one task: a permutation is cut into hash ranges of at most
about `block_tokens` tokens and `RANGE_ROWS` rows, sums run within a range and over the
ranges' totals.

Only DataFrame functions run here; the driver sees a fixed number of sums.

Defined cases: a null source is a source of its own. Null or empty texts have no tokens;
they go with their source's whole epochs and are free in the last. Sources without any
tokens get weight 0 and one epoch. Repeated rows are mixed like others. An empty table
gives an empty result. With one source the weight is 1.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.llm.common import Scratch, fresh

#: Up to so many sources their plan is broadcast (a row is under 100 bytes).
BROADCAST_SOURCES = 50_000
_SALTS = 64
#: Rows of a hash range, on average, of the source with the most rows.
RANGE_ROWS = 4_096


def count_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def order_key(doc_id: Column, epoch: Column, seed: int) -> Column:
    """63-bit place of a document in an epoch's permutation."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch.cast("int"), doc_id), 1)


@dataclass
class Mix:
    """plan: one row per source; items: narrow rows (doc_id, source, n_tokens)."""

    exponent: float
    budget: float
    plan: DataFrame
    items: DataFrame
    bits: int
    seed: int


def _measure(shares: DataFrame, exponents: list[float]) -> dict[float, float]:
    """Entropy of the weights at each exponent, from one aggregation."""
    p = F.col("share")
    sums = [f for a in exponents for f in (F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p)))]
    row = shares.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
    return {a: math.log(row[2 * i]) - a * row[2 * i + 1] / row[2 * i] for i, a in enumerate(exponents)}


def bisect_exponent(shares: DataFrame, target_entropy: float, max_epochs: float, passes: int = 5) -> float:
    """shares: rows with a positive `share`. Each pass tells the entropy at the 31
    midpoints that the next five halvings could ask for."""
    low_share, high_share = shares.agg(F.min("share"), F.max("share")).first()
    spread = high_share / low_share
    floor, top = 0.0, 1.0
    for _ in range(60):  # repetition: (largest / smallest share) ** (1 - a)
        mid = (floor + top) / 2
        floor, top = (floor, mid) if spread ** (1 - mid) <= max_epochs else (mid, top)
    limit = top if spread > max_epochs else 0.0
    low, high = 0.0, 1.0
    if _measure(shares, [1.0])[1.0] >= target_entropy:
        return 1.0
    for _ in range(passes):
        grid = [low + (high - low) * k / 32 for k in range(1, 32)]
        known = _measure(shares, grid)
        for _ in range(5):
            mid = min(grid, key=lambda a: abs(a - (low + high) / 2))
            low, high = (mid, high) if known[mid] >= target_entropy else (low, mid)
    return max(low, limit)


def plan_mix(docs: DataFrame, entropy_share: float = 0.95, max_epochs: float = 2.0, block_tokens: int = 1_000_000, seed: int = 17) -> Mix:
    """entropy_share: the target entropy as a part of the entropy of uniform weights."""
    scratch = Scratch(docs.sparkSession, "mixing")
    items = scratch.stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), count_tokens(F.col("text")).alias("n_tokens")), "mix-items")
    totals = scratch.stored(items.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "mix-sources")
    total, most, sources, rows = totals.agg(F.sum("tokens"), F.max("tokens"), F.count(F.when(F.col("tokens") > 0, 1)), F.max("rows")).first()
    bits = max(0, min(30, math.ceil(math.log2(max((most or 0) / block_tokens, (rows or 0) / RANGE_ROWS, 1)))))
    if not total:
        plan = totals.select("source", F.lit(0.0).alias("weight"), F.lit(1).alias("epochs"), F.lit(0).cast("long").alias("rest"), F.lit(-1).cast("long").alias("cut"), "tokens")
        return Mix(1.0, 0.0, plan, items, bits, seed)
    shares = totals.filter("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(total)))
    exponent = bisect_exponent(shares, entropy_share * math.log(max(sources, 2)), max_epochs)
    norm = shares.agg(F.sum(F.pow("share", F.lit(exponent)))).first()[0]
    weight = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(exponent)) / F.lit(norm)
    # w_s / p_s is least for the largest source; there one epoch is the whole budget
    budget = most / ((most / total) ** exponent / norm)
    want = F.when(F.col("tokens") > 0, F.greatest(weight * budget, F.col("tokens").cast("double"))).otherwise(0.0)
    epochs = F.when(F.col("tokens") > 0, F.floor(want / F.col("tokens") + F.lit(1e-9))).otherwise(1).cast("int")
    planned = totals.select("source", "tokens", F.when(F.col("tokens") > 0, weight).otherwise(0.0).alias("weight"), epochs.alias("epochs"), F.greatest(F.floor(want - epochs * F.col("tokens")), F.lit(0)).cast("long").alias("rest"))
    plan = scratch.stored(planned, "mix-weights")

    # the last, partial epoch: sums by hash range, then only the range that holds the cut
    last = attach(items, plan.filter("rest > 0").select("source", "epochs", "rest"))
    last = last.withColumn("key", order_key(F.col("doc_id"), F.col("epochs"), seed)).withColumn("range", F.shiftright("key", 63 - bits))
    ranges = _with_base(last.groupBy("source", "range").agg(F.sum("n_tokens").alias("in_range"), F.first("rest").alias("rest")), ["source"])
    edges = scratch.stored(ranges.filter((F.col("base") <= F.col("rest")) & (F.col("base") + F.col("in_range") > F.col("rest"))).select("source", F.col("range").alias("edge"), "base"), "mix-edges")
    upto = F.sum("n_tokens").over(Window.partitionBy("source", "range").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    inside = attach(last, edges).filter(F.col("range") == F.col("edge")).withColumn("upto", F.col("base") + upto)
    fit = F.max(F.when(F.col("upto") <= F.col("rest"), F.col("key")))
    start = F.shiftleft(F.col("edge").cast("long"), 63 - bits)
    cuts = inside.groupBy("source", "edge").agg(fit.alias("fit")).select("source", F.coalesce("fit", start - 1).alias("cut"))
    planned = attach(plan, cuts, "left").withColumn("cut", F.coalesce("cut", F.lit(-1).cast("long")))
    planned = scratch.stored(planned, "mix-plan")
    scratch.drop("mix-sources", "mix-weights", "mix-edges")
    return Mix(exponent, budget, planned, items, bits, seed)


def _with_base(ranges: DataFrame, group: list[str]) -> DataFrame:
    """Adds `base`, the tokens in the ranges before each, from one row per range."""
    order = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("base", F.coalesce(F.sum("in_range").over(order), F.lit(0)))


def attach(rows: DataFrame, plan: DataFrame, how: str = "inner") -> DataFrame:
    """Join one-row-per-source columns to rows. The plan is broadcast if it is counted to
    be small; else the join is salted, so that no source meets in one task."""
    key, salt = fresh(rows, "source_key"), fresh(rows, "salt")
    plan = plan.withColumnRenamed("source", key)
    same = rows["source"].eqNullSafe(plan[key])
    if plan.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(plan), same, how).drop(key)
    # a hash of the row: the same again if a task is run twice
    spread = F.xxhash64(F.lit(0), *[F.col(c) for c in ("doc_id", "n_tokens", "text") if c in rows.columns])
    left = rows.withColumn(salt, F.pmod(spread, F.lit(_SALTS)).cast("int"))
    right = plan.withColumn(f"{salt}r", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return left.join(right, left["source"].eqNullSafe(right[key]) & (F.col(salt) == F.col(f"{salt}r")), how).drop(key, salt, f"{salt}r")


def realise(mix: Mix, block_tokens: int = 1_000_000) -> DataFrame:
    """One row per document and epoch of the mixed stream: doc_id, source, n_tokens,
    weight, epoch, block and order_key (its place within the block). Each block holds
    about `block_tokens` tokens, every source with its weight."""
    rows = attach(mix.items, mix.plan).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
    rows = rows.withColumn("order_key", order_key(F.col("doc_id"), F.col("epoch"), mix.seed)).filter((F.col("epoch") < F.col("epochs")) | (F.col("order_key") <= F.col("cut")))
    rows = rows.withColumn("range", F.shiftright("order_key", 63 - mix.bits))
    ranges = _with_base(rows.groupBy("source", "epoch", "range").agg(F.sum("n_tokens").alias("in_range")), ["source", "epoch"]).drop("in_range")
    ranges = ranges.select(F.col("source").alias("source_r"), F.col("epoch").alias("epoch_r"), F.col("range").alias("range_r"), "base")
    same = F.col("source").eqNullSafe(F.col("source_r")) & (F.col("epoch") == F.col("epoch_r")) & (F.col("range") == F.col("range_r"))
    inside = Window.partitionBy("source", "epoch", "range").orderBy("order_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("epoch") * F.col("tokens") + F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    blocks = max(1, math.ceil(mix.budget / block_tokens))
    whole = F.greatest(F.col("epochs") * F.col("tokens") + F.col("rest"), F.lit(1))
    block = F.least(F.floor(place / whole * blocks), F.lit(blocks - 1)).cast("long")
    return rows.join(ranges, same).select("doc_id", "source", "n_tokens", "weight", "epoch", block.alias("block"), "order_key")


def rewrite(docs: DataFrame, **options) -> DataFrame:
    """`docs` with the same columns, each row as often as the mix has it."""
    mix = plan_mix(docs, **options)
    names = {c: fresh(docs, c) for c in ("epochs", "cut", "copies")}
    plan = mix.plan.select("source", F.col("epochs").alias(names["epochs"]), F.col("cut").alias(names["cut"]))
    rows = attach(docs, plan)
    again = order_key(F.col("doc_id").cast("long"), F.col(names["epochs"]), mix.seed) <= F.col(names["cut"])
    copies = F.sequence(F.lit(1), F.col(names["epochs"]) + F.when(again, 1).otherwise(0))
    return rows.withColumn(names["copies"], F.explode(copies)).select(*[F.col(f"`{c}`") for c in docs.columns])
