"""Quality classifier: a convolutional network over bytes, in numpy.

A text's UTF-8 bytes become learned vectors. Learned filters of `WIDTH` bytes are laid over
all of them, every second byte a start. Chunks of 512 bytes begin every 256 bytes, so each
place lies in two of them and the whole text is covered, whatever its length; the largest
answer of each filter within a chunk goes through a hidden layer, and the chunks' mean through
a logistic unit to one probability that the quality label is 1.

A text shorter than a chunk is padded by a symbol of its own, so that filters can tell short
texts from monotonous ones. Filters meet every start with
plain matrix products: for a fixed offset the windows lie one behind the other in memory.

Training runs on the driver over a bounded sample, the same size for any corpus; its rows are
weighted so that both labels count as often as in all labelled rows.

Defined cases: null and empty texts are scored as one chunk of padding. Without labelled rows
of both kinds every text has the share of label 1 among them, 0.5 where there are none. Rows
with another label than 0 or 1 teach nothing. Repeated rows are scored each, equal texts alike.
An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import chunks, held_out, map_batches

#: Bytes of a filter, of half a chunk; offsets of the windows.
WIDTH, HALF, OFFSETS = 8, 256, (0, 2, 4, 6)
#: Sizes: symbols, numbers for a symbol, filters, hidden units.
SYMBOLS, DIM, FILTERS, HIDDEN = 257, 8, 32, 16
#: Bytes scored side by side.
BATCH = 500_000
#: Share of the training examples that are cut to a short text, which has few answers.
SHORTENED = 0.1
PARAMETERS = ("byte", "filter", "filter_bias", "hidden", "hidden_bias", "out", "out_bias")


@dataclass
class Network:
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    #: The score of all texts where nothing could be learned.
    share: float = 0.5


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' symbols, each text padded by 0 to whole halves of a chunk (two at least) and
    one window more, so that no window meets two texts; where each text's halves begin (and the
    end); and which windows begin within halves."""
    halves = np.array([max(2, -(-len(t) // HALF)) for t in texts], np.int64)
    edge = np.concatenate([[0], np.cumsum(halves)])
    flat = np.zeros(edge[-1] * HALF + len(texts) * WIDTH, np.int16)
    for i, t in enumerate(texts):
        at = edge[i] * HALF + i * WIDTH
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        flat[at : at + len(t)] += 1
    inside = np.ones(len(flat) // WIDTH, bool)
    inside[edge[1:] * (HALF // WIDTH) + np.arange(len(texts))] = False
    return flat, edge, np.flatnonzero(inside)


def answers(w: dict[str, np.ndarray], flat: np.ndarray, inside: np.ndarray) -> list[np.ndarray]:
    """For each offset the filters' answers, (halves, windows of a half, filters)."""
    x = w["byte"][flat]
    rows = len(flat) // WIDTH - 1
    found = [x[o : o + rows * WIDTH].reshape(rows, WIDTH * DIM) @ w["filter"] for o in OFFSETS]
    return [(f if len(inside) == rows else f[inside]).reshape(-1, HALF // WIDTH, FILTERS) for f in found]


def pooled(w: dict[str, np.ndarray], flat: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The largest answer of each filter in each half, rectified."""
    best = None
    for found in answers(w, flat, inside):
        top = found.max(1)
        best = top if best is None else np.maximum(best, top)
    return np.maximum(best + w["filter_bias"], 0)


def probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """The probability of label 1 for each text."""
    if not net.weights:
        return np.full(len(texts), net.share)
    out, w = np.zeros(len(texts)), net.weights
    for start, stop in chunks([max(len(t), 2 * HALF) for t in texts], BATCH):
        part = texts[start:stop]
        sums = np.zeros((len(part), HIDDEN))
        count = np.array([max(2, -(-len(t) // HALF)) - 1 for t in part])
        if len(part) == 1:  # one text of any length, piece by piece; pieces share a half
            size = BATCH // HALF * HALF
            for at in range(0, max(len(part[0]) - HALF, 1), size):
                # with the next piece's first bytes, for the windows that reach into it
                flat, _, inside = symbols([part[0][at : at + size + HALF + WIDTH]])
                halves = max(2, -(-min(len(part[0]) - at, size + HALF) // HALF))
                p = pooled(w, flat[: halves * HALF + WIDTH], inside[: halves * HALF // WIDTH])
                sums[0] += np.maximum(np.maximum(p[:-1], p[1:]) @ w["hidden"] + w["hidden_bias"], 0).sum(0)
        else:
            flat, edge, inside = symbols(part)
            p = pooled(w, flat, inside)
            chunk = np.setdiff1d(np.arange(len(p)), edge[1:] - 1)  # all halves but each text's last
            h = np.maximum(np.maximum(p[chunk], p[chunk + 1]) @ w["hidden"] + w["hidden_bias"], 0)
            sums = np.add.reduceat(h, edge[:-1] - np.arange(len(part)), axis=0)
        logit = (sums / count[:, None]) @ w["out"] + w["out_bias"]
        out[start:stop] = 1 / (1 + np.exp(-np.clip(logit[:, 0], -30, 30)))
    return np.round(out, 6)


# -- training ------------------------------------------------------------------------


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {
        "byte": rng.normal(0, 0.5, (SYMBOLS, DIM)), "filter": rng.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)), "filter_bias": np.zeros(FILTERS),
        "hidden": rng.normal(0, (2 / FILTERS) ** 0.5, (FILTERS, HIDDEN)), "hidden_bias": np.full(HIDDEN, 0.1), "out": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), "out_bias": np.zeros(1),
    }
    return {k: v.astype(np.float32) for k, v in w.items()}


def gradients(w: dict[str, np.ndarray], flat: np.ndarray, inside: np.ndarray, bag: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted mean log loss of bags of chunks; flat holds the chunks as texts of two
    halves each; bag says to which of the labels a chunk belongs."""
    n = len(bag)
    per = HALF // WIDTH * 2
    found = np.stack([a.reshape(n, per, FILTERS) for a in answers(w, flat, inside)], 1).reshape(n, -1, FILTERS)
    at = found.argmax(1)  # (chunks, filters): offset number * windows + window
    best = np.take_along_axis(found, at[:, None], 1)[:, 0] + w["filter_bias"]
    p = np.maximum(best, 0)
    hidden = p @ w["hidden"] + w["hidden_bias"]
    h = np.maximum(hidden, 0)
    size = np.bincount(bag, minlength=len(label))[:, None]
    mean = np.zeros((len(label), HIDDEN), np.float32)
    np.add.at(mean, bag, h)
    mean /= size
    score = 1 / (1 + np.exp(-np.clip((mean @ w["out"] + w["out_bias"])[:, 0], -30, 30)))
    slope = ((score - label) * weight / weight.sum()).astype(np.float32)[:, None]
    back = {"out": mean.T @ slope, "out_bias": slope.sum(0)}
    d_hidden = (slope @ w["out"].T / size)[bag] * (hidden > 0)
    back |= {"hidden": p.T @ d_hidden, "hidden_bias": d_hidden.sum(0)}
    d_best = (d_hidden @ w["hidden"].T) * (best > 0)
    start = np.arange(n)[:, None] * (2 * HALF + WIDTH) + np.array(OFFSETS)[at // per] + at % per * WIDTH
    seen = flat[start[:, :, None] + np.arange(WIDTH)]  # symbols of the windows that answered
    x = w["byte"][seen].reshape(n, FILTERS, WIDTH * DIM)
    back |= {"filter": np.einsum("nf,nfx->xf", d_best, x), "filter_bias": d_best.sum(0)}
    d_x = (d_best[:, :, None] * w["filter"].T[None]).reshape(-1, DIM)
    flat_seen = seen.ravel()
    back["byte"] = np.stack([np.bincount(flat_seen, d_x[:, k], SYMBOLS) for k in range(DIM)], 1)
    return back


def _part(bag: list[bytes], rng: np.random.Generator) -> list[bytes]:
    """A short text: 12 to 400 bytes of one of the chunks, from a word's beginning."""
    piece = bag[rng.integers(len(bag))]
    start = piece.find(b" ", int(rng.integers(max(1, len(piece) - 12)))) + 1
    return [piece[start : start + int(12 * (400 / 12) ** rng.random())]]


def _bag_logits(w: dict[str, np.ndarray], bags: list[list[bytes]], size: int = 100) -> np.ndarray:
    """Of the training examples as they are, not cut."""
    out = []
    for at in range(0, len(bags), size):
        part = bags[at : at + size]
        flat, _, inside = symbols([p[: 2 * HALF] for b in part for p in b])
        halves = pooled(w, flat, inside).reshape(-1, 2, FILTERS)
        h = np.maximum(halves.max(1) @ w["hidden"] + w["hidden_bias"], 0)
        count = np.array([len(b) for b in part])
        mean = np.add.reduceat(h, np.cumsum(count) - count, axis=0) / count[:, None]
        out.append((mean @ w["out"] + w["out_bias"])[:, 0])
    return np.concatenate(out).astype(np.float64)


def curve(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by penalised Newton steps: the last unit once more,
    on whole examples, as training sees many that are cut."""
    x, a = np.stack([logit, np.ones(len(logit))], 1), np.array([1.0, 0.0])
    weight = weight / weight.sum() * len(label)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        slope = x.T @ (weight * (p - label)) + 0.1 * (a - [1.0, 0.0])
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + 0.1 * np.eye(2), slope)
        a -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a[0], 0.1)), float(a[1])


def train(bags: list[list[bytes]], label: np.ndarray, weight: np.ndarray, steps: int = 450, size: int = 48, seed: int = 7) -> Network:
    """Adam over `steps` batches of `size` bags, half of each label, weighted."""
    share = float((label * weight).sum() / weight.sum()) if len(label) else 0.5
    if len(set(label.tolist())) < 2:
        return Network(share=share)
    rng, w = np.random.default_rng(seed), initial(seed)
    first, second = ({k: np.zeros(v.shape) for k, v in w.items()} for _ in range(2))
    sides = [np.flatnonzero(label == y) for y in (0, 1)]
    # half of a batch is of each label, so a label's weight is its share of all weight
    mass = np.where(label == 1, share, 1 - share)
    for step in range(1, steps + 1):
        picked = np.concatenate([rng.choice(side, size // 2) for side in sides])
        shown = [bags[i] if rng.random() > SHORTENED else _part(bags[i], rng) for i in picked]
        pieces = [p for b in shown for p in b]
        bag = np.repeat(np.arange(size), [len(b) for b in shown])
        flat, _, inside = symbols([p[: 2 * HALF] for p in pieces])
        back = gradients(w, flat, inside, bag, label[picked], mass[picked])
        rate = 0.01 * min(1, step / 20) * (1 - step / (steps + 1))
        for k in PARAMETERS:
            g = back[k] + 1e-5 * w[k]
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g**2 - second[k])
            w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    slope, shift = curve(_bag_logits(w, bags), label, weight)
    w["out"], w["out_bias"] = w["out"] * np.float32(slope), w["out_bias"] * np.float32(slope) + np.float32(shift)
    return Network(w, share)


def fit(docs: DataFrame, labels: DataFrame, max_each: int = 1000, pieces: int = 4) -> Network:
    """Train on labelled rows that are not held out: of each label at most `max_each`
    documents (smallest hashes of their ids), and of a document at most `pieces` chunks, spread
    evenly from its beginning to its end."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    usable = named.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id", 5, 0) & F.col("quality").isin(0, 1)).distinct()
    counts = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = usable.filter("quality = 0").orderBy(*order).limit(max_each).unionByName(usable.filter("quality = 1").orderBy(*order).limit(max_each))
    span = 2 * HALF
    room = F.greatest(F.length("text") - span, F.lit(0))
    parts = F.least(F.ceil(F.length("text") / span), F.lit(pieces)).cast("int")
    begins = F.transform(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1), lambda i: F.when(parts > 1, F.floor(room * i / (parts - 1))).otherwise(0).cast("int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.transform(begins, lambda b: F.substr("text", b + 1, F.lit(span))).alias("parts"))
    # one text per picked row: repeated doc_ids do not widen the bounds
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("parts").alias("parts")).collect()
    rows = sorted((r["doc_id"], r["quality"], r["parts"]) for r in rows)
    label = np.array([y for _, y, _ in rows], np.int64)
    held = np.bincount(label, minlength=2)
    weight = np.array([counts[y] / held[y] for y in label.tolist()])
    return train([[p.encode() for p in parts] for _, _, parts in rows], label, weight)


def score(docs: DataFrame, net: Network, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(batches):
        for batch in batches:
            found = probabilities(shared.value, [t.encode() for t in batch["text"]])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": found, "predicted": (found >= threshold).astype("int32")})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 5, 0).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")
