"""Toxicity by a subsequence string-kernel support vector machine.

The kernel compares two short strings by their common subsequences of three characters;
an occurrence that spans s characters weighs decay**s, spans up to `SPAN`. So an insult
still matches when characters are inserted or left apart. A sentence is the list of its
parts (words without punctuation, long ones as overlapping windows), and the kernel of two
sentences is the sum, over pairs of their parts, of the normalised kernel to the power of
`SHARP`, so that what is alike counts and the many faint likenesses do not. It is made
explicit with Nyström landmarks (parts of toxic and of clean training sentences), and a
linear SVM is trained on sentences in that space. A part so has one evidence, from its
kernels with the landmarks, and a sentence's decision is the sum over its parts.

Training sentences carry their document's label, by the multiple-instance rule: all
sentences of a clean document are clean, and of a toxic document one at least is toxic, the
one with the strongest decision so far. At first that is the sentence of the part that is
most clearly commoner in toxic documents; machine and choice then alternate. The clean
sentences of the largest decisions join the training set from round to round. The rule holds
within sentences too: of a toxic one the strongest part is also given alone, as it is and
with a letter inserted, of a clean one any part alone is clean, and so is the empty
sentence. A text's decision is that of its
strongest sentence, and a logistic curve fitted on the training documents makes it a score.

Sentences end behind . ! ? with white space, and at line ends; one of more than `PARTS`
parts is cut. A run of spaced-out single letters is also a sentence of its own.

Defined cases: null and empty texts have no sentence and get the score of a decision
without any evidence. No labelled row of both classes, or no part in any toxic text ->
every score is 0. Labels of held-out rows are never read. Repeated rows are scored alike.
Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import held_out, map_batches

SPAN = 6
DECAY = 0.7
CODES = 64
WINDOW = 24
#: Power of the parts' kernel.
SHARP = 4
#: Most parts of one sentence.
PARTS = 40
_OTHER = CODES - 1
_SPACED = re.compile(r"\b\w(?:[^\w\n]{1,3}\w\b){2,}")
_BREAK = re.compile(r"(?<=[.!?…])\s+|[\n\v\f\r\x85\u2028\u2029]")
_GLUE = re.compile(r"[\W_]+")
_CACHE_WORDS = 800_000
_GAPS = [(a, b) for a in range(1, SPAN - 1) for b in range(1, SPAN - a)]


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence of a text; the runs of spaced-out letters come last."""
    if not text:
        return []
    low = text.lower()
    out = [words for part in _BREAK.split(low) if (words := part.split())]
    return out + [[m.group()] for m in _SPACED.finditer(low)]


class Kernel:
    """Subsequence features of short strings over a fixed alphabet of up to 62 characters;
    all other characters share one code."""

    def __init__(self, alphabet: str):
        self.alphabet = alphabet
        self.table = np.full(0x110000, _OTHER, np.uint8)  # of every code point, in any script
        self.table[0] = 0
        self.table[[ord(ch) for ch in alphabet[: CODES - 2]]] = np.arange(1, min(len(alphabet), CODES - 2) + 1)

    def encode(self, strings: list[str]) -> np.ndarray:
        """(n, width) codes, 0 behind the end."""
        width = max([3, *map(len, strings)])
        points = np.zeros((len(strings), width), np.uint32)
        flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        points[np.arange(width) < size[:, None]] = flat
        return self.table[points]

    @staticmethod
    def triples(codes: np.ndarray):
        """For each gap pattern the subsequences' numbers (0: one reaches past the end)
        and their weight."""
        wide = codes.astype(np.int32)
        for a, b in _GAPS:
            n = codes.shape[1] - a - b
            if n > 0:
                third = wide[:, a + b :]
                number = (wide[:, :n] * CODES + wide[:, a : a + n]) * CODES + third
                yield np.where(third > 0, number, 0), DECAY ** (a + b + 1)

    def norms(self, codes: np.ndarray) -> np.ndarray:
        """Square roots of the kernel of each string with itself."""
        pairs = list(self.triples(codes))
        number = np.concatenate([n for n, _ in pairs], 1)
        weight = np.concatenate([np.full(n.shape[1], w) for n, w in pairs])
        order = np.argsort(number, 1)
        number = np.take_along_axis(number, order, 1)
        weight = np.where(number > 0, weight[order], 0.0)
        total = np.cumsum(weight, 1)
        last = np.ones(number.shape, bool)
        last[:, :-1] = number[:, 1:] != number[:, :-1]
        out = np.zeros(len(codes))
        row, at = np.nonzero(last)
        ends = total[row, at]
        before = np.where(np.diff(row, prepend=-1) > 0, 0.0, np.concatenate([[0.0], ends[:-1]]))
        np.add.at(out, row, (ends - before) ** 2)
        return np.sqrt(np.maximum(out, 1e-12))


def pieces(unit: str) -> list[str]:
    """A word without punctuation and blanks, between marks for its ends; a long one as
    overlapping windows."""
    if not unit.isalnum():
        unit = _GLUE.sub("", unit)
    if len(unit) <= WINDOW:
        return [f"<{unit}>"] if len(unit) > 2 else []
    unit = f"<{unit}>"
    return [unit[i : i + WINDOW] for i in range(0, len(unit) - WINDOW // 2, WINDOW // 2)]


def sentence_parts(text: str | None) -> list[tuple[str, ...]]:
    """The parts of each sentence, at most PARTS in one."""
    out = []
    for words in sentences(text):
        parts = [p for w in words for p in pieces(w)]
        out += [tuple(parts[i : i + PARTS]) for i in range(0, len(parts), PARTS)]
    return out


def with_insertion(part: str) -> list[str]:
    """The part with one more letter, an x or a doubled one, near its middle."""
    k = len(part) // 2
    return [part[:k] + "x" + part[k:], part[: k + 1] + part[k:]]


@dataclass
class ToxicModel:
    """alphabet; the landmarks' subsequences and features; the weight of each landmark;
    bias; slope and shift of the score curve."""

    alphabet: str = ""
    columns: np.ndarray | None = None
    marks: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 0.0
    shift: float = 0.0

    def score(self, decision: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(decision))
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.shift, -50, 50)))


class Scorer:
    def __init__(self, model: ToxicModel):
        self.model = model
        self.space = Landmarks(Kernel(model.alphabet), model.columns, model.marks) if model.weights is not None else None
        self.known: dict[str, float] = {}  # of words that are one part at most
        self.long: dict[str, list[float]] = {}  # of the parts of others, none or several

    def evidence(self, parts: list[str]) -> np.ndarray:
        """The machine's sum over the landmarks for each part."""
        return self.space.likeness(parts) @ self.model.weights

    def learn(self, words) -> None:
        """Work out the evidence of words that are not known yet."""
        words = list(words)
        for start in range(0, len(words), 20_000):
            part = words[start : start + 20_000]
            found = [pieces(w) for w in part]
            value = iter(self.evidence([p for f in found for p in f]).tolist())
            for word, own in zip(part, found, strict=True):
                if len(own) > 1:
                    self.long[word] = [next(value) for _ in own]
                    self.known[word] = math.nan
                else:
                    self.known[word] = next(value) if own else 0.0
                    if not own:
                        self.long[word] = []

    def _strongest(self, found: list[list[str]]) -> float:
        """The best sum of a sentence's evidence. Words of two parts or more, and sentences
        of more than PARTS words, are summed part by part."""
        known, best = self.known, -math.inf
        for words in found:
            total = sum(map(known.__getitem__, words)) if len(words) <= PARTS else math.nan
            if total != total:
                values = [v for w in words for v in (self.long[w] if w in self.long else (known[w],))]
                total = max((sum(values[i : i + PARTS]) for i in range(0, len(values), PARTS)), default=0.0)
            if total > best:
                best = total
        return best if found else 0.0

    def decisions(self, texts) -> np.ndarray:
        if self.model.weights is None:
            return np.zeros(len(texts))
        if len(self.known) > _CACHE_WORDS:
            self.known.clear()
            self.long.clear()
        out = np.zeros(len(texts))
        batch: list[tuple[int, list]] = []
        missing: set[str] = set()

        def settle():
            self.learn(missing)
            missing.clear()
            for i, found in batch:
                out[i] = self._strongest(found)
            batch.clear()

        for i, text in enumerate(texts):
            found = sentences(text)
            batch.append((i, found))
            for words in found:
                missing.update(words)
            if len(batch) > 500 or len(missing) > 50_000:
                missing.difference_update(self.known)
                settle()
        missing.difference_update(self.known)
        settle()
        return out + self.model.bias


# -- training ------------------------------------------------------------------------


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = 1500, max_clean: int = 3000, max_chars: int = 20_000) -> ToxicModel:
    """Train on labelled rows that are not held out: at most `max_toxic` and `max_clean`
    documents (smallest hashes of their ids) and of each the first `max_chars` characters.
    The bounds keep training on the driver the same size for any corpus."""
    usable = labels.filter(F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1)).distinct()
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = usable.filter("toxic = 1").orderBy(*order).limit(max_toxic).unionByName(usable.filter("toxic = 0").orderBy(*order).limit(max_clean))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.substring("text", 1, max_chars).alias("text")).filter("text is not null")
    # one text per picked row: repeated doc_ids do not widen the bounds
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows = sorted((r["doc_id"], r["text"], r["toxic"]) for r in rows)
    return train([t for _, t, _ in rows], np.array([y for _, _, y in rows]))


def train(texts: list[str], toxic: np.ndarray, landmarks: int = 96, rounds: int = 4, clean_sentences: int = 8000) -> ToxicModel:
    if len(set(toxic.tolist())) < 2:
        return ToxicModel()
    found = [sentence_parts(t) for t in texts]
    bags = [{p for s in of for p in s} for of in found]
    n_bad, n_good = int(toxic.sum()), int((1 - toxic).sum())
    bad, good = Counter(), Counter()
    for bag, y in zip(bags, toxic, strict=True):
        (bad if y else good).update(bag)
    worth = {w: _evidence(n, n_bad, good[w], n_good) for w, n in bad.items()}
    if not worth:
        return ToxicModel()
    # landmarks: the parts of most evidence, and the commonest of clean text
    marks = sorted(worth, key=lambda w: (-worth[w], w))[: landmarks * 3 // 4]
    alphabet = "<>" + "".join(ch for ch, _ in Counter("".join(marks)).most_common(CODES - 2) if ch not in "<>")
    clean_marks = [w for w in sorted(good, key=lambda w: (-good[w], w)) if w not in set(marks)][: landmarks // 4]
    space = Landmarks.of(Kernel(alphabet), marks + clean_marks)
    root = space.root()

    clean = sorted({s for of, y in zip(found, toxic, strict=True) if not y for s in of}, key=lambda s: zlib.crc32(" ".join(s).encode("utf-8", "surrogatepass")))
    bad_docs = [of for of, y in zip(found, toxic, strict=True) if y and of]
    value = worth
    strength = lambda s: max(value[p] for p in s)
    near = clean[:clean_sentences]
    model = ToxicModel()
    common = sorted(good, key=lambda w: (-good[w], w))[:2000]
    for _ in range(rounds):
        strongest = lambda s: max(s, key=lambda p: (value.get(p, 0.0), p))
        positive = Counter(max(of, key=lambda s: (strength(s), s)) for of in bad_docs)
        alone = Counter((strongest(s),) for s in positive.elements())
        varied = Counter({(v,): n for (p,), n in alone.items() for v in with_insertion(p) if v not in good})
        single = sorted(({(strongest(s),) for s in near} | {(p,) for p in common}) - set(alone))
        toxic_side, clean_side = [*positive, *alone, *varied], [*near, *single]
        x = np.concatenate([space.sums(toxic_side + clean_side, root), np.zeros((1, root.shape[1]))])
        y = np.concatenate([np.ones(len(toxic_side)), -np.ones(len(clean_side) + 1)])
        times = [*positive.values(), *np.sqrt([*alone.values(), *varied.values()])]
        weight = np.concatenate([times, np.ones(len(clean_side)), [0.1 * len(near)]])
        weight[y > 0] *= weight[y < 0].sum() / weight[y > 0].sum()
        w, bias = _svm(x, y, weight)
        model = ToxicModel(alphabet, space.columns, space.marks, root @ w, bias)
        parts = sorted({p for bag in bags for p in bag})
        value = dict(zip(parts, Scorer(model).evidence(parts).tolist(), strict=True))
        total = lambda s: sum(value[p] for p in s)
        strength = total
        near = sorted(set(near) | set(sorted(clean, key=lambda s: -total(s))[: clean_sentences // 2]))
    decision = np.array([max((sum(value[p] for p in s) for s in of), default=0.0) for of in found]) + model.bias
    model.slope, model.shift = _curve(decision, toxic)
    return model


def _evidence(a: int, of_a: int, b: int, of_b: int) -> float:
    """Log-likelihood ratio of a part's document counts in toxic and clean text; 0 unless
    it is commoner in toxic text."""
    if a * of_b <= b * of_a:
        return 0.0
    share = (a + b) / (of_a + of_b)
    cells = ((a, of_a * share), (b, of_b * share), (of_a - a, of_a * (1 - share)), (of_b - b, of_b * (1 - share)))
    return 2 * sum(n * math.log(n / expected) for n, expected in cells if n)


class Landmarks:
    """Normalised features of the landmarks, by subsequence; `columns` are the numbers of
    the subsequences that they have."""

    def __init__(self, kernel: Kernel, columns: np.ndarray, marks: np.ndarray):
        self.kernel, self.columns, self.marks = kernel, columns, marks
        self.column = np.full(CODES**3, len(columns), np.int32)
        self.column[columns] = np.arange(len(columns))

    @classmethod
    def of(cls, kernel: Kernel, marks: list[str]) -> Landmarks:
        numbers = np.unique(np.concatenate([n.ravel() for n, _ in kernel.triples(kernel.encode(marks))]))
        space = cls(kernel, numbers[numbers > 0], np.zeros((0, 0), np.float32))
        space.marks = space._features(marks)
        return space

    def _features(self, parts: list[str]) -> np.ndarray:
        """Normalised features, only those subsequences that landmarks have."""
        codes = self.kernel.encode(parts)
        width = len(self.columns) + 1
        out = np.zeros(len(codes) * width, np.float32)
        own = np.arange(len(codes))[:, None] * width
        for number, weight in self.kernel.triples(codes):
            at = self.column[number]
            for k in range(number.shape[1]):
                out[own[:, 0] + at[:, k]] += np.float32(weight)
        return out.reshape(len(codes), width)[:, :-1] / self.kernel.norms(codes)[:, None].astype(np.float32)

    def likeness(self, parts: list[str]) -> np.ndarray:
        """(parts, landmarks): the sharpened kernel."""
        out = np.zeros((len(parts), len(self.marks)), np.float32)
        order = np.argsort(np.fromiter(map(len, parts), np.int64, len(parts)), kind="stable")
        for group in np.array_split(order, max(1, len(order) // 500)):  # alike in length
            if len(group):
                out[group] = np.maximum(self._features([parts[i] for i in group]) @ self.marks.T, 0) ** SHARP
        return out

    def root(self) -> np.ndarray:
        """Turns kernels with the landmarks into coordinates in which a dot product is the
        kernel."""
        values, vectors = np.linalg.eigh(np.maximum(self.marks.astype(np.float64) @ self.marks.T, 0) ** SHARP)
        keep = values > 1e-6 * values.max()
        return vectors[:, keep] / np.sqrt(values[keep])

    def sums(self, examples: list[tuple[str, ...]], root: np.ndarray) -> np.ndarray:
        """Coordinates of sentences: the sums of their parts'."""
        index = {p: i for i, p in enumerate(sorted({p for s in examples for p in s}))}
        x = self.likeness(list(index)) @ root
        flat = np.fromiter((index[p] for s in examples for p in s), np.int64)
        start = np.cumsum([0, *map(len, examples)])[:-1]
        return np.add.reduceat(x[flat], start)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps on the rows inside the margin."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    ridge = np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-4
    active = None
    for _ in range(steps):
        inside = y * (x1 @ w) < 1
        if active is not None and (inside == active).all():
            break
        active = inside
        part, cost = x1[inside], (c * weight)[inside, None]
        w = np.linalg.solve(ridge + part.T @ (cost * part), part.T @ (cost[:, 0] * y[inside]))
    return w[:-1], float(w[-1])


def _curve(decision: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic slope and shift by penalised Newton steps, classes weighted alike."""
    x = np.stack([decision, np.ones(len(decision))], 1)
    weight = np.where(toxic == 1, 0.5 / max(toxic.sum(), 1), 0.5 / max((1 - toxic).sum(), 1)) * len(toxic)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        gradient = x.T @ (weight * (p - toxic)) + np.array([0.02, 0.0]) * w
        hessian = (x.T * (weight * p * (1 - p))) @ x + np.diag([0.02, 1e-6])
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: ToxicModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            found = shared.value.score(scorer.decisions(batch["text"].tolist()))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": found, "predicted": (found >= threshold).astype("int32")})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")
