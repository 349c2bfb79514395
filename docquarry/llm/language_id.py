"""Language identification by cross-parsing entropy.

A suffix automaton per language is built over running labelled text: letters in lower
case, everything between them one blank. A text, read in the same way, is parsed greedily
into the longest phrases that occur in a language's text, across words; the language whose
parse costs fewest bits per letter (phrases times log2 of its text's size) wins. A letter that
was learned in no language fits none: it is a phrase of its own everywhere. The score is the
language's share by those bits, drawn to 1 / languages as phrases get shorter than one and a half
letters; a text without any longer phrase has that score and the alphabetically first language.

An automaton is a table of steps, state and symbol to state and phrases ended, so a batch
of texts is parsed side by side, a symbol of each at a time; the few longest ones are then
parsed to their end one by one. All tables together are bounded by `CELLS`, whatever the
number of languages: with many of them each learns from less text. Letters beyond the
commonest share symbols, a block of the code table each.

Noise is told from language by the parse, too: letters of the learned text in random order
show how many phrases a letter costs where nothing but letter frequencies fits.

Defined cases: null text, or text without a letter -> `und`, score 0. No labelled
row at all -> every row `und`. Repeated rows -> each row gets its own result.
Ties between languages -> the alphabetically first one. A language with labelled text is
learned however long its texts are: fitting reads their beginnings. Extra columns are
ignored.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.llm.common import chunks, held_out, map_batches

UND = "und"
#: Symbols: 0 for blanks, the commonest letters, then shared ones; the last one stands for all
#: letters that were not learned, and is in no automaton.
COMMON, SHARED = 160, 32
#: Entries of all languages' tables (4 bytes each).
CELLS = 25_000_000
#: Characters parsed side by side, and texts below which they are parsed one by one.
_BATCH, _FEW = 2_000_000, 12


class SuffixAutomaton:
    """Suffix automaton of a sequence of symbols: every path from state 0 spells a part
    of it."""

    def __init__(self, symbols):
        self.edges: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for symbol in symbols:
            last = self._extend(last, symbol)

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.edges.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.edges) - 1

    def _split(self, p: int, symbol: int, q: int) -> int:
        """The state for the part of q that is one longer than p; q keeps the rest."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.edges[q]))
        self.link[q] = copy
        while p >= 0 and self.edges[p].get(symbol) == q:
            self.edges[p][symbol] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and symbol not in self.edges[p]:
            self.edges[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, symbol, self.edges[p][symbol])
        return new

    def steps(self, symbols: int) -> np.ndarray:
        """(states, symbols): 4 * next state + phrases that end before it. A symbol that
        does not go on ends the phrase and begins the next; one that occurs nowhere in the
        learned text is a phrase of its own."""
        table = np.full((len(self.edges), symbols), -1, np.int32)
        for state, edges in enumerate(self.edges):
            for symbol, after in edges.items():
                table[state, symbol] = after
        start = np.where(table[0] >= 0, table[0] * 4, 1)  # behind an ended phrase
        return np.where(table >= 0, table * 4, start + (np.arange(len(table)) > 0)[:, None]).astype(np.int32)


@lru_cache(2)
def symbol_table(alphabet: str, rare: str = "") -> np.ndarray:
    """Symbol of each code point: 0 unless it is a letter. rare: learned letters that share
    symbols."""
    letter = np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)
    table = np.where(letter, 1 + len(alphabet) + SHARED, 0).astype(np.uint8)
    some = np.array([ord(ch) for ch in rare], np.int64)
    table[some] = 1 + len(alphabet) + (some >> 7) % SHARED
    table[[ord(ch) for ch in alphabet]] = np.arange(1, len(alphabet) + 1)
    return table


def read(texts: list[str], alphabet: str, rare: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' symbols in one array, where each text begins (and the end), and the
    letters in each. Blanks never repeat and stand at no text's ends."""
    lowered = [t.lower() for t in texts]
    size = np.fromiter(map(len, lowered), np.int64, len(lowered))
    flat = symbol_table(alphabet, rare)[np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)]
    edge = np.concatenate([[0], np.cumsum(size)])
    begins = edge[:-1][size > 0]
    keep = flat > 0
    blank = ~keep
    blank[1:] &= keep[:-1]  # the first of a run
    blank[begins] = False
    last = np.zeros(len(flat) + 1, np.int32)  # letters before each place
    np.cumsum(keep, out=last[1:])
    blank &= last[:-1] < np.repeat(last[edge[1:]], size)  # a letter follows
    blank &= last[:-1] > np.repeat(last[edge[:-1]], size)  # and one is before
    keep |= blank
    before = np.zeros(len(flat) + 1, np.int32)
    np.cumsum(keep, out=before[1:])
    return flat[keep], before[edge].astype(np.int64), last[edge[1:]] - last[edge[:-1]]


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, the text each was learned from, the alphabet, the phrases per letter
    from which a text is noise in each language, and the learned letters beyond the alphabet."""

    langs: tuple[str, ...]
    texts: tuple[str, ...]
    alphabet: str
    noise: tuple[float, ...] = ()
    rare: str = ""


class Identifier:
    def __init__(self, model: LanguageModel):
        self.model = model
        self.symbols = 2 + len(model.alphabet) + SHARED
        tables, sizes, roots = [], [], [0]  # roots: where each language's states begin in the common table
        for text in model.texts:
            symbols = read([text], model.alphabet, model.rare)[0].tolist()
            table = SuffixAutomaton(symbols).steps(self.symbols)
            table += 4 * roots[-1]
            tables.append(table)
            sizes.append(len(symbols))
            roots.append(roots[-1] + len(table))
        self.root = np.array(roots[:-1], np.int32)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.bits = np.log2(2.0 + np.array(sizes))

    def phrases(self, flat: np.ndarray, start: np.ndarray) -> np.ndarray:
        """(texts, languages): phrases of each text, read as by `read`, in each language."""
        size = np.diff(start)
        order = np.argsort(-size, kind="stable")
        size, begin = size[order], start[:-1][order]
        state = np.repeat(self.root[None, :], len(order), 0)
        count = np.zeros(state.shape, np.int32)
        longest = int(size[0]) if len(size) else 0
        running = len(order) - np.searchsorted(size[::-1], np.arange(longest), side="right")  # texts longer than t
        t = 0
        while t < longest and (n := int(running[t])) >= _FEW:
            step = self.table[state[:n] * self.symbols + flat[begin[:n] + t][:, None]]
            count[:n] += step & 3
            state[:n] = step >> 2
            t += 1
        if t < longest:
            table, width = memoryview(self.table), self.symbols
            for i in range(int(running[t])):
                rest = flat[begin[i] + t : begin[i] + size[i]].tolist()
                for k in range(len(self.root)):
                    at, ended = int(state[i, k]), 0
                    for symbol in rest:
                        step = table[at * width + symbol]
                        ended += step & 3
                        at = step >> 2
                    state[i, k], count[i, k] = at, count[i, k] + ended
        out = np.empty_like(count)
        out[order] = count + (state != self.root)
        return out

    def predict(self, texts) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Of each text the language, the score and whether it is noise."""
        texts = [t or "" for t in texts]
        langs, scores, noise = [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        if not self.model.langs:
            return langs, scores, noise
        limit = np.array(self.model.noise or [np.inf] * len(self.model.langs))
        for a, b in chunks(list(map(len, texts)), _BATCH):
            flat, start, letters = read(texts[a:b], self.model.alphabet, self.model.rare)
            phrases = self.phrases(flat, start)
            size = np.maximum(np.diff(start), 1)
            longer = 1 - phrases.min(1) / size  # 0: every phrase is one symbol, in all languages
            cost = np.where(longer[:, None] > 0, phrases * self.bits, 0.0)
            best = cost.argmin(1)
            least = cost[np.arange(len(best)), best]
            even = 1 / len(self.model.langs)
            score = even + np.minimum(3 * longer, 1) * (1 / np.exp2(np.maximum(least[:, None] - cost, -200)).sum(1) - even)
            for i in np.flatnonzero(letters).tolist():
                langs[a + i], scores[a + i] = self.model.langs[best[i]], score[i]
                noise[a + i] = phrases[i, best[i]] > limit[best[i]] * letters[i] + _SLACK
        return langs, scores, noise


#: Phrases that a text of noise must have beyond the limit: short texts are not judged.
_SLACK = 20.0


@lru_cache(1)
def identifier(model: LanguageModel) -> Identifier:
    """One per Python worker, whatever the number of its tasks."""
    return Identifier(model)


def fit(docs: DataFrame, max_letters: int = 20_000, max_docs: int = 400, max_chars: int = 4_000) -> LanguageModel:
    """Learn from rows with text and lang that are not held out: of at most `max_docs`
    documents per language (the smallest hashes of their ids) the first `max_chars`
    characters each, until there are `max_letters` characters, or fewer where the tables of
    all languages would pass CELLS. A language without a letter in them is not learned."""
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out()).select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("string").alias("doc_id"), F.substring("text", 1, max_chars).alias("text"))
    counts = rows.groupBy("lang").count().collect()  # a row per language
    if not counts:
        return LanguageModel((), (), "")
    # a hash range with some four times the documents wanted of each language, so that the
    # windows see few rows however many a language has
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 4 * max_docs / r["count"])) for r in counts], "lang string, share double")
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / F.lit(float(1 << 63))
    rows = rows.join(F.broadcast(shares), "lang").filter(place <= F.col("share")).select("lang", "doc_id", "text").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    picked = rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= max_docs)
    before = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
    picked = picked.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < 2 * max_letters)  # bounded by max_letters and max_chars per language
    by_lang: dict[str, list] = {}
    for row in picked.collect():
        by_lang.setdefault(row["lang"], []).append((row["nth"], row["text"]))
    texts = {lang: "\n".join(t for _, t in sorted(found)) for lang, found in sorted(by_lang.items())}
    return learn(texts, max_letters)


def learn(texts: dict[str, str], limit: int) -> LanguageModel:
    """A model of at most `limit` characters of each language's text."""
    texts = {lang: text[:limit] for lang, text in sorted(texts.items()) if any(map(str.isalpha, text[:limit]))}
    letters = Counter(ch for text in texts.values() for ch in text.lower() if ch.isalpha())
    alphabet = "".join(ch for ch, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:COMMON])
    while texts and sum(2 * len(t) for t in texts.values()) * (2 + len(alphabet) + SHARED) > CELLS:
        texts = {lang: text[: max(20, len(text) * 3 // 4)] for lang, text in texts.items()}
        if all(len(t) <= 20 for t in texts.values()):
            break
    rare = "".join(sorted(set(letters) - set(alphabet)))
    model = LanguageModel(tuple(texts), tuple(texts.values()), alphabet, rare=rare)
    return LanguageModel(model.langs, model.texts, alphabet, _noise(model), rare)


def _noise(model: LanguageModel, size: int = 4_000) -> tuple[float, ...]:
    """Phrases per letter of each language's own letters in random order, less a
    twentieth."""
    if not model.langs:
        return ()
    rng, own = random.Random(7), Identifier(model)
    out = []
    for k, text in enumerate(model.texts):
        symbols = list(text[:size].lower())
        rng.shuffle(symbols)
        flat, start, letters = read(["".join(symbols)], model.alphabet, model.rare)
        out.append(0.95 * float(own.phrases(flat, start)[0, k]) / max(1, int(letters[0])))
    return tuple(out)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit()'s limits

    def run(batches):
        own = identifier(shared.value)
        for batch in batches:
            langs, scores, _ = own.predict(batch["text"])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": langs, "score": scores})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return map_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of `docs`, with all their columns, less those predicted `und` and noise;
    all rows where no language could be learned."""
    if not model.langs:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def is_language(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = identifier(shared.value)
        for texts in batches:
            langs, _, noise = own.predict(texts)
            yield pd.Series([lang != UND and not bad for lang, bad in zip(langs, noise, strict=True)], dtype=bool)

    return docs.filter(is_language("text"))
