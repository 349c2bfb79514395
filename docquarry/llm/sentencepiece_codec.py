"""Encoding and decoding with a SentencePiece model by streaming Viterbi.

A text is a chain of boundaries; every piece that ends at a boundary is an arc. The
decoder keeps the surviving backpointers of a window no longer than the longest piece, and
commits ids whenever all surviving paths converge on one boundary. Two kinds of survivor
rule are known:

* ``unigram``: the path with the largest sum of piece scores survives.
* ``bpe``: a path survives if merging by rank would build it. The merge result of any
  prefix ends in exactly one piece, so each boundary has exactly one survivor: the arc
  whose piece and predecessor merge into just that pair. This makes the ids equal those
  of the merge procedure for BPE models.

Paths converge on a boundary if the least of the last common boundaries of neighbouring
survivors is that boundary; a boundary from which a piece may still start is a survivor
itself. So within a word no longer than the longest piece nothing can be committed before
its end, and words that share a beginning share its lattice: the decoder takes the distinct
words of a batch in sorted order and goes on from the boundary up to which a word equals
the one before, unless it has committed ids since.

No piece runs from a character into a following word mark, so the mark is always a
boundary on which all paths converge: every word is a stream of its own. The ids that the
decoder found for words are remembered in a bounded cache.

Models are read from their file. Supported are BPE and unigram models with the identity
normaliser, a dummy prefix, escaped white space, no removal of extra white space and no
user-defined pieces; others raise ValueError.

Defined cases: null text -> no ids, decoded ''. Empty text -> no ids. Characters outside
the vocabulary -> byte pieces (models without them: the unknown id, which decodes to
U+2047). A text's own U+2581 is the word mark and decodes to a space. Very long words
cost memory in proportion to the window, not to their length. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import chunks, map_batches

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words, and pairs of pieces, whose decisions a decoder remembers.
_CACHE_WORDS, _CACHE_PAIRS = 400_000, 400_000
_NEVER = float("-inf")
_ONE = (1,)


@dataclass(eq=False)
class PieceModel:
    """Plain data of a model: pieces by id, scores, which ids text may use, byte ids."""

    pieces: list[str]
    scores: list[float]
    usable: list[bool]
    byte_ids: list[int]
    unk: int
    kind: str = "bpe"
    ids: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.usable[i]}


# Fixed values of the public model format: field numbers of the file, of a piece, of the
# trainer's and the normaliser's settings; kinds of pieces and of models.
_PIECES, _TRAINER, _NORMALISER = 1, 2, 3
_PIECE, _SCORE, _TYPE = 1, 2, 3
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_MODEL_TYPE, _KINDS = 3, {1: "unigram", 2: "bpe"}
_CHARSMAP, _DUMMY_PREFIX, _REMOVE_EXTRA, _ESCAPE = 2, 3, 4, 5


def _fields(data: bytes):
    """(field number, value) of a serialised message: integers, 4- or 8-byte strings of
    fixed-width numbers, or the bytes of strings and messages."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


def parse_model(data: bytes) -> PieceModel:
    """The vocabulary of a model file; ValueError for models that need what is not built."""
    pieces, scores, types = [], [], []
    trainer: dict = {}
    normaliser: dict = {}
    for number, value in _fields(data):
        if number == _PIECES:
            piece = dict(_fields(value))
            pieces.append(piece.get(_PIECE, b"").decode())
            scores.append(struct.unpack("<f", piece[_SCORE])[0] if _SCORE in piece else 0.0)
            types.append(piece.get(_TYPE, _NORMAL))
        elif number in (_TRAINER, _NORMALISER):
            (trainer if number == _TRAINER else normaliser).update(_fields(value))
    kind = _KINDS.get(trainer.get(_MODEL_TYPE, 1))
    if kind is None:
        raise ValueError("only BPE and unigram models are supported")
    if _USER in types:
        raise ValueError("user-defined pieces are not supported")
    if normaliser.get(_CHARSMAP) or normaliser.get(_REMOVE_EXTRA, 1) or not normaliser.get(_DUMMY_PREFIX, 1) or not normaliser.get(_ESCAPE, 1):
        raise ValueError("the model's normaliser is not supported")
    bytes_ = {int(p[3:-1], 16): i for i, (p, t) in enumerate(zip(pieces, types, strict=True)) if t == _BYTE}
    usable = [t == _NORMAL for t in types]
    unk = types.index(_UNKNOWN) if _UNKNOWN in types else 0
    return PieceModel(pieces, scores, usable, [bytes_[b] for b in range(256)] if len(bytes_) == 256 else [], unk, kind)


def load_model(path: str = DEFAULT_MODEL) -> PieceModel:
    """Read the vocabulary of a model file on the driver."""
    with open(path, "rb") as file:
        return parse_model(file.read())


class _Cache(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        self[key] = value = self.make(key)
        return value


class _Window:
    """Surviving backpointers of the boundaries from `base` on, where all paths met last:
    for each the size of its arc, the arc's piece (None: not reached; -1: a character
    outside the vocabulary) and the sum of scores."""

    __slots__ = ("base", "sizes", "arcs", "sums")

    def __init__(self):
        self.base = 0
        self.sizes: list[int] = [0]
        self.arcs: list[int | None] = [None]
        self.sums: list[float] = [0.0]

    def back(self, boundary: int) -> None:
        del self.sizes[boundary + 1 :], self.arcs[boundary + 1 :], self.sums[boundary + 1 :]

    def commit(self, boundary: int) -> None:
        """Forget what is before; a bpe pair must still see its left neighbour, so that
        boundary's arc stays."""
        self.base += boundary
        del self.sizes[:boundary], self.arcs[:boundary], self.sums[:boundary]


class Codec:
    def __init__(self, model: PieceModel):
        self.model, self.ids = model, model.ids
        self.longest = max(map(len, self.ids), default=1)
        self.growth = _Cache(self._growth)
        self.fits = _Cache(self._fits)
        self.worst = min(model.scores, default=0.0) - 10.0  # score of a character outside the vocabulary
        self.first = _Cache(lambda w: self._bytes(MARK + w))  # words behind a mark
        self.plain = _Cache(self._bytes)
        self.splits = all(MARK not in p.lstrip(MARK) for p in self.ids) and "\n" not in "".join(self.ids)
        self.raw = self._raw()
        tails: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) > 1:
                tails.setdefault(piece[-3:], set()).add(len(piece))
        #: lengths of the pieces that end in three characters, or are two, the longest first
        self.tails = {end: (*sorted(sizes | tails.get(end[-2:], set()), reverse=True), 1) for end, sizes in tails.items()}

    def _raw(self) -> list[bytes]:
        raw = [p.encode() if use else b"" for p, use in zip(self.model.pieces, self.model.usable, strict=True)]
        for b, i in enumerate(self.model.byte_ids):
            raw[i] = bytes([b])
        if 0 <= self.model.unk < len(raw):
            raw[self.model.unk] = " ⁇ ".encode()
        return raw

    # -- lattice ---------------------------------------------------------------

    def _growth(self, piece: int) -> tuple[list, list]:
        """The merges that build a piece from its characters, in order: for each its
        score with the last symbol it leaves, and the same with the first symbol."""
        symbols, scores, last, first = list(self.model.pieces[piece]), self.model.scores, [], []
        while len(symbols) > 1:
            ranked = [(scores[i], -k) for k in range(len(symbols) - 1) if (i := self.ids.get(symbols[k] + symbols[k + 1])) is not None]
            if not ranked:
                break
            score, k = max(ranked)
            symbols[-k : 2 - k] = [symbols[-k] + symbols[1 - k]]
            last.append((score, symbols[-1]))
            first.append((score, symbols[0]))
        return last, first

    def _fits(self, pair: int) -> bool:
        """Whether merging the text of two pieces (first * number of pieces + second) by
        rank gives just them: no merge across the seam may ever outrank the next merge on
        either side (leftmost on ties)."""
        one, two = divmod(pair, len(self.model.pieces))
        (left, _), (_, right) = self.growth[one], self.growth[two]
        x, y = self.model.pieces[one][-1], self.model.pieces[two][0]
        i = j = 0
        while True:
            a = left[i][0] if i < len(left) else _NEVER
            b = right[j][0] if j < len(right) else _NEVER
            across = self.ids.get(x + y)
            if across is not None and (score := self.model.scores[across]) > a and score >= b:
                return False
            if a == b == _NEVER:
                return True
            if a >= b:
                x, i = left[i][1], i + 1
            else:
                y, j = right[j][1], j + 1

    def _unknown(self, ch: str) -> tuple[int, ...]:
        return tuple(self.model.byte_ids[b] for b in ch.encode("utf-8", "surrogatepass")) or (self.model.unk,) if self.model.byte_ids else (self.model.unk,)

    def viterbi(self, text: str):
        """Yield runs of ids in order, each as soon as every surviving path has it."""
        yield from self._decode(_Window(), text, 0)

    def _decode(self, window: _Window, text: str, known: int):
        """Go on from boundary `known` of the text, up to which the window holds it."""
        bpe, ids, tails, longest, scores, fits = self.model.kind == "bpe", self.ids, self.tails, self.longest, self.model.scores, self.fits
        number = len(scores)
        base, sizes, arcs, sums = window.base, window.sizes, window.arcs, window.sums
        for end in range(known + 1, len(text) + 1):
            at = end - base  # the boundary's place in the window
            best, piece_of, top = 0, None, _NEVER
            for size in tails.get(text[end - 3 : end]) or tails.get(text[end - 2 : end], _ONE):
                if size > at:
                    continue
                piece = ids.get(text[end - size : end])
                if piece is None:
                    continue
                before = arcs[at - size]
                if before is None and at - size + base:
                    continue  # no path reaches that boundary
                if bpe:
                    if before is None or before < 0 or fits[before * number + piece]:
                        best, piece_of = size, piece
                        break
                elif sums[at - size] + scores[piece] > top:
                    best, piece_of, top = size, piece, sums[at - size] + scores[piece]
            if not best and text[end - 1] not in ids:
                best, piece_of, top = 1, -1, sums[at - 1] + self.worst  # outside the vocabulary: a break for either rule
            sizes.append(best)
            arcs.append(piece_of)
            sums.append(0.0 if bpe else top)
            if at >= longest and best:
                meet = self._meet(window, at)
                if meet:
                    yield self._path(window, meet, text)
                    window.commit(meet)
                    base = window.base
        yield self._path(window, len(text) - base, text)

    def _meet(self, window: _Window, at: int) -> int:
        """The last boundary that all survivors run through: those in reach of the next
        character and the newest. 0 if that is the one committed last."""
        arcs, sizes = window.arcs, window.sizes
        alive = [k for k in range(max(0, at - self.longest + 1), at + 1) if arcs[k] is not None or not k]
        meet = alive[0]
        for other in alive[1:]:
            while other > meet:
                other -= sizes[other]
            while meet > other:
                meet -= sizes[meet]
                while other > meet:
                    other -= sizes[other]
        return meet

    def _path(self, window: _Window, at: int, text: str) -> list[int]:
        out: list[int] = []
        while at > 0:
            piece = window.arcs[at]
            out += (piece,) if piece >= 0 else reversed(self._unknown(text[window.base + at - 1]))
            at -= window.sizes[at]
        return out[::-1]

    # -- texts -------------------------------------------------------------------

    def _bytes(self, word: str) -> bytes:
        return b"".join(struct.pack(f"<{len(run)}i", *run) for run in self.viterbi(word))

    def forget(self) -> None:
        """Empty the cache of words."""
        self.first.clear()
        self.plain.clear()

    def learn(self, texts) -> None:
        """Decode the words of texts that the cache lacks."""
        if len(self.first) + len(self.plain) > _CACHE_WORDS:
            self.forget()
        if len(self.fits) > _CACHE_PAIRS:
            self.fits.clear()
        if not self.splits:
            return
        marked: set[str] = set()
        plain: set[str] = set()
        for text in texts:
            head, *lines = (text or "").split("\n")
            marked.update(head.split(" "))
            for line in lines:
                word, *words = line.split(" ")
                plain.add(word)
                marked.update(words)
        marked.difference_update(self.first)
        plain.difference_update(self.plain)
        for word, data in self._sorted_words(sorted(MARK + w for w in marked if MARK not in w)):
            self.first[word[1:]] = data
        for word, data in self._sorted_words(sorted(w for w in plain if w and MARK not in w)):
            self.plain[word] = data

    def _sorted_words(self, words: list[str]):
        """(word, ids as bytes). A word goes on in the window of the one before from the
        last boundary that they share, if nothing was committed there."""
        window, last, pack = _Window(), "", struct.pack
        for word in words:
            same = 0
            if window.base:
                window = _Window()
            else:
                most = min(len(word), len(last))
                while same < most and word[same] == last[same]:
                    same += 1
                window.back(same)
            last = word
            yield word, b"".join([pack(f"<{len(run)}i", *run) for run in self._decode(window, word, same)])

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not text:
            return b""
        if not self.splits:
            return self._bytes(MARK + text.replace(" ", MARK))
        out, first, plain = [], self.first.__getitem__, self.plain.__getitem__
        newline = b""
        for line in text.split("\n"):
            if newline:
                out.append(newline)
            if "  " in line or line[-1:] == " " or MARK in line or (newline and line[:1] == " "):
                marked = ("" if newline else MARK) + line.replace(" ", MARK)
                out += map(plain, self._units(marked))
            elif newline:
                head, *rest = line.split(" ")
                if head:
                    out.append(plain(head))
                out += map(first, rest)
            elif line[:1] == " ":
                out += map(plain, self._units(MARK + line.replace(" ", MARK)))
            else:
                words = line.split(" ")
                out += map(first, words)
            newline = newline or plain("\n")
        return b"".join(out)

    @staticmethod
    def _units(marked: str) -> list[str]:
        """Runs of marks with the word behind them."""
        units, start = [], 0
        for k in range(1, len(marked)):
            if marked[k] == MARK and marked[k - 1] != MARK:
                units.append(marked[start:k])
                start = k
        if marked:
            units.append(marked[start:])
        return units

    def encode_all(self, texts):
        """encode_bytes of each text; the words of a few megabytes are decoded together."""
        texts = [t or "" for t in texts]
        for a, b in chunks(list(map(len, texts))):
            self.learn(texts[a:b])
            yield from map(self.encode_bytes, texts[a:b])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()

    def decode(self, ids) -> str:
        data = b"".join(map(self.raw.__getitem__, ids))
        text = data.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


@lru_cache(1)
def _codec(model: PieceModel) -> Codec:
    """One per Python worker: what it knows of pairs of pieces serves all its tasks."""
    return Codec(model)


def encode_documents(docs: DataFrame, model: PieceModel) -> DataFrame:
    """doc_id, the token ids and the text that decodes from them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary: of fixed size

    def run(batches):
        codec = _codec(shared.value)
        for batch in batches:
            packed = [np.frombuffer(data, "<i4") for data in codec.encode_all(batch["text"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "token_ids": packed, "decoded": [codec.decode(p.tolist()) for p in packed]})
        codec.forget()  # the words; the worker goes on to other tasks

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, token_ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model: PieceModel) -> DataFrame:
    """Like encode_documents, but digests in place of ids and text: n_tokens,
    ids_sha256 (ids as little-endian int32), decoded_sha256 (UTF-8) and whether the
    decoded text equals the input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        codec = _codec(shared.value)
        for batch in batches:
            rows = []
            for text, data in zip(batch["text"], codec.encode_all(batch["text"]), strict=True):
                decoded = codec.decode(np.frombuffer(data, "<i4").tolist())
                rows.append((len(data) // 4, hashlib.sha256(data).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), decoded == (text or "")))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "lossless"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out
        codec.forget()

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean")
