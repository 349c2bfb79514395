"""Text to vector. The model is a plug-in; the default hashes words, needs no files and
gives the same vector on every machine."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Turns texts into an (n, dimension) array.
Model = Callable[[list[str]], np.ndarray]
_WORD = re.compile(r"\w+")


class HashingModel:
    """Signed counts of words and neighbouring pairs, hashed into `dimension` places."""

    def __init__(self, dimension: int = 64, seed: int = 1):
        self.dimension, self.seed = dimension, seed

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts, strict=True):
            words = _WORD.findall(text.lower())
            for part in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
                h = zlib.crc32(part.encode("utf-8", "surrogatepass"), self.seed)
                row[h % self.dimension] += 1 if h & 0x80000000 else -1
        return out


def unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(length > 0, length, 1)).astype(np.float32)


def embed(chunks: DataFrame, load: Callable[[], Model] = HashingModel, text_col: str = "text") -> DataFrame:
    """chunks with an `embedding` of unit length; `load` makes the model once per task."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(list(unit(np.asarray(model([t or "" for t in texts])))))

    return chunks.withColumn("embedding", vectors(F.col(text_col)))


def embed_query(query: str, load: Callable[[], Model] = HashingModel) -> list[float]:
    """A query's vector, from the same function as the passages'."""
    return unit(np.asarray(load()([query])))[0].tolist()
