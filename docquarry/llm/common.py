"""Helpers shared by the training-data operators: intermediate tables in the shared
folder, ids that stay exact through Python, joins without hot keys, and vectorised word
hashing over UTF-8 buffers."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Bytes of text that a vectorised Python step handles at once; a longer single
#: document is still handled whole.
CHUNK_BYTES = 2_000_000
#: Tasks over which a join deals the rows of one key.
SALTS = 8


# -- intermediate tables -------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir). A local
    session without one gets a temporary folder; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docquarry-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Scratch:
    """The intermediate tables of one operator call, below one folder of the shared one.
    What the result does not read is dropped before the operator returns; the rest goes
    with `clear`, or when the process ends."""

    _open: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/docquarry/{name}-{uuid.uuid4().hex}"
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self._tables: list[str] = []
        Scratch._open.append(self)

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df` and read it back: later jobs start from these files, whichever
        executors are lost meanwhile."""
        path = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, buckets: int, keys: list[str]) -> DataFrame:
        """Like stored, as a table bucketed and sorted by keys."""
        table = f"docquarry_{name}_{uuid.uuid4().hex}".replace("-", "_")
        df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{self.path}/{name}").format("parquet").saveAsTable(table)
        self._tables.append(table)
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            self._files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)
            prefix = f"docquarry_{name}_".replace("-", "_")
            for table in [t for t in self._tables if t.startswith(prefix)]:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
                self._tables.remove(table)

    def close(self) -> None:
        if self in Scratch._open:
            Scratch._open.remove(self)
        for table in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._tables = []
        self._files.delete(self._folder, True)


def opened() -> list[Scratch]:
    """The operator calls whose intermediate tables are there."""
    return list(Scratch._open)


def clear(keep: list[Scratch] = ()) -> None:
    """Delete the intermediate tables of operator calls, once their results are written;
    those of the calls in `keep` stay."""
    for scratch in [s for s in Scratch._open if s not in keep]:
        scratch.close()


@atexit.register
def _leave_nothing() -> None:
    for scratch in list(Scratch._open):
        try:
            scratch._files.delete(scratch._folder, True)
        except (Py4JError, OSError, AttributeError):  # the JVM has gone already
            return


# -- rows through Python, joins ------------------------------------------------------


def map_batches(rows: DataFrame, run, schema: str, ids: tuple = ("doc_id",)) -> DataFrame:
    """mapInPandas with 64-bit ids that stay exact beside nulls: pandas would make doubles
    of such a column, so ids travel as text."""
    sent = rows.select(*[F.col(c).cast("string").alias(c) if c in ids else F.col(c) for c in rows.columns])
    wanted = StructType.fromDDL(schema)
    carried = StructType([StructField(f.name, StringType() if f.name in ids else f.dataType) for f in wanted])
    return sent.mapInPandas(run, carried).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])


def salted_join(rows: DataFrame, one_each: DataFrame, on: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """rows joined with a table of one row per key; the rows of a hot key are dealt over
    SALTS tasks by a hash of `spread`, for which the other side is repeated."""
    salt = fresh(rows, "salt")
    left = rows.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    right = one_each.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*on, salt], how).drop(salt)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that `df` does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: Column | str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """crc32 of the id's decimal text, modulo `folds`, equals `fold`; a null id is not held
    out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def chunks(sizes, limit: int = CHUNK_BYTES):
    """Ranges (start, stop) of consecutive rows with about `limit` bytes each."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


U64 = np.uint64
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift rounds)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def randoms(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words for a seed, the same on every machine."""
    start = (seed * 0x9E3779B97F4A7C15) & _MASK
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(start))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(size - 1, self.base, U64)]))
            self.down = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(size - 1, self.inverse, U64)]))
        return self.up[:n], self.down[:n]


_LANES = [_Powers(0x5851F42D4C957F2D), _Powers(0xDA942042E4DD58B5)]
_BYTES = [randoms(256, 11), randoms(256, 29)]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span [start, end) of buf: a polynomial over random
    byte values, read off prefix sums, then mixed."""
    up, down = _LANES[lane].get(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U64)
    np.cumsum(_BYTES[lane][buf] * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of several texts (UTF-8 bytes): byte spans,
    the row each belongs to and its number within that row."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        inside = ~_SPACE[self.buf]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.starts, self.ends = edge[0::2], edge[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.row_at = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.first = np.searchsorted(self.starts, self.row_at)  # first word of each row, and the end
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(texts)), self.counts)

    def hashes(self, lane: int = 0) -> np.ndarray:
        return span_hash(self.buf, self.starts, self.ends, lane)


_STEP = [randoms(64, 101) | U64(1), randoms(64, 202) | U64(1)]


def window_hashes(words: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Hash of each n consecutive entries, by doubling: a window of 2k is two of k."""
    if len(words) < n:
        return np.zeros(0, U64)
    parts, power, width, out, have = words, 0, 1, None, 0
    while True:
        if n & width:
            piece = parts[have : len(words) - n + 1 + have]
            out = piece.copy() if out is None else out * _STEP[lane][32 + power] + piece
            have += width
        if have == n:
            return mix(out)
        parts = parts[:-width] * _STEP[lane][power] + parts[width:]
        width, power = 2 * width, power + 1
