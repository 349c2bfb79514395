"""Log-structured tables: immutable segments, tombstones, tiered compaction, safe commits.

A commit writes one segment, a folder per table with the rows that it adds, and then publishes
a manifest that names all segments of the new version. Rows carry the key that they are
replaced by; a commit's tombstones, (key, dead), hide the rows of that key in older segments.
Summed tables hold signed counts by a key of their own and are added up when read, so what a
removal takes away is a row of negative counts.

Manifests are numbered. Publishing one fails if its number is taken, and then the commit is
undone and `Conflict` raised: of two writers that began from one version only one wins. The
file system must refuse to rename onto a file that is there, as HDFS does; local files are
linked instead. Readers hold a `Snapshot`; segments that a compaction has replaced stay on
disk for `retention` seconds, so a reader that began before it still ends.

Compaction merges `fan` segments of like size (a factor of `fan`) into one, drops hidden rows
and tombstones that no older segment needs, and adds up counts. It does not conflict with
commits: it publishes again on top of those that came in between. So a row is written anew
about once a tier, and a small commit writes in proportion to its own rows.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

GONE = "gone"
#: Up to so many keys go to the rows that they are joined with, some 100 MB in a process; more
#: keys and their rows are exchanged.
FEW = 2_000_000


def to_rows(keys: DataFrame, n: int) -> DataFrame:
    """n keys, for a join that leaves the other side's rows where they are if n is small."""
    return F.broadcast(keys) if n <= FEW else keys


class Conflict(RuntimeError):
    """Another writer has published the version that this commit was to become."""


@dataclass(frozen=True)
class Table:
    """schema: DDL; order: by what files are sorted; summed: the columns that are added up,
    for a table of signed counts, which has no document key; bloom: columns with a Bloom
    filter per file; rows: rows of a file's page, small where single rows are looked up;
    unpack, pack: between stored rows that hold many keys and rows of one key each."""

    schema: str
    order: tuple[str, ...]
    summed: tuple[str, ...] = ()
    bloom: tuple[str, ...] = ()
    rows: int = 20_000
    unpack: Callable[[DataFrame], DataFrame] | None = None
    pack: Callable[[DataFrame], DataFrame] | None = None

    @property
    def columns(self) -> list[str]:
        return StructType.fromDDL(self.schema).names


@dataclass(frozen=True)
class Segment:
    name: str
    seq: int
    size: int
    tables: tuple[str, ...]


@dataclass(frozen=True)
class Snapshot:
    """A version: its segments, and those replaced by it or before, with the time."""

    version: int = 0
    segments: tuple[Segment, ...] = ()
    retired: tuple[tuple[str, tuple[str, ...], float], ...] = ()
    properties: dict = field(default_factory=dict)


class LogTables:
    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table], key: str = "doc_id", fan: int = 4, retention: float = 3600.0):
        self.spark, self.path, self.key, self.fan, self.retention = spark, path.rstrip("/"), key, fan, retention
        kind = next(f.dataType.simpleString() for t in tables.values() for f in StructType.fromDDL(t.schema) if f.name == key)
        self.tables = tables | {GONE: Table(f"{key} {kind}, dead long", (key,))}

    # -- files -----------------------------------------------------------------------

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folder(self, table: str, segment: str) -> str:
        return f"{table}/segment={segment}"

    def _delete(self, segment: str, tables: tuple[str, ...]) -> None:
        for name in tables:
            self._files().delete(self._path(self._folder(name, segment)), True)

    def _versions(self) -> list[tuple[int, float]]:
        """Numbers and times of the published manifests."""
        files, folder = self._files(), self._path("manifest")
        found = files.listStatus(folder) if files.exists(folder) else []
        names = [(f.getPath().getName(), f.getModificationTime() / 1000) for f in found]
        return sorted((int(n.removesuffix(".json")), t) for n, t in names if n.endswith(".json") and not n.startswith((".", "_")))

    def snapshot(self) -> Snapshot:
        """The newest version."""
        versions = self._versions()
        if not versions:
            return Snapshot()
        stream = self._files().open(self._path(f"manifest/{versions[-1][0]:020}.json"))
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        segments = tuple(Segment(s["name"], s["seq"], s["size"], tuple(s["tables"])) for s in found["segments"])
        return Snapshot(found["version"], segments, tuple((n, tuple(t), at) for n, t, at in found["retired"]), found["properties"])

    def _publish(self, snapshot: Snapshot) -> None:
        """Write the manifest whole, then give it its number, which must be free."""
        files = self._files()
        draft, final = self._path(f"manifest/.{uuid.uuid4().hex}"), self._path(f"manifest/{snapshot.version:020}.json")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(asdict(snapshot)).encode()))
        out.close()
        jvm = self.spark._jvm
        try:
            if files.getUri().getScheme() == "file":
                jvm.java.nio.file.Files.createLink(jvm.java.io.File(final.toUri().getPath()).toPath(), jvm.java.io.File(draft.toUri().getPath()).toPath())
            else:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, none)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise Conflict(f"version {snapshot.version} of {self.path} was published by another writer") from error
            raise
        finally:
            files.delete(draft, False)

    # -- reading ---------------------------------------------------------------------

    def _stored(self, name: str, snapshot: Snapshot, segments: tuple[Segment, ...] | None = None) -> DataFrame | None:
        """The rows of some segments, with `segment`; None where they have none."""
        held = [s for s in (snapshot.segments if segments is None else segments) if name in s.tables]
        if not held:
            return None
        schema = f"{self.tables[name].schema}, segment string"
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{self._folder(name, s.name)}" for s in held])

    def _live(self, rows: DataFrame, snapshot: Snapshot, segments: tuple[Segment, ...] | None = None) -> DataFrame:
        """Without the rows that a later tombstone hides; `segment` stays. segments: those that
        the rows are of, where not all."""
        gone = self._stored(GONE, snapshot)
        if gone is None:
            return rows
        later = gone.filter(F.col("dead") > min(s.seq for s in segments or snapshot.segments))
        n = later.count()
        if not n:
            return rows
        last = to_rows(later.groupBy(self.key).agg(F.max("dead").alias("dead")), n)
        seq = F.create_map(*[F.lit(x) for s in snapshot.segments for x in (s.name, s.seq)])[F.col("segment")]
        return rows.withColumn("seq", seq).join(last, self.key, "left").filter(F.col("dead").isNull() | (F.col("seq") >= F.col("dead"))).drop("seq", "dead")

    def held(self, name: str, keys: DataFrame, snapshot: Snapshot | None = None) -> DataFrame:
        """Of some keys, each once, those that a table has live rows of; reads keys alone."""
        return self.table(name, snapshot).select(self.key).distinct().join(keys, self.key, "left_semi")

    def table(self, name: str, snapshot: Snapshot | None = None, raw: bool = False, keys: DataFrame | None = None) -> DataFrame:
        """The live rows; of a summed table the signed counts, several rows a key. raw: with
        the column `segment` and hidden rows. keys: only rows of these, of a table that is
        stored as it is; they are picked before hidden rows are told."""
        now, spec = snapshot or self.snapshot(), self.tables[name]
        rows = self._stored(name, now)
        if rows is None:
            return self.spark.createDataFrame([], spec.schema + (", segment string" if raw else ""))
        if raw:
            return rows
        if spec.summed or name == GONE:
            return rows.select(*spec.columns)
        if keys is not None:
            rows = rows.join(to_rows(keys, keys.count()), self.key, "left_semi")
        if spec.unpack:
            return self._live(spec.unpack(rows), now).drop("segment")
        return self._live(rows, now).select(*spec.columns)

    def visible(self, rows: DataFrame, snapshot: Snapshot) -> DataFrame:
        """Of raw rows (with the key and `segment`) the live ones."""
        return self._live(rows, snapshot)

    # -- writing ---------------------------------------------------------------------

    def _write(self, name: str, rows: DataFrame, segment: str) -> int:
        """Write a segment's rows of a table; returns their bytes."""
        spec = self.tables[name]
        dealt = rows.select(*spec.columns).repartitionByRange(*spec.order).sortWithinPartitions(*spec.order)
        writer = dealt.write.option("compression", "zstd").option("parquet.page.row.count.limit", str(spec.rows))
        for column in spec.bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        folder = self._folder(name, segment)
        writer.parquet(f"{self.path}/{folder}")
        return self._files().getContentSummary(self._path(folder)).getLength()

    def _write_all(self, new: dict[str, DataFrame], segment: str) -> int:
        """Write a segment's tables, a few side by side, and wait for all of them."""
        with ThreadPoolExecutor(4) as pool:
            jobs = [pool.submit(inheritable_thread_target(self.spark)(self._write), name, rows, segment) for name, rows in new.items()]
        return sum(job.result() for job in jobs)

    def commit(self, new: dict[str, DataFrame], gone: DataFrame | None = None, base: Snapshot | None = None, properties: dict | None = None) -> Snapshot:
        """Publish the version after `base`: `gone`, a column of keys, hides their rows, `new`
        adds rows. Conflict where another writer was there first; nothing has changed then."""
        base = base or self.snapshot()
        seq, name = base.version + 1, uuid.uuid4().hex
        if gone is not None:
            new = new | {GONE: gone.select(self.key).distinct().withColumn("dead", F.lit(seq).cast("long"))}
        try:
            size = self._write_all(new, name)
            old = time.time() - self.retention
            kept = tuple(r for r in base.retired if r[2] > old)
            done = Snapshot(seq, (*base.segments, Segment(name, seq, size, tuple(new))), kept, base.properties | (properties or {}))
            self._publish(done)
        except BaseException:
            self._delete(name, tuple(new))
            raise
        for segment, tables, at in base.retired:
            if at <= old:
                self._delete(segment, tables)
        for version, at in self._versions()[:-1]:
            if at < old and version < seq:
                self._files().delete(self._path(f"manifest/{version:020}.json"), False)
        return done

    def due(self, snapshot: Snapshot) -> tuple[Segment, ...]:
        """The segments of the lowest tier that has `fan` of them."""
        tiers: dict[int, list[Segment]] = {}
        for s in snapshot.segments:
            tiers.setdefault(int(math.log(max(s.size, 1), self.fan)), []).append(s)
        full = [tiers[k] for k in sorted(tiers) if len(tiers[k]) >= self.fan]
        return tuple(full[0]) if full else ()

    def compact(self, segments: tuple[Segment, ...] | None = None) -> Snapshot:
        """Merge the segments that are due, or some named ones, into one."""
        start = self.snapshot()
        merged = self.due(start) if segments is None else segments
        if not merged:
            return start
        name, new = uuid.uuid4().hex, {}
        others = [s.seq for s in start.segments if s not in merged]
        try:
            for table, spec in self.tables.items():
                rows = self._stored(table, start, merged)
                if rows is None:
                    continue
                if table == GONE:
                    last = rows.groupBy(self.key).agg(F.max("dead").alias("dead"))
                    rows = last.filter(F.col("dead") > min(others)) if others else last.filter(F.lit(False))
                elif spec.summed:
                    keys = [c for c in spec.columns if c not in spec.summed]
                    rows = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in spec.summed])
                    rows = rows.filter(" OR ".join(f"{c} <> 0" for c in spec.summed))
                else:
                    rows = self._live(spec.unpack(rows) if spec.unpack else rows, start, merged).drop("segment")
                    rows = spec.pack(rows) if spec.pack else rows
                new[table] = rows
            made = Segment(name, max(s.seq for s in merged), self._write_all(new, name), tuple(new))
            while True:
                now = self.snapshot()
                if not set(merged) <= set(now.segments):
                    raise Conflict(f"segments of {self.path} were compacted by another writer")
                rest = tuple(s for s in now.segments if s not in merged)
                retired = (*now.retired, *((s.name, s.tables, time.time()) for s in merged))
                try:
                    done = replace(now, version=now.version + 1, segments=(*rest, made), retired=retired)
                    self._publish(done)
                    return done
                except Conflict:
                    continue  # a commit came in between: once more on top of it
        except BaseException:
            self._delete(name, tuple(new))
            raise
