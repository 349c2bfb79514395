"""Log-structured tables and the store on them: commits, conflicts, compaction, counts."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from docquarry.log import Conflict, LogTables, Table
from docquarry.operators import catalog_ops, hybrid, inverted, keyword
from docquarry.sources import embedder
from docquarry.sources.files import text_parser
from docquarry.store import DocStore

DOC = "1. Cache Guide\nThe alpha mode is fast. It helps.\f2.1 Cache control register (CACHE_CR)\nAddress offset: 0x10\nBits 7:4 MODE: mode\nBits 3:0 WAIT: wait"
SPEC = {"rows": Table("doc_id string, value int", ("doc_id",)), "sums": Table("value int, n long", ("value",), summed=("n",))}


def log_of(spark, tmp_path, **options):
    return LogTables(spark, f"file://{tmp_path}/log", SPEC, **options)


def put(log, spark, values, base=None):
    """Commit {doc_id: value, or None to remove}, with the counts that change."""
    base = base or log.snapshot()
    keys = spark.createDataFrame([(k,) for k in values], "doc_id string")
    new = spark.createDataFrame([(k, v) for k, v in values.items() if v is not None], "doc_id string, value int")
    old = log.table("rows", base).join(keys, "doc_id", "left_semi")
    sums = new.withColumn("n", F.lit(1)).unionByName(old.withColumn("n", F.lit(-1))).groupBy("value").agg(F.sum("n").alias("n"))
    return log.commit({"rows": new, "sums": sums}, keys, base)


def state(log, snapshot=None):
    rows = {r.doc_id: r.value for r in log.table("rows", snapshot).collect()}
    sums = {r.value: r.n for r in log.table("sums", snapshot).groupBy("value").agg(F.sum("n").alias("n")).filter("n <> 0").collect()}
    return rows, sums


def counted(rows):
    return {v: list(rows.values()).count(v) for v in set(rows.values())}


def test_random_changes_equal_a_dict(spark, tmp_path):
    log, plain, rng = log_of(spark, tmp_path, fan=3), {}, random.Random(1)
    assert state(log) == ({}, {})
    for step in range(10):
        values = {f"d{rng.randint(0, 9)}": rng.choice([None, 1, 2, 3]) for _ in range(rng.randint(1, 4))}
        put(log, spark, values)
        plain = {k: v for k, v in (plain | values).items() if v is not None}
        if step % 4 == 3:
            now = log.snapshot().segments
            log.compact(tuple(rng.sample(now, rng.randint(2, len(now)))) if rng.random() < 0.7 and len(now) > 2 else None)
        assert state(log) == (plain, counted(plain)), step
    log.compact(log.snapshot().segments)
    assert state(log) == (plain, counted(plain)) and len(log.snapshot().segments) == 1
    assert log.table("gone").count() == 0 and log.table("rows", raw=True).count() == len(plain)


def test_two_writers_conflict(spark, tmp_path):
    log = log_of(spark, tmp_path)
    base = put(log, spark, {"a": 1})
    put(log, spark, {"b": 2}, base)
    with pytest.raises(Conflict):
        put(log, spark, {"c": 3}, base)
    assert state(log) == ({"a": 1, "b": 2}, {1: 1, 2: 1})
    assert len(list((tmp_path / "log/rows").iterdir())) == 2 and not list((tmp_path / "log/manifest").glob(".*[!c]"))


def test_a_commit_during_a_compaction_stays(spark, tmp_path, monkeypatch):
    log = log_of(spark, tmp_path)
    for k in "abc":
        put(log, spark, {k: 1, "x": 2})
    write, done = log._write, []

    def slow(name, rows, segment):
        size = write(name, rows, segment)
        if not done:
            done.append(True)
            put(log_of(spark, tmp_path), spark, {"a": None, "d": 5})
        return size

    monkeypatch.setattr(log, "_write", slow)
    log.compact(log.snapshot().segments)
    assert state(log) == ({"b": 1, "c": 1, "x": 2, "d": 5}, {1: 2, 2: 1, 5: 1}) and len(log.snapshot().segments) == 2


def test_readers_outlive_a_compaction_and_old_files_go(spark, tmp_path):
    log = log_of(spark, tmp_path, retention=3600)
    for k in "abcd":
        put(log, spark, {k: 1})
    before = log.snapshot()
    reader = log.table("rows", before)
    log.compact()
    assert len(log.snapshot().segments) == 1 and reader.count() == 4 and state(log, before)[0] == dict.fromkeys("abcd", 1)
    late = log_of(spark, tmp_path, retention=0.0)
    time.sleep(0.1)
    put(late, spark, {"e": 1})
    put(late, spark, {"f": 1})
    assert {p.name for p in (tmp_path / "log/rows").iterdir()} == {f"segment={s.name}" for s in late.snapshot().segments}
    assert len(list((tmp_path / "log/manifest").glob("*.json"))) <= 2 and set(state(late)[0]) == set("abcdef")


def test_a_failed_commit_leaves_nothing(spark, tmp_path):
    log = log_of(spark, tmp_path)
    put(log, spark, {"a": 1})
    bad = spark.createDataFrame([("b", 1)], "doc_id string, value int").withColumn("value", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        log.commit({"rows": bad})
    assert state(log) == ({"a": 1}, {1: 1}) and len(list((tmp_path / "log/rows").iterdir())) == 1


# -- the store ------------------------------------------------------------------------------


def check_derived(db):
    """Everything that follows from the chunks equals what a scan of them gives."""
    chunks = db.table("chunks").cache()
    index = db.index(db.log.snapshot())
    assert {(r.term, r.df, r.tf) for r in db.terms().collect()} == {(r.term, r.df, r.tf) for r in keyword.term_table(chunks).collect()}
    n, words = index.sizes.agg(F.sum("n_chunks"), F.sum("n_tokens")).first()
    assert (n, words) == tuple(keyword.lengths(chunks).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first())
    assert {(r.chunk_id, r.term, tuple(r.positions)) for r in index.postings().collect()} == {(r.chunk_id, r.term, tuple(r.positions)) for r in keyword.postings(chunks).collect()}
    assert {tuple(r) for r in db.registers().collect()} == {tuple(r) for r in hybrid.explode_registers(chunks).collect()}
    assert {r.chunk_id for r in db.table("vectors").collect()} == {r.chunk_id for r in chunks.collect()}
    for query in ("alpha mode", "fast*", "CR)"):
        want = [(r.chunk_id, round(r.score, 9)) for r in keyword.keyword_search(chunks, query, 5).collect()]
        assert [(r.chunk_id, round(r.score, 9)) for r in inverted.search(index, db.table("chunks"), query, 5).collect()] == want, query
    chunks.unpersist()


def test_store_follows_every_change(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    for k in range(3):
        (docs / f"d{k}.txt").write_text(DOC.replace("fast", f"fast{k}"))
    db = DocStore(spark, f"file://{tmp_path}/index", fan=3)
    report = {r.filename: r for r in db.ingest_files([str(docs)], text_parser, "*.txt", title="Guide", version="2").collect()}
    assert len(report) == 3 and {(r.pages, r.sections, r.tables, r.chunks, r.hidden) for r in report.values()} == {(2, 2, 0, 2, 0)}
    assert {(r.title, r.version) for r in db.list_documents().collect()} == {("Guide", "2")}
    (docs / "d1.txt").write_text("1. Other Guide\nzeta text with alpha.")
    db.ingest_files([str(docs / "d1.txt")], text_parser, "*.txt")
    check_derived(db)
    assert db.search("zeta", 3).first().section_title == "1. Other Guide" and db.table("chunks").count() == 5
    assert db.remove(report["d0.txt"].doc_id) and not db.remove("nothing")
    check_derived(db)
    assert not list((tmp_path / "index/staging").glob("*"))
    db.log.compact(db.log.snapshot().segments)
    check_derived(db)
    for bad, pattern in ((f"{docs}/none.txt", "*.txt"), (f"{docs}/d1.txt", "*.pdf")):
        with pytest.raises(ValueError):
            db.ingest_files([bad], text_parser, pattern)


def test_a_small_ingest_writes_little(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(900)]
    for k in range(12):
        (docs / f"d{k}.txt").write_text("1. Part\n" + " ".join(rng.choice(words) for _ in range(1500)))
    db = DocStore(spark, f"file://{tmp_path}/index")
    db.ingest_files([str(docs)], text_parser, "*.txt")
    (docs / "d3.txt").write_text("1. Part\nzeta text.")
    before = {str(p) for p in (tmp_path / "index").rglob("*.parquet")}
    db.ingest_files([str(docs / "d3.txt")], text_parser, "*.txt")
    first, second = db.log.snapshot().segments
    assert second.size < first.size / 2  # counts of one document's words go, no other document is written
    assert before <= {str(p) for p in (tmp_path / "index").rglob("*.parquet")}


def test_files_of_one_name_do_not_mix(spark, tmp_path):
    for folder, word in (("a", "alpha"), ("b", "beta")):
        (tmp_path / "docs" / folder).mkdir(parents=True)
        (tmp_path / "docs" / folder / "guide.txt").write_text(f"1. Guide\n{word} text.")
    db = DocStore(spark, f"file://{tmp_path}/index")
    report = db.ingest_files([str(tmp_path / "docs")], text_parser, "*.txt").collect()
    assert [(r.filename, r.sections, r.chunks, r.hidden) for r in report] == [("guide.txt", 1, 1, 1)]
    assert db.list_documents().count() == 1 and [re.search("alpha|beta", c.text)[0] for c in db.table("chunks").collect()] == ["beta"]


def test_known_texts_are_not_embedded_again(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    class Model(embedder.HashingModel):
        def __call__(self, texts):
            seen.add(len([t for t in texts if t]))
            return super().__call__(texts)

    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.txt").write_text("1. One\nsame text.\f2. Two\nother text.")
    db = DocStore(spark, f"file://{tmp_path}/index", load_model=Model)
    db.ingest_files([str(docs)], text_parser, "*.txt")
    assert seen.value == 2
    db.rebuild()
    assert seen.value == 2 and db.size() == 2 and len(db.log.snapshot().segments) == 1
    (docs / "a.txt").write_text("1. One\nsame text.\f2. Two\nnew text.")
    db.ingest_files([str(docs)], text_parser, "*.txt")
    assert seen.value == 3 and db.size() == 2

    class Longer(Model):
        def __init__(self):
            super().__init__(96)

    (docs / "a.txt").write_text("1. One\nquite new.")
    with pytest.raises(Exception, match="vector of 96 numbers; the index holds 64"):
        DocStore(spark, f"file://{tmp_path}/index", load_model=Longer).ingest_files([str(docs)], text_parser, "*.txt")


def test_register_lookup_reads_pages_of_the_name(spark, tmp_path):
    from test_search import scanned_rows

    rows = [(f"c{i:05}", "d", "register_map", f"P{i % 7}", f"REG{i:05}", "", "") for i in range(9000)]
    schema = "chunk_id string, doc_id string, chunk_type string, peripheral string, name string, address string, offset string"
    log = LogTables(spark, f"file://{tmp_path}/log", {"registers": Table(schema, ("name", "chunk_id"), bloom=("name",), rows=256)})
    log.commit({"registers": spark.createDataFrame(rows, schema)})
    found = hybrid.find_register(log.table("registers"), "REG04321")
    assert found.first().chunk_id == "c04321" and scanned_rows(found, "name") <= 1024
    assert scanned_rows(hybrid.find_register(log.table("registers"), "NONE"), "name") == 0


def test_upsert_keeps_repeated_new_keys(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, value int")
    new = spark.createDataFrame([("a", 2), ("a", 3)], "doc_id string, value int")
    assert sorted(tuple(r) for r in catalog_ops.upsert(old, new, "doc_id").collect()) == [("a", 2), ("a", 3), ("b", 1)]


def small_log(spark, path):
    """Ten documents, every third one again, one removed that is there and one that is not."""
    log = LogTables(spark, str(path), {"chunks": Table("doc_id long, version int, text string", ("doc_id",))})
    rows = spark.range(10).select(F.col("id").alias("doc_id"), F.lit(1).alias("version"), F.lit("text").alias("text"))
    log.commit({"chunks": rows}, rows.select("doc_id"))
    return log, rows


def test_rows_that_nothing_hides_are_not_joined(spark, tmp_path):
    """A first commit's tombstones hide nothing; later ones go to the rows, texts stay put."""
    log, rows = small_log(spark, tmp_path / "log")
    assert "Join" not in log.table("chunks")._jdf.queryExecution().executedPlan().toString()
    log.commit({"chunks": rows.filter("doc_id % 3 = 0").withColumn("version", F.lit(2))}, rows.filter("doc_id % 3 = 0").select("doc_id"))
    plan = log.table("chunks")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted((r.doc_id, r.version) for r in log.table("chunks").collect()) == [(i, 1 if i % 3 else 2) for i in range(10)]


@pytest.mark.parametrize("few", [0, 2_000_000])
def test_keys_are_picked_before_rows_are_told(spark, tmp_path, monkeypatch, few):
    """The same whether keys go to the rows or both are exchanged."""
    monkeypatch.setattr("docquarry.log.FEW", few)
    log, rows = small_log(spark, tmp_path / "log")
    gone = spark.createDataFrame([(3,), (3,), (4,), (77,), (None,)], "doc_id long")
    held = log.held("chunks", gone)
    assert sorted(r.doc_id for r in held.collect()) == [3, 4]
    log.commit({"chunks": rows.filter("doc_id = 3").withColumn("version", F.lit(2))}, held)
    assert log.table("gone").filter("dead = 2").count() == 2
    assert sorted(r.doc_id for r in log.held("chunks", gone).collect()) == [3]
    assert [(r.doc_id, r.version) for r in log.table("chunks", keys=gone).collect()] == [(3, 2)]
    log.compact(log.snapshot().segments)
    assert sorted((r.doc_id, r.version) for r in log.table("chunks").collect()) == [(i, 2 if i == 3 else 1) for i in range(10) if i != 4]


def test_live_store_keeps_tombstones_of_held_documents_alone(spark, monkeypatch):
    from conftest import SF
    from docquarry.plans import catalog

    monkeypatch.setattr(catalog, "_STORED", {})
    docs, toxic = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").select("doc_id")
    again = docs.select("doc_id").filter("doc_id % 3 = 0 OR doc_id % 5 = 0").union(toxic.join(docs, "doc_id", "left_semi").select("doc_id")).distinct()
    assert catalog.live_store(spark, SF).table("gone").select("doc_id").distinct().count() <= again.count()


def live_plan(spark, query):
    """The plan of a query of the live store where no table is small enough for Spark's own
    broadcasts."""
    from conftest import SF
    from docquarry.plans import catalog

    catalog.live_store(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return getattr(catalog, query)(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_live_sources_move_no_texts(spark):
    plan = live_plan(spark, "store_live_sources")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert not any("Exchange" in line and "text" in line for line in plan.splitlines())


def test_live_point_read_moves_no_texts(spark):
    """The ids reach the scan, and its rows stay where they are read."""
    plan = live_plan(spark, "store_point_read")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "In(chunk_id, [15,21,22,23])" in plan
