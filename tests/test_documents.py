"""Sections, chunks, the store and streaming ingest."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docquarry.config import Config
from docquarry.functions import text as T
from docquarry.operators import chunks as C
from docquarry.operators import render, sections as S
from docquarry.sources.files import text_parser
from docquarry.store import DocStore
from docquarry.streaming.ingest import ingest_stream

TREE = "doc_id string, section_id int, title string, level int, start_page int, end_page int, content string"
BITS = "Address offset: 0x10\nBits 7:4 MODE: mode\nBits 3:0 WAIT: wait"


def tree(spark, rows):
    df = spark.createDataFrame([("d", i, t, level, 1, 2, c) for i, (t, level, c) in enumerate(rows)], TREE)
    return S.outline_tree(df).withColumn("doc_title", F.lit("Doc"))


def chunked(spark, rows, **options):
    return C.section_chunks(tree(spark, rows), **options).orderBy("text").collect()


def test_register_section_hides_its_subtree(spark):
    found = chunked(spark, [("Cache control register (CACHE_CR)", 1, BITS), ("Table 9. CACHE_CR", 2, ""), ("Notes", 2, "prose")])
    assert [(c.chunk_type, c.structured_data.registers[0].name) for c in found] == [("bitfield_definition", "CACHE_CR")]


def test_bits_under_a_table_child_are_merged(spark):
    found = chunked(spark, [("1 Cache", 1, ""), ("Cache control register (CACHE_CR)", 2, ""), ("Table 9. CACHE_CR", 3, BITS)])
    assert len(found) == 1 and [f.name for f in found[0].structured_data.registers[0].fields] == ["MODE", "WAIT"]
    assert found[0].structured_data.peripheral == "Cache" and found[0].text.startswith("[Doc > 1 Cache > Cache control register (CACHE_CR)]\n")


def test_only_leaves_give_text(spark):
    assert [c.section_title for c in chunked(spark, [("A", 1, "lost"), ("B", 2, "kept"), ("C", 1, " ")])] == ["B"]


def test_contents_are_dropped_and_prose_stays(spark):
    text = "Parts A1 and B2. " * 20 + "\n\n" + "\n".join(f"{i} Chapter . . . . . {i}" for i in range(120))
    found = chunked(spark, [("Products", 1, text)], target=400, overlap=50)
    assert any("Parts A1" in c.text for c in found) and sum(c.text.count(". . .") for c in found) < 120


def test_table_header_is_injected(spark):
    rows = tree(spark, [("Table 3. Codes", 1, "row " * 200)]).withColumn("table_header", F.lit("Columns: A | B"))
    found = C.section_chunks(rows, target=300).collect()
    assert len(found) > 2 and all("Columns: A | B\n" in c.text for c in found)


@pytest.mark.parametrize("text, toc", [("\n".join(["x . . . 3"] * 4), True), ("\n".join(["some prose."] * 9), False), ("x ..... 1", False), ("[D]\n" + "\n".join(["x ....... 3"] * 4), True)])
def test_is_toc(one, text, toc):
    assert one(T.is_toc(F.lit(text))) is toc


@pytest.mark.parametrize("content, title, after, cut", [("before A  b c text D e rest", "A b", "D e", "A  b c text "), ("nothing here", "A b", "D e", "nothing here"), ("x A b text", "A b", None, "A b text"), ("A b text D", "A b", "D", "A b text "), ("x C:\\Ever (a text D", "C:\\Ever (a", "D", "C:\\Ever (a text "), ("C: Every", "C:\\Ever", None, "C: Every")])
def test_trim(spark, content, title, after, cut):
    df = spark.createDataFrame([(content, title, after)], "c string, t string, n string")
    assert df.select(S.trim_to_title("c", "t", "n")).first()[0] == cut


def test_hierarchy_equals_the_stack(spark):
    levels = [random.Random(5).randint(1, 5) for _ in range(60)]
    df = spark.createDataFrame([("d", i, f"s{i}", v, 0, 0, "") for i, v in enumerate(levels)], TREE)
    stack, want = [], []
    for i, v in enumerate(levels):
        while stack and levels[stack[-1]] >= v:
            stack.pop()
        want.append(stack[-1] if stack else None)
        stack.append(i)
    assert [r.parent_id for r in S.hierarchy(df).orderBy("section_id").collect()] == want
    made = S.outline_tree(df).orderBy("section_id").collect()
    assert [r.parent_id for r in made] == want
    assert all(r.ancestor_ids == ([*made[r.parent_id].ancestor_ids, r.parent_id] if r.parent_id is not None else []) for r in made)
    assert all(r.is_leaf == (r.section_id not in want) for r in made)


def test_deep_levels_have_their_parents(spark):
    rng = random.Random(6)
    levels = {"d": [*range(1, 31), 14, 15, 40, 13], "e": [rng.choice([0, 1, 2, 12, 13, 30, 57]) for _ in range(40)], "f": [3]}
    rows = [(doc, i, f"s{i}", v, 0, 0, "") for doc, found in levels.items() for i, v in enumerate(found)]
    df = spark.createDataFrame(rows, TREE)
    want = {}
    for doc, found in levels.items():
        stack = []
        for i, v in enumerate(found):
            while stack and found[stack[-1]] >= v:
                stack.pop()
            want[doc, i] = list(stack)
            stack.append(i)
    parents = {k: v[-1] if v else None for k, v in want.items()}
    assert {(r.doc_id, r.section_id): r.parent_id for r in S.hierarchy(df).collect()} == parents
    made = S.outline_tree(df).collect()
    assert {(r.doc_id, r.section_id): r.ancestor_ids for r in made} == want
    assert {(r.doc_id, r.section_id): r.parent_id for r in made} == parents
    assert S.outline_tree(df).columns == [*df.columns, "ancestor_ids", "ancestor_titles", "parent_id", "is_leaf"]
    assert S.hierarchy(df.limit(0)).count() == S.outline_tree(df.limit(0)).count() == 0


def spans_of(spark, rows):
    """Spans of (text, budget, overlap) rows, in their order; one overlap for all."""
    df = spark.createDataFrame([(i, t, b) for i, (t, b, _) in enumerate(rows)], "i int, t string, b int")
    found = df.select("i", C.split_spans(F.col("t"), F.col("b"), rows[0][2]).alias("s")).orderBy("i").collect()
    return [[(x.start, x.end) for x in r.s] for r in found]


@pytest.mark.parametrize("overlap", [0, 13, 30, 80])
def test_spans_equal_plain_ones(spark, overlap):
    rng = random.Random(overlap)
    rows = [("".join(rng.choice(["word ", "End. ", "Why?  ", "\n\n", "longwordwithoutblank", "x", "!\n", "\u00e9\U0001f600. "]) for _ in range(rng.randint(0, 120))).strip(), rng.randint(1, 200), overlap) for _ in range(150)]
    for (text, budget, _), spans in zip(rows, spans_of(spark, rows), strict=True):
        assert [text[a:b] for a, b in spans] == plain_split(text, max(budget, 64), overlap)
        starts = [a for a, _ in spans]
        assert starts == sorted(set(starts)) and (not text or spans[0][0] == 0 and spans[-1][1] == len(text))
        assert all(b >= c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_splitter_long_prefixes_and_nulls(spark):
    rows = spark.createDataFrame([("d", 1, "p" * 500, "word " * 100), ("d", 2, None, None), ("d", 3, "p", "")], "doc_id string, section_id int, prefix string, content string")
    found = C.split_sections(rows, target=300).collect()
    assert {r.section_id for r in found} == {1} and len(found) > 5 and all(r.text.startswith("p" * 500 + "word") for r in found)


@pytest.mark.parametrize("n, want", [(499, 499), (500, 500), (501, 503)])
def test_excerpt_lengths(one, n, want):
    assert len(one(T.excerpt(F.lit("x" * n)))) == want


def test_excerpt_cuts_behind_a_stop(one):
    assert one(T.excerpt(F.lit("a" * 400 + "." + "b" * 300))) == "a" * 400 + "...."


def test_row_clusters_use_the_first_block(spark):
    blocks = [(10.0, 5.0), (14.0, 1.0), (18.0, 0.0), (30.0, 0.0)]
    df = spark.createDataFrame([([{"y0": y, "x0": x} for y, x in blocks],)], "b array<struct<y0 double, x0 double>>")
    found = df.select(S.cluster_rows("b").alias("r")).first()["r"]
    assert [(x.row, x.y0) for x in found] == [(1, 14.0), (1, 10.0), (2, 18.0), (3, 30.0)]


def test_config():
    assert Config.load(None).chunking.target_size == 2500
    assert Config.load({"search": {"top_k": 3}}).search.top_k == 3
    with pytest.raises(ValueError):
        Config.load({"serach": {}})


def test_config_file(tmp_path):
    path = tmp_path / "options.yaml"
    path.write_text("# options\ndoc_dirs:\n  - ./a  # first\n  - 'b c'\nsearch:\n  top_k: 3\n  keyword_weight: 0.5\nchunking:\n")
    found = Config.read(str(path))
    assert found.doc_dirs == ("./a", "b c") and found.search.top_k == 3 and found.search.keyword_weight == 0.5 and found.chunking.overlap == 200
    assert Config.read(str(tmp_path / "none.yaml")) == Config()
    path.write_text("search:\n  top: 3\n")
    with pytest.raises(ValueError):
        Config.read(str(path))


def plain_split(text, budget, overlap):
    """The splitter, boundary by boundary."""
    import re

    out, start = [], 0
    while start < len(text):
        end = min(start + budget, len(text))
        if end < len(text):
            stops = [m.end() for m in re.finditer(r"(?<=[.!?])\s+|\n\n+", text) if start < m.end() <= end]
            blank = text.rfind(" ", start, end)
            end = stops[-1] if stops else blank + 1 if blank > start else end
        out.append(text[start:end])
        near = [m.end() for m in re.compile(r"(?<=[.!?])\s+|\n\n+").finditer(text, max(start, end - overlap), end)]
        again = near[-2] if len(near) > 1 else near[0] if near else end
        start = again if start < again < end else end
    return out


def test_split_documents_equal_plain(spark):
    from conftest import SF
    from docquarry.plans import catalog

    found = {}
    for r in catalog.split_chunks(spark, SF).collect():
        found.setdefault(r.doc_id, []).append((r.part, r.text_md5, r.n_chars))
    import hashlib

    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        prefix, body = f"[{r.source}]\n", r.text.strip()
        want = [prefix + p.strip() for p in plain_split(body, 1000 - len(prefix), 100)]
        assert sorted(found.get(r.doc_id, [])) == [(i, hashlib.md5(t.encode()).hexdigest(), len(t)) for i, t in enumerate(want)]


def test_embedded_documents_equal_plain(spark):
    import re
    import zlib

    from conftest import SF
    from docquarry.plans import catalog

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in catalog.embed_documents(spark, SF).collect():
        words, out = re.findall(r"\w+", texts[r.chunk_id].lower()), [0.0] * 64
        for part in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
            h = zlib.crc32(part.encode(), 1)
            out[h % 64] += 1 if h & 0x80000000 else -1
        size = sum(x * x for x in out) ** 0.5 or 1.0
        assert [float(x) for x in r.embedding.strip("[]").split(",")] == pytest.approx([x / size for x in out], abs=2e-5)


def test_memory_maps_and_structured_results(spark):
    from docquarry.functions import grids as G
    from docquarry.functions import registers as R

    grid = [["Peripheral", "Base Address", "Size"], ["UART0", "0x4000", "1K"]]
    assert spark.createDataFrame([(grid,)], "g array<array<string>>").select(G.table_type(G.grid_keywords("g"))).first()[0] == "memory_map"
    grid = [["Name", "Address"], ["UART0", "0x4000"], ["", "0x5000"]]
    table = spark.createDataFrame([(grid,)], "g array<array<string>>").select(G.extract_table(F.lit("memory_map"), "g", F.lit("Map of the device")).alias("t"))
    row = table.select("t", R.table_markdown("t").alias("m")).first()
    assert [(r.name, r.address) for r in row.t.registers] == [("UART0", "0x4000")] and "### UART0 (0x4000)" in row.m and "**Width:** 32-bit" in row.m
    assert table.select(G.extract_table(F.lit("other"), F.array(F.array(F.lit("a"))), F.lit(""))).first()[0] is None


DOC = "1. Cache Guide\nThe cache is fast. It has alpha mode.\f2.1 Cache control register (CACHE_CR)\nAddress offset: 0x10\nBits 7:4 MODE: mode\nBits 3:0 WAIT: wait\n"


@pytest.fixture
def store(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/guide.txt").write_text(DOC)
    return DocStore(spark, f"file://{tmp_path}/index"), tmp_path / "docs"


def test_store_lifecycle(store):
    db, docs = store
    assert db.list_documents().count() == 0
    db.ingest_files([str(docs)], text_parser, "*.txt")
    doc = db.list_documents().first()
    assert doc.filename == "guide.txt" and db.stats().first().n_chunks == db.table("chunks").count() == 2
    assert db.search("alpha", 1).first().text.startswith("[guide.txt > 1. Cache Guide]")
    register = db.find_register("CACHE_CR")
    assert "**MODE** [7:4]" in render.format_register(register, "CACHE_CR")
    assert render.format_register(db.find_register("NONE"), "NONE") == "Register 'NONE' not found."
    assert "## Result 1" in db.search_markdown("alpha")
    assert "indexed" in db.list_files([str(docs)], "*.txt").first().line
    (docs / "more.TXT").write_text("plain")
    assert db.list_markdown([str(docs), str(docs / "none")], "*.txt").startswith("# Documentation\n\n**1** PDFs found (1 indexed)\n\n- **guide.txt** (0.0 MB) — indexed\n  - ID: `")
    assert db.list_markdown([str(docs / "none")]) == f"No PDF files found in: {docs / 'none'}"
    (docs / "more.TXT").unlink()
    assert db.find_register("CACHE_CR").first().register_names == ["CACHE_CR"]
    assert db.size() == 2 and db.search("al* mode", 1).first().section_title == "1. Cache Guide"
    assert db.search("cache-control", 1).first().section_title == "2.1 Cache control register (CACHE_CR)"

    (docs / "guide.txt").write_text("1. Other Guide\nbeta text.")
    db.ingest_files([str(docs)], text_parser, "*.txt")
    assert db.table("chunks").count() == db.table("vectors").count() == 1 and db.registers().count() == 0
    db.rebuild()
    assert db.table("vectors").count() == 1
    assert not db.remove("nothing") and db.remove(doc.doc_id)
    assert db.table("chunks").count() == db.table("vectors").count() == db.list_documents().count() == 0


def test_ingested_table_sections_carry_their_header(spark, tmp_path):
    def parser(content):
        pages = [{"page_num": n, "width": 612.0, "height": 792.0, "blocks": [], "raw_text": t} for n, t in enumerate(["Table 3. Codes\n" + "Row of codes. " * 40, "more", "Table 4. Late\nlate rows", "still", "Table 5. None\nplain", "Prose\nprose text", "end"])]
        toc = [{"level": 1, "title": t, "page_num": n} for t, n in [("Table 3. Codes", 0), ("Table 4. Late", 2), ("Table 5. None", 4), ("Prose", 5)]]
        grids = [(0, 0, [["x", "y"]]), (0, 1, [["A", "B  b", "", None, " C "], ["1", "2", "3", "4", "5"]]), (1, 0, [["p", "q", "r", "s", "t", "u"]]), (2, 0, [["only"]]), (3, 0, [["D", "E"]]), (4, 0, []), (6, 0, [["F", "G"]])]
        tables = [{"page_num": n, "table_index": i, "bbox": None, "grid": g} for n, i, g in grids]
        return {"pages": pages, "toc": toc, "tables": tables}

    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.pdf").write_bytes(b"x")
    db = DocStore(spark, f"file://{tmp_path}/index", Config.load({"chunking": {"target_size": 300}}))
    db.ingest_files([str(tmp_path / "docs")], parser)
    texts = {}
    for c in db.table("chunks").collect():
        texts.setdefault(c.section_title, []).append(c.text)
    head = lambda title, columns: f"[a.pdf > {title}]\n{columns}"
    assert len(texts["Table 3. Codes"]) > 2
    assert all(t.startswith(head("Table 3. Codes", "Columns: A | B b | C\n")) for t in texts["Table 3. Codes"])
    assert [t.startswith(head("Table 4. Late", "Columns: D | E\n")) for t in texts["Table 4. Late"]] == [True]
    assert not any("Columns:" in t for title in ("Table 5. None", "Prose") for t in texts[title])


def test_streaming_ingest(store, tmp_path):
    db, docs = store
    ingest_stream(db, str(docs), text_parser, str(tmp_path / "state"), "*.txt", once=True).awaitTermination()
    assert db.list_documents().count() == 1


def test_regions_grow_while_rows_are_alike(spark):
    """A header of four, three rows like it, one that is too far right, one like the header."""
    rows = [(10.0, [0, 50, 100, 150]), (20.0, [0, 50, 100, 150]), (30.0, [0, 100]), (40.0, [10, 50, 160]), (50.0, [90, 150]), (60.0, [0, 50, 100, 150])]
    blocks = [("d", 1, float(x), x + 30.0, y + (i % 2), y + 8) for y, xs in rows for i, x in enumerate(xs)] + [("e", 1, 0.0, 10.0, 5.0, 9.0)]
    found = S.block_rows(spark.createDataFrame(blocks, "doc_id string, page_num int, x0 double, x1 double, y0 double, y1 double"))
    assert [(r.row, r.n) for r in found.filter("doc_id = 'd'").orderBy("row").collect()] == [(1, 4), (2, 4), (3, 2), (4, 3), (5, 2), (6, 4)]
    assert [tuple(r) for r in S.grown_regions(found, F.col("row") == 1).collect()] == [("d", 1, 1, 3, 0.0, 10.0, 180.0, 48.0)]
    assert S.grown_regions(found, F.col("row") == 5).count() == 0 and S.grown_regions(found, F.col("row") == 6).count() == 0
