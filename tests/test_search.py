"""Keyword search against SQLite's full-text engine, vectors and fusion."""

from __future__ import annotations

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators import hybrid, inverted, keyword, literal, semantic

WORDS = "alpha beta gamma delta Café reg_a1 0x1F base/address x".split()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    return [(f"c{i:03}", f"d{i % 3}", " ".join(rng.choices(WORDS, k=rng.randint(1, 30)))) for i in range(60)]


@pytest.fixture(scope="module")
def chunks(spark, corpus):
    return spark.createDataFrame(corpus, "chunk_id string, doc_id string, text string")


def fts(corpus, query):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, text)")
    con.executemany("INSERT INTO f VALUES (?, ?)", [(c, t) for c, _, t in corpus])
    try:
        return {i: -r for i, r in con.execute("SELECT id, rank FROM f WHERE f MATCH ?", (query,))}
    except sqlite3.OperationalError:
        return {}


@pytest.mark.parametrize("query, match", [("alpha", "alpha"), ("alpha beta", "alpha AND beta"), ("cafe", "cafe"), ("reg_a1", '"reg_a1"'), ("0x1f gamma", '"0x1f" AND gamma'), ("base/address", '"base/address"'), ("alph*", "alph*"), ("^delta x", "^delta AND x"), ("zzz", "zzz")])
def test_scores_equal_fts(chunks, corpus, query, match):
    found = {r.chunk_id: r.score for r in keyword.keyword_search(chunks, query, 100).collect()}
    assert found == pytest.approx(fts(corpus, match), abs=1e-9)


@pytest.mark.parametrize("query", ["what's", "alpha, beta", "alpha AND beta", "a?", "x=1"])
def test_forbidden_words_match_nothing(chunks, query):
    assert keyword.keyword_search(chunks, query).count() == 0


def test_filter_narrows_results_not_statistics(chunks):
    every = {r.chunk_id: r.score for r in keyword.keyword_search(chunks, "alpha", 100).collect()}
    mine = {r.chunk_id: r.score for r in keyword.keyword_search(chunks, "alpha", 100, "d1").collect()}
    assert mine and all(every[c] == s for c, s in mine.items()) and len(mine) < len(every)


def test_literal_falls_back(spark):
    rows = spark.createDataFrame([("a", "d", "mode (ABC) x"), ("b", "d", "none")], "chunk_id string, doc_id string, text string")
    assert [(r.chunk_id, r.score) for r in keyword.keyword_search(rows, "(AB").collect()] == [("a", 1.0)]


def index_of(chunks, block=inverted.BLOCK):
    postings = keyword.postings(chunks, keep=["doc_id"])
    grams = literal.gram_rows(chunks, keep=["doc_id"])
    return inverted.Index(inverted.block_rows(postings, block), inverted.term_counts(postings), inverted.size_counts(chunks), grams, literal.gram_counts(grams))


def test_stored_index_equals_scan(chunks):
    index = inverted.Index(*[t.cache() for t in list(vars(index_of(chunks)).values())[:5]])
    for query in ("alpha beta", "alpha beta alpha", "0x1f gamma", "alph* ^delta", "zz-z", "(a", "what's", ""):
        for doc in (None, "d1") if query.startswith("alpha b") else (None,):
            scan = [(r.chunk_id, round(r.score, 9)) for r in keyword.keyword_search(chunks, query, 7, doc).collect()]
            assert [(r.chunk_id, round(r.score, 9)) for r in inverted.search(index, chunks, query, 7, doc).collect()] == scan, query


def test_blocks_bound_their_scores_and_few_are_read(spark, monkeypatch):
    """One short text repeats the word; the blocks of the long ones cannot reach it."""
    rng = random.Random(4)
    rows = [(f"c{i:04}", "d", " ".join(["alpha", *rng.choices(["beta", "gamma", "delta"], k=rng.randint(50, 400))])) for i in range(400)]
    rows += [(f"s{i}", "d", "alpha alpha alpha") for i in range(3)] + [("t", "d", "other words")] * 1 + [(f"u{i:03}", "d", "none of it") for i in range(900)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string, text string")
    index, told = index_of(chunks, 8), {}
    found = inverted.top_words(index, ["alpha"], 3, told=told, first=2)
    assert [c for c, _ in found] == ["s0", "s1", "s2"] and told["blocks"] > 40 and told["read"] <= 10
    scan = keyword.keyword_search(chunks, "alpha", 20).collect()
    for first, heads in ((1, 4096), (4, 10), (500, 4096)):
        monkeypatch.setattr(inverted, "HEADS", heads)
        assert [(c, round(v, 9)) for c, v in inverted.top_words(index, ["alpha"], 20, first=first)] == [(r.chunk_id, round(r.score, 9)) for r in scan]
    assert inverted.top_words(index, ["alpha", "none"], 5) == []


def test_dictionary_equals_scan(chunks):
    index = index_of(chunks)
    terms = {(r.term, r.df, r.tf) for r in keyword.term_table(chunks).collect()}
    assert {(r.term, r.df, r.tf) for r in inverted.dictionary(index).collect()} == terms
    assert {r.term for r in inverted.prefix_terms(index, "a").collect()} == {t for t, _, _ in terms if t.startswith("a")}


LITERALS = ["plain text", "A% b_c 100%", "C:\\foo\\bar and \\", "caf\u00e9 CAF\u00c9 x", "", None, "ab", "\U0001f600\U0001f600z", "x" * 3000 + "needle", "a\\%", "0x40020000 [31:0]", "tail(ab"]


def like(text, word):
    """SQL's LIKE with ASCII case folded."""
    import re

    fold = lambda x: "".join(ch.lower() if ch.isascii() else ch for ch in x)
    body = "".join({"%": ".*", "_": "."}.get(ch, re.escape(ch)) for ch in fold(word))
    return re.search(body, fold(text), re.S) is not None


@pytest.mark.parametrize("words", [["C:\\foo"], ["\\"], ["bar\\"], ["foo\\"], ["ab"], ["b"], ["%"], ["_"], ["a%c"], ["1_0%"], ["CAF\u00e9"], ["\U0001f600z"], ["NEEDLE"], ["needle", "xxx"], ["0X4002", "[31"], ["zzz"], ["a", "%", "plain"], ["(AB"]])
def test_literal_search_equals_like(spark, words):
    rows = spark.createDataFrame([(f"c{i:02}", t) for i, t in enumerate(LITERALS)], "chunk_id string, text string")
    want = sorted(((f"c{i:02}", float(sum(w.lower() in t.lower() for w in words))) for i, t in enumerate(LITERALS) if t is not None and all(like(t, w) for w in words)), key=lambda x: (-x[1], x[0]))
    grams = literal.gram_rows(rows)
    assert [tuple(r) for r in literal.scan(rows, words, 50).collect()] == want
    assert [tuple(r) for r in literal.search(rows, grams, literal.gram_counts(grams), words, 50).collect()] == want
    literal_named = literal.NAMED
    try:
        literal.NAMED = 0  # all candidates are joined
        assert [tuple(r) for r in literal.search(rows, grams, literal.gram_counts(grams), words, 50).collect()] == want
    finally:
        literal.NAMED = literal_named


def scanned_rows(df, column):
    """Rows that the scans with a column gave while df was collected."""
    df.collect()
    plan, out, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        if name.startswith("Scan parquet") and column in node.schema().fieldNames():
            out += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_stored_literal_search_reads_only_candidates(spark, tmp_path):
    rows = [(f"c{i:05}", "d", f"text {i} of many " + ("reg[7:4] holds" if i in (17, 4000) else "plain")) for i in range(6000)]
    spark.createDataFrame(rows, "chunk_id string, doc_id string, text string").coalesce(1).sortWithinPartitions("chunk_id").write.option("parquet.page.row.count.limit", "64").parquet(str(tmp_path / "c"))
    chunks = spark.read.parquet(str(tmp_path / "c"))
    literal.gram_rows(chunks).write.parquet(str(tmp_path / "g"))
    grams = spark.read.parquet(str(tmp_path / "g"))
    found = literal.search(chunks, grams, literal.gram_counts(grams), ["REG[7:4]"], 10)
    assert [r.chunk_id for r in found.collect()] == ["c00017", "c04000"] and scanned_rows(found, "text") <= 256
    assert literal.candidates(grams, literal.gram_counts(grams), ["%"]) is None


def test_no_text_is_scanned_where_words_have_hits(chunks):
    index = index_of(chunks)
    plan = inverted.search(index, chunks, "reg_a1 alpha", 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan


@pytest.mark.parametrize("text, want", [("Dvo\u0159\u00e1k", ["dvorak"]), ("Dvor\u030ca\u0301k", ["dvorak"]), ("re\u0301sume\u0301 \u0160imon", ["resume", "simon"]), ("\u0151 \u01d6 \u0439 \u0386\u03bb\u03c6\u03b1", ["o", "u", "\u0438", "\u03b1\u03bb\u03c6\u03b1"]), ("stra\u00dfe \u00f8l \u0130x", ["stra\u00dfe", "\u00f8l", "ix"]), ("\ud55c\uae00 \u4e2d\u6587", ["\ud55c\uae00", "\u4e2d\u6587"])])
def test_folding(one, text, want):
    assert one(T.tokens(F.lit(text))) == want == keyword.fold_word(text)


def test_accents_are_found_either_way(spark):
    chunks = spark.createDataFrame([("a", "d", "Dvo\u0159\u00e1k"), ("b", "d", "Dvor\u030ca\u0301k"), ("c", "d", "dvor"), ("e", "d", "x"), ("f", "d", "y"), ("g", "d", "z")], "chunk_id string, doc_id string, text string")
    for query in ("dvorak", "Dvo\u0159\u00e1k", "Dvor\u030ca\u0301k"):
        assert {r.chunk_id for r in keyword.keyword_search(chunks, query).collect()} == {r.chunk_id for r in inverted.search(index_of(chunks), chunks, query).collect()} == {"a", "b"}


@pytest.fixture
def vectors(spark):
    return spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [-1.0, 0.0])], "chunk_id string, embedding array<float>")


def test_scores_are_clamped_cosines(vectors):
    assert [(r.chunk_id, round(r.score, 6)) for r in semantic.semantic_search(vectors, [1.0, 0.0], 10).collect()] == [("a", 1.0), ("b", 0.0), ("c", 0.0)]


def test_fewer_vectors_than_asked_are_no_artefacts(vectors):
    assert semantic.nearest(vectors, [1.0, 0.0], 50).count() == 3
    assert semantic.nearest(vectors.limit(0), [1.0, 0.0], 5).count() == 0


def test_filter_before_and_after(vectors, spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y")], "chunk_id string, doc_id string")
    for overfetch in (False, True):
        found = semantic.semantic_search(vectors, [1.0, 0.0], 2, chunks, "y", overfetch)
        assert {r.chunk_id for r in found.collect()} == {"b", "c"}


def test_new_vectors_win(vectors, spark):
    new = spark.createDataFrame([("a", [0.5, 0.5])], vectors.schema)
    assert {r.chunk_id: list(r.embedding) for r in semantic.add_vectors(vectors, new).collect()}["a"] == [0.5, 0.5]


def test_vectors_of_another_length_are_refused(vectors, spark):
    new = spark.createDataFrame([("d", [0.5, 0.5, 0.5])], vectors.schema)
    with pytest.raises(Exception, match="vector of 3 numbers; the index holds 2"):
        semantic.add_vectors(vectors, new, 2).collect()
    assert semantic.add_vectors(vectors, vectors.limit(1), 2).count() == 3


def test_clustered_vectors_equal_the_flat_scan(spark):
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    points = [[c + rng.gauss(0, 0.1) for c in rng.choice(centres)] for _ in range(3000)]
    points += [points[0]] * 40  # ties
    rows = spark.createDataFrame([(f"v{i:04}", [float(x) for x in p]) for i, p in enumerate(points)] + [("none", None)], "chunk_id string, embedding array<float>")
    pivots = semantic.pick_pivots(rows, 24)
    index = semantic.clustered(rows, pivots).cache()
    for query in (points[0], points[77], centres[3], [9.0] * 8):
        for k in (1, 10, 45):
            told = {}
            want = [tuple(r) for r in semantic.nearest(rows, query, k).collect()]
            assert [tuple(r) for r in semantic.nearest_clustered(index, pivots, query, k, told=told).collect()] == want
            if query in (points[77], centres[3]):
                assert told["read"] < 0.3 * told["vectors"]
    assert semantic.nearest_clustered(index, pivots, points[0], 9999).count() == 3040
    assert semantic.nearest_clustered(semantic.clustered(rows.limit(0), []), [], points[0], 3).count() == 0


def test_fusion(spark):
    scores = lambda rows: spark.createDataFrame(rows, "chunk_id string, score double")
    found = {r.chunk_id: r.score for r in hybrid.fuse(scores([("k", 1.0), ("b", 0.5), ("z", 0.2)]), scores([("s", 1.0), ("b", 0.5), ("z", 0.0)])).collect()}
    assert found == pytest.approx({"k": 0.4, "s": 0.6, "b": 0.6, "z": 0.2 * 0.4 * 1.2})


def test_orphans_go_before_the_limit(spark):
    chunks = spark.createDataFrame([("a", "d", "alpha"), ("b", "d", "alpha beta")], "chunk_id string, doc_id string, text string")
    vectors = spark.createDataFrame([("gone", [1.0, 0.0]), ("a", [0.9, 0.1])], "chunk_id string, embedding array<float>")
    assert [r.chunk_id for r in hybrid.hybrid_search(chunks, vectors, "alpha", [1.0, 0.0], 2).collect()] == ["a", "b"]


def test_register_priority(spark):
    rows = [("1", "d", "text", "P", "R"), ("2", "d", "register_map", "P", "R"), ("3", "d", "bitfield_definition", "Q", "R"), ("4", "d", "bitfield_definition", "P", "r")]
    registers = spark.createDataFrame(rows, "chunk_id string, doc_id string, chunk_type string, peripheral string, name string")
    assert hybrid.find_register(registers, "R").first().chunk_id == "3"
    assert hybrid.find_register(registers, "R", "P").first().chunk_id == "2"
    assert hybrid.find_register(registers, "R", "").first().chunk_id == "3"
    assert hybrid.find_register(registers, "none").count() == 0
    assert {(r.peripheral, r.chunk_id) for r in hybrid.best_register(registers).filter(F.col("name") == "R").collect()} == {("P", "2"), ("Q", "3")}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_made_within_rows(chunks):
    """Nothing is exchanged for postings, and only counts for the terms."""
    assert "Exchange" not in plan_of(keyword.postings(chunks, keep=["doc_id"]))
    plan = plan_of(keyword.term_table(chunks))
    assert plan.count("Exchange") == 1 and "collect_list" not in plan


def test_terms_of_ids_with_several_rows(spark):
    """An id counts once for a term, however many rows it has; all occurrences count."""
    rows = spark.createDataFrame([(1, "b a a"), (1, "a c"), (2, "a"), (None, "c"), (None, "c"), (3, None), (4, "é E")], "chunk_id long, text string")
    assert sorted(tuple(r) for r in keyword.term_table(rows).collect()) == [("a", 2, 4), ("b", 1, 1), ("c", 2, 3), ("e", 1, 2)]
    assert not keyword.repeats(rows.filter("chunk_id > 1")) and keyword.repeats(rows)
    held = {(r.chunk_id, r.term): (r.dl, r.positions) for r in keyword.merged(keyword.postings(rows.filter("chunk_id = 4"))).collect()}
    assert held == {(4, "e"): (2, [0, 1])}


@pytest.mark.parametrize("rows_a_batch", [7, 10_000])
def test_blocks_of_dealt_texts(spark, chunks, rows_a_batch):
    """The same blocks as of postings; texts are exchanged, once, and no postings."""
    more = [(f"n{i}", None if i % 2 else "d", t) for i, t in enumerate(["", None, "é É x", "-", "alpha " * 300])]
    rows = chunks.unionByName(spark.createDataFrame(more, "chunk_id string, doc_id string, text string"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        made = inverted.blocks_of_chunks(rows, inverted.length_classes(keyword.lengths(rows)), 8)
        plan = plan_of(made)
        assert plan.count("Exchange") == 1 and "collect_list" not in plan
        want = inverted.block_rows(keyword.postings(rows, keep=["doc_id"]), 8)
        assert made.dtypes == want.dtypes
        held = {(r.block, r.term): r for r in made.collect()}
        assert len(held) == made.count() and held == {(r.block, r.term): r for r in want.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    counts = {tuple(r) for r in inverted.block_term_counts(made).collect()}
    assert counts == {tuple(r) for r in keyword.term_table(rows).collect()}


def test_stored_index_of_ids_with_several_rows(spark, tmp_path):
    from docquarry.plans import catalog

    rows = [(1, "than thanks than", "s"), (1, "than", "s"), (2, "thank", "s"), (3, None, "s"), (4, "than a", "t")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in catalog.term_prefix_range(spark, str(tmp_path)).collect()) == [("than", 2, 4), ("thank", 1, 1), ("thanks", 1, 1)]


def test_a_search_with_hits_needs_no_trigrams(spark, monkeypatch):
    """The index of the words is built without them; they are stored when a literal wants them."""
    from conftest import SF
    from docquarry.plans import catalog

    monkeypatch.setattr(catalog, "_STORED", {})
    assert catalog.keyword_bm25_and(spark, SF).count() > 0
    assert {k[2] for k in catalog._STORED} == {"keyword-index"}
    assert catalog.keyword_literal_common(spark, SF).count() > 0
    assert {k[2] for k in catalog._STORED} == {"keyword-index", "trigrams"}


def test_hybrid_fusion_stores_blocks_and_words_alone(spark, monkeypatch):
    """Neither postings nor trigrams are written for it."""
    import os

    from conftest import SF
    from docquarry.plans import catalog

    monkeypatch.setattr(catalog, "_STORED", {})
    assert catalog.hybrid_fusion(spark, SF).count() > 0
    file = catalog.stored_index(spark, SF).blocks.inputFiles()[0].removeprefix("file://")
    assert sorted(os.listdir(os.path.dirname(os.path.dirname(file)))) == ["blocks", "terms"]


def test_blocks_are_stored_in_pages_of_many_rows(spark, monkeypatch):
    """A page's head and compressor cost more than a short row of blocks."""
    import pyarrow.parquet as pq

    from conftest import SF
    from docquarry.plans import catalog

    monkeypatch.setattr(catalog, "_STORED", {})
    footers = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in catalog.stored_index(spark, SF).blocks.inputFiles()]
    columns = [m.row_group(g).column(c) for m in footers for g in range(m.num_row_groups) for c in range(m.num_columns)]
    numbers = [c for c in columns if c.path_in_schema == "n"]
    assert sum(c.total_compressed_size for c in numbers) < 0.5 * sum(c.num_values for c in numbers)


def test_texts_are_split_once_to_deal_them(chunks):
    """Below the exchange no filter splits the texts beside the block's number."""
    plan = plan_of(inverted.blocks_of_chunks(chunks, inverted.length_classes(keyword.lengths(chunks)), 8))
    assert not any("Filter" in line and "split(" in line for line in plan.splitlines())


def test_texts_without_a_word_give_no_blocks(spark):
    rows = spark.createDataFrame([(1, "d", ""), (2, "d", None), (3, "d", " - ")], "chunk_id long, doc_id string, text string")
    assert inverted.blocks_of_chunks(rows, inverted.length_classes(keyword.lengths(rows))).count() == 0
    more = rows.union(spark.createDataFrame([(4, "d", "x")], rows.schema))
    assert [(r.term, r.ids) for r in inverted.blocks_of_chunks(more, inverted.length_classes(keyword.lengths(more))).collect()] == [("x", [4])]
