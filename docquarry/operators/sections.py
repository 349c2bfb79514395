"""Sections of documents: outline bounds, page ranges, titles, headings, hierarchy.

All windows are per document, so their partitions are bounded by a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.functions.grids import widest_header
from docquarry.functions.text import col, is_table_title

#: What a numbered heading looks like; larger type also makes a heading.
HEADING = r"^(\d+\.)+\d*\s+[A-Z]"
HEADING_SIZE = 12


def outline_bounds(toc: DataFrame, last_page: Column | str = "last_page") -> DataFrame:
    """Adds start_page (not below 0), end_page and span_end to outline rows (doc_id,
    toc_idx, title, level, page_num, last_page). The span reaches into the page on which
    the next entry starts; the end page does not."""
    order = Window.partitionBy("doc_id").orderBy("toc_idx")
    start = F.greatest(F.col("page_num"), F.lit(0))
    after = F.lead("start_page").over(order)
    rows = toc.withColumn("start_page", start)
    return rows.withColumn("next_title", F.lead("title").over(order)).withColumn("span_end", F.greatest("start_page", F.coalesce(after, col(last_page)))).withColumn("end_page", F.when(after.isNull(), F.greatest("start_page", col(last_page))).otherwise(F.greatest(F.col("start_page"), after - 1)))


def section_text(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds `content`, the section's page texts in order, each with a line end. The range
    join is an equi-join on the pages that the span lists."""
    wanted = sections.select("doc_id", "toc_idx", F.explode(F.sequence("start_page", "span_end")).alias("page_num"))
    texts = wanted.join(pages.select("doc_id", "page_num", "raw_text"), ["doc_id", "page_num"]).groupBy("doc_id", "toc_idx").agg(F.array_sort(F.collect_list(F.struct("page_num", "raw_text"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: F.concat(p["raw_text"], F.lit("\n"))), "")
    return sections.join(texts.select("doc_id", "toc_idx", joined.alias("content")), ["doc_id", "toc_idx"], "left").withColumn("content", F.coalesce("content", F.lit("")))


def title_pattern(title) -> Column:
    """A pattern that finds a title whatever white space stands between its words."""
    words = F.filter(F.split(col(title), r"(?U)\s+"), lambda w: w != "")
    quoted = F.transform(words, lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return F.array_join(quoted, r"(?U)\s+")


def trim_to_title(content, title, next_title) -> Column:
    """Cuts what stands before the title and from the next title on; a title that is not
    found, or found at the start, cuts nothing."""
    whole, own, after = col(content), col(title), col(next_title)
    has = F.coalesce(own, F.lit("")) != ""
    at = F.when(has, F.regexp_instr(whole, title_pattern(own))).otherwise(0)
    cut = F.when(at > 1, F.substr(whole, at, F.length(whole))).otherwise(whole)

    def behind(text: Column) -> Column:
        skip = F.coalesce(F.length(own), F.lit(0))
        rest = F.substr(text, skip + 1, F.length(text))
        found = F.when(F.coalesce(after, F.lit("")) != "", F.regexp_instr(rest, title_pattern(after))).otherwise(0)
        return F.when((found > 0) & (found + skip > 1), F.substr(text, F.lit(1), found + skip - 1)).otherwise(text)

    return F.transform(F.array(cut), behind)[0]


def is_heading(text, font_size) -> Column:
    return (col(font_size) > HEADING_SIZE) | col(text).rlike(HEADING)


def heading_level(text) -> Column:
    return F.length(col(text)) - F.length(F.replace(col(text), F.lit("."), F.lit(""))) + 1


def heading_sections(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Sections by headings, for documents without an outline. blocks: (doc_id, page_num,
    block_idx, text, font_size); pages: (doc_id, page_num, raw_text). A page's text goes to
    the last heading up to its end, so earlier headings of the page stay empty."""
    order = Window.partitionBy("doc_id").orderBy("page_num", "block_idx")
    heads = blocks.filter(is_heading("text", "font_size")).withColumn("section_id", F.row_number().over(order))
    heads = heads.withColumn("next_page", F.lead("page_num").over(order))
    last = pages.groupBy("doc_id").agg((F.count("*") - 1).cast("int").alias("last_page"))
    sections = heads.join(last, "doc_id").select("doc_id", "section_id", F.col("text").alias("title"), heading_level("text").alias("level"), F.col("page_num").alias("start_page"), F.coalesce(F.col("next_page") - 1, F.col("last_page")).alias("end_page"))
    owner = heads.groupBy("doc_id", "page_num").agg(F.max("section_id").alias("owner"))
    until = Window.partitionBy("doc_id").orderBy("page_num").rowsBetween(Window.unboundedPreceding, 0)
    owned = pages.join(owner, ["doc_id", "page_num"], "left").withColumn("section_id", F.last("owner", ignorenulls=True).over(until)).filter("section_id is not null")
    texts = owned.groupBy("doc_id", "section_id").agg(F.array_sort(F.collect_list(F.struct("page_num", "raw_text"))).alias("parts"))
    content = F.array_join(F.transform("parts", lambda p: F.concat(p["raw_text"], F.lit("\n"))), "")
    return sections.join(texts.select("doc_id", "section_id", content.alias("content")), ["doc_id", "section_id"], "left").withColumn("content", F.coalesce("content", F.lit("")))


def _ranked(sections: DataFrame, max_level: int | None) -> tuple[DataFrame, int]:
    """Sections with `rank`, that of their level among the document's levels, and the number
    of ranks; with max_level the levels themselves, those from max_level on being no
    parents'."""
    if max_level is not None:
        return sections.withColumn("rank", F.col("level")), max_level
    most = sections.groupBy("doc_id").agg(F.countDistinct("level").alias("n")).agg(F.max("n")).first()[0] or 0
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("level")))
    return sections.withColumn("rank", F.when(F.col("level").isNotNull(), rank)), max(most, 3)


def hierarchy(sections: DataFrame, id_col: str = "section_id", max_level: int | None = None) -> DataFrame:
    """Adds parent_id: the nearest earlier section of a smaller level. For each level the
    latest section so far is known; the parent is the latest of those of smaller levels.
    All levels count, unless max_level is given."""
    before = Window.partitionBy("doc_id").orderBy(id_col).rowsBetween(Window.unboundedPreceding, -1)
    rows, top = _ranked(sections, max_level)
    latest = [F.when(F.col("rank") > k, F.last(F.when(F.col("rank") == k, F.col(id_col)), ignorenulls=True).over(before)) for k in range(1, top)]
    return rows.withColumn("parent_id", F.greatest(*latest)).drop("rank")


def outline_tree(sections: DataFrame, id_col: str = "section_id", max_level: int | None = None) -> DataFrame:
    """Adds parent_id, ancestor_ids and ancestor_titles (from the root down) and is_leaf to
    sections in document order, in one window pass. Of the latest earlier section of each
    smaller level, those are ancestors behind which no section of a smaller level came:
    their ids rise with their levels. All levels count, unless max_level is given."""
    order = Window.partitionBy("doc_id").orderBy(id_col)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    own = F.struct(F.col(id_col).cast("bigint").alias("id"), "title", "level")
    rows, top = _ranked(sections, max_level)
    latest = F.array(*[F.last(F.when(F.col("rank") == k, own), ignorenulls=True).over(before) for k in range(1, top)])
    rows = rows.withColumn("latest", latest).withColumn("next_level", F.lead("level").over(order))
    empty = F.array().cast("array<struct<id bigint, title string, level int>>")
    smaller = F.transform(F.filter("latest", lambda x: x.isNotNull() & (x["level"] < F.col("level"))), lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), x["level"].cast("int").alias("level")))
    chain = F.aggregate(smaller, empty, lambda up, x: F.when((F.size(up) == 0) | (x["id"] > F.get(up, F.size(up) - 1)["id"]), F.concat(up, F.array(x))).otherwise(up))
    rows = rows.withColumn("chain", chain)
    return rows.withColumn("ancestor_ids", F.transform("chain", lambda x: x["id"])).withColumn("ancestor_titles", F.transform("chain", lambda x: x["title"])).withColumn("parent_id", F.get("chain", F.size("chain") - 1)["id"].cast(sections.schema[id_col].dataType)).withColumn("is_leaf", F.coalesce(F.col("next_level") <= F.col("level"), F.lit(True))).drop("rank", "latest", "next_level", "chain")


def ancestors(sections: DataFrame, id_col: str = "section_id", depth: int = 4) -> DataFrame:
    """For trees that name their parents but are in no document order: adds ancestor_ids and ancestor_titles from the root down, and is_leaf. `depth` levels are
    climbed by joins on (doc_id, id)."""
    ids = sections.select("doc_id", F.col(id_col).alias("up_id"), F.col("title").alias("up_title"), F.col("parent_id").alias("up_parent"))
    out = sections.withColumn("ancestor_ids", F.array().cast("array<bigint>")).withColumn("ancestor_titles", F.array().cast("array<string>")).withColumn("up_id", F.col("parent_id"))
    for _ in range(depth):
        step = out.join(ids, ["doc_id", "up_id"], "left")
        found = F.col("up_title").isNotNull()
        out = step.withColumn("ancestor_ids", F.when(found, F.concat(F.array(F.col("up_id").cast("bigint")), "ancestor_ids")).otherwise(F.col("ancestor_ids"))).withColumn("ancestor_titles", F.when(found, F.concat(F.array("up_title"), "ancestor_titles")).otherwise(F.col("ancestor_titles"))).withColumn("up_id", F.col("up_parent")).drop("up_title", "up_parent")
    parents = sections.filter("parent_id is not null").select("doc_id", F.col("parent_id").alias(id_col)).distinct().withColumn("has_child", F.lit(True))
    return out.drop("up_id").join(parents, ["doc_id", id_col], "left").withColumn("is_leaf", F.col("has_child").isNull()).drop("has_child")


def merge_table_children(sections: DataFrame, id_col: str = "section_id") -> DataFrame:
    """Adds merged: the section's content and, behind it, that of its children whose title
    starts with 'Table ', in order, empty ones left out."""
    child = sections.filter(F.col("parent_id").isNotNull() & F.col("title").startswith("Table ") & (F.coalesce("content", F.lit("")) != "")).groupBy("doc_id", "parent_id").agg(F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("at"), "content"))).alias("parts"))
    child = child.select("doc_id", F.col("parent_id").alias(id_col), F.transform("parts", lambda p: p["content"]).alias("parts"))
    both = F.filter(F.concat(F.array(F.col("content")), F.coalesce("parts", F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != ""))
    return sections.join(child, ["doc_id", id_col], "left").withColumn("merged", F.array_join(both, "\n")).drop("parts")


def skip_subtrees(sections: DataFrame, hit: Column, id_col: str = "section_id") -> DataFrame:
    """Sections without an ancestor for which `hit` holds."""
    hits = sections.filter(hit).select("doc_id", F.col(id_col).cast("bigint").alias("hit_id"))
    below = sections.select("doc_id", id_col, F.explode("ancestor_ids").alias("hit_id")).join(hits, ["doc_id", "hit_id"], "left_semi").select("doc_id", id_col).distinct()
    return sections.join(below, ["doc_id", id_col], "left_anti")


def table_context(tables: DataFrame, blocks: DataFrame, reach: float = 100.0, lines: int = 5) -> DataFrame:
    """(doc_id, page_num, table_index, context): the last `lines` blocks that end above
    the table, less than `reach` away, in order. Joined on the page."""
    near = tables.select("doc_id", "page_num", "table_index", F.col("y0").alias("top")).join(blocks.select("doc_id", "page_num", "y0", "y1", "text"), ["doc_id", "page_num"]).filter((F.col("top") - F.col("y1") > 0) & (F.col("top") - F.col("y1") < reach))
    order = Window.partitionBy("doc_id", "page_num", "table_index").orderBy(F.desc("y0"), F.desc("text"))
    last = near.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= lines)
    return last.groupBy("doc_id", "page_num", "table_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "text"))), lambda b: b["text"]), " ").alias("context"))


def table_headers(sections: DataFrame, tables: DataFrame) -> DataFrame:
    """Adds table_header to sections: for leaves titled 'Table N.' the header of the first of
    the pages start_page and start_page + 1 that has one, else null. tables: (doc_id,
    page_num, table_index, grid), of any kind. Joined on the page."""
    by_page = tables.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(F.struct("table_index", "grid"))).alias("parts"))
    headers = by_page.select("doc_id", "page_num", widest_header(F.transform("parts", lambda p: p["grid"])).alias("header")).filter("header is not null")
    leaves = sections.filter(is_table_title("title") & F.col("is_leaf")).select("doc_id", "section_id", F.explode(F.sequence("start_page", F.col("start_page") + 1)).alias("page_num"))
    found = leaves.join(headers, ["doc_id", "page_num"]).groupBy("doc_id", "section_id").agg(F.min_by("header", "page_num").alias("table_header"))
    return sections.join(found, ["doc_id", "section_id"], "left")


def cluster_rows(blocks: Column | str, tolerance: float = 5.0) -> Column:
    """Rows of blocks (struct with y0, x0): a row takes blocks whose y0 is within the
    tolerance of its first block's; rows from top to bottom, each from left to right."""
    ordered = F.array_sort(F.transform(col(blocks), lambda b: F.struct(b["y0"].alias("y0"), b["x0"].alias("x0"), b.alias("block"))))
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("row"), F.array().cast("array<int>").alias("rows"))

    def step(s: Column, b: Column) -> Column:
        same = s["anchor"].isNotNull() & (F.abs(b["y0"] - s["anchor"]) <= tolerance)
        row = F.when(same, s["row"]).otherwise(s["row"] + 1)
        return F.struct(F.when(same, s["anchor"]).otherwise(b["y0"].cast("double")).alias("anchor"), row.alias("row"), F.concat(s["rows"], F.array(row)).alias("rows"))

    numbers = F.aggregate(ordered, start, step)["rows"]
    placed = F.zip_with(ordered, numbers, lambda b, row: F.struct(row.alias("row"), b["x0"].alias("x0"), b["y0"].alias("y0"), b["block"].alias("block")))
    return F.array_sort(placed)


def block_rows(blocks: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """(doc_id, page_num, row, n, x0, x1, y0, y1): the clustered rows of each page's blocks
    (doc_id, page_num, x0, x1, y0, y1), with their number of blocks and their edges."""
    held = blocks.groupBy("doc_id", "page_num").agg(F.collect_list(F.struct("y0", "x0", "x1", "y1")).alias("blocks"))
    flat = held.select("doc_id", "page_num", F.explode(cluster_rows("blocks", tolerance)).alias("b")).select("doc_id", "page_num", "b.row", "b.block.*")
    return flat.groupBy("doc_id", "page_num", "row").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))


def grown_regions(rows: DataFrame, is_header: Column, reach: float = 50.0, least: float = 20.0) -> DataFrame:
    """(doc_id, page_num, head, n_rows, x0, y0, x1, y1): the table below each header row. It
    goes on while rows have two blocks and at most two fewer than the header, and edges within
    `reach` of the header's; it ends where its last row ends and is `least` high."""
    page = ["doc_id", "page_num"]
    heads = rows.filter(is_header).select(*page, F.col("row").alias("head"), F.col("n").alias("columns"), F.col("x0").alias("left"), F.col("x1").alias("right"), F.col("y0").alias("top"))
    fits = (F.col("n") >= F.greatest(F.lit(2), F.col("columns") - 2)) & (F.abs(F.col("x0") - F.col("left")) <= reach) & (F.abs(F.col("x1") - F.col("right")) <= reach)
    down = Window.partitionBy(*page, "head").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    below = heads.join(rows, page).filter(F.col("row") > F.col("head")).withColumn("open", F.min(fits).over(down)).filter("open")
    found = below.groupBy(*page, "head", "left", "top", "right").agg(F.count("*").alias("n_rows"), F.max_by("y1", "row").alias("bottom"))
    return found.filter(F.col("bottom") - F.col("top") >= least).select(*page, "head", "n_rows", F.col("left").alias("x0"), F.col("top").alias("y0"), F.col("right").alias("x1"), F.col("bottom").alias("y1"))
