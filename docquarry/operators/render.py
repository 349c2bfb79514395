"""Results as markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.functions.registers import table_markdown
from docquarry.functions.text import excerpt


def result_lines(results: DataFrame, max_results: int = 5) -> DataFrame:
    """(nth, markdown) of the first results by score. results is a top-k table, so ranking
    it in one task is bounded."""
    top = results.orderBy(F.desc("score"), "chunk_id").limit(max_results)
    rows = top.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))
    body = F.when(F.col("structured_data").isNotNull(), table_markdown("structured_data")).otherwise(excerpt("text"))
    section = F.when(F.coalesce("section_title", F.lit("")) != "", F.concat(F.lit("**Section:** "), "section_title", F.lit("\n"))).otherwise("")
    source = F.format_string("\n\n**Source:** Pages %d-%d\n", "page_start", "page_end")
    return rows.select("nth", F.concat(F.format_string("## Result %d\n\n", "nth"), body, source, section, F.lit("\n---\n")).alias("markdown"))


def format_results(results: DataFrame, max_results: int = 5) -> str:
    rows = result_lines(results, max_results).orderBy("nth").collect()  # at most max_results
    return "\n".join(r["markdown"] for r in rows) if rows else "No results found."


def format_register(result: DataFrame, name: str) -> str:
    """The one row of a register lookup: structured data, else the raw text."""
    row = result.select(F.coalesce(F.when(F.col("structured_data").isNotNull(), table_markdown("structured_data")), "text").alias("m")).first()
    return row["m"] if row else f"Register '{name}' not found."


def listing(files: DataFrame) -> DataFrame:
    """files: (filename, size_mb, doc_id or null). Lines, indexed ones first, then by name."""
    indexed = F.col("doc_id").isNotNull()
    line = F.format_string("- **%s** (%.1f MB) — %s", "filename", "size_mb", F.when(indexed, "indexed").otherwise("not indexed"))
    return files.select(indexed.alias("indexed"), "filename", F.concat(line, F.when(indexed, F.concat(F.lit("\n  - ID: `"), "doc_id", F.lit("`"))).otherwise("")).alias("line")).orderBy(F.desc("indexed"), "filename")


def listing_text(lines: DataFrame, dirs: list[str]) -> str:
    """A listing as one text, headed by the numbers of files and of indexed ones."""
    rows = lines.orderBy(F.desc("indexed"), "filename").collect()  # the files of some directories
    if not rows:
        return f"No PDF files found in: {', '.join(dirs)}"
    known = sum(r["indexed"] for r in rows)
    return "\n".join(["# Documentation", "", f"**{len(rows)}** PDFs found ({known} indexed)", "", *(r["line"] for r in rows)])
