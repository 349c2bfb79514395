"""Sources: Parquet tables, directories of files, and documents through a parser plug-in."""

from __future__ import annotations

import fnmatch
import tempfile
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry import schemas
from docquarry.functions import grids as G
from docquarry.functions.text import document_id

#: A parser turns a file's bytes into page dicts, outline dicts and table dicts; see
#: schemas.PAGES, TOC and TABLE_REGIONS (without doc_id, keywords and type).
Parser = Callable[[bytes], dict[str, Iterable[dict]]]
TABLE_CELLS = f"doc_id string, page_num int, table_index int, bbox {schemas.BOX}, grid array<array<string>>"


def work_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, which a
    local session need not have."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (base or "file://" + tempfile.mkdtemp(prefix="docquarry-")).rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks_of_documents(documents: DataFrame) -> DataFrame:
    """The driver's documents as chunks: one each, `source` being the document."""
    return documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), "text", "lang", "n_chars")


def vectors_of_embeddings(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def _status(spark: SparkSession, path: str):
    """Hadoop's file status of a path, or None where there is nothing."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(jvm_path) if fs.exists(jvm_path) else None


def list_files(spark: SparkSession, paths: list[str], pattern: str = "*.pdf") -> DataFrame:
    """(path, filename, size_mb) of the files below some directories; contents unread.
    Missing directories hold no files."""
    there = [p for p in paths if _status(spark, p) is not None]
    if not there:
        return spark.createDataFrame([], "path string, filename string, size_mb double")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(there)
    return files.select("path", F.substring_index("path", "/", -1).alias("filename"), (F.col("length") / 1048576).alias("size_mb"))


def check_paths(spark: SparkSession, paths: list[str], pattern: str) -> None:
    """ValueError for a path that is not there, and for a named file that the pattern,
    upper and lower case alike, does not match."""
    for path in paths:
        found = _status(spark, path)
        if found is None:
            raise ValueError(f"Documentation file not found: {path}")
        name = found.getPath().getName()
        if not found.isDirectory() and not fnmatch.fnmatch(name.lower(), pattern.lower()):
            raise ValueError(f"Only {pattern} files are supported. Got: {name}")


def binary_documents(spark: SparkSession, paths: list[str], pattern: str = "*") -> DataFrame:
    either = "".join(f"[{ch.lower()}{ch.upper()}]" if ch.isalpha() else ch for ch in pattern)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", either).load(paths)
    return files.select(document_id("path").alias("doc_id"), F.substring_index("path", "/", -1).alias("filename"), "path", "content")


def last_paths(documents: DataFrame) -> DataFrame:
    """(doc_id, path, hidden): of files with one doc_id, that is one name, the last path, and
    how many others there are. Contents are not read."""
    return documents.groupBy("doc_id").agg(F.max("path").alias("path"), (F.count("*") - 1).alias("hidden"))


def parse_documents(files: DataFrame, parser: Parser, what: str) -> DataFrame:
    """One kind of parser output ('pages', 'toc' or 'tables') for (doc_id, content) rows.
    The parser runs on the executors, a file at a time."""
    schema = {"pages": schemas.PAGES, "toc": schemas.TOC, "tables": TABLE_CELLS}[what]
    names = [f.split()[0] for f in _top_level(schema)]

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                for i, item in enumerate(parser(content).get(what, ())):
                    rows.append({"doc_id": doc_id, "toc_idx": i, **item})
            yield pd.DataFrame(rows, columns=names)

    return files.select("doc_id", "content").mapInPandas(run, schema)


def _fields_of(what: str) -> str:
    """The fields of one kind of parser output, without the doc_id."""
    schema = {"pages": schemas.PAGES, "toc": schemas.TOC, "tables": TABLE_CELLS}[what]
    return ", ".join(f for f in _top_level(schema) if not f.startswith("doc_id "))


def parse_all(files: DataFrame, parser: Parser) -> DataFrame:
    """(doc_id, filename, pages, toc, tables): everything the parser finds in each file,
    which it reads once."""
    kinds = ("pages", "toc", "tables")
    schema = "doc_id string, filename string, " + ", ".join(f"{k} array<struct<{_fields_of(k)}>>" for k in kinds)
    names = {k: [f.split()[0] for f in _top_level(_fields_of(k))] for k in kinds}

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, filename, content in zip(batch["doc_id"], batch["filename"], batch["content"], strict=True):
                found = parser(content)
                rows.append([doc_id, filename, *[[{n: ({"toc_idx": i} | item).get(n) for n in names[k]} for i, item in enumerate(found.get(k, ()))] for k in kinds]])
            yield pd.DataFrame(rows, columns=["doc_id", "filename", *kinds])

    return files.select("doc_id", "filename", "content").mapInPandas(run, schema)


def parsed_rows(parsed: DataFrame, what: str) -> DataFrame:
    """One kind of output of parse_all, a row each."""
    return parsed.select("doc_id", F.explode(what).alias("x")).select("doc_id", "x.*")


def _top_level(schema: str) -> list[str]:
    depth, start, out = 0, 0, []
    for i, ch in enumerate(schema + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return out


def page_range(pages: DataFrame, first: int, last: int) -> DataFrame:
    return pages.filter(F.col("page_num").between(first, last))


def classify_tables(tables: DataFrame) -> DataFrame:
    """Keeps grids of two rows or more whose first two rows look like a register header and
    whose box is known; adds header_keywords and table_type."""
    rows = tables.withColumn("header_keywords", G.grid_keywords("grid"))
    kept = rows.filter((F.size("grid") >= 2) & F.col("bbox").isNotNull() & G.is_header("header_keywords"))
    return kept.withColumn("table_type", G.table_type("header_keywords"))


def text_parser(content: bytes) -> dict[str, list[dict]]:
    """A parser for plain text: form feeds end pages, every line is a block in 10 point
    type; numbered headings make the sections."""
    pages = []
    for n, page in enumerate(content.decode("utf-8", "replace").split("\f")):
        blocks = [{"text": line.strip(), "bbox": {"x0": 0.0, "y0": 12.0 * k, "x1": 500.0, "y1": 12.0 * k + 10}, "font_size": 10.0, "font_name": "", "page_num": n} for k, line in enumerate(page.split("\n")) if line.strip()]
        pages.append({"page_num": n, "width": 612.0, "height": 792.0, "blocks": blocks, "raw_text": page})
    return {"pages": pages, "toc": [], "tables": []}
