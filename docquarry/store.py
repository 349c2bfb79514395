"""DocStore: ingest, search, look up, list, remove and rebuild over log-structured tables.

`chunks` is the single source of truth; registers, vectors, postings, trigrams and counts are
derived from it and committed with it, so a re-ingested or removed document leaves nothing
stale behind. A change writes one segment with its own rows and the counts it takes away (see
log.LogTables); every query reads one snapshot.

Vectors are kept by the hash of the text they belong to: a text that the store has had before
is not embedded again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry import schemas
from docquarry.config import Config
from docquarry.functions.grids import extract_table
from docquarry.log import LogTables, Snapshot, Table
from docquarry.operators import catalog_ops, chunks as C, hybrid, inverted, keyword, literal, render, sections as S, semantic
from docquarry.sources import embedder, files
from docquarry.sources.pdf import pdf_parser

TABLES = {
    "documents": Table(schemas.DOCUMENTS, ("doc_id",)),
    "chunks": Table(schemas.CHUNKS, ("doc_id", "chunk_id"), rows=256),
    "registers": Table(schemas.REGISTERS, ("name", "chunk_id"), bloom=("name",), rows=2048),
    "vectors": Table(schemas.VECTORS, ("cluster", "radius"), rows=256),
    "blocks": Table(inverted.blocks_schema(), ("term", "block"), bloom=("term",), rows=64, unpack=inverted.postings_of, pack=inverted.block_rows),
    "terms": Table(inverted.TERMS, ("term",), summed=("df", "tf"), rows=2048),
    "sizes": Table(inverted.SIZES, ("n_chunks",), summed=("n_chunks", "n_tokens")),
    "grams": Table(schemas.GRAMS, ("gram", "chunk_id"), rows=2048),
    "gram_counts": Table(inverted.GRAM_COUNTS, ("gram",), summed=("n",), rows=2048),
}
REPORT = "filename string, doc_id string, pages long, sections long, tables long"


class DocStore:
    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, load_model: Callable = embedder.HashingModel, fan: int = 4, retention: float = 3600.0):
        """fan, retention: see log.LogTables."""
        self.spark, self.path, self.config, self.load_model = spark, path.rstrip("/"), config or Config(), load_model
        self.log = LogTables(spark, path, TABLES, "doc_id", fan, retention)

    # -- tables ------------------------------------------------------------------

    def table(self, name: str, snapshot: Snapshot | None = None) -> DataFrame:
        return self.log.table(name, snapshot)

    def _staged(self, df: DataFrame, folder: str, name: str) -> DataFrame:
        """df written below the store's folder and read back: parsed once, planned once. The
        folder goes when the change is done."""
        path = f"{self.path}/staging/{folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _unstage(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/staging/{folder}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def index(self, snapshot: Snapshot) -> inverted.Index:
        raw = {name: self.log.table(name, snapshot, raw=True) for name in ("blocks", "terms", "sizes", "gram_counts")}
        return inverted.Index(raw["blocks"], raw["terms"], raw["sizes"], self.log.table("grams", snapshot), raw["gram_counts"], partial(self.log.visible, snapshot=snapshot))

    # -- lifecycle ---------------------------------------------------------------

    def _vectors(self, chunks: DataFrame, base: Snapshot, folder: str) -> tuple[DataFrame, dict]:
        """Vectors of the chunks, those of known texts taken over, and the store's properties
        with the pivots of the vector index, which the first vectors settle."""
        dimension = base.properties.get("dimension") or len(embedder.embed_query("", self.load_model))
        wanted = chunks.select("chunk_id", "doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("content"))
        known = self.log.table("vectors", base, raw=True).select("content", "embedding")
        once = wanted.select("content").distinct()
        kept = known.join(once, "content", "left_semi").groupBy("content").agg(F.min("embedding").alias("embedding"))
        unseen = wanted.join(kept, "content", "left_anti").groupBy("content").agg(F.min("text").alias("text"))
        new = semantic.checked(embedder.embed(unseen.repartition("content"), self.load_model), dimension).select("content", "embedding")
        every = self._staged(wanted.drop("text").join(kept.unionByName(new), "content"), folder, "vectors")
        pivots = base.properties.get("pivots") or semantic.pick_pivots(every)
        return semantic.clustered(every, pivots), {"dimension": dimension, "pivots": pivots}

    def _counts(self, chunks: DataFrame, sign: int) -> dict[str, DataFrame]:
        """What chunks add to the summed tables, or take away."""
        words = inverted.term_counts(keyword.postings(chunks), sign)
        return {"terms": words, "sizes": inverted.size_counts(chunks, sign), "gram_counts": literal.gram_counts(literal.gram_rows(chunks)).withColumn("n", F.col("n") * sign)}

    def _change(self, gone: DataFrame, documents: DataFrame | None = None, chunks: DataFrame | None = None, base: Snapshot | None = None) -> None:
        """Commit: the documents `gone` (doc_id) go, with all that follows from them, the new
        ones come."""
        base, folder = base or self.log.snapshot(), uuid.uuid4().hex
        try:
            old = self._staged(literal.only(self.table("chunks", base), "doc_id", gone), folder, "old")
            new, properties = {}, {}
            counts = [self._counts(old, -1)]
            if chunks is not None:
                postings = self._staged(keyword.postings(chunks, keep=["doc_id"]), folder, "postings")
                vectors, properties = self._vectors(chunks, base, folder)
                new = {"documents": documents, "chunks": chunks, "registers": hybrid.explode_registers(chunks), "vectors": vectors, "blocks": inverted.block_rows(postings), "grams": literal.gram_rows(chunks, keep=["doc_id"])}
                counts.append(self._counts(chunks, 1))
            for name in counts[0]:
                spec = TABLES[name]
                keys = [c for c in spec.columns if c not in spec.summed]
                rows = counts[0][name] if len(counts) == 1 else counts[0][name].unionByName(counts[1][name])
                new[name] = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in spec.summed]).filter(" OR ".join(f"{c} <> 0" for c in spec.summed))
            done = self.log.commit(new, gone, base, properties)
        finally:
            self._unstage(folder)
        if self.log.due(done):
            self.log.compact()

    def ingest_sections(self, documents: DataFrame, sections: DataFrame, tables: DataFrame | None = None) -> None:
        """documents: (doc_id, filename, title, version); sections: flattened trees with
        doc_title. All that these documents had brought before is replaced."""
        base, folder = self.log.snapshot(), uuid.uuid4().hex
        options = {"target": self.config.chunking.target_size, "overlap": self.config.chunking.overlap}
        try:
            made = self._staged(C.chunk_documents(sections, tables, **options), folder, "chunks")
            stamped = self._staged(documents.dropDuplicates(["doc_id"]).select("doc_id", "filename", "title", "version", F.current_timestamp().alias("index_date")), folder, "documents")
            self._change(stamped.select("doc_id"), stamped, made, base)
        finally:
            self._unstage(folder)

    def ingest_files(self, paths: list[str], parser: files.Parser = pdf_parser, pattern: str = "*.pdf", title: str | None = None, version: str | None = None, with_tables: bool = True) -> DataFrame:
        """Parse files, each once, and ingest them: outline sections where there is an
        outline, heading sections elsewhere, register tables of all pages. 'Table N.'
        sections carry the header of a table on their first two pages. A document is known by
        its file's name: of files of one name in different folders the one of the last path is
        ingested. Returns the report: filename, doc_id, pages, sections, tables and chunks of
        each file, and `hidden`, how many others of its name were left out."""
        files.check_paths(self.spark, paths, pattern)
        folder = uuid.uuid4().hex
        try:
            raw = files.binary_documents(self.spark, paths, pattern)
            last = self._staged(files.last_paths(raw), folder, "paths")
            parsed = self._staged(files.parse_all(raw.join(last.select("path"), "path", "left_semi"), parser), folder, "parsed")
            return self._ingest_parsed(parsed, last, folder, title, version, with_tables)
        finally:
            self._unstage(folder)

    def _ingest_parsed(self, parsed: DataFrame, last_path: DataFrame, folder: str, title: str | None, version: str | None, with_tables: bool) -> DataFrame:
        pages = files.parsed_rows(parsed, "pages")
        texts = pages.select("doc_id", "page_num", "raw_text")
        last = texts.groupBy("doc_id").agg(F.max("page_num").alias("last_page"))
        toc = files.parsed_rows(parsed, "toc").join(last, "doc_id")
        titled = S.section_text(S.outline_bounds(toc), texts)
        outline = titled.select("doc_id", F.col("toc_idx").alias("section_id"), "title", "level", "start_page", "end_page", S.trim_to_title("content", "title", "next_title").alias("content"))
        blocks = pages.select("doc_id", "page_num", F.posexplode("blocks").alias("block_idx", "b")).select("doc_id", "page_num", "block_idx", "b.text", "b.font_size", F.col("b.bbox.y0").alias("y0"), F.col("b.bbox.y1").alias("y1"))
        headed = S.heading_sections(blocks.join(toc.select("doc_id").distinct(), "doc_id", "left_anti"), texts.join(toc.select("doc_id").distinct(), "doc_id", "left_anti"))
        names = ["doc_id", "section_id", "title", "level", "start_page", "end_page", "content"]
        flat = self._staged(outline.select(*names).unionByName(headed.select(*names)), folder, "flat")
        tree = self._staged(S.outline_tree(flat), folder, "sections")
        shown = F.lit(title) if title else F.col("filename")
        documents = parsed.select("doc_id", "filename", shown.alias("title"), F.lit(version).cast("string").alias("version"))
        found = files.parsed_rows(parsed, "tables") if with_tables else files.parsed_rows(parsed, "tables").limit(0)
        tree = S.table_headers(tree, found)
        kept = files.classify_tables(found)
        near = S.table_context(kept.select("doc_id", "page_num", "table_index", F.col("bbox.y0").alias("y0")), blocks)
        tables = kept.join(near, ["doc_id", "page_num", "table_index"], "left").select("doc_id", extract_table("table_type", "grid", F.coalesce("context", F.lit(""))).alias("table"), F.col("page_num").alias("page")).join(documents.select("doc_id", F.col("title").alias("doc_title")), "doc_id")
        counts = [F.coalesce(F.size(c), F.lit(0)).cast("long").alias(c) for c in ("pages", "tables")]
        sections = tree.groupBy("doc_id").agg(F.count("*").alias("sections"))
        report = parsed.select("filename", "doc_id", *counts).join(last_path, "doc_id").join(sections, "doc_id", "left").select("filename", "doc_id", "pages", F.coalesce("sections", F.lit(0)).alias("sections"), "tables", "hidden").collect()  # a row per file of the call
        self.ingest_sections(documents, tree.join(documents.select("doc_id", F.col("title").alias("doc_title")), "doc_id"), tables)
        told = self.spark.createDataFrame(report, f"{REPORT}, hidden long")
        return told.join(self.stats().select("doc_id", F.col("n_chunks").alias("chunks")), "doc_id", "left").select("filename", "doc_id", "pages", "sections", "tables", F.coalesce("chunks", F.lit(0)).alias("chunks"), "hidden")

    def remove(self, doc_id: str) -> bool:
        """False if the document is not there."""
        base = self.log.snapshot()
        if self.table("documents", base).filter(F.col("doc_id") == doc_id).isEmpty():
            return False
        self._change(self.spark.createDataFrame([(doc_id,)], "doc_id string"), base=base)
        return True

    def rebuild(self) -> None:
        """All that follows from the chunks anew, in one segment; texts keep their vectors."""
        base, folder = self.log.snapshot(), uuid.uuid4().hex
        try:
            documents, chunks = (self._staged(self.table(name, base), folder, name) for name in ("documents", "chunks"))
            self._change(documents.select("doc_id"), documents, chunks, base)
        finally:
            self._unstage(folder)
        self.log.compact(self.log.snapshot().segments)

    def size(self) -> int:
        """Number of vectors."""
        return self.table("vectors").count()

    # -- queries -----------------------------------------------------------------

    def registers(self) -> DataFrame:
        return self.table("registers")

    def search(self, query: str, top_k: int | None = None, doc_filter: str | None = None) -> DataFrame:
        options, now = self.config.search, self.log.snapshot()
        vector = embedder.embed_query(query, self.load_model)
        chunks, vectors = self.table("chunks", now), self.table("vectors", now)
        return hybrid.hybrid_search_stored(chunks, vectors, self.index(now), now.properties.get("pivots", []), query, vector, top_k or options.top_k, doc_filter or None, options.keyword_weight, options.semantic_weight)

    def search_markdown(self, query: str, top_k: int | None = None, doc_filter: str | None = None) -> str:
        return render.format_results(self.search(query, top_k, doc_filter), top_k or self.config.search.top_k)

    def find_register(self, name: str, peripheral: str | None = None) -> DataFrame:
        """The best chunk of a register, off the registers table: sorted by name, with a Bloom
        filter per file, so only files that may hold the name are read."""
        now = self.log.snapshot()
        hit = hybrid.find_register(self.table("registers", now), name, peripheral).select("chunk_id", F.lit(1.0).alias("score"))
        return hybrid.hydrated(self.table("chunks", now), hit)

    def get_chunk(self, chunk_id: str) -> DataFrame:
        return self.table("chunks").filter(F.col("chunk_id") == chunk_id)

    def terms(self, prefix: str = "") -> DataFrame:
        """(term, df, tf) of the live chunks, those that begin with `prefix`."""
        return inverted.prefix_terms(self.index(self.log.snapshot()), prefix)

    def list_documents(self) -> DataFrame:
        return self.table("documents").orderBy(F.desc("index_date"), "doc_id")

    def list_files(self, paths: list[str] | None = None, pattern: str = "*.pdf") -> DataFrame:
        """Files with their status, as listing lines."""
        found = files.list_files(self.spark, list(paths or self.config.doc_dirs), pattern)
        return render.listing(catalog_ops.status(found, self.table("documents")))

    def list_markdown(self, paths: list[str] | None = None, pattern: str = "*.pdf") -> str:
        """The listing with its counts."""
        dirs = list(paths or self.config.doc_dirs)
        return render.listing_text(self.list_files(dirs, pattern), dirs)

    def stats(self) -> DataFrame:
        return catalog_ops.document_stats(self.table("chunks"))
