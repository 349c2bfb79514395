"""Schemas of the data model, as DDL. Trees are flattened: sections name their parent."""

from __future__ import annotations

from docquarry.functions.registers import FIELD, REGISTER, TABLE
from docquarry.operators.chunks import CHUNK_SCHEMA

BOX = "struct<x0 double, y0 double, x1 double, y1 double>"
BLOCK = f"struct<text string, bbox {BOX}, font_size double, font_name string, page_num int>"
PAGES = f"doc_id string, page_num int, width double, height double, blocks array<{BLOCK}>, raw_text string"
TOC = "doc_id string, toc_idx int, level int, title string, page_num int"
SECTIONS = "doc_id string, section_id int, parent_id int, title string, level int, start_page int, end_page int, content string"
TABLE_TYPES = ("register_map", "bitfield_definition", "memory_map", "other")
TABLE_REGIONS = f"doc_id string, page_num int, table_index int, bbox {BOX}, table_type string, header_keywords array<string>, grid array<array<string>>"
BIT_FIELD, REGISTER_ROW, REGISTER_TABLE = FIELD, REGISTER, TABLE
DOCUMENTS = "doc_id string, filename string, title string, version string, index_date timestamp"
CHUNKS = CHUNK_SCHEMA
REGISTERS = "chunk_id string, doc_id string, chunk_type string, peripheral string, name string, address string, offset string"
VECTORS = "chunk_id string, doc_id string, content string, cluster int, radius double, embedding array<float>"
GRAMS = "gram string, chunk_id string, doc_id string"
RESULTS = f"chunk_id string, score double, text string, structured_data {TABLE}, section_title string, doc_id string, page_start int, page_end int"
