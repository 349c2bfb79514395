"""Inputs of the registered queries, made from the driver's tables by SQL that Spark and
DuckDB both run."""

from __future__ import annotations

#: Register prose per part: title, section text, caption, contents lines.
TITLE = "concat(p_name, ' control register (', upper(substr(p_type, 1, 4)), '_R', p_partkey % 97, ')')"
CONTENT = """concat('Address offset:  0x0', p_size % 10, ' or 0x1', p_size % 10, chr(10), 'Reset value: 0x0000  00', 10 + p_partkey % 80, chr(10),
'Bits 31:', 8 + p_partkey % 8, ' Reserved, must be kept at reset value.', chr(10),
'  Bits 7:', p_partkey % 7, ' F', p_partkey % 11, '[5:0]: ', p_name, ' mode', chr(10), 'applies to ', p_brand, chr(10),
'Bit 0 EN', p_size % 5, ': enable')"""
CAPTION = """CASE p_partkey % 5
WHEN 0 THEN concat('Table ', p_size, '. Ctl', p_size % 9, ' register bit assignments')
WHEN 1 THEN concat('7.1.', p_size, '  Function Control Address = 04-06h')
WHEN 2 THEN concat('the ', upper(substr(p_type, 1, 3)), '_X register of ', p_name)
WHEN 3 THEN '' ELSE concat('plain ', p_name) END"""
HEADER = """CASE p_partkey % 6
WHEN 0 THEN 'Address Offset Register Reset' WHEN 1 THEN 'Bits Field Type, Function' WHEN 2 THEN 'Peripheral Base Size'
WHEN 3 THEN 'Name Value' WHEN 4 THEN 'Bit Name Description (R/W)' ELSE concat('Base ', p_name) END"""
LEADERS = """concat('[Doc > Contents]', chr(10), '1 ', p_name, CASE WHEN p_partkey % 2 = 0 THEN ' . . . . 4' ELSE '' END, chr(10),
'2 ', p_type, CASE WHEN p_partkey % 3 = 0 THEN ' ....... 9' ELSE '' END, chr(10), chr(10), '3 ', p_brand, chr(10), '4 last', CASE WHEN p_partkey % 5 = 0 THEN ' . . .' ELSE '' END)"""

#: DuckDB: folded tokens of documents.
TOKENS = r"""tok AS (SELECT doc_id, source, list_filter(regexp_split_to_array(strip_accents(lower(coalesce(text, ''))), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS ws FROM documents)"""


def bm25_sql(counts: list[str], filters: str = "true") -> str:
    """DuckDB: (chunk_id, score) where every count expression over `ws` is positive."""
    fs = ", ".join(f"{c} AS f{i}" for i, c in enumerate(counts))
    ns = ", ".join(f"sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END) AS n{i}" for i in range(len(counts)))
    idf = "CASE WHEN ln((n_all - n{0} + 0.5) / (n{0} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_all - n{0} + 0.5) / (n{0} + 0.5)) END * f{0} * 2.2 / (f{0} + 1.2 * (0.25 + 0.75 * dl / avgdl))"
    score = " + ".join(idf.format(i) for i in range(len(counts)))
    every = " AND ".join(f"f{i} > 0" for i in range(len(counts)))
    return f"""{TOKENS},
cnt AS (SELECT doc_id, source, len(ws) AS dl, {fs} FROM tok),
st AS (SELECT count(*) AS n_all, avg(dl) AS avgdl, {ns} FROM cnt),
bm AS (SELECT doc_id AS chunk_id, {score} AS score FROM cnt, st WHERE {every} AND {filters})"""


def term(word: str) -> str:
    return f"len(list_filter(ws, lambda t: t = '{word}'))"
