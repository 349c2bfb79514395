"""The queries of the training-data operators: thin, over the whole table each is
meant for, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import byte_cnn, dual_tree_kmeans, fingerprints, gif_store, html_extract, language_id, line_dedup, mixing, ngram_join, sentencepiece_codec, source_divergence, substring_dedup, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2("line_dedup.kept", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_of(docs: DataFrame) -> DataFrame:
    return gif_store.media_columns(docs).withColumn("feature", gif_store.frames_text(F.col("frames"))).drop("frames")


def op3_gif_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_of(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.realise(mixing.plan_mix(table(spark, sf_dir, "documents")))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digests(table(spark, sf_dir, "documents"), sentencepiece_codec.load_model())


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


def op12_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_cnn.score(docs, byte_cnn.fit(docs, table(spark, sf_dir, "labels")))


def op13_dual_tree_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree_kmeans.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_gif_columns": op3_gif_columns,
    "op4_fingerprints": op4_fingerprints,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_ngram_join": op6_ngram_join,
    "op7_mixing": op7_mixing,
    "op8_html_extraction": op8_html_extraction,
    "op9_language_id": op9_language_id,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_source_divergence": op11_source_divergence,
    "op12_byte_cnn": op12_byte_cnn,
    "op13_dual_tree_kmeans": op13_dual_tree_kmeans,
}


def lloyd_sql(k: int, rounds: int, dim: int) -> str:
    """DuckDB: the plain rounds, every vector against every centroid."""
    parts = [
        f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dim}),
c0 AS (SELECT (row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), x) - 1)::INT AS cluster, x AS c FROM v QUALIFY cluster < {k})"""
    ]
    for r in range(rounds + 1):
        parts.append(f"""d{r} AS (SELECT vec, vec_id, x, cluster, list_sum(list_transform(range(1, {dim + 1}), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS distance
  FROM (SELECT *, row_number() OVER () AS vec FROM v) CROSS JOIN c{r})""")
        parts.append(f"a{r} AS (SELECT vec_id, x, cluster, distance FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec ORDER BY distance, cluster) = 1)")
        if r < rounds:
            parts.append(f"""m{r} AS (SELECT cluster, list(m ORDER BY i) AS c FROM (
  SELECT cluster, i, floor(sum(x[i])::HUGEINT / count(*))::BIGINT AS m FROM a{r}, range(1, {dim + 1}) t(i) GROUP BY cluster, i) GROUP BY cluster),
c{r + 1} AS (SELECT c{r}.cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON m{r}.cluster = c{r}.cluster)""")
    last = f"""SELECT a.vec_id, a.cluster, a.distance, sum(a.distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia, sum(a.distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster"""
    return ",\n".join(parts) + "\n" + last


#: DuckDB SQL for those that SQL can express.
ORACLES = {
    "op1_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
hot AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.doc_id, k.pos, k.line, h.key IS NOT NULL AND k.doc_id < h.last AS gone FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op5_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, pos, ws[pos] AS word, CASE WHEN pos + 12 <= len(ws) THEN array_to_string(ws[pos:pos + 12], ' ') END AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM d)),
f AS (SELECT win, min(doc_id) AS first FROM s WHERE win IS NOT NULL GROUP BY win),
c AS (
  SELECT s.doc_id, s.pos, s.word,
         max(CASE WHEN f.first < s.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY s.doc_id ORDER BY s.pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
  FROM s LEFT JOIN f ON s.win = f.win),
k AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op6_ngram_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[pos:pos + 4], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS pos FROM d WHERE len(ws) > 0)),
sets AS (SELECT doc_id, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS node, count(*) AS n FROM g GROUP BY doc_id),
nodes AS (SELECT node, min(doc_id) AS rep, count(*) AS copies, any_value(n) AS n FROM sets GROUP BY node),
r AS (SELECT nodes.rep, nodes.n, g.shingle FROM nodes JOIN g ON g.doc_id = nodes.rep),
shared AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS common FROM r a JOIN r b ON a.shingle = b.shingle AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n),
links AS (SELECT a, b FROM shared WHERE common * 5 >= 4 * (na + nb - common)),
reach AS (SELECT rep AS a, rep AS b FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
class AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT d.doc_id, coalesce(class.class_id, d.doc_id) AS class_id, coalesce(degree.n_links, 0)::BIGINT AS n_links, coalesce(nodes.copies, 1)::BIGINT AS n_copies
FROM d LEFT JOIN sets ON sets.doc_id = d.doc_id LEFT JOIN nodes ON nodes.node = sets.node
LEFT JOIN class ON class.a = nodes.rep LEFT JOIN degree ON degree.a = nodes.rep""",
    "op11_source_divergence": r"""
WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc FROM documents),
w AS (SELECT lang, source, doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT x.lang, x.source, coalesce(v.v, 0) AS v, coalesce(t.n, 0) AS n
      FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN v ON v.lang = x.lang
      LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) t ON t.lang = x.lang AND t.source = x.source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v))::BIGINT AS p
      FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
lt AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
q AS (SELECT lt.lang, lt.term, (1 + (1000000000::HUGEINT * (lt.n + 2)) // (s.n + 2 * s.v))::BIGINT AS q
      FROM lt JOIN (SELECT lang, sum(n) AS n, any_value(v) AS v FROM g GROUP BY lang) s ON s.lang = lt.lang),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
found AS (
  SELECT every.lang, every.source, 'pair' AS part, every.item, coalesce(pairs.value, 0)::BIGINT AS value FROM every LEFT JOIN pairs USING (lang, source, item)
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, ((p.p - q.q) * (p.p - q.q) // (p.p + q.q))::BIGINT FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM found)
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10""",
    "op13_dual_tree_kmeans": lloyd_sql(40, 5, 64),
}
