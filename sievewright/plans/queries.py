"""Registered queries of the engine's operators over the test tables, with their SQL.

``documents`` stand for chunks, ``benchmark`` items for a batch of queries,
``embeddings`` for the vector index, and ``lineitem`` (supplier, part, discount)
for relationships with a confidence.  Terms are not stemmed here, as the SQL has
no stemmer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.config import EntityRetrieval, Weights
from sievewright.functions import text as tx
from sievewright.functions.vectors import cosine, dot, l2_normalized
from sievewright.operators import evaluation, fusion, graph, lexical
from sievewright.operators.vector_index import VectorIndex
from sievewright.sources import ingest
from sievewright.sources.storage import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.plain_chunks(table(spark, sf_dir, "documents"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def lexical_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Chunks, postings, term statistics, corpus statistics, query terms."""
    rows = chunks(spark, sf_dir)
    post = cut(lexical.postings(rows, stem=False))
    terms = cut(lexical.query_terms(questions(spark, sf_dir), stem=False))
    return rows, post, lexical.term_stats(post, terms), lexical.corpus_stats(rows, post), terms


_STOP = ", ".join(f"'{w}'" for w in sorted(tx.STOPWORDS))


def _terms_sql(source: str, key: str, text: str) -> str:
    """Rows ``key, term``: words, compounds whole and in parts, without stop words and single letters."""
    return f"""
    SELECT {key}, unnest(regexp_extract_all(lower(replace({text}, '’', '''')), '{tx.WORD.replace("A-Z", "")}')) AS word FROM {source}"""


_TERMS = """
{name}_words AS ({words}),
{name}_parts AS (SELECT {key}, unnest(regexp_split_to_array(word, '[-_./]')) AS term FROM {name}_words),
{name} AS (
  SELECT {key}, term FROM {name}_parts WHERE term <> '' AND term NOT IN (""" + _STOP + """) AND (length(term) > 1 OR regexp_matches(term, '^[0-9]$'))
  UNION ALL SELECT {key}, word FROM {name}_words WHERE regexp_matches(word, '[-_./]'))"""

_INDEX = (
    "WITH "
    + _TERMS.format(name="terms", key="doc_id", words=_terms_sql("documents", "doc_id", "text"))
    + ","
    + _TERMS.format(name="asked", key="item_id", words=_terms_sql("benchmark", "item_id", "text"))
    + """,
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
post AS (SELECT doc_id, term, tf, sum(tf) OVER (PARTITION BY doc_id) AS dl FROM tf),
stats AS (SELECT term, count(*) AS df FROM post GROUP BY term),
corpus AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(tf) FROM post) / (SELECT count(*) FROM documents)::DOUBLE AS avgdl),
qterms AS (SELECT DISTINCT item_id, term FROM asked),
weighed AS (
  SELECT item_id, q.term, coalesce(df, 0) AS df, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf, avgdl
  FROM qterms q LEFT JOIN stats s ON q.term = s.term CROSS JOIN corpus),
bm25 AS (
  SELECT item_id, doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM post p JOIN weighed w ON p.term = w.term GROUP BY item_id, doc_id),
lex AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm25)"""
)


def ranked_stably(scores: DataFrame, k: int) -> DataFrame:
    """Top lists by scores rounded to nine places, so that sums in another order rank alike."""
    return lexical.top_k(scores.withColumn("by", F.round("score", 9)), k, by="by").drop("by")


# Lexical


@query(_INDEX + " SELECT term, df, (SELECT sum(tf) FROM post p WHERE p.term = s.term)::BIGINT AS cf FROM stats s")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_stats(lexical.postings(chunks(spark, sf_dir), stem=False))


@query(_INDEX + " SELECT n AS n_docs, round(avgdl, 6) AS avgdl FROM corpus")
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    return lexical.corpus_stats(rows, lexical.postings(rows, stem=False)).withColumn("avgdl", F.round("avgdl", 6))


@query(_INDEX + " SELECT item_id AS query_id, term, df, round(idf, 6) AS idf FROM weighed")
def query_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, stats, corpus, terms = lexical_index(spark, sf_dir)
    rows = lexical.document_frequencies(terms, stats).crossJoin(F.broadcast(corpus))
    return rows.select("query_id", "term", "df", F.round(lexical.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


@query(_INDEX + " SELECT item_id AS query_id, q.term FROM qterms q WHERE NOT EXISTS (SELECT 1 FROM stats s WHERE s.term = q.term)")
def unknown_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, stats, _, terms = lexical_index(spark, sf_dir)
    return lexical.unknown_terms(terms, stats)


@query(_INDEX + " SELECT item_id AS query_id, doc_id AS chunk_id, round(score, 5) AS score, rank FROM lex WHERE rank <= 30")
def bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, post, stats, corpus, terms = lexical_index(spark, sf_dir)
    return ranked_stably(lexical.bm25_scores(terms, post, stats, corpus), 30).withColumn("score", F.round("score", 5))


@query(_INDEX + """, c AS (SELECT item_id, doc_id FROM lex WHERE rank <= 3)
SELECT c.item_id AS query_id, c.doc_id AS chunk_id,
  round(coalesce((SELECT sum(idf) FROM weighed w JOIN post p ON p.term = w.term WHERE w.item_id = c.item_id AND p.doc_id = c.doc_id), 0)
    / (SELECT sum(idf) FROM weighed w WHERE w.item_id = c.item_id), 5) AS coverage FROM c""")
def term_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, post, stats, corpus, terms = lexical_index(spark, sf_dir)
    near = ranked_stably(lexical.bm25_scores(terms, post, stats, corpus), 3)
    return lexical.coverage(near, terms, post, stats, corpus).withColumn("coverage", F.round("coverage", 5))


@query(_INDEX + """, r AS (SELECT item_id, doc_id, sum(tf) * 0.1 AS score FROM post p JOIN qterms q ON p.term = q.term GROUP BY item_id, doc_id)
SELECT item_id AS query_id, doc_id AS chunk_id, round(score, 5) AS score, rank
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM r) WHERE rank <= 10""")
def ts_rank_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, post, _, _, terms = lexical_index(spark, sf_dir)
    return ranked_stably(lexical.ts_rank_scores(terms, post), 10).withColumn("score", F.round("score", 5))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]'))::INT AS tokens FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.token_count(F.col("text")).alias("tokens"))


# Vectors

_VECTORS = """
WITH scores AS (
  SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score
  FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 100 = 0),
vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scores)"""


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries (every row whose id is divisible by 100) and all rows of the vector index."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    return rows.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding", "label"), rows


@query(_VECTORS + " SELECT query_id, chunk_id, round(score, 5) AS score, rank FROM vec WHERE rank <= 30")
def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, rows = vectors(spark, sf_dir)
    return fusion.vector_top_k(asked, rows, 30).withColumn("score", F.round("score", 5))


@query()
def vector_index_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approximate index over all vectors; its recall is tested against ``vector_top_k``."""
    asked, rows = vectors(spark, sf_dir)
    return VectorIndex.build(rows, 16).top_k(asked, 10, probes=8).withColumn("score", F.round("score", 5))


@query("""SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS size, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) / list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS self
FROM embeddings""")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    unit = l2_normalized(F.col("embedding"))
    return rows.select("vec_id", F.round(F.sqrt(dot(F.col("embedding"), F.col("embedding"))), 5).alias("size"), F.round(cosine(unit, unit), 5).alias("self"))


# Fusion

_FUSED = _VECTORS + """,
lexical AS (  -- a second signal: the product of the first eight coordinates
  SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_dot_product(q.embedding[1:8]::DOUBLE[], v.embedding[1:8]::DOUBLE[]) AS score
  FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 100 = 0),
lexr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM lexical),
cand AS (SELECT query_id, chunk_id FROM vec WHERE rank <= 30 UNION SELECT query_id, chunk_id FROM lexr WHERE rank <= 30),
filled AS (
  SELECT c.query_id, c.chunk_id, v.score AS vector_raw, l.score AS lexical_raw,
    list_sort([x FOR x IN [CASE WHEN l.rank <= 30 THEN 'lexical' END, CASE WHEN v.rank <= 30 THEN 'vector' END] IF x IS NOT NULL]) AS sources
  FROM cand c JOIN vec v USING (query_id, chunk_id) JOIN lexr l USING (query_id, chunk_id))"""


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of two signals, whole vectors and their first eight coordinates, with both raw scores."""
    asked, rows = vectors(spark, sf_dir)
    short = lambda df: df.withColumn("embedding", F.slice("embedding", 1, 8))
    hits = {"lexical": fusion.vector_top_k(short(asked), short(rows), 30), "vector": fusion.vector_top_k(asked, rows, 30)}
    candidates = cut(fusion.union_candidates(hits))
    fills = {"lexical": fusion.vector_scores(short(asked), short(rows), candidates), "vector": fusion.vector_scores(asked, rows, candidates)}
    return fusion.backfilled(candidates, fills)


@query(_FUSED + """,
scored AS (
  SELECT *, (vector_raw - min(vector_raw) OVER w) / (max(vector_raw) OVER w - min(vector_raw) OVER w) AS vs,
    (lexical_raw - min(lexical_raw) OVER w) / (max(lexical_raw) OVER w - min(lexical_raw) OVER w) AS ls FROM filled WINDOW w AS (PARTITION BY query_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(0.5 * vs + 0.5 * ls, 9) DESC, chunk_id) AS rank FROM scored)
SELECT query_id, chunk_id, rank, round(0.5 * vs + 0.5 * ls, 5) AS final_score, array_to_string(sources, ',') AS retrieved_by FROM ranked WHERE rank <= 10""")
def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signals(spark, sf_dir)
    for signal in ("vector", "lexical"):
        rows = rows.withColumn(f"{signal}_score", fusion.normalized(F.col(f"{signal}_raw"), "minmax"))
    fused = fusion.weighted_fusion(rows, Weights(0.5, 0.5)).withColumn("by", F.round("final_score", 9))
    return fusion.ranked(fused, 10, by="by").select("query_id", "chunk_id", "rank", F.round("final_score", 5).alias("final_score"), F.array_join("sources", ",").alias("retrieved_by"))


@query(_FUSED + """,
places AS (
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY vector_raw DESC, chunk_id) AS vr,
    row_number() OVER (PARTITION BY query_id ORDER BY lexical_raw DESC, chunk_id) AS lr FROM filled),
fused AS (SELECT *, 0.5 / (60 + vr) + 0.5 / (60 + lr) AS final_score FROM places),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 12) DESC, chunk_id) AS rank FROM fused)
SELECT query_id, chunk_id, rank, round(final_score, 8) AS final_score FROM ranked WHERE rank <= 10""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.rrf_fusion(_signals(spark, sf_dir), Weights(0.5, 0.5)).withColumn("by", F.round("final_score", 12))
    return fusion.ranked(fused, 10, by="by").select("query_id", "chunk_id", "rank", F.round("final_score", 8).alias("final_score"))


@query("""SELECT c_custkey AS chunk_id, c_nationkey AS query_id, round(CASE WHEN max(c_acctbal) OVER w <= 1e-12 THEN 0 ELSE greatest(0, c_acctbal / max(c_acctbal) OVER w) END, 6) AS scaled,
  round(least(1, greatest(0, c_acctbal / 10000)), 6) AS clipped FROM customer WINDOW w AS (PARTITION BY c_nationkey)""")
def other_normalizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chunk_id"), F.col("c_nationkey").alias("query_id"), "c_acctbal")
    return rows.select("chunk_id", "query_id", F.round(fusion.normalized(F.col("c_acctbal"), "max"), 6).alias("scaled"), F.round(fusion.normalized(F.col("c_acctbal") / 10000, "none"), 6).alias("clipped"))


# Graph


def supply(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers and parts as entities, line items as relationships whose confidence is the discount."""
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id"), F.col("s_name").alias("canonical_name"), F.lit("ORGANIZATION").alias("entity_type"))
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("entity_id"), F.col("p_name").alias("canonical_name"), F.lit("PROJECT").alias("entity_type"))
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("source_entity_id"), F.concat(F.lit("p"), "l_partkey").alias("target_entity_id"), F.col("l_discount").alias("confidence"),
        F.concat(F.lit("r"), "l_returnflag").alias("relationship_type"), F.col("l_orderkey").cast("string").alias("supporting_chunk_id"),
    )
    return suppliers.unionByName(parts), rows


_EDGES = """
WITH rel AS (SELECT 's' || l_suppkey AS s, 'p' || l_partkey AS p, l_discount AS c, 'r' || l_returnflag AS t, l_orderkey AS o FROM lineitem
  WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) AND l_partkey IN (SELECT p_partkey FROM part)),
both_ways AS (SELECT s AS src, p AS dst, c, t, o FROM rel UNION ALL SELECT p, s, c, t, o FROM rel),
edges AS (SELECT src, dst, least(0.95, 1 - product(1 - c)) AS weight, array_to_string(list_sort(list(DISTINCT t)), ',') AS relation_types, count(DISTINCT o) AS n_chunks FROM both_ways GROUP BY src, dst)"""


@query(_EDGES + " SELECT src, dst, round(weight, 6) AS weight, relation_types, n_chunks FROM edges")
def noisy_or_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, rows = supply(spark, sf_dir)
    return graph.edges(rows, entities).select("src", "dst", F.round("weight", 6).alias("weight"), F.array_join("relation_types", ",").alias("relation_types"), "n_chunks")


@query(_EDGES + """,
direct AS (SELECT c_custkey AS query_id, 's' || (c_custkey % (SELECT count(*) FROM supplier) + 1) AS e, 1.0 AS w FROM customer),
hop AS (
  SELECT query_id, dst, e AS via, w * weight * 0.6 AS weight FROM direct JOIN edges ON src = e),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(weight, 9) DESC, dst) AS nth FROM hop WHERE weight > 0)
SELECT query_id, dst AS entity_id, round(weight, 6) AS weight, via FROM ranked WHERE nth <= 15""")
def graph_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, rows = supply(spark, sf_dir)
    n = table(spark, sf_dir, "supplier").count()
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.lit("").alias("query"))
    links = asked.select("query_id", F.concat(F.lit("s"), F.col("query_id") % n + 1).alias("entity_id"), F.lit(1.0).alias("confidence"))
    edge_table = graph.edges(rows, entities).withColumn("weight", F.round("weight", 12))
    plan = graph.plan(asked, links, edge_table, entities, EntityRetrieval())
    return plan.where("kind = 'expanded'").select("query_id", "entity_id", F.round("weight", 6).alias("weight"), "via")


@query(_EDGES + """,
direct AS (SELECT s_suppkey AS query_id, 's' || s_suppkey AS ent FROM supplier),
hop AS (SELECT query_id, dst AS ent, weight * 0.6 AS w FROM direct JOIN edges ON src = ent),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(w, 9) DESC, ent) AS nth FROM hop WHERE w > 0),
plan AS (SELECT query_id, ent, 1.0 AS d, 0.0 AS x FROM direct UNION ALL SELECT query_id, ent, 0.0, w FROM ranked WHERE nth <= 15),
held AS (SELECT l_orderkey AS chunk_id, 's' || l_suppkey AS ent FROM lineitem UNION SELECT l_orderkey, 'p' || l_partkey FROM lineitem)
SELECT query_id, chunk_id, round(1 - (1 - least(1, sum(d))) * (1 - max(x)), 6) AS score, count(*) AS matched FROM plan JOIN held USING (ent) GROUP BY query_id, chunk_id""")
def entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier as a query; orders as chunks that hold their suppliers and parts."""
    entities, rows = supply(spark, sf_dir)
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.lit("").alias("query"))
    links = asked.select("query_id", F.concat(F.lit("s"), "query_id").alias("entity_id"), F.lit(1.0).alias("confidence"))
    edge_table = graph.edges(rows, entities).withColumn("weight", F.round("weight", 12))
    plan = cut(graph.plan(asked, links, edge_table, entities, EntityRetrieval()))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.concat(F.lit("s"), "l_suppkey").alias("s"), F.concat(F.lit("p"), "l_partkey").alias("p"))
    held = lines.select("chunk_id", F.explode(F.array("s", "p")).alias("entity_id")).distinct()
    out = graph.entity_scores(plan, held, entities)
    return out.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.size("matched_entities").cast("long").alias("matched"))


@query("""
WITH e AS (SELECT DISTINCT 2 * l_suppkey AS a, 2 * l_partkey + 1 AS b FROM lineitem WHERE l_discount = 0.1 AND l_tax = 0.08 AND l_quantity > 45),
n AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (
  WITH RECURSIVE r(node, comp) AS (SELECT a, a FROM n UNION SELECT n.b, r.comp FROM r JOIN n ON n.a = r.node WHERE r.comp < n.b) SELECT * FROM r)
SELECT node, min(comp) AS comp FROM reach GROUP BY node""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_discount = 0.1 and l_tax = 0.08 and l_quantity > 45")
    return graph.connected_components(rows.select((2 * F.col("l_suppkey")).alias("a"), (2 * F.col("l_partkey") + 1).alias("b")))


@query("""
WITH e AS (SELECT DISTINCT 2 * l_suppkey AS a, 2 * l_partkey + 1 AS b FROM lineitem),
n AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
lowest AS (SELECT a FROM n GROUP BY a HAVING a < min(b)),
reach AS (
  WITH RECURSIVE r(node, comp) AS (SELECT a, a FROM lowest UNION SELECT n.b, r.comp FROM r JOIN n ON n.a = r.node WHERE r.comp < n.b) SELECT * FROM r)
SELECT node, min(comp) AS comp FROM reach GROUP BY node""")
def components_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``components``, over all rows: the whole table's large component and its hubs."""
    rows = table(spark, sf_dir, "lineitem")
    return graph.connected_components(rows.select((2 * F.col("l_suppkey")).alias("a"), (2 * F.col("l_partkey") + 1).alias("b")))


@query(_EDGES + """, best AS (SELECT src, dst, weight, row_number() OVER (PARTITION BY src ORDER BY round(weight, 9) DESC, dst) AS nth FROM edges)
SELECT src, dst, round(weight, 6) AS weight FROM best WHERE nth <= 12""")
def strongest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, rows = supply(spark, sf_dir)
    return graph.neighborhoods(graph.edges(rows, entities), 12).select("src", "dst", F.round("weight", 6).alias("weight"))


# Names


# Documents


@query("""SELECT doc_id, 'doc_' || substr(sha256(source || '.txt' || chr(0) || sha256(text)), 1, 16) AS document_id, sha256(text) AS content_hash, 'txt' AS source_type FROM documents""")
def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(".txt")).alias("filename"), F.sha2("text", 256).alias("content_hash"))
    return rows.select("doc_id", ingest.document_id(F.col("filename"), F.col("content_hash")).alias("document_id"), "content_hash", ingest.source_type(F.col("filename")).alias("source_type"))


@query("""
WITH d AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS hay FROM documents),
b AS (SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS needle FROM benchmark)
SELECT item_id AS query_id, doc_id AS chunk_id FROM d JOIN b ON contains(hay, needle)""".replace("\\\\", "\\"))
def evidence_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that hold an item's text; the items are a stated query set against all rows."""
    needles = questions(spark, sf_dir).select("query_id", tx.collapsed(F.col("query")).alias("needle"))
    hay = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), tx.collapsed(F.col("text")).alias("hay"))
    return evaluation.holding(hay, needles).select("query_id", "chunk_id")


@query("""
SELECT doc_id, CASE WHEN p > 81 THEN '…' ELSE '' END || replace(substr(text, greatest(p - 80, 1), p + 82 - greatest(p - 80, 1)), chr(10), ' ') || CASE WHEN length(text) > p + 81 THEN '…' ELSE '' END AS snippet
FROM (SELECT doc_id, text, strpos(text, '. ') AS p FROM documents) WHERE p > 0""")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.instr("text", ". ").alias("p")).where("p > 0")
    return rows.select("doc_id", graph.context(F.col("text"), F.col("p") - 1, F.col("p") + 1).alias("snippet"))


# Evaluation


@query(_VECTORS + """,
rel AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 100 = 0),
sizes AS (SELECT query_id, count(*) AS n_relevant FROM rel GROUP BY query_id),
marked AS (SELECT v.query_id, v.rank, r.chunk_id IS NOT NULL AS good FROM vec v LEFT JOIN rel r USING (query_id, chunk_id) WHERE rank <= 10),
per AS (SELECT query_id, min(rank) FILTER (good) AS first_rank, count(*) FILTER (good AND rank <= 1) AS n1, count(*) FILTER (good AND rank <= 5) AS n5,
  count(*) FILTER (good AND rank <= 10) AS n10, coalesce(sum(1 / log2(rank + 1)) FILTER (good), 0) AS dcg FROM marked GROUP BY query_id)
SELECT query_id, n_relevant, round(1.0 / first_rank, 6) AS rr, round(n5::DOUBLE / n_relevant, 6) AS recall_5, round(n10::DOUBLE / n_relevant, 6) AS recall_10,
  CASE WHEN n1 > 0 THEN 1.0 ELSE 0.0 END AS hit_1, round(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= n_relevant), 6) AS ndcg
FROM per JOIN sizes USING (query_id)""")
def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, rows = vectors(spark, sf_dir)
    relevant = asked.select("query_id", "label").join(rows.select("chunk_id", "label"), "label").select("query_id", "chunk_id")
    results = fusion.vector_top_k(asked, rows, 10)
    out = evaluation.rank_metrics(asked, results, relevant)
    return out.select("query_id", "n_relevant", *(F.round(c, 6).alias(c) for c in ("rr", "recall_5", "recall_10")), "hit_1", F.round("ndcg", 6).alias("ndcg"))


@query("""
SELECT event_type, count(*) FILTER (a AND NOT b) + count(*) FILTER (a AND b) AS abstentions, count(*) FILTER (a AND NOT b) AS correct_abstentions, count(*) FILTER (a AND b) AS false_abstentions, count(*) FILTER (NOT a AND NOT b) AS missed_abstentions,
  round(count(*) FILTER (a AND NOT b) / nullif(count(*) FILTER (a), 0), 4) AS abstention_precision, round(count(*) FILTER (a AND NOT b) / nullif(count(*) FILTER (NOT b), 0), 4) AS abstention_recall,
  round(2.0 * count(*) FILTER (a AND NOT b) / nullif(count(*) FILTER (a) + count(*) FILTER (NOT b), 0), 4) AS abstention_f1, round(count(*) FILTER (a AND b) / nullif(count(*) FILTER (b), 0), 4) AS false_abstention_rate
FROM (SELECT event_type, value < 50 AS a, user_id % 3 > 0 AS b FROM events) GROUP BY event_type""")
def abstention_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("value") < 50).alias("abstained"), (F.col("user_id") % 3 > 0).alias("answerable"))
    return evaluation.abstention(rows, ("event_type",))


@query("SELECT event_type, round(avg(value), 2) AS mean_ms, round(quantile_cont(value, 0.5), 2) AS p50_ms, round(quantile_cont(value, 0.95), 2) AS p95_ms FROM events GROUP BY event_type")
def latency_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.latency(table(spark, sf_dir, "events"), ("event_type",), "value")


@query("""
SELECT mode, category, split, CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(split) = 0 THEN 'split' ELSE 'mode' END AS level, count(*) AS queries, round(avg(rr), 4) AS rr, round(avg(hit), 4) AS hit
FROM (SELECT l_returnflag AS mode, l_linestatus AS category, CASE WHEN l_linenumber % 2 = 0 THEN 'dev' ELSE 'test' END AS split, 1.0 / l_linenumber AS rr, CASE WHEN l_linenumber <= 3 THEN 1.0 ELSE 0.0 END AS hit FROM lineitem)
GROUP BY GROUPING SETS ((mode), (mode, category), (mode, split))""")
def metric_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("mode"), F.col("l_linestatus").alias("category"), F.when(F.col("l_linenumber") % 2 == 0, "dev").otherwise("test").alias("split"),
        (1 / F.col("l_linenumber")).alias("rr"), F.when(F.col("l_linenumber") <= 3, 1.0).otherwise(0.0).alias("hit"),
    )
    return evaluation.rolled_up(rows, ("rr", "hit"))


@query("""
WITH rows AS (SELECT event_type AS mode, CASE WHEN user_id % 2 = 0 THEN 'dev' ELSE 'test' END AS split, round(value / 200, 6) AS confidence, user_id % 3 > 0 AS b FROM events),
grid AS (SELECT round(0.3 + 0.025 * i, 3) AS threshold FROM range(17) t(i)),
judged AS (SELECT mode, split, threshold, b, confidence < threshold AS a FROM rows CROSS JOIN grid)
SELECT mode, split, threshold, count(*) FILTER (a) AS abstentions, count(*) FILTER (a AND NOT b) AS correct_abstentions, round(count(*) FILTER (a AND b) / nullif(count(*) FILTER (b), 0), 4) AS false_abstention_rate FROM judged GROUP BY mode, split, threshold""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("mode"), F.when(F.col("user_id") % 2 == 0, "dev").otherwise("test").alias("split"), F.round(F.col("value") / 200, 6).alias("confidence"),
        F.lit(False).alias("gated"), (F.col("user_id") % 3 > 0).alias("answerable"),
    )
    return evaluation.threshold_sweep(rows).select("mode", "split", "threshold", "abstentions", "correct_abstentions", "false_abstention_rate")


@query("""
WITH g AS (SELECT lang AS gold_id, source AS predicted, count(*) AS n FROM documents GROUP BY 1, 2),
c AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM g) AS tp, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM g GROUP BY predicted)) AS said, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM g GROUP BY gold_id)) AS "true")
SELECT tp::DOUBLE AS tp, said::DOUBLE AS said, "true"::DOUBLE AS "true", round(tp / said, 6) AS precision, round(tp / "true", 6) AS recall, round(2 * tp / (said + "true"), 6) AS f1 FROM c""")
def pairwise_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("gold_id"), F.col("source").alias("predicted"))
    out = evaluation.pairwise_resolution(rows)
    return out.select("tp", "said", "true", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))
