"""Registered queries of the entity layer, ingest, confidence and storage, with their SQL.

Each calls the operator it is named after over whole tables: part names stand for
names of entities, customers for persons with made-up names, conversations for
files, and orders and suppliers for documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.config import Chunking, EntityRetrieval, Resolution, Settings, Weights
from sievewright.functions import names as nm
from sievewright.functions.lexicons import TYPE_HINTS
from sievewright.operators import confidence, evaluation, fusion, generation, graph, lexical, linking, resolution
from sievewright.plans.queries import _EDGES, _FUSED, _INDEX, lexical_index, query, supply, table, vectors
from sievewright.sources import ingest
from sievewright.sources.shared import shared_dir, stored
from sievewright.sources.storage import TableStore, counted, cut

# Names

_BASIC = r"trim(regexp_replace(regexp_replace(replace(lower(regexp_replace(strip_accents({0}), '[^\x00-\x7F]', '', 'g')), '&', ' and '), '[^a-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_NAMED = "SELECT s_name AS surface FROM supplier UNION SELECT n_name FROM nation UNION SELECT p_name FROM part UNION SELECT c_name FROM customer UNION SELECT array_to_string(regexp_extract_all(text, '[^ \\n]+')[1:3], ' ') FROM documents WHERE text NOT LIKE '%''%' AND text NOT LIKE '%’%'".replace("\\n", "\n")


@query(f"""
WITH s AS ({_NAMED}), b AS (SELECT surface, {_BASIC.format("surface")} AS basic FROM s),
t AS (SELECT surface, basic, CASE WHEN basic = 'the' THEN '' ELSE regexp_replace(basic, '^the ', '') END AS plain FROM b)
SELECT surface, basic, replace(plain, ' ', '') AS compact FROM t""")
def normalized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [table(spark, sf_dir, t).select(F.col(c).alias("surface")) for t, c in (("supplier", "s_name"), ("nation", "n_name"), ("part", "p_name"), ("customer", "c_name"))]
    texts = table(spark, sf_dir, "documents").where(~F.contains("text", F.lit("'")) & ~F.contains("text", F.lit("’")))
    names.append(texts.select(F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[^ \n]+"), F.lit(0)), 1, 3), " ").alias("surface")))
    every = names[0]
    for n in names[1:]:
        every = every.unionByName(n)
    return every.distinct().select("surface", nm.basic_udf("surface").alias("basic"), F.array_join(nm.tokens_udf("surface", F.lit("LOCATION")), "").alias("compact"))


def place_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names, some in capitals, and their first words, as mentions of places in the documents of their brands."""
    parts = table(spark, sf_dir, "part")
    named = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    surfaces = F.array(F.struct(F.lit("n").alias("part"), named.alias("surface")), F.struct(F.lit("w").alias("part"), F.substring_index("p_name", " ", 1).alias("surface")))
    rows = parts.select("p_partkey", "p_brand", F.inline(surfaces))
    return rows.select(
        F.concat(F.col("p_partkey").cast("string"), "part").alias("mention_id"), F.col("p_partkey").cast("string").alias("chunk_id"), F.col("p_brand").alias("document_id"), "surface",
        F.lit("LOCATION").alias("entity_type"), F.lit("LOCATION").alias("kind"), F.lit(1.0).alias("confidence"), F.lit("rules").alias("extractor"),
    )


_PLACES = """
WITH m AS (
  SELECT p_partkey || 'n' AS mention_id, p_brand AS doc, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS surface FROM part
  UNION ALL SELECT p_partkey || 'w', p_brand, split_part(p_name, ' ', 1) FROM part),
g AS (
  SELECT lower(surface) AS name, 'LOCATION::' || lower(surface) AS gid, string_split(lower(surface), ' ') AS tokens, replace(lower(surface), ' ', '') AS compact, list(DISTINCT doc) AS docs
  FROM m GROUP BY lower(surface)),
keys AS (SELECT DISTINCT gid, key FROM (SELECT gid, 'p:' || substr(compact, 1, 4) AS key FROM g UNION ALL SELECT gid, 't:' || t FROM (SELECT gid, unnest(tokens) AS t FROM g) WHERE length(t) >= 3)),
useful AS (SELECT key FROM keys GROUP BY key HAVING count(*) BETWEEN 2 AND 200),
pairs AS (SELECT DISTINCT x.gid AS a, y.gid AS b FROM keys x JOIN keys y ON x.key = y.key AND x.gid < y.gid WHERE x.key IN (SELECT key FROM useful)),
grow AS (  -- full forms that a short one is a proper part of
  SELECT s.gid, l.gid AS g2, l.tokens AS t2, l.compact AS c2 FROM g s JOIN g l ON s.gid <> l.gid AND len(l.tokens) >= 2 AND list_has_all(l.tokens, s.tokens) AND NOT list_has_all(s.tokens, l.tokens)),
smallest AS (SELECT x.* FROM grow x WHERE NOT EXISTS (SELECT 1 FROM grow y WHERE y.gid = x.gid AND list_has_all(x.t2, y.t2) AND NOT list_has_all(y.t2, x.t2))),
completions AS (SELECT gid, count(DISTINCT c2) AS n FROM smallest GROUP BY gid)"""


def place_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(resolution.surface_groups(place_mentions(spark, sf_dir)))


@query(_PLACES + " SELECT gid, array_to_string(tokens, ' ') AS tokens, compact, len(docs) AS docs, len(tokens) >= 2 AS \"full\" FROM g")
def surface_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place_groups(spark, sf_dir).select("gid", F.array_join("tokens", " ").alias("tokens"), "compact", F.size("docs").cast("long").alias("docs"), "full")


@query(_PLACES + " SELECT a, b FROM pairs")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.candidate_pairs(place_groups(spark, sf_dir))


@query(_PLACES + " SELECT gid, n AS n_completions FROM completions")
def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.completions(place_groups(spark, sf_dir))


@query(_PLACES + """,
sides AS (
  SELECT a, b, x.tokens AS ta, y.tokens AS tb, x.compact AS ca, y.compact AS cb, x.docs AS da, y.docs AS db, jaro_winkler_similarity(x.name, y.name) AS jw,
    list_has_all(x.tokens, y.tokens) AS b_in_a, list_has_all(y.tokens, x.tokens) AS a_in_b, CASE WHEN len(x.tokens) <= len(y.tokens) THEN a ELSE b END AS short
  FROM pairs JOIN g x ON x.gid = a JOIN g y ON y.gid = b),
judged AS (SELECT *, a_in_b <> b_in_a AS subset, len(ta) >= 2 AND len(tb) >= 2 AND a_in_b = b_in_a AND ca <> cb AND jw < 0.9 AS clash FROM sides),
features AS (
  SELECT a, b, (ca = cb)::INT AS compact_equal, round(greatest(0, (jw - 0.7) / 0.3), 4) AS string, subset::INT AS token_subset, list_has_any(da, db)::INT AS doc_cooccur,
    (subset AND NOT clash AND coalesce(n, 0) = 1)::INT AS unique_completion, (subset AND NOT clash AND coalesce(n, 0) > 1)::INT AS ambiguous_completion, clash::INT AS conflict
  FROM judged LEFT JOIN completions ON gid = short)
SELECT a, b, string, token_subset::DOUBLE AS token_subset, doc_cooccur::DOUBLE AS doc_cooccur, unique_completion::DOUBLE AS unique_completion, ambiguous_completion::DOUBLE AS ambiguous_completion, conflict > 0 AS conflict,
  round(1 / (1 + exp(-(-4 + 6 * compact_equal + 3.5 * string + 1.5 * token_subset + 1.5 * doc_cooccur + 1.5 * unique_completion - 2.5 * ambiguous_completion - 6 * conflict))), 5) AS score FROM features""")
def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log-linear score of every candidate pair and the features it is made of."""
    groups = place_groups(spark, sf_dir)
    rows = resolution.scored_pairs(groups, cut(resolution.candidate_pairs(groups)), Resolution())
    return rows.select("a", "b", *(F.col("features")[f].alias(f) for f in ("string", "token_subset", "doc_cooccur", "unique_completion", "ambiguous_completion")), "conflict", F.round("score", 5).alias("score"))


_ENTITIES = _PLACES + """,
surfaces AS (SELECT lower(surface) AS name, surface, count(*) AS n FROM m GROUP BY ALL),
best AS (SELECT name, surface FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, length(surface) DESC, surface) AS nth FROM surfaces) WHERE nth = 1),
ents AS (SELECT 'ent_' || substr(sha1('LOCATION:' || b.name), 1, 12) AS entity_id, b.name, b.surface AS canonical_name, list_sort(list(s.surface) FILTER (s.surface <> b.surface)) AS aliases FROM best b JOIN surfaces s ON b.name = s.name GROUP BY ALL)"""


@query(_ENTITIES + " SELECT entity_id, canonical_name, coalesce(array_to_string(aliases, ','), '') AS aliases FROM ents")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = resolution.entities(place_groups(spark, sf_dir), spark.createDataFrame([], "gid string, cluster string"))
    return found.select("entity_id", "canonical_name", F.array_join(F.array_sort("aliases"), ",").alias("aliases"))


@query(_ENTITIES + " SELECT entity_id, count(*) AS mention_count, count(DISTINCT doc) AS document_count, array_to_string(list_sort(list(DISTINCT surface)), ',') AS seen FROM m JOIN ents ON lower(surface) = name GROUP BY entity_id")
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = place_mentions(spark, sf_dir)
    _, of_group = resolution.entities(place_groups(spark, sf_dir), spark.createDataFrame([], "gid string, cluster string"))
    assigned = mentions.select("mention_id", F.concat(F.lit("LOCATION::"), F.lower("surface")).alias("gid")).join(of_group, "gid").select("mention_id", "entity_id")
    return resolution.counted(assigned, mentions).select("entity_id", "mention_count", "document_count", F.array_join(F.array_sort("seen"), ",").alias("seen"))


_FIRST, _LAST = "Anna Bert Carla David Emma Fred Greta".split(), "Adams Baker Clark Davis Evans Frank Green Hills Irwin Jones Klein".split()
_PICK = lambda words, key: "[" + ", ".join(f"'{w}'" for w in words) + f"][{key} % {len(words)} + 1]"


@query(f"""
WITH p AS (SELECT c_custkey AS k, c_nationkey % 400 + c_custkey % 40 AS doc, {_PICK(_FIRST, "c_custkey")} AS f, {_PICK(_LAST, "(c_custkey // 7)")} AS l, c_custkey % 5 AS form FROM customer),
full_names AS (SELECT DISTINCT doc, lower(f) AS f, lower(l) AS l FROM p WHERE form > 2),
fits AS (
  SELECT k, 'PERSON::' || x.f || ' ' || x.l AS gid FROM p JOIN full_names x ON p.doc = x.doc
  WHERE (form = 0 AND lower(p.l) = x.l) OR (form = 1 AND lower(p.l) = x.l AND lower(p.f[1]) = x.f[1]) OR (form = 2 AND (lower(p.f) = x.f OR lower(p.f) = x.l)))
SELECT k::VARCHAR AS mention_id, min(gid) AS gid FROM fits GROUP BY k HAVING count(*) = 1""")
def coreferent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons by last name, initial and last name, first name, or full name; partial names find the one full name of their document."""
    key = F.col("c_custkey")
    first, last = F.element_at(F.array(*map(F.lit, _FIRST)), (key % 7 + 1).cast("int")), F.element_at(F.array(*map(F.lit, _LAST)), (F.floor(key / 7) % 11 + 1).cast("int"))
    form = key % 5
    surface = F.when(form == 0, last).when(form == 1, F.concat(F.substring(first, 1, 1), F.lit(". "), last)).when(form == 2, first).otherwise(F.concat_ws(" ", first, last))
    rows = table(spark, sf_dir, "customer").select(key.cast("string").alias("mention_id"), (F.col("c_nationkey") % 400 + key % 40).cast("string").alias("document_id"), surface.alias("surface"), F.lit("PERSON").alias("kind"))
    return resolution.coreferent(rows)[0].select("mention_id", "gid")


@query("""
WITH m AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_partkey AS id, p_name AS surface, replace(lower(p_name), ' ', '') AS key,
    CASE l_returnflag WHEN 'A' THEN 'PROJECT' WHEN 'N' THEN 'ORGANIZATION' ELSE 'LOCATION' END AS t, l_quantity AS c FROM lineitem JOIN part ON p_partkey = l_partkey),
votes AS (SELECT key, t, sum(c) AS v, min(id) AS first FROM m GROUP BY key, t),
best AS (SELECT key, t FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY v DESC, first) AS nth FROM votes) WHERE nth = 1)
SELECT m.surface, m.t AS entity_type, best.t AS kind, count(*) AS n FROM m JOIN best ON m.key = best.key GROUP BY ALL""")
def harmonized_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a mention of its part under a type that its flag gives; the name's type by summed weight."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    kind = F.when(F.col("l_returnflag") == "A", "PROJECT").when(F.col("l_returnflag") == "N", "ORGANIZATION").otherwise("LOCATION")
    rows = rows.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("mention_id"), F.col("p_name").alias("surface"), kind.alias("entity_type"), F.col("l_quantity").alias("confidence"))
    return resolution.harmonized(rows)[0].groupBy("surface", "entity_type", "kind").agg(F.count(F.lit(1)).alias("n"))


_HINTS = ", ".join("CASE WHEN list_has_any(w, [" + ", ".join(f"'{h}'" for h in hints.split()) + f"]) THEN '{kind}' END" for kind, hints in TYPE_HINTS.items())


@query(f"""
WITH asked AS (SELECT doc_id, source || ' ' || {_PICK([h.split()[0] for h in TYPE_HINTS.values()], "doc_id")} || ' ' || text AS q FROM documents),
words AS (SELECT doc_id, regexp_extract_all(lower(q), '[a-z]+') AS w FROM asked)
SELECT doc_id, array_to_string([x FOR x IN [{_HINTS}] IF x IS NOT NULL], ',') AS types FROM words""")
def hinted_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.element_at(F.array(*(F.lit(h.split()[0]) for h in TYPE_HINTS.values())), (F.col("doc_id") % len(TYPE_HINTS) + 1).cast("int"))
    asked = F.concat_ws(" ", "source", first, "text")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(graph.hinted_types(asked), ",").alias("types"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as organizations and part names as projects, with aliases."""
    first = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id"), F.col("s_name").alias("canonical_name"), F.lit("ORGANIZATION").alias("entity_type"))
    parts = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("canonical_name")).agg(F.concat(F.lit("p"), F.min("p_partkey")).alias("entity_id"))
    return first.unionByName(parts.select("entity_id", "canonical_name", F.lit("LOCATION").alias("entity_type"))).withColumn("aliases", F.array(F.concat(F.lit("The "), "canonical_name")))


@query(f"""
WITH e AS (SELECT 's' || s_suppkey AS id, s_name AS name, 'ORGANIZATION' AS t FROM supplier UNION ALL SELECT 'p' || min(p_partkey), p_name, 'LOCATION' FROM part GROUP BY p_name),
a AS (SELECT id, t, {_BASIC.format("name")} AS basic FROM e UNION SELECT id, t, {_BASIC.format("'The ' || name")} FROM e),
n AS (SELECT id, t, basic, regexp_replace(basic, '^the ', '') AS plain FROM a)
SELECT id AS entity_id, 'exact' AS index, basic AS key FROM n UNION SELECT id, 'exact', plain FROM n
UNION SELECT id, 'compact', replace(plain, ' ', '') FROM n WHERE length(replace(plain, ' ', '')) >= 4
UNION SELECT id, 'token', k FROM (SELECT id, unnest(string_split(plain, ' ')) AS k FROM n WHERE t = 'ORGANIZATION') WHERE length(k) >= 3""")
def alias_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.alias_index(suppliers(spark, sf_dir))


@query("""
WITH e AS (SELECT 'p' || min(p_partkey) AS id, p_name AS name FROM part GROUP BY p_name)
SELECT p_partkey AS query_id, id AS entity_id, 1.0::DOUBLE AS confidence, 'exact' AS method, p_name AS surface, 17 AS start FROM part JOIN e ON name = p_name""")
def linked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for every part, by its name: spans of the question find the entity, the longest first."""
    entities = suppliers(spark, sf_dir).where("entity_type = 'LOCATION'")
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("what became of a "), "p_name", F.lit(" that we bought")).alias("query"))
    found = linking.link(asked, graph.alias_index(entities), entities, EntityRetrieval())
    return found.select("query_id", "entity_id", "confidence", "method", "surface", "start")


# Graph and listings


@query(_EDGES + " SELECT src, dst, round(weight, 6) AS weight FROM edges WHERE src < dst AND round(weight, 9) >= 0.05 ORDER BY round(weight, 9) DESC, src, dst LIMIT 200")
def listed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, rows = supply(spark, sf_dir)
    edges = graph.edges(rows, entities).withColumn("weight", F.round("weight", 9))
    return graph.listed_edges(edges, 0.05, 200).select("src", "dst", F.round("weight", 6).alias("weight"))


@query("""SELECT 's' || l_suppkey AS source_entity_id, 'p' || l_partkey AS target_entity_id, coalesce(s_name, '?') AS source_name, coalesce(p_name, '?') AS target_name, l_discount AS confidence, 'r' || l_returnflag AS relationship_type
FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 9 > 0) ON s_suppkey = l_suppkey LEFT JOIN part ON p_partkey = l_partkey""")
def named_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships with the names of both ends; every ninth supplier is unknown."""
    entities, rows = supply(spark, sf_dir)
    known = entities.where(~(F.col("entity_id").startswith("s") & (F.expr("try_cast(substr(entity_id, 2) AS bigint)") % 9 == 0)))
    return graph.named_relationships(rows, known).select("source_entity_id", "target_entity_id", "source_name", "target_name", "confidence", "relationship_type")


@query("SELECT 'c' || c_custkey AS entity_id, c_name AS canonical_name, c_custkey % 50 AS mention_count FROM customer WHERE contains(lower(c_name), '7') OR contains(lower(c_mktsegment), '7') ORDER BY c_custkey % 50 DESC, c_name LIMIT 100")
def listed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("entity_id"), F.col("c_name").alias("canonical_name"), F.lit("PERSON").alias("entity_type"), F.array("c_mktsegment").alias("aliases"), (F.col("c_custkey") % 50).alias("mention_count"))
    return graph.listed_entities(rows, "PERSON", "7").select("entity_id", "canonical_name", "mention_count")


@query(_EDGES + """,
direct AS (SELECT s_suppkey AS query_id, 's' || s_suppkey AS ent FROM supplier),
hop AS (SELECT query_id, dst AS ent, weight * 0.6 AS w FROM direct JOIN edges ON src = ent),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(w, 9) DESC, ent) AS nth FROM hop WHERE w > 0),
plan AS (SELECT query_id, ent, 1.0 AS d, 0.0 AS x FROM direct UNION ALL SELECT query_id, ent, 0.0, w FROM near WHERE nth <= 15),
held AS (SELECT l_orderkey AS chunk_id, 's' || l_suppkey AS ent FROM lineitem UNION SELECT l_orderkey, 'p' || l_partkey FROM lineitem),
scores AS (SELECT query_id, chunk_id, round(1 - (1 - least(1, sum(d))) * (1 - max(x)), 9) AS score FROM plan JOIN held USING (ent) GROUP BY query_id, chunk_id)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 5""")
def entity_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five orders that hold most of each supplier's planned entities."""
    entities, rows = supply(spark, sf_dir)
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.lit("").alias("query"))
    links = asked.select("query_id", F.concat(F.lit("s"), "query_id").alias("entity_id"), F.lit(1.0).alias("confidence"))
    plan = cut(graph.plan(asked, links, graph.edges(rows, entities).withColumn("weight", F.round("weight", 12)), entities))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.concat(F.lit("s"), "l_suppkey").alias("entity_id"), F.concat(F.lit("p"), "l_partkey").alias("p"))
    mentions = lines.select("chunk_id", "entity_id").unionByName(lines.select("chunk_id", F.col("p").alias("entity_id")))
    scores = graph.entity_scores(plan, graph.chunk_entities(mentions, entities), entities).withColumn("score", F.round("score", 9))
    return lexical.top_k(scores.where("score > 0"), 5).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


# Ingest


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents k WHERE k.doc_id % 2 = 0 AND k.text = d.text AND k.source = d.source)")
def new_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the index lacks, where it has every second document already."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("filename"), F.sha2("text", 256).alias("content_hash"))
    return ingest.without_known(rows, rows.where("doc_id % 2 = 0")).select("doc_id")


_LINES = r"trim(regexp_replace(regexp_replace(replace({0}, chr(9), '    '), '[ ]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), E' \n\r\t')"


@query(f"""
WITH r AS (SELECT conv_id, turn, {_LINES.format("'turn: ' || turn || chr(10) || 'role: ' || role || chr(10) || 'text: ' || text")} AS piece FROM conversations)
SELECT conv_id, 'doc_' || substr(sha256('c' || conv_id || '.json' || chr(0) || sha256(max(file))), 1, 16) AS document_id, md5(string_agg(piece, chr(10) || chr(10) ORDER BY turn)) AS text_md5, count(*) AS records
FROM r JOIN (SELECT conv_id, '{{"title":"c' || conv_id || '","turns":[' || string_agg('{{"turn":' || turn || ',"role":' || to_json(role) || ',"text":' || to_json(text) || '}}', ',' ORDER BY turn) || ']}}' AS file FROM conversations GROUP BY conv_id) USING (conv_id)
GROUP BY conv_id""")
def parsed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON files: ids, flattened records, and the text they make."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    body = F.to_json(F.struct(F.concat(F.lit("c"), "conv_id").alias("title"), F.col("turns")))
    files = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns")).select(F.concat(F.lit("c"), "conv_id", F.lit(".json")).alias("filename"), F.encode(body, "UTF-8").alias("content"))
    rows = ingest.parsed(files, Settings())
    return rows.select(
        F.regexp_extract("filename", "[0-9]+", 0).cast("long").alias("conv_id"), "document_id", F.md5("text").alias("text_md5"),
        F.size(F.array_distinct(F.transform(F.filter("chunks", lambda c: F.element_at(c["metadata"], F.lit("kind")) == "record"), lambda c: F.element_at(c["metadata"], F.lit("record_index"))))).cast("long").alias("records"),
    )


@query(f"""
WITH RECURSIVE b AS (
  SELECT conv_id % 20 AS g, row_number() OVER (PARTITION BY conv_id % 20 ORDER BY conv_id, turn) AS k, {_LINES.format("text")} AS t FROM conversations),
t AS (SELECT g, k, length(t) AS n, len(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')) AS tok FROM b),
walk AS (
  SELECT g, k, 0 AS chunk, tok AS run, tok, n, 0 AS start FROM t WHERE k = 1
  UNION ALL SELECT t.g, t.k, chunk + (run + t.tok > 1000)::INT, CASE WHEN run + t.tok > 1000 THEN t.tok ELSE run + t.tok END, t.tok, t.n, w.start + w.n + 2 FROM walk w JOIN t ON t.g = w.g AND t.k = w.k + 1)
SELECT g, chunk AS chunk_index, sum(tok)::INT AS token_count, min(start)::INT AS char_start, max(start + n)::INT AS char_end FROM walk GROUP BY g, chunk""")
def packed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as the paragraphs of twenty text files, packed into chunks of up to a thousand tokens with their places in the text."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 20).alias("g"), F.struct("conv_id", "turn", "text").alias("t"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["text"]), "\n\n")
    files = rows.groupBy("g").agg(body.alias("body")).select(F.concat(F.col("g").cast("string"), F.lit(".txt")).alias("filename"), F.encode("body", "UTF-8").alias("content"))
    out = ingest.parsed(files, Settings(chunking=Chunking(max_tokens=1000)))
    return out.select(F.regexp_extract("filename", "[0-9]+", 0).cast("long").alias("g"), F.inline("chunks")).select("g", "chunk_index", "token_count", "char_start", "char_end")


@query("""
WITH d AS (SELECT doc_id, source, text FROM documents)
SELECT 'deleted' AS state, doc_id::VARCHAR AS document_id, sha256(text) AS content_hash FROM d WHERE doc_id % 5 <> 0 UNION ALL SELECT 'restored', doc_id::VARCHAR, sha256(text) FROM d""")
def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored in two appends; a snapshot; every fifth deleted; and the snapshot's state."""
    store = TableStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    own = F.col("doc_id").cast("string")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", own.alias("document_id"), F.col("source").alias("filename"), F.lit("txt").alias("source_type"), F.sha2("text", 256).alias("content_hash"), F.lit(None).cast("timestamp").alias("created_at"),
        "text", F.lit("").alias("title"), F.lit(None).cast("map<string,string>").alias("metadata"), F.lit(1).alias("chunk_count"),
    )
    store.append("documents", rows.where("doc_id % 2 = 0"))
    store.append("documents", rows.where("doc_id % 2 = 1"))
    store.compact("documents")
    store.snapshot("whole")
    store.delete_documents(rows.where("doc_id % 5 = 0"))
    deleted = store.read("documents")
    store.restore("whole")
    kept = lambda df, state: df.select(F.lit(state).alias("state"), "document_id", "content_hash")
    return kept(deleted, "deleted").unionByName(kept(store.read("documents"), "restored"))


@query("""
WITH t AS (SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'benchmark', count(*) FROM benchmark
  UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'conversations', count(*) FROM conversations) SELECT * FROM t""")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted({n: table(spark, sf_dir, n) for n in ("documents", "pages", "benchmark", "labels", "conversations")})


# Search


@query(_INDEX + """
SELECT item_id AS query_id, doc_id AS chunk_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 5) AS score
FROM post p JOIN weighed w ON p.term = w.term WHERE doc_id % 7 = item_id % 7 GROUP BY item_id, doc_id""")
def bm25_of_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of given candidates alone: for each question a seventh of the documents."""
    rows, post, stats, corpus, terms = lexical_index(spark, sf_dir)
    asked = terms.select("query_id").distinct()
    pairs = rows.select("chunk_id").withColumn("r", F.col("chunk_id") % 7).join(asked.withColumn("r", F.col("query_id") % 7), "r").select("query_id", "chunk_id")
    return lexical.bm25_scores(terms, post, stats, corpus, candidates=pairs).withColumn("score", F.round("score", 5))


_THREE = _FUSED + """,
ent AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, greatest(0, list_dot_product(q.embedding[9:16]::DOUBLE[], v.embedding[9:16]::DOUBLE[])) AS score FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 100 = 0 AND v.vec_id % 3 > 0),
entr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM ent),
cand3 AS (SELECT query_id, chunk_id FROM cand UNION SELECT query_id, chunk_id FROM entr WHERE rank <= 30),
filled3 AS (
  SELECT c.query_id, c.chunk_id, v.score AS vr, l.score AS lr, coalesce(e.score, 0) AS es, list_sort([x FOR x IN [CASE WHEN e.rank <= 30 THEN 'entity' END, CASE WHEN l.rank <= 30 THEN 'lexical' END, CASE WHEN v.rank <= 30 THEN 'vector' END] IF x IS NOT NULL]) AS sources
  FROM cand3 c JOIN vec v USING (query_id, chunk_id) JOIN lexr l USING (query_id, chunk_id) LEFT JOIN entr e USING (query_id, chunk_id)),
scored3 AS (SELECT *, 0.4 * (vr - min(vr) OVER w) / (max(vr) OVER w - min(vr) OVER w) + 0.4 * (lr - min(lr) OVER w) / (max(lr) OVER w - min(lr) OVER w) + 0.2 * es AS f FROM filled3 WINDOW w AS (PARTITION BY query_id))"""


@query(_THREE + """
SELECT query_id, chunk_id, rank, round(f, 5) AS final_score, array_to_string(sources, ',') AS retrieved_by
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(f, 9) DESC, chunk_id) AS rank FROM scored3) WHERE rank <= 10""")
def three_signal_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector, lexical and entity signals: union, backfill with zeros where a chunk holds no entity, normalization, weighted sum."""
    asked, rows = vectors(spark, sf_dir)
    part = lambda df, at: df.withColumn("embedding", F.slice("embedding", at, 8))
    held = stored(fusion.vector_scores(part(asked, 9), part(rows.where("chunk_id % 3 > 0"), 9)).withColumn("score", F.greatest("score", F.lit(0.0))), "entity-scores")
    best = fusion.ranked(held.withColumn("by", F.round("score", 9)), 30, by="by").drop("by")
    hits = {"vector": fusion.vector_top_k(asked, rows, 30), "lexical": fusion.vector_top_k(part(asked, 1), part(rows, 1), 30), "entity": best}
    candidates = cut(fusion.union_candidates(hits))
    fills = {"vector": fusion.vector_scores(asked, rows, candidates), "lexical": fusion.vector_scores(part(asked, 1), part(rows, 1), candidates), "entity": held}
    filled = fusion.backfilled(candidates, fills, zero=("entity",))
    for signal in ("vector", "lexical"):
        filled = filled.withColumn(f"{signal}_score", fusion.normalized(F.col(f"{signal}_raw"), "minmax"))
    fused = fusion.weighted_fusion(filled.withColumn("entity_score", F.col("entity_raw")), Weights(0.4, 0.4, 0.2)).withColumn("by", F.round("final_score", 9))
    return fusion.ranked(fused, 10, by="by").select("query_id", "chunk_id", "rank", F.round("final_score", 5).alias("final_score"), F.array_join("sources", ",").alias("retrieved_by"))


_CONFIDENCE = _FUSED + """,
top AS (SELECT query_id, chunk_id, chunk_id % 4 AS doc, rank, round(score, 9) AS s, (chunk_id % 10) / 10.0 AS cov FROM vec WHERE rank <= 5),
one AS (SELECT query_id, max(s) FILTER (rank <= 3) AS cos, max(cov) FILTER (rank <= 3) AS cov, max(s) FILTER (rank = 1) AS s1, coalesce(max(s) FILTER (rank = 2), 0) AS s2, max(chunk_id) FILTER (rank = 1) AS first FROM top GROUP BY query_id),
strong AS (SELECT query_id, count(DISTINCT doc) AS n FROM top JOIN one USING (query_id) WHERE s >= 0.8 * s1 GROUP BY query_id),
agree AS (
  SELECT o.query_id, count(*) FILTER (v.rank <= 5 AND l.rank <= 5) / 5.0 AS shared, coalesce(max((v.chunk_id = o.first)::INT), 0) AS is_both
  FROM one o LEFT JOIN vec v ON v.query_id = o.query_id AND v.rank <= 10 JOIN lexr l ON l.query_id = v.query_id AND l.chunk_id = v.chunk_id AND l.rank <= 10 GROUP BY o.query_id),
signals AS (
  SELECT query_id, cos, one.cov, (least(1, greatest(0, (cos - 0.2) / 0.4)) + one.cov) / 2 AS relevance, CASE WHEN s1 > 0 THEN least(1, greatest(0, (s1 - s2) / s1)) ELSE 0 END AS margin,
    0.5 * coalesce(shared, 0) + 0.5 * coalesce(is_both, 0) AS agreement, least(1, n / 2.0) AS support
  FROM one JOIN strong USING (query_id) LEFT JOIN agree USING (query_id)),
judged AS (SELECT *, (0.45 * relevance + 0.1 * margin + 0.2 * agreement + 0.1 * support) / 0.85 AS raw, (cos < 0.25) AND (cov < 0.34) AS weak FROM signals)"""


def _outcomes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asked, rows = vectors(spark, sf_dir)
    near = stored(fusion.vector_top_k(asked, rows, 30).withColumn("score", F.round("score", 9)), "near")
    short = lambda df: df.withColumn("embedding", F.slice("embedding", 1, 8))
    top = near.where("rank <= 5").select("query_id", "chunk_id", (F.col("chunk_id") % 4).alias("document_id"), "rank", F.col("score").alias("final_score"), F.col("score").alias("vector_raw"), (F.col("chunk_id") % 10 / 10).alias("coverage"))
    return top, confidence.evaluate(asked.select("query_id"), top, "hybrid", fusion.vector_top_k(short(asked), short(rows), 30), near)


@query(_CONFIDENCE + """
SELECT query_id, round(raw, 4) AS confidence, CASE WHEN weak OR raw < 0.45 THEN 'insufficient_evidence' ELSE 'success' END AS status, round(relevance, 4) AS relevance, round(margin, 4) AS margin, round(agreement, 4) AS agreement, round(support, 4) AS support,
  CASE WHEN weak THEN 'weak_evidence' ELSE '' END AS gates FROM judged""")
def confidence_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance, margin, agreement and support of every query, and whether its evidence suffices."""
    _, out = _outcomes(spark, sf_dir)
    return out.select("query_id", "confidence", "status", *(F.col("signals")[s].alias(s) for s in ("relevance", "margin", "agreement", "support")), F.array_join("gates", ",").alias("gates"))


@query(_CONFIDENCE + " SELECT t.query_id, t.chunk_id, t.rank FROM top t JOIN judged j ON t.query_id = j.query_id WHERE NOT (weak OR raw < 0.45)")
def visible_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    top, out = _outcomes(spark, sf_dir)
    return confidence.visible(top, out).select("query_id", "chunk_id", "rank")


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(a, '\\[(\\d+)\\]', 1)::INT[])), ',') AS cited FROM (SELECT doc_id, text || ' [' || doc_id % 9 || '] and [' || doc_id % 4 || '][x] [ 7]' AS a FROM documents)""".replace("\\\\", "\\"))
def cited_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat("text", F.lit(" ["), (F.col("doc_id") % 9).cast("string"), F.lit("] and ["), (F.col("doc_id") % 4).cast("string"), F.lit("][x] [ 7]"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(generation.cited_markers(answer).cast("array<string>"), ",").alias("cited"))


# Evaluation


@query(r"""
WITH d AS (SELECT doc_id, source, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS hay FROM documents WHERE length(text) >= 60),
q AS (SELECT doc_id AS query_id, source, substr(hay, 11, 40) AS needle FROM d WHERE doc_id % 20 = 0)
SELECT DISTINCT query_id, doc_id AS chunk_id FROM q JOIN d ON contains(hay, trim(needle)) AND (query_id % 100 = 0 OR q.source = d.source)""")
def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence cut out of every twentieth document: chunks of its source that hold it, and of any for every hundredth."""
    from sievewright.functions.text import collapsed

    rows = table(spark, sf_dir, "documents").where(F.length("text") >= 60)
    texts = rows.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), "text")
    sources = F.when(F.col("doc_id") % 100 == 0, F.array().cast("array<string>")).otherwise(F.array("source"))
    asked = rows.where("doc_id % 20 = 0 AND (source IS NOT NULL OR doc_id % 100 = 0)").select(F.col("doc_id").alias("query_id"), F.lit(True).alias("answerable"), sources.alias("relevant_sources"), F.array(F.substring(collapsed(F.col("text")), 11, 40)).alias("evidence"), F.lit(None).cast("array<bigint>").alias("relevant_chunk_ids"))
    documents = rows.select(F.col("source").alias("document_id"), F.col("source").alias("filename")).distinct()
    return evaluation.relevance(asked, texts, documents)


@query("""
WITH m AS (SELECT p_name AS surface, 'f' || l_suppkey AS source, 'e' || l_linenumber AS e FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'R'),
gold AS (SELECT DISTINCT p_name AS surface, 'f' || l_suppkey AS source, 'g' || p_size AS gold_id FROM lineitem JOIN part ON p_partkey = l_partkey),
votes AS (SELECT g.gold_id, g.source, g.surface, e, count(e) AS n FROM gold g LEFT JOIN m ON m.source = g.source AND m.surface = g.surface GROUP BY ALL)
SELECT gold_id, source, surface, e AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY gold_id, source, surface ORDER BY n DESC, e NULLS FIRST) AS nth FROM votes) WHERE nth = 1""")
def gold_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as mentions of part names in their suppliers' files; header mentions do not count."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    mentions = rows.select(F.col("p_name").alias("surface"), F.col("l_suppkey").alias("document_id"), F.concat(F.lit("e"), "l_linenumber").alias("entity_id"), F.when(F.col("l_returnflag") == "R", "header").otherwise("rules").alias("extractor"))
    gold = rows.select(F.concat(F.lit("g"), "p_size").alias("gold_id"), F.concat(F.lit("f"), "l_suppkey").alias("source"), F.col("p_name").alias("surface")).distinct()
    documents = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("document_id"), F.concat(F.lit("f"), "l_suppkey").alias("filename")).distinct()
    return evaluation.gold_assignments(gold, mentions, documents)


@query("""
WITH rows AS (SELECT event_type AS mode, CASE WHEN user_id % 2 = 0 THEN 'dev' ELSE 'test' END AS split, round(value / 200, 6) AS confidence, user_id % 3 > 0 AS b FROM events),
grid AS (SELECT round(0.3 + 0.025 * i, 3) AS threshold FROM range(17) t(i)),
j AS (SELECT mode, split, threshold, b, confidence < threshold AS a FROM rows CROSS JOIN grid),
s AS (SELECT mode, split, threshold, round(2.0 * count(*) FILTER (a AND NOT b) / nullif(count(*) FILTER (a) + count(*) FILTER (NOT b), 0), 4) AS f1, count(*) FILTER (a AND NOT b) AS tp, round(count(*) FILTER (a AND b) / nullif(count(*) FILTER (b), 0), 4) AS far FROM j GROUP BY ALL)
SELECT mode, split, threshold, f1 AS abstention_f1 FROM (SELECT *, row_number() OVER (PARTITION BY mode, split ORDER BY CASE WHEN tp > 0 THEN f1 END DESC NULLS LAST, far NULLS LAST, threshold) AS nth FROM s) WHERE nth = 1""")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("mode"), F.when(F.col("user_id") % 2 == 0, "dev").otherwise("test").alias("split"), F.round(F.col("value") / 200, 6).alias("confidence"),
        F.lit(False).alias("gated"), (F.col("user_id") % 3 > 0).alias("answerable"),
    )
    return evaluation.best_threshold(evaluation.threshold_sweep(rows)).select("mode", "split", "threshold", "abstention_f1")
