"""The entity graph: components, noisy-OR edges, neighbours, alias indexes, entity scores of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewright.config import EntityRetrieval
from sievewright.functions import names as nm
from sievewright.functions.lexicons import TYPE_HINTS
from sievewright.sources.shared import stored

MAX_EDGE = 0.95


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``edges (a, b)``; ``comp`` is the component's smallest node.

    Nodes are numbered at random (by a bijection of 64-bit numbers).  Every round
    each node moves to the smallest of its neighbours and from there to that
    node's, and the edges follow.  As the order is random, a fixed share of the
    nodes goes each round whatever the shape, long chains included: the rounds
    grow with the logarithm of the size.  A node's neighbours are summed up by
    partial aggregation, so a hub costs no task more than its share.
    """
    pairs = stored(edges.select("a", "b").where("a <> b"), "edges")
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    if dict(pairs.dtypes)["a"] == dict(pairs.dtypes)["b"] == "bigint":
        numbers = ends.withColumn("number", F.xxhash64("node"))
        links = pairs.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    else:
        numbers = stored(stored(ends.withColumn("i", F.monotonically_increasing_id()), "nodes").select("node", F.xxhash64("i").alias("number")), "numbers")
        links = pairs.join(numbers.select(F.col("node").alias("a"), F.col("number").alias("na")), "a").join(numbers.select(F.col("node").alias("b"), F.col("number").alias("nb")), "b")
        links = links.select(F.col("na").alias("a"), F.col("nb").alias("b"))
    links = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while not links.isEmpty():
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        step = stored(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), "steps")
        to = stored(step.join(step.toDF("p", "q"), "p").select("u", F.col("q").alias("p")), "steps")
        labels = to.toDF("number", "top") if labels is None else stored(labels.join(to, F.col("top") == F.col("u"), "left").select("number", F.coalesce("p", "top").alias("top")), "labels")
        moved = links.join(to.toDF("a", "pa"), "a").join(to.toDF("b", "pb"), "b").where("pa <> pb")
        links = stored(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
    if labels is None:
        return numbers.select("node", F.col("node").alias("comp"))
    named = stored(numbers.join(labels, "number").select("node", "top"), "labels")
    least = stored(named.groupBy("top").agg(F.min("node").alias("comp")), "least")  # a join of two tables can be split at a hot key
    return named.join(least, "top").select("node", "comp")


def edges(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Undirected weighted edges in both directions: ``src, dst, weight, relation_types, n_chunks``.

    The weight is the noisy-OR of the confidences, at most ``MAX_EDGE``;
    relationships of unknown entities are left out.
    """
    ids = entities.select("entity_id")
    known = relationships.join(ids.withColumnRenamed("entity_id", "source_entity_id"), "source_entity_id", "left_semi").join(ids.withColumnRenamed("entity_id", "target_entity_id"), "target_entity_id", "left_semi")
    one = known.select(F.col("source_entity_id").alias("src"), F.col("target_entity_id").alias("dst"), "confidence", "relationship_type", "supporting_chunk_id")
    other = one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "confidence", "relationship_type", "supporting_chunk_id")
    return one.unionByName(other).groupBy("src", "dst").agg(
        F.least(F.lit(MAX_EDGE), 1 - F.product(1 - F.col("confidence"))).alias("weight"),
        F.array_sort(F.collect_set("relationship_type")).alias("relation_types"),
        F.count_distinct("supporting_chunk_id").alias("n_chunks"),
    )


def neighborhoods(edge_table: DataFrame, k: int = 12) -> DataFrame:
    """The strongest ``k`` neighbours of every entity; weights equal to nine places tie by the neighbour's id."""
    order = Window.partitionBy("src").orderBy(F.round("weight", 9).desc(), "dst")
    return edge_table.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= k).drop("_nth")


def neighborhood(edge_table: DataFrame, entity_id: str, k: int = 12) -> DataFrame:
    """The strongest ``k`` neighbours of one entity."""
    return neighborhoods(edge_table.where(F.col("src") == entity_id), k)


def listed_edges(edge_table: DataFrame, min_weight: float = 0.0, limit: int | None = 200) -> DataFrame:
    """Every edge once, from a weight on, the strongest first."""
    rows = edge_table.where((F.col("src") < F.col("dst")) & (F.col("weight") >= min_weight)).orderBy(F.col("weight").desc(), "src", "dst")
    return rows if limit is None else rows.limit(limit)


def listed_entities(entities: DataFrame, kind: str | None = None, contains: str | None = None, limit: int | None = 100) -> DataFrame:
    """Entities of a type whose name or alias holds a string, in any case; the most mentioned first."""
    rows = entities if kind is None else entities.where(F.col("entity_type") == kind)
    if contains:
        holds = lambda name: F.contains(F.lower(name), F.lit(contains.lower()))
        rows = rows.where(holds(F.col("canonical_name")) | F.coalesce(F.exists("aliases", holds), F.lit(False)))
    rows = rows.orderBy(F.col("mention_count").desc(), "canonical_name")
    return rows if limit is None else rows.limit(limit)


def context(text, start, end, width: int = 80):
    """What stands around ``start`` to ``end`` of a text, on one line, with marks where it is cut."""
    first = F.greatest(start - width, F.lit(0))
    body = F.replace(F.substring(text, first + 1, end + width - first), F.lit("\n"), F.lit(" "))
    return F.concat(F.when(start > width, "…").otherwise(""), body, F.when(F.length(text) > end + width, "…").otherwise(""))


def in_context(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """``mention_id, chunk_id, document_id, surface, context``."""
    rows = mentions.join(chunks.select("chunk_id", "text"), "chunk_id")
    return rows.select("mention_id", "chunk_id", "document_id", "surface", context(F.col("text"), F.col("char_start"), F.col("char_end")).alias("context"))


def named_relationships(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships with the names of both ends; ``?`` for entities that are not there."""
    out = relationships
    for side in ("source", "target"):
        names = entities.select(F.col("entity_id").alias(f"{side}_entity_id"), F.col("canonical_name").alias(f"{side}_name"))
        out = out.join(names, f"{side}_entity_id", "left").withColumn(f"{side}_name", F.coalesce(f"{side}_name", F.lit("?")))
    return out


def chunk_entities(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct ``chunk_id, entity_id`` of mentions with a known entity."""
    return mentions.where("entity_id is not null").join(entities.select("entity_id"), "entity_id", "left_semi").select("chunk_id", "entity_id").distinct()


def alias_index(entities: DataFrame) -> DataFrame:
    """``index (exact | compact | token), key, entity_id``: the ways in which a query may name an entity."""
    alias = entities.select("entity_id", "entity_type", F.explode(F.array_union(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    rows = alias.select("entity_id", "entity_type", nm.basic_udf("alias").alias("basic"), nm.tokens_udf("alias", "entity_type").alias("tokens")).where("basic <> ''")
    plain = F.array_join("tokens", " ")
    entries = F.array(
        F.struct(F.lit("exact").alias("index"), F.col("basic").alias("key")),
        F.struct(F.lit("exact").alias("index"), plain.alias("key")),
        F.when(F.length(F.array_join("tokens", "")) >= 4, F.struct(F.lit("compact").alias("index"), F.array_join("tokens", "").alias("key"))),
    )
    of_tokens = F.when(F.col("entity_type").isin("PERSON", "ORGANIZATION", "PROJECT"), F.transform(F.filter("tokens", lambda t: F.length(t) >= 3), lambda t: F.struct(F.lit("token").alias("index"), t.alias("key"))))
    return rows.select("entity_id", F.inline(F.filter(F.concat(entries, F.coalesce(of_tokens, F.array().cast("array<struct<index:string,key:string>>"))), lambda e: e.isNotNull() & (e["key"] != "")))).distinct()


def hinted_types(query):
    """Types of entity that a query's words point to."""
    words = F.regexp_extract_all(F.lower(query), F.lit("[a-z]+"), F.lit(0))
    return F.array_compact(F.array(*(F.when(F.arrays_overlap(words, F.array(*map(F.lit, hints.split()))), F.lit(kind)) for kind, hints in TYPE_HINTS.items())))


def plan(queries: DataFrame, links: DataFrame, edge_table: DataFrame, entities: DataFrame, s: EntityRetrieval = EntityRetrieval()) -> DataFrame:
    """``query_id, entity_id, kind (direct | expanded), weight, via`` of a batch of queries.

    Linked entities are direct, with their best link's confidence.  Neighbours
    one edge away that are neither direct nor dates get confidence * edge *
    decay, the best over their direct neighbours; the strongest
    ``max_neighbors`` of a query stay.
    """
    direct = links.groupBy("query_id", "entity_id").agg(F.max("confidence").alias("weight"))
    first = direct.select("query_id", "entity_id", F.lit("direct").alias("kind"), "weight", F.lit(None).cast("string").alias("via"))
    if s.max_hops < 1:
        return first
    hints = queries.select("query_id", hinted_types(F.col("query")).alias("hints"))
    hop = direct.withColumnRenamed("entity_id", "src").withColumnRenamed("weight", "confidence").join(edge_table.select("src", "dst", F.col("weight").alias("edge")), "src")
    hop = hop.join(direct.select("query_id", F.col("entity_id").alias("dst")), ["query_id", "dst"], "left_anti")
    typed = hop.join(entities.where("entity_type <> 'DATE'").select(F.col("entity_id").alias("dst"), "entity_type"), "dst").join(hints, "query_id")
    decay = F.when(F.array_contains("hints", F.col("entity_type")), s.hinted_hop_decay).otherwise(s.hop_decay)
    weight = F.col("confidence") * F.col("edge") * decay
    best = typed.groupBy("query_id", "dst").agg(F.max(F.struct(weight.alias("weight"), F.col("src").alias("via"))).alias("best")).where("best.weight > 0")
    order = Window.partitionBy("query_id").orderBy(F.col("best.weight").desc(), "dst")
    kept = best.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= s.max_neighbors)
    return first.unionByName(kept.select("query_id", F.col("dst").alias("entity_id"), F.lit("expanded").alias("kind"), F.col("best.weight").alias("weight"), F.col("best.via").alias("via")))


def entity_scores(plans: DataFrame, in_chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """``query_id, chunk_id, score, matched_entities`` of chunks that hold a planned entity.

    score = 1 - (1 - direct coverage) (1 - best expansion).
    """
    total = plans.where("kind = 'direct'").groupBy("query_id").agg(F.sum("weight").alias("total"))
    names = entities.select("entity_id", F.col("canonical_name").alias("name"))
    named = plans.join(names, "entity_id").join(names.select(F.col("entity_id").alias("via"), F.col("name").alias("via_name")), "via", "left")
    label = F.when(F.col("kind") == "direct", F.col("name")).otherwise(F.concat("name", F.lit(" (via "), "via_name", F.lit(")")))
    held = named.withColumn("label", label).join(in_chunks, "entity_id").groupBy("query_id", "chunk_id").agg(
        F.sum(F.when(F.col("kind") == "direct", F.col("weight")).otherwise(0.0)).alias("direct"),
        F.max(F.when(F.col("kind") == "expanded", F.col("weight")).otherwise(0.0)).alias("expansion"),
        F.transform(F.array_sort(F.collect_list(F.struct("kind", "label"))), lambda x: x["label"]).alias("matched_entities"),
    )
    out = held.join(total, "query_id").where("total > 0")
    covered = F.least(F.lit(1.0), F.col("direct") / F.col("total"))
    return out.select("query_id", "chunk_id", (1 - (1 - covered) * (1 - F.col("expansion"))).alias("score"), "matched_entities")
