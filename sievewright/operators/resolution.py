"""Entity resolution: harmonized types, coreference, blocking, scored pairs, constrained clusters.

All stages are joins and aggregations but one: the merging of groups by
descending score under cannot-link constraints is sequential.  As merges follow
edges only, each connected component of the edges above the threshold is
independent, so it runs once per component.
"""

from __future__ import annotations

from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewright.config import Resolution
from sievewright.functions import names as nm
from sievewright.functions.lexicons import ALIAS_OF, ORG_SUFFIXES, PERSON_TITLES
from sievewright.functions.vectors import l2_normalized
from sievewright.operators.graph import connected_components
from sievewright.sources.storage import cut

#: Types that only ever equal themselves.
EXACT_ONLY = ("DATE",)


def harmonized(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``mentions`` with the type that its name mostly has, by summed confidence; and the decisions about conflicting names."""
    keyed = mentions.withColumn("key", nm.harmony_udf("surface"))
    votes = keyed.where(~F.col("entity_type").isin(*EXACT_ONLY)).groupBy("key", "entity_type").agg(F.sum("confidence").alias("vote"), F.min("mention_id").alias("first"))
    best = Window.partitionBy("key").orderBy(F.col("vote").desc(), "first")
    chosen = votes.withColumn("nth", F.row_number().over(best)).withColumn("kinds", F.count(F.lit(1)).over(Window.partitionBy("key")))
    chosen = chosen.where("nth = 1").select("key", F.col("entity_type").alias("kind"), "kinds")
    joined = keyed.join(chosen, "key", "left")
    out = joined.withColumn("kind", F.coalesce("kind", "entity_type"))
    changed = out.where((F.col("kind") != F.col("entity_type")) & (F.col("kinds") > 1)).groupBy("key").agg(F.min_by("surface", "mention_id").alias("left"), F.first("kind").alias("entity_type"))
    said = votes.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("entity_type", F.round("vote", 3)))).alias("features"))
    decisions = changed.join(said, "key").select("left", F.col("left").alias("right"), "entity_type", F.lit(1.0).alias("score"), F.lit("type_harmonized").alias("decision"), "features", F.concat(F.lit("conflicting labels; kept "), "entity_type").alias("reason"))
    return out.drop("key", "kinds"), decisions


def coreferent(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``mention_id, gid`` of partial persons' names with exactly one full name in their document that they may stand for; and decisions."""
    people = mentions.where("kind = 'PERSON'").withColumn("tokens", nm.tokens_udf("surface", "kind")).where(F.size("tokens") > 0)
    people = people.withColumn("partial", (F.size("tokens") == 1) | (F.length(F.element_at("tokens", 1)) == 1) | nm.title_form_udf("surface"))
    full = people.where(~F.col("partial")).withColumn("gid", _gid()).groupBy("document_id", "gid").agg(F.first("tokens").alias("full"), F.max_by("surface", "mention_id").alias("right"))
    pairs = people.where("partial").join(full, "document_id").where(nm.may_be_udf("tokens", "full"))
    one = pairs.groupBy("mention_id").agg(F.count(F.lit(1)).alias("n"), F.first("gid").alias("gid"), F.first("surface").alias("left"), F.first("right").alias("right"), F.first("document_id").alias("document_id")).where("n = 1")
    decisions = one.groupBy("left", "document_id").agg(F.first("right").alias("right")).select(
        "left", "right", F.lit("PERSON").alias("entity_type"), F.lit(1.0).alias("score"), F.lit("merge").alias("decision"),
        F.create_map(F.lit("within_document"), F.lit(1.0)).alias("features"), F.lit("the only full name in the document that it can stand for").alias("reason"),
    )
    return one.select("mention_id", "gid"), decisions


def _gid() -> Column:
    return F.concat("kind", F.lit("::"), F.array_join("tokens", " "))


def surface_groups(mentions: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """One row per type and normal form: ``gid, kind, tokens, compact, surfaces (map), docs, context, technologies, partial, full``."""
    rows = mentions.withColumn("tokens", nm.tokens_udf("surface", "kind")).where(F.size("tokens") > 0).withColumn("gid", _gid())
    counts = rows.groupBy("gid", "kind", "tokens", "surface").agg(F.count(F.lit(1)).alias("n"))
    alias = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in ALIAS_OF.items()))
    counts = counts.withColumn("technology", F.element_at(alias, F.lower("surface")))
    groups = counts.groupBy("gid", "kind", "tokens").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("surface", "n")))).alias("surfaces"),
        F.max_by("surface", F.struct("n", "surface")).alias("dominant"),
        F.array_sort(F.collect_set("technology")).alias("technologies"),
    )
    groups = groups.join(rows.groupBy("gid").agg(F.collect_set("document_id").alias("docs")), "gid")
    if chunks is not None:
        parts = rows.select("gid", "chunk_id").distinct().join(chunks.where("embedding is not null").select("chunk_id", "embedding"), "chunk_id")
        means = parts.select("gid", F.posexplode("embedding").alias("i", "x")).groupBy("gid", "i").agg(F.avg("x").alias("x"))
        vectors = means.groupBy("gid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
        groups = groups.join(vectors.select("gid", l2_normalized(F.col("v")).alias("context")), "gid", "left")
    else:
        groups = groups.withColumn("context", F.lit(None).cast("array<double>"))
    partial = (F.col("kind") == "PERSON") & ((F.size("tokens") == 1) | ((F.size("tokens") == 2) & (F.length(F.element_at("tokens", 1)) == 1)))
    out = groups.withColumn("compact", F.array_join("tokens", "")).withColumn("partial", partial)
    return out.withColumn("full", (F.size("tokens") >= 2) & ~F.col("partial"))


def blocking_keys(groups: DataFrame) -> DataFrame:
    """``gid, kind, key``: a prefix, words of three letters, a person's last name and first initial, known technologies."""
    person = F.col("kind") == "PERSON"
    keys = F.concat(
        F.array(F.concat(F.lit("p:"), F.substring("compact", 1, 4))),
        F.transform(F.filter("tokens", lambda t: F.length(t) >= 3), lambda t: F.concat(F.lit("t:"), t)),
        F.when(person, F.array(F.concat(F.lit("last:"), F.element_at("tokens", -1)), F.concat(F.lit("first:"), F.substring(F.element_at("tokens", 1), 1, 1)))).otherwise(F.array().cast("array<string>")),
        F.transform("technologies", lambda t: F.concat(F.lit("kb:"), t)),
    )
    return groups.where(~F.col("kind").isin(*EXACT_ONLY)).select("gid", "kind", F.explode(F.array_distinct(keys)).alias("key"))


def candidate_pairs(groups: DataFrame, max_block: int = 200) -> DataFrame:
    """``a, b`` (gids, a < b) that share a block; blocks of more than ``max_block`` say nothing and are left out (a rule of the model)."""
    keys = blocking_keys(groups)
    useful = keys.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, max_block)).drop("n")
    kept = keys.join(useful, ["kind", "key"])
    left = kept.select("kind", "key", F.col("gid").alias("a"))
    return left.join(kept.withColumnRenamed("gid", "b"), ["kind", "key"]).where("a < b").select("a", "b").distinct()


def completions(groups: DataFrame) -> DataFrame:
    """``gid, n_completions``: different full forms a short form can grow to.

    Persons count by last name and first initial, others by their minimal sets of
    words.  A completion shares a word or, for persons, the first letter with the
    short form, so the search is an equi-join.
    """
    person = F.col("kind") == "PERSON"
    keys = F.when(person, F.array_distinct(F.array(F.element_at("tokens", -1), F.concat(F.lit("^"), F.substring(F.element_at("tokens", 1), 1, 1)), F.concat(F.lit("^"), F.substring(F.element_at("tokens", -1), 1, 1))))).otherwise(F.array_distinct("tokens"))
    short = groups.select("gid", "kind", "tokens", F.explode(keys).alias("key"))
    long = groups.where("full").select(F.col("gid").alias("g2"), "kind", F.col("tokens").alias("t2"), F.col("compact").alias("c2"), F.explode(keys).alias("key"))
    subset = (F.size(F.array_except("tokens", "t2")) == 0) & (F.size(F.array_except("t2", "tokens")) > 0)
    pairs = short.join(long, ["kind", "key"]).where("gid <> g2").where(F.when(F.col("kind") == "PERSON", nm.may_be_udf("tokens", "t2")).otherwise(subset)).select("gid", "kind", "g2", "t2", "c2").distinct()
    people = pairs.where("kind = 'PERSON'").select("gid", F.concat(F.element_at("t2", -1), F.lit(":"), F.substring(F.element_at("t2", 1), 1, 1)).alias("form"))
    other = pairs.where("kind <> 'PERSON'")
    inner = other.select("gid", F.col("t2").alias("t3"))
    smaller = (F.size(F.array_except("t3", "t2")) == 0) & (F.size(F.array_except("t2", "t3")) > 0)
    minimal = other.join(other.join(inner, "gid").where(smaller).select("gid", "g2").distinct(), ["gid", "g2"], "left_anti").select("gid", F.col("c2").alias("form"))
    return people.unionByName(minimal).groupBy("gid").agg(F.count_distinct("form").alias("n_completions"))


def scored_pairs(groups: DataFrame, pairs: DataFrame, s: Resolution = Resolution()) -> DataFrame:
    """``a, b`` with ``features (map)`` and ``score``, the log-linear probability that both name one entity."""
    side = lambda x: groups.select(*(F.col(c).alias(f"{c}_{x}") for c in ("gid", "kind", "tokens", "compact", "docs", "context", "technologies", "partial", "full", "dominant")))
    counts = cut(completions(groups))
    rows = pairs.join(side("a"), F.col("a") == F.col("gid_a")).join(side("b"), F.col("b") == F.col("gid_b"))
    person = F.col("kind_a") == "PERSON"
    n_a, n_b = F.size("tokens_a"), F.size("tokens_b")
    known = F.arrays_overlap("technologies_a", "technologies_b")
    jw = nm.jaro_winkler_udf(F.array_join("tokens_a", " "), F.array_join("tokens_b", " "))
    rows = rows.withColumn("jw", jw).withColumn("known", known)
    a_in_b, b_in_a = F.size(F.array_except("tokens_a", "tokens_b")) == 0, F.size(F.array_except("tokens_b", "tokens_a")) == 0
    proper = (a_in_b & ~b_in_a) | (b_in_a & ~a_in_b)
    a_short = F.when(F.col("partial_a") != F.col("partial_b"), F.col("partial_a")).otherwise(n_a <= n_b)
    rows = rows.withColumn("a_short", a_short)
    pick = lambda c, short: F.when(F.col("a_short") == short, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))
    rows = rows.select("*", *(pick(c, x).alias(f"{c}_{n}") for c in ("gid", "tokens", "partial", "full") for n, x in (("short", True), ("long", False))))
    both = (n_a >= 2) & (n_b >= 2)
    first_a, first_b = F.element_at("tokens_a", 1), F.element_at("tokens_b", 1)
    firsts = F.when((F.length(first_a) == 1) | (F.length(first_b) == 1), F.substring(first_a, 1, 1) == F.substring(first_b, 1, 1)).otherwise(first_a.startswith(first_b) | first_b.startswith(first_a))
    same_name = (F.element_at("tokens_a", -1) == F.element_at("tokens_b", -1)) & firsts
    mixed = F.col("partial_short") & F.col("full_long")
    rows = rows.withColumn("fits", F.when(person & mixed, nm.may_be_udf("tokens_short", "tokens_long")).otherwise(False))
    fits = person & mixed & F.col("fits")
    subset = proper | fits
    surname = person & ((both & same_name) | (fits & (F.element_at("tokens_short", -1) == F.element_at("tokens_long", -1))))
    digits = lambda c: F.array_sort(F.array_distinct(F.filter(c, lambda t: t.rlike("[0-9]"))))
    numbers = (F.size(digits("tokens_a")) > 0) & (F.size(digits("tokens_b")) > 0) & (digits("tokens_a") != digits("tokens_b"))
    conflict = (person & ((both & ~same_name) | (mixed & ~F.col("fits")))) | (~person & both & ~proper & (F.col("compact_a") != F.col("compact_b")) & (F.col("jw") < 0.9)) | numbers
    cos = F.aggregate(F.zip_with("context_a", "context_b", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    near = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cos - s.context_floor) / (s.context_ceiling - s.context_floor)))
    rows = rows.withColumn("subset", subset).withColumn("clash", conflict & ~F.col("known"))
    rows = rows.join(counts.withColumnRenamed("gid", "gid_short"), "gid_short", "left")
    may_grow = F.col("subset") & ~F.col("clash")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    features = {
        "compact_equal": flag(F.col("compact_a") == F.col("compact_b")),
        "known_alias": flag(F.col("known")),
        "string": F.round(F.greatest(F.lit(0.0), (F.col("jw") - s.string_floor) / (1 - s.string_floor)), 4),
        "surname_match": flag(surname),
        "token_subset": flag(F.col("subset")),
        "context": F.round(F.coalesce(near, F.lit(0.0)), 4),
        "doc_cooccur": flag(F.arrays_overlap("docs_a", "docs_b")),
        "unique_completion": flag(may_grow & (F.coalesce("n_completions", F.lit(0)) == 1)),
        "ambiguous_completion": flag(may_grow & (F.coalesce("n_completions", F.lit(0)) > 1)),
        "conflict": flag(F.col("clash")),
    }
    rows = rows.select("a", "b", F.col("kind_a").alias("kind"), F.col("dominant_a").alias("left"), F.col("dominant_b").alias("right"), *(v.alias(k) for k, v in features.items()))
    logit = sum((getattr(s, k) * F.col(k) for k in features), F.lit(s.bias))
    return rows.select("a", "b", "kind", "left", "right", F.create_map(*chain.from_iterable((F.lit(k), F.col(k)) for k in features)).alias("features"), (F.col("conflict") > 0).alias("conflict"), (1 / (1 + F.exp(-logit))).alias("score"))


def merge_component(pairs: list[tuple[float, str, str, bool]], threshold: float) -> tuple[dict[str, str], list[tuple[str, str, str]]]:
    """Merges pairs by descending (score, a, b) unless a cannot-link pair lies between the clusters.

    Returns each group's representative and ``(a, b, decision)`` of the pairs tried.
    """
    cannot: dict[str, set[str]] = {}
    for _, a, b, conflict in pairs:
        if conflict:
            cannot.setdefault(a, set()).add(b)
            cannot.setdefault(b, set()).add(a)
    cluster: dict[str, set[str]] = {}
    tried = []
    for score, a, b, _ in sorted(pairs, reverse=True):
        left, right = cluster.setdefault(a, {a}), cluster.setdefault(b, {b})
        if score < threshold or left is right:
            continue
        if any(not cannot.get(x, set()).isdisjoint(right) for x in left):
            tried.append((a, b, "blocked_conflict"))
            continue
        left |= right
        for x in right:
            cluster[x] = left
        tried.append((a, b, "merge"))
    return {x: min(members) for x, members in cluster.items()}, tried


def clustered(scored: DataFrame, s: Resolution = Resolution()) -> tuple[DataFrame, DataFrame]:
    """``gid, cluster`` of groups with a pair above the threshold, and ``a, b, decision`` of the merges tried."""
    strong = scored.where(F.col("score") >= s.auto_merge)
    comp = connected_components(strong.select("a", "b"))
    of_a, of_b = comp.select(F.col("node").alias("a"), F.col("comp").alias("ca")), comp.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    inside = scored.where((F.col("score") >= s.auto_merge) | F.col("conflict")).join(of_a, "a").join(of_b, "b").where("ca = cb")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        reps, tried = merge_component(list(zip(frame["score"], frame["a"], frame["b"], frame["conflict"], strict=True)), s.auto_merge)
        return pd.DataFrame([(g, r, None, None) for g, r in reps.items()] + [(None, a, b, d) for a, b, d in tried], columns=["gid", "x", "y", "decision"])

    merged = inside.select("ca", "score", "a", "b", "conflict").groupBy("ca").applyInPandas(run, "gid string, x string, y string, decision string")
    merged = cut(merged)
    return merged.where("gid is not null").select("gid", F.col("x").alias("cluster")), merged.where("gid is null").select(F.col("x").alias("a"), F.col("y").alias("b"), "decision")


def _canonical_rank() -> Column:
    """Smaller is better: no title or company ending, ``Project`` in front, frequent, long, then by code point."""
    words = F.split(F.col("basic"), " ")
    titled = (F.col("kind") == "PERSON") & F.element_at(words, 1).isin(sorted(PERSON_TITLES))
    ended = (F.col("kind") == "ORGANIZATION") & (F.size(words) > 1) & F.element_at(words, -1).isin(sorted(ORG_SUFFIXES))
    project = (F.col("kind") == "PROJECT") & F.col("surface").startswith("Project ")
    return F.struct(titled | ended, ~project, -F.col("n"), -F.length("surface"), F.col("surface"))


def entities(groups: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``entity_id, canonical_name, entity_type, aliases, surface_groups`` and the map ``gid, entity_id``."""
    rows = groups.join(clusters, "gid", "left").withColumn("cluster", F.coalesce("cluster", "gid"))
    surfaces = rows.select("cluster", "kind", "partial", "technologies", F.explode("surfaces").alias("surface", "n"))
    any_full = F.max(F.when(~F.col("partial"), 1).otherwise(0)).over(Window.partitionBy("cluster"))
    named = surfaces.withColumn("usable", (any_full == 0) | ~F.col("partial")).where("usable").groupBy("cluster", "kind", "surface").agg(F.sum("n").alias("n")).withColumn("basic", nm.basic_udf("surface"))
    best = named.groupBy("cluster", "kind").agg(F.min_by("surface", _canonical_rank()).alias("by_surface"))
    tech = surfaces.where("kind = 'TECHNOLOGY'").select("cluster", "n", F.explode("technologies").alias("technology")).groupBy("cluster", "technology").agg(F.sum("n").alias("n"))
    tech = tech.groupBy("cluster").agg(F.min_by("technology", F.struct(-F.col("n"), F.col("technology"))).alias("technology"))
    every = surfaces.groupBy("cluster").agg(F.array_sort(F.collect_set("surface")).alias("all"))
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("surface_groups"))
    out = best.join(tech, "cluster", "left").join(every, "cluster").join(sizes, "cluster").withColumn("canonical_name", F.coalesce("technology", "by_surface"))
    ident = F.concat(F.lit("ent_"), F.substring(F.sha1(F.concat("kind", F.lit(":"), nm.basic_udf("canonical_name"))), 1, 12))
    out = out.withColumn("entity_id", ident)
    table = out.select("entity_id", "canonical_name", F.col("kind").alias("entity_type"), F.array_except("all", F.array("canonical_name")).alias("aliases"), "surface_groups")
    return table, rows.select("gid", "cluster").join(out.select("cluster", "entity_id"), "cluster").select("gid", "entity_id")


def counted(assignments: DataFrame, mentions: DataFrame) -> DataFrame:
    """``entity_id, mention_count, document_count, seen`` (its surfaces)."""
    held = assignments.join(mentions.select("mention_id", "document_id", "surface"), "mention_id")
    return held.groupBy("entity_id").agg(F.count(F.lit(1)).alias("mention_count"), F.count_distinct("document_id").alias("document_count"), F.collect_set("surface").alias("seen"))


def resolve(mentions: DataFrame, chunks: DataFrame | None = None, s: Resolution = Resolution()) -> dict[str, DataFrame]:
    """``mentions (mention_id, chunk_id, document_id, surface, entity_type, confidence)`` to entities.

    Returns ``entities`` (with counts), ``assignments (mention_id, entity_id)``
    and ``decisions``.
    """
    typed, type_log = harmonized(mentions)
    typed = cut(typed)
    coref, coref_log = coreferent(typed)
    coref = cut(coref)
    free = typed.join(coref, "mention_id", "left_anti")
    groups = cut(surface_groups(free, chunks))
    scored = cut(scored_pairs(groups, cut(candidate_pairs(groups, s.max_block)), s))
    clusters, tried = clustered(scored, s)
    table, of_group = (cut(df) for df in entities(groups, clusters))
    grouped = free.withColumn("tokens", nm.tokens_udf("surface", "kind")).where(F.size("tokens") > 0).select("mention_id", _gid().alias("gid"))
    assignments = grouped.unionByName(coref).join(of_group, "gid").select("mention_id", "entity_id")
    assignments = cut(assignments)
    table = table.join(counted(assignments, typed), "entity_id").withColumn("aliases", F.array_sort(F.array_except(F.array_union("aliases", "seen"), F.array("canonical_name")))).drop("seen")
    band = scored.where(F.col("score").between(0.2, s.auto_merge) & (F.col("score") < s.auto_merge))
    kept = band.select("left", "right", F.col("kind").alias("entity_type"), F.round("score", 4).alias("score"), F.when(F.col("score") >= s.candidate, "ambiguous").otherwise("distinct").alias("decision"), "features", F.when(F.col("score") >= s.candidate, "score between the thresholds; kept apart").otherwise("score too low").alias("reason"))
    merged = scored.join(tried, ["a", "b"]).select("left", "right", F.col("kind").alias("entity_type"), F.round("score", 4).alias("score"), "decision", "features", F.when(F.col("decision") == "merge", "score above the threshold").otherwise("the merge would join names that exclude each other").alias("reason"))
    decisions = type_log.unionByName(coref_log).unionByName(kept).unionByName(merged)
    return {"entities": table, "assignments": assignments, "decisions": decisions, "groups": groups, "scored": scored}


def statistics(result: dict[str, DataFrame], mentions: DataFrame) -> DataFrame:
    """One row of counters."""
    d = result["decisions"].agg(
        F.count_if((F.col("decision") == "merge") & ~F.array_contains(F.map_keys("features"), "within_document")).alias("merged_pairs"),
        F.count_if(F.col("decision") == "ambiguous").alias("ambiguous_pairs"),
        F.count_if(F.col("decision") == "blocked_conflict").alias("blocked_conflicts"),
        F.count_if(F.col("decision") == "type_harmonized").alias("type_harmonized"),
    )
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(mentions, "mentions").crossJoin(one(result["groups"], "surface_groups")).crossJoin(one(result["entities"], "entities")).crossJoin(d)
