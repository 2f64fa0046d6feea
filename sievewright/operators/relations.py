"""Relationships between entities in one sentence or record.

Units, anchors and their pairs are joins; only the trigger patterns of a pair
are tried in an Arrow function, once per pair.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewright.functions.text import sentence_spans

# Source type, target type, relation, triggers.
PATTERNS = (
    ("PERSON", "PROJECT", "works_on", (
        "leads", "led by", "lead", "leading", "works on", "working on", "worked on", "owns", "owner", "maintains", "maintainer", "contributes",
        "contributor", "assigned", "assignee", "building", "builds", "drives", "driving", "manages", "managing", "heads", "tech lead", "tech_lead",
        "joined", "oversees", "responsible for", "author", "project", "projects", "on the", "pm", "engineer", "sponsor", "sponsored by",
        "product manager", "runs", "run",
    )),
    ("PERSON", "ORGANIZATION", "affiliated_with", (
        "at", "joined", "joins", "works for", "working for", "employed", "employee", "ceo", "cto", "vp", "director", "head of", "engineer",
        "scientist", "from", "of", "organization", "company", "employer", "hired", "moved to", "founder", "co-founder", "contact", "account",
        "manager", "leaves", "left",
    )),
    ("PROJECT", "TECHNOLOGY", "uses", (
        "uses", "use", "using", "used", "built on", "built with", "runs on", "running on", "migrated to", "migrating to", "migrate to",
        "powered by", "written in", "adopted", "adopts", "relies on", "backed by", "stores", "on top of", "stack", "deployed on", "integrates",
        "chose", "choose", "selected", "replaced", "moved to", "via", "with", "serves", "technologies",
    )),
    ("ORGANIZATION", "PROJECT", "owns", (
        "develops", "developed", "launched", "owns", "runs", "funds", "funded", "sponsors", "built", "building", "internal", "initiative",
        "project", "team", "organization", "'s",
    )),
    ("ORGANIZATION", "LOCATION", "located_in", ("based in", "headquartered", "office", "offices", "located", "hq", "depot", "site", "in")),
    ("PERSON", "LOCATION", "located_in", ("based in", "located", "relocated", "lives in", "works from", "office", "location", "in")),
    ("ORGANIZATION", "ORGANIZATION", "partners_with", ("customer", "client", "vendor", "partner", "partnership", "contract", "supplier", "acquired")),
    ("PERSON", "EVENT", "participates_in", (
        "attended", "attend", "attending", "presented", "presenting", "speaker", "spoke", "hosted", "organized", "organizer", "keynote", "session",
    )),
)
# Confidences by method, entities in a unit up to which co-occurrence counts, types that take no part.
BETWEEN, RECORD, SENTENCE, COOCCURRENCE, CONTEXT = 0.85, 0.75, 0.65, 0.35, 0.52
MAX_COOCCURRING = 6
SKIPPED = ("DATE",)
EVIDENCE_CHARS = 500


def trigger_pattern(triggers: tuple[str, ...]) -> re.Pattern:
    """Whole triggers in either case, the longest first."""
    return re.compile(r"(?<!\w)(?:" + "|".join(re.escape(t) for t in sorted(triggers, key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)


_TRIGGERS = {(source, target): (relation, trigger_pattern(triggers)) for source, target, relation, triggers in PATTERNS}


def classify(kind_a: str, kind_b: str, sentence: str, between: str | None, mode: str, n_entities: int) -> tuple[bool, str, float, str] | None:
    """``(swapped, relation, confidence, method)`` of a pair: which way the types' pattern points, and how near its trigger stands.

    ``mode`` is text, record, or context (the first entity stands in the header).
    """
    for swapped, key in ((False, (kind_a, kind_b)), (True, (kind_b, kind_a))):
        if key not in _TRIGGERS:
            continue
        relation, pattern = _TRIGGERS[key]
        if mode == "text" and pattern.search(between or ""):
            return swapped, relation, BETWEEN, "pattern_between"
        if pattern.search(sentence):
            return swapped, relation, *{"text": (SENTENCE, "pattern_sentence"), "record": (RECORD, "record"), "context": (CONTEXT, "context")}[mode]
        break
    return None if mode == "context" or n_entities > MAX_COOCCURRING else (None, "related_to", COOCCURRENCE, "cooccurrence")


def units(chunks: DataFrame) -> DataFrame:
    """``chunk_id, unit_start, unit_end, sentence, is_record``: sentences, or the whole of a record or header chunk."""

    @F.pandas_udf("array<struct<unit_start: int, unit_end: int>>")
    def spans(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([[(0, len(t))] if k in ("record", "header") else sentence_spans(t) or [(0, len(t))] for t, k in zip(texts, kinds, strict=True)], dtype=object)

    kind = F.coalesce(F.element_at("metadata", F.lit("kind")), F.lit(""))
    rows = chunks.select("chunk_id", "text", kind.alias("kind"), F.inline(spans("text", kind)))
    return rows.select("chunk_id", "unit_start", "unit_end", F.substring("text", F.col("unit_start") + 1, F.col("unit_end") - F.col("unit_start")).alias("sentence"), (F.col("kind") == "record").alias("is_record"))


def relationships(chunks: DataFrame, mentions: DataFrame, entities: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """All relationships of all chunks, the best of each source, target, relation and chunk.

    ``mentions`` have ``entity_id``; ``header (chunk_id, entity_id)`` are entities
    named by the chunk's title or section path.
    """
    kinds = entities.where(~F.col("entity_type").isin(*SKIPPED)).select("entity_id", "entity_type")
    anchors = mentions.where("entity_id is not null").join(kinds.withColumnRenamed("entity_type", "kind"), "entity_id").select("chunk_id", "entity_id", "kind", "char_start", "char_end", "mention_id")
    placed = units(chunks).join(anchors, "chunk_id").where("unit_start <= char_start and char_start < unit_end")
    per_unit = placed.groupBy("chunk_id", "unit_start").agg(F.count_distinct("entity_id").alias("n_entities"))
    placed = placed.join(per_unit, ["chunk_id", "unit_start"])
    texts = chunks.select("chunk_id", "text")

    right = placed.select("chunk_id", "unit_start", F.col("entity_id").alias("eb"), F.col("kind").alias("kb"), F.col("char_start").alias("sb"), F.col("char_end").alias("xb"), F.col("mention_id").alias("mb"))
    pairs = placed.join(right, ["chunk_id", "unit_start"]).where("entity_id <> eb and (char_start < sb or (char_start = sb and mention_id < mb))").join(texts, "chunk_id")
    between = F.when(F.col("char_end") < F.col("sb"), F.substring("text", F.col("char_end") + 1, F.col("sb") - F.col("char_end"))).otherwise("")
    pairs = pairs.select("chunk_id", "unit_start", "sentence", F.col("entity_id").alias("ea"), F.col("kind").alias("ka"), "eb", "kb", between.alias("between"), F.when(F.col("is_record"), "record").otherwise("text").alias("mode"), "n_entities", F.struct(F.lit(0), F.col("char_start"), F.col("sb")).alias("seq"))
    if header is not None:
        inside = placed.select("chunk_id", "unit_start", "entity_id").distinct()
        named = header.select("chunk_id", "entity_id").distinct().join(kinds, "entity_id").select("chunk_id", F.col("entity_id").alias("hc"), F.col("entity_type").alias("hk"))
        context = placed.join(named, "chunk_id").join(inside.withColumnRenamed("entity_id", "hc"), ["chunk_id", "unit_start", "hc"], "left_anti")
        pairs = pairs.unionByName(
            context.select("chunk_id", "unit_start", "sentence", F.col("hc").alias("ea"), F.col("hk").alias("ka"), F.col("entity_id").alias("eb"), F.col("kind").alias("kb"), F.lit("").alias("between"), F.lit("context").alias("mode"), "n_entities", F.struct(F.lit(1), F.col("char_start"), F.col("char_start").alias("sb")).alias("seq"))
        )

    @F.pandas_udf("struct<swapped: boolean, relation: string, confidence: double, method: string>")
    def judge(ka: pd.Series, kb: pd.Series, sentence: pd.Series, between: pd.Series, mode: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = [classify(*x) or (None, None, None, None) for x in zip(ka, kb, sentence, between, mode, n, strict=True)]
        return pd.DataFrame(rows, columns=["swapped", "relation", "confidence", "method"])

    judged = pairs.withColumn("r", judge("ka", "kb", "sentence", "between", "mode", "n_entities")).where("r.relation is not null")
    first = F.when(F.col("r.swapped").isNull(), F.least("ea", "eb")).when(F.col("r.swapped"), F.col("eb")).otherwise(F.col("ea"))
    second = F.when(F.col("r.swapped").isNull(), F.greatest("ea", "eb")).when(F.col("r.swapped"), F.col("ea")).otherwise(F.col("eb"))
    rows = judged.select("chunk_id", "unit_start", "seq", first.alias("source_entity_id"), second.alias("target_entity_id"), F.col("r.relation").alias("relationship_type"), F.col("r.confidence").alias("confidence"), F.col("r.method").alias("method"), F.substring(F.trim("sentence"), 1, EVIDENCE_CHARS).alias("evidence"))
    order = Window.partitionBy("chunk_id", "source_entity_id", "target_entity_id", "relationship_type").orderBy(F.col("confidence").desc(), "unit_start", "seq")
    best = rows.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    ident = F.concat(F.lit("rel_"), F.substring(F.sha1(F.concat_ws("|", "source_entity_id", "target_entity_id", "relationship_type", "chunk_id")), 1, 16))
    return best.select(ident.alias("relationship_id"), "source_entity_id", "target_entity_id", "relationship_type", "confidence", F.col("chunk_id").alias("supporting_chunk_id"), "evidence", "method")
