"""Confidence of an answer and the decision to abstain, for a batch of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.config import Confidence

ABSTAIN_MESSAGE = "The indexed sources hold no evidence strong enough to answer this."
#: Results that count for relevance.
BEST_OF = 3


def _unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def _two(x: Column) -> Column:
    return F.format_string("%.2f", x)


def evaluate(queries: DataFrame, top: DataFrame, mode: str, lexical_hits: DataFrame | None, vector_hits: DataFrame | None, linked: DataFrame | None = None, unknown: DataFrame | None = None, s: Confidence = Confidence(), threshold: float | None = None) -> DataFrame:
    """One row per query: ``confidence, status, signals (map), reasons, gates``.

    ``top`` has ``query_id, chunk_id, document_id, rank, final_score, vector_raw,
    coverage`` of the returned results; ``*_hits`` the source lists with
    ``rank``; ``linked`` ``query_id, entity_id, weight, in_top``; ``unknown``
    ``query_id, surface``.  Signals that a mode does not have are left out and
    the weights of the others share the whole.
    """
    limit = s.threshold if threshold is None else threshold
    near, k = F.col("rank") <= BEST_OF, s.support_window
    first = F.max(F.when(F.col("rank") == 1, F.col("final_score")))
    facts = top.groupBy("query_id").agg(
        F.max(F.when(near, F.col("vector_raw"))).alias("best_cos"),
        F.max(F.when(near, F.col("coverage"))).alias("best_cov"),
        first.alias("s1"),
        F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("final_score"))), F.lit(0.0)).alias("s2"),
        F.max(F.when(F.col("rank") == 1, F.col("chunk_id"))).alias("top_chunk"),
    )
    strong = top.join(facts.select("query_id", "s1"), "query_id").where((F.col("rank") <= k) & (F.col("final_score") >= 0.8 * F.col("s1")))
    facts = facts.join(strong.groupBy("query_id").agg(F.count_distinct("document_id").alias("n_strong")), "query_id", "left")
    if mode in ("hybrid", "hybrid_entity") and lexical_hits is not None and vector_hits is not None:
        lists = lexical_hits.where(F.col("rank") <= 2 * k).select("query_id", F.col("chunk_id"), F.col("rank").alias("lr")).join(
            vector_hits.where(F.col("rank") <= 2 * k).select("query_id", "chunk_id", F.col("rank").alias("vr")), ["query_id", "chunk_id"]
        )
        shared = lists.join(facts.select("query_id", "top_chunk"), "query_id").groupBy("query_id").agg(
            (F.count_if((F.col("lr") <= k) & (F.col("vr") <= k)) / k).alias("overlap"), F.max(F.when(F.col("chunk_id") == F.col("top_chunk"), 1.0).otherwise(0.0)).alias("both")
        )
        present = lexical_hits.select("query_id").distinct().join(vector_hits.select("query_id").distinct(), "query_id")
        agreement = present.join(shared, "query_id", "left").select("query_id", (0.5 * F.coalesce("overlap", F.lit(0.0)) + 0.5 * F.coalesce("both", F.lit(0.0))).alias("agreement"))
        facts = facts.join(agreement, "query_id", "left")
    else:
        facts = facts.withColumn("agreement", F.lit(None).cast("double"))
    if mode == "hybrid_entity" and linked is not None:
        held = linked.groupBy("query_id").agg(F.sum("weight").alias("w"), F.sum(F.when(F.col("in_top"), F.col("weight")).otherwise(0.0)).alias("h"))
        facts = facts.join(held.select("query_id", F.when(F.col("w") > 0, F.col("h") / F.col("w")).otherwise(0.0).alias("entity_consistency")), "query_id", "left")
    else:
        facts = facts.withColumn("entity_consistency", F.lit(None).cast("double"))
    none = F.array().cast("array<string>")
    if mode == "hybrid_entity" and unknown is not None and s.abstain_on_unknown_entities:
        facts = facts.join(unknown.groupBy("query_id").agg(F.array_sort(F.collect_set("surface")).alias("unknown")), "query_id", "left")
    else:
        facts = facts.withColumn("unknown", F.lit(None).cast("array<string>"))

    rows = queries.select("query_id").join(facts, "query_id", "left")
    cos = _unit((F.col("best_cos") - s.vector_floor) / (s.vector_ceiling - s.vector_floor))
    parts = F.array_compact(F.array(cos, F.col("best_cov")))
    relevance = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda t, x: t + x) / F.size(parts)).otherwise(0.0)
    margin = F.when(F.col("s1") > 0, _unit((F.col("s1") - F.col("s2")) / F.col("s1"))).otherwise(0.0)
    signals = {"relevance": (relevance, s.w_relevance), "margin": (margin, s.w_margin), "agreement": (F.col("agreement"), s.w_agreement), "support": (_unit(F.col("n_strong") / 2), s.w_support), "entity_consistency": (F.col("entity_consistency"), s.w_entity)}
    rows = rows.select("query_id", "best_cos", "best_cov", "unknown", (F.col("s1").isNull()).alias("empty"), *(c.alias(f"s_{n}") for n, (c, _) in signals.items()))
    weight = sum((F.when(F.col(f"s_{n}").isNotNull(), w).otherwise(0.0) for n, (_, w) in signals.items()), F.lit(0.0))
    total = sum((F.coalesce(F.col(f"s_{n}"), F.lit(0.0)) * w for n, (_, w) in signals.items()), F.lit(0.0))
    rows = rows.withColumn("raw", F.when(F.col("empty"), 0.0).otherwise(total / weight))

    weak = (F.col("best_cos").isNull() | (F.col("best_cos") < s.min_vector_similarity)) & (F.col("best_cov").isNull() | (F.col("best_cov") < s.min_lexical_coverage))
    named = F.size(F.coalesce("unknown", none)) > 0
    low = F.col("raw") < limit
    entry = lambda i, n: F.when(F.col(f"s_{n}").isNotNull(), F.struct(F.round(f"s_{n}", 4).alias("value"), F.lit(i).alias("nth"), F.lit(n).alias("name")))
    weakest = F.slice(F.array_sort(F.array_compact(F.array(*(entry(i, n) for i, n in enumerate(signals))))), 1, 2)
    shown = F.array_join(F.transform(weakest, lambda e: F.concat(e["name"], F.lit("="), _two(e["value"]))), ", ")
    why_weak = F.concat_ws("; ", F.when(F.col("best_cos").isNotNull(), F.concat(F.lit("best cosine similarity "), _two(F.col("best_cos")), F.lit(f" < {s.min_vector_similarity}"))), F.when(F.col("best_cov").isNotNull(), F.concat(F.lit("best query-term coverage "), _two(F.col("best_cov")), F.lit(f" < {s.min_lexical_coverage}"))))
    gates = F.when(F.col("empty"), F.array(F.lit("no_results"))).otherwise(F.array_compact(F.array(F.when(weak, F.lit("weak_evidence")), F.when(named, F.lit("unknown_entity")))))
    reasons = F.when(F.col("empty"), F.array(F.lit("no candidate chunks were retrieved"))).otherwise(
        F.array_compact(F.array(
            F.when(weak, F.concat(F.lit("no chunk is close to the query ("), why_weak, F.lit(")"))),
            F.when(named, F.concat(F.lit("the query names what the corpus does not hold: "), F.array_join(F.coalesce("unknown", none), ", "))),
            F.when(low, F.concat(F.lit("confidence "), _two(F.col("raw")), F.lit(f" < threshold {limit:.2f} (weakest signals: "), shown, F.lit(")"))),
        ))
    )
    every = F.filter(F.array(
        F.struct(F.lit("vector_similarity").alias("k"), F.round("best_cos", 4).alias("v")), F.struct(F.lit("lexical_coverage").alias("k"), F.round("best_cov", 4).alias("v")),
        *(F.struct(F.lit(n).alias("k"), F.round(f"s_{n}", 4).alias("v")) for n in signals),
    ), lambda e: e["v"].isNotNull())
    status = F.when((F.size(gates) > 0) | low, "insufficient_evidence").otherwise("success")
    return rows.select("query_id", F.round("raw", 4).alias("confidence"), status.alias("status"), F.map_from_entries(F.when(F.col("empty"), F.filter(every, lambda e: F.lit(False))).otherwise(every)).alias("signals"), reasons.alias("reasons"), gates.alias("gates"))


def visible(results: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Results of the queries that succeeded; evidence of the others is hidden."""
    return results.join(outcomes.where("status = 'success'").select("query_id"), "query_id", "left_semi")
