"""Evaluation of retrieval and of entity resolution: rank metrics, abstention, roll-ups, sweeps."""

from __future__ import annotations

import json
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewright.functions.search import holding_ids
from sievewright.functions.text import collapsed
from sievewright.sources.shared import stored


#: Rows up to which queries, strings and documents are broadcast.
MAX_BROADCAST_NEEDLES = 100_000


class EvaluationError(ValueError):
    """The dataset does not fit itself or the corpus."""


def relevance(queries: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``query_id, chunk_id`` of chunks that hold an evidence string of the query, from one of its sources.

    All strings are looked up in one pass over the chunks (see ``holding_ids``).

    ``queries`` has ``query_id, answerable, relevant_sources, evidence,
    relevant_chunk_ids``.  A chunk counts for the queries that name its
    document's file, and for every query without sources.  An evidence string
    that no chunk holds is an error.
    """
    wanted = queries.where("answerable").select("query_id", F.explode("evidence").alias("evidence"), "relevant_sources").withColumn("needle", collapsed(F.col("evidence"))).drop("evidence")
    wanted, needles = _numbered(wanted)
    texts = chunks.select("chunk_id", "document_id", collapsed(F.col("text")).alias("hay"))
    hits = holding_ids(texts, needles).join(_few(documents.select("document_id", "filename")), "document_id", "left").select("chunk_id", "filename", "needle_id")
    hits = stored(hits, "hits")
    sourced = wanted.where(F.size("relevant_sources") > 0).select("query_id", "needle_id", F.explode("relevant_sources").alias("filename"))
    free = wanted.where(F.size("relevant_sources") == 0).select("query_id", "needle_id")
    seen = hits.select("needle_id", "filename").distinct()
    held = sourced.join(seen, ["needle_id", "filename"], "left_semi").select("query_id", "needle_id").unionByName(free.join(seen, "needle_id", "left_semi"))
    lost = wanted.select("query_id", "needle_id", "needle").join(held.distinct(), ["query_id", "needle_id"], "left_anti").select("query_id", "needle").distinct().limit(5).collect()
    if lost:
        raise EvaluationError(f"no chunk holds the evidence of {[(r['query_id'], (r['needle'] or '')[:60]) for r in lost]}")
    # Sources as a set: hits dealt out by chunk are joined once and stay where they are, so the pairs need no exchange to be distinct.
    # A stated number of partitions, as hits are few beside the pairs that they make.
    n = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = F.when(F.size("relevant_sources") > 0, F.col("relevant_sources"))
    asked = wanted.where("relevant_sources is not null").select("query_id", F.col("needle_id").alias("_needle"), names.alias("_names"))
    here = (F.col("needle_id") == F.col("_needle")) & (F.col("_names").isNull() | F.array_contains("_names", F.col("filename")))
    found = hits.repartition(n, "chunk_id").join(_few(asked), here).select("query_id", "chunk_id")
    given = queries.where("answerable").select("query_id", F.explode(F.coalesce("relevant_chunk_ids", F.array().cast("array<string>"))).alias("chunk_id"))
    return (found if given.isEmpty() else found.unionByName(given)).distinct()


def _few(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to be small."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_NEEDLES else df


def _numbered(wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``wanted`` with ``needle_id``, and the different strings with theirs."""
    needles = stored(wanted.where("needle is not null").select("needle").distinct().withColumn("needle_id", F.monotonically_increasing_id()), "needles")
    return stored(wanted.join(_few(needles), "needle", "left"), "wanted"), needles


def holding(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """``query_id, needle, chunk_id`` of ``texts (chunk_id, hay)`` that hold a string of ``needles (query_id, needle)``; both collapsed."""
    wanted, strings = _numbered(needles.select("query_id", "needle"))
    return holding_ids(texts.select("chunk_id", "hay"), strings).join(_few(wanted), "needle_id").select("query_id", "needle", "chunk_id")


def rank_metrics(queries: DataFrame, results: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), ndcg_k: int = 10) -> DataFrame:
    """Per query: ``n_relevant, first_rank, rr, recall_<k>, hit_<k>, ndcg``.

    ``results`` has ``query_id, chunk_id, rank``; ``relevant`` ``query_id, chunk_id``.
    """
    marked = results.select("query_id", "chunk_id", "rank").join(relevant.select("query_id", "chunk_id").distinct().withColumn("good", F.lit(True)), ["query_id", "chunk_id"], "left")
    good = F.col("good").isNotNull()
    per = marked.groupBy("query_id").agg(
        F.min(F.when(good, F.col("rank"))).alias("first_rank"),
        *(F.count_if(good & (F.col("rank") <= k)).alias(f"n_{k}") for k in ks),
        F.sum(F.when(good & (F.col("rank") <= ndcg_k), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    sizes = relevant.select("query_id", "chunk_id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    rows = queries.select("query_id").join(sizes, "query_id", "left").join(per, "query_id", "left").withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(ndcg_k), F.greatest(F.col("n_relevant"), F.lit(1)).cast("int"))), F.lit(0.0), lambda t, i: t + 1 / F.log2(i + 1))
    some = F.col("n_relevant") > 0
    return rows.select(
        "query_id", "n_relevant", "first_rank", F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("rr"),
        *(F.when(some, F.coalesce(F.col(f"n_{k}"), F.lit(0)) / F.col("n_relevant")).otherwise(0.0).alias(f"recall_{k}") for k in ks),
        *(F.when(F.coalesce(F.col(f"n_{k}"), F.lit(0)) > 0, 1.0).otherwise(0.0).alias(f"hit_{k}") for k in ks),
        F.when(some, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg"),
    )


def abstention_columns(abstained, answerable, n=None) -> list:
    """Aggregate columns: true and false abstentions, misses, precision, recall, F1, false-abstention rate (null where undefined); a row stands for ``n``."""
    count = lambda which: F.coalesce(F.sum(F.when(which, F.lit(1) if n is None else n)), F.lit(0)).cast("long")
    tp, fp, fn = count(abstained & ~answerable), count(abstained & answerable), count(~abstained & ~answerable)
    precision, recall = tp / F.nullif(tp + fp, F.lit(0)), tp / F.nullif(tp + fn, F.lit(0))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall))
    return [
        (tp + fp).alias("abstentions"), tp.alias("correct_abstentions"), fp.alias("false_abstentions"), fn.alias("missed_abstentions"),
        F.round(precision, 4).alias("abstention_precision"), F.round(recall, 4).alias("abstention_recall"), F.round(f1, 4).alias("abstention_f1"),
        F.round(fp / F.nullif(count(answerable), F.lit(0)), 4).alias("false_abstention_rate"),
    ]


def abstention(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Abstention metrics of ``rows (abstained, answerable)`` by ``by``."""
    return rows.groupBy(*by).agg(*abstention_columns(F.col("abstained"), F.col("answerable")))


def latency(rows: DataFrame, by: tuple[str, ...] = (), column: str = "ms") -> DataFrame:
    """Mean, median and 95th percentile (linear interpolation), rounded to two places."""
    p = lambda q: F.round(F.percentile(column, q), 2)
    return rows.groupBy(*by).agg(F.round(F.avg(column), 2).alias("mean_ms"), p(0.5).alias("p50_ms"), p(0.95).alias("p95_ms"))


def rolled_up(per_query: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Means of ``metrics`` by mode, by mode and category, and by mode and split, in one pass (grouping sets)."""
    aggregates = [F.count(F.lit(1)).alias("queries"), *(F.round(F.avg(m), 4).alias(m) for m in metrics)]
    sets = [[F.col("mode")], [F.col("mode"), F.col("category")], [F.col("mode"), F.col("split")]]
    level = F.when(F.grouping("category") == 0, "category").when(F.grouping("split") == 0, "split").otherwise("mode")
    return per_query.groupingSets(sets, "mode", "category", "split").agg(level.alias("level"), *aggregates)


def threshold_sweep(rows: DataFrame, thresholds: tuple[float, ...] = tuple(round(0.3 + 0.025 * i, 3) for i in range(17))) -> DataFrame:
    """Abstention metrics of ``rows (mode, split, confidence, gated, answerable)`` at every threshold.

    Rows are counted by the number of thresholds that they reach; only these
    counts meet the thresholds.
    """
    limits = sorted(thresholds)
    reached = F.when(F.col("gated"), 0).otherwise(sum((F.when(F.col("confidence") >= t, 1).otherwise(0) for t in limits), F.lit(0)))
    counts = rows.select("mode", "split", "answerable", reached.alias("reached")).groupBy("mode", "split", "answerable", "reached").agg(F.count(F.lit(1)).alias("n"))
    grid = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(t).alias("threshold")) for i, t in enumerate(limits)))
    judged = counts.select("*", F.inline(grid))
    return judged.groupBy("mode", "split", "threshold").agg(*abstention_columns(F.col("place") >= F.col("reached"), F.col("answerable"), F.col("n")))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Per mode and split, the threshold of the best F1; ties by the lower false-abstention rate, then the lower threshold."""
    order = Window.partitionBy("mode", "split").orderBy(F.col("abstention_f1").desc_nulls_last(), F.col("false_abstention_rate").asc_nulls_last(), "threshold")
    return sweep.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def gold_assignments(gold: DataFrame, mentions: DataFrame, documents: DataFrame) -> DataFrame:
    """``gold_id, source, surface, predicted``: the entity that most mentions of a gold surface in its file have."""
    own = mentions.where("extractor <> 'header' and entity_id is not null").join(documents.select("document_id", F.col("filename").alias("source")), "document_id")
    votes = gold.join(own, ["source", "surface"], "left").groupBy("gold_id", "source", "surface", "entity_id").agg(F.count("entity_id").alias("n"))
    order = Window.partitionBy("gold_id", "source", "surface").orderBy(F.col("n").desc(), "entity_id")
    return votes.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("gold_id", "source", "surface", F.col("entity_id").alias("predicted"))


def pairwise_resolution(assigned: DataFrame) -> DataFrame:
    """Pairwise precision, recall and F1 of a clustering, from group sizes; no pairs are made.

    Rows without a prediction are alone in their cluster.
    """
    two = lambda n: n * (n - 1) / 2
    pairs = lambda df, *by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(two(F.col("n"))), F.lit(0.0)).alias("pairs"))
    predicted = assigned.where("predicted is not null")
    both = pairs(predicted, "gold_id", "predicted").withColumnRenamed("pairs", "tp")
    said = pairs(predicted, "predicted").withColumnRenamed("pairs", "said")
    true = pairs(assigned, "gold_id").withColumnRenamed("pairs", "true")
    rows = both.crossJoin(said).crossJoin(true)
    precision = F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(1.0)
    recall = F.when(F.col("true") > 0, F.col("tp") / F.col("true")).otherwise(1.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return rows.select("tp", "said", "true", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def compared(runs: dict[str, DataFrame]) -> DataFrame:
    """Summaries of several runs under their names."""
    parts = [df.withColumn("run", F.lit(name)) for name, df in runs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def provenance(folder: str | None = None) -> tuple[str | None, bool | None]:
    """The commit that results come from, and whether the tree differs from it; no commit is named for a tree that does, nor outside a repository."""
    at = folder or str(Path(__file__).resolve().parents[2])
    git = lambda *args: subprocess.run(["git", "-C", at, *args], capture_output=True, text=True, check=True, timeout=10).stdout.strip()
    try:
        dirty = bool(git("status", "--porcelain"))
        return (None if dirty else git("rev-parse", "--short", "HEAD")), dirty
    except (OSError, subprocess.SubprocessError):
        return None, None


def as_json(frames: dict[str, DataFrame]) -> str:
    """Small summaries by name as JSON."""
    return json.dumps({name: [r.asDict(recursive=True) for r in df.collect()] for name, df in frames.items()}, ensure_ascii=False, indent=2, default=str)


def markdown(summary: DataFrame, title: str) -> str:
    """A small summary as a Markdown table."""
    rows = summary.collect()
    head = summary.columns
    show = lambda x: "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x)
    lines = [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + " --- |" * len(head)]
    return "\n".join([*lines, *("| " + " | ".join(show(r[c]) for c in head) + " |" for r in rows)]) + "\n"
