"""Candidate union, per-query normalization, fusion and the final cut."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from sievewright.config import Weights
from sievewright.functions.vectors import dot
from sievewright.sources.shared import stored

#: Query vectors of up to so many rows are broadcast against the chunks.
MAX_BROADCAST_QUERIES = 10_000


def _query() -> WindowSpec:
    return Window.partitionBy("query_id")


def vector_scores(queries: DataFrame, chunks: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """``query_id, chunk_id, score``: inner products of ``queries.embedding`` and ``chunks.embedding``.

    With ``candidates``, only those pairs; chunks without an embedding have no
    score.  Without them the query batch meets every chunk and is broadcast; one
    of more than ``MAX_BROADCAST_QUERIES`` rows is an error, as ``vector_top_k``
    takes them in blocks.
    """
    own = chunks.where(F.col("embedding").isNotNull()).select("chunk_id", F.col("embedding").alias("_chunk"))
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").alias("_query"))
    if candidates is None:
        if asked.limit(MAX_BROADCAST_QUERIES + 1).count() > MAX_BROADCAST_QUERIES:
            raise ValueError(f"more than {MAX_BROADCAST_QUERIES} queries meet every chunk; vector_top_k takes them in blocks")
        pairs = own.crossJoin(F.broadcast(asked))
    else:
        pairs = candidates.select("query_id", "chunk_id").join(asked, "query_id").join(own, "chunk_id")
    return pairs.select("query_id", "chunk_id", dot(F.col("_query"), F.col("_chunk")).alias("score"))


def best_of_batches(pick: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], asked: pa.Array, k: int):
    """Maps batches of ``chunk_id, embedding, ...`` to the ``k`` best rows of each query among them: ``query_id, chunk_id, score``.

    ``pick`` gives rows of a batch and a matrix of their scores by query (not a
    number where a query does not ask for the row).  Scores equal to nine places
    tie by the smaller id.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.empty(batch.num_rows, np.int64)  # of ids in order
            place[pc.sort_indices(batch.column(0)).to_numpy()] = np.arange(batch.num_rows)
            of_query, of_row, score = [], [], []
            for rows, scores in pick(batch):
                near = np.round(scores, 9)
                for q in np.flatnonzero(~np.isnan(near).all(0)).tolist():
                    own = near[:, q]
                    some = np.flatnonzero(~np.isnan(own))
                    if len(some) > k:
                        least = np.partition(own[some], len(some) - k)[len(some) - k]
                        some = some[own[some] >= least]
                    some = some[np.lexsort((place[rows[some]], -own[some]))][:k]
                    of_query += [q] * len(some)
                    of_row += rows[some].tolist()
                    score += scores[some, q].tolist()
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(of_query, pa.int64())), batch.column(0).take(pa.array(of_row, pa.int64())), pa.array(score, pa.float64())], ["query_id", "chunk_id", "score"])

    return best


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector has ``dim`` numbers, and their vectors."""
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == dim)
    flat = pc.list_flatten(column.take(pa.array(rows)))
    return rows, flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def vector_top_k(queries: DataFrame, chunks: DataFrame, k: int, block: int = 1000) -> DataFrame:
    """The ``k`` nearest chunks of every query, exactly; scores equal to nine places tie by the smaller id.

    About ``block`` queries at a time go to the executors as a matrix; a batch of
    chunks is multiplied with it, and only its ``k`` best rows of each query
    leave the task.  Chunks without a vector of the queries' length have no score.
    """
    asked = stored(queries.where("embedding is not null").select("query_id", "embedding"), "query-vectors")
    blocks = max(1, -(-asked.count() // block))
    number = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    own = chunks.where("embedding is not null").select("chunk_id", "embedding")
    schema = f"query_id {dict(asked.dtypes)['query_id']}, chunk_id {dict(own.dtypes)['chunk_id']}, score double"
    parts = []
    for i in range(blocks):
        table = (asked.where(number == i) if blocks > 1 else asked).toArrow().combine_chunks()
        if table.num_rows:
            vectors = table.column("embedding").combine_chunks()
            dim = len(vectors[0])
            _, q = matrix(vectors, dim)
            if len(q) < table.num_rows:
                raise ValueError("the queries' vectors differ in length")

            def pick(batch: pa.RecordBatch, q=q, dim=dim) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                rows, vectors = matrix(batch.column(1), dim)
                if len(rows):
                    yield rows, vectors @ q.T

            parts.append(own.mapInArrow(best_of_batches(pick, table.column("query_id").combine_chunks(), k), schema))
    found = reduce(DataFrame.unionByName, parts) if parts else chunks.sparkSession.createDataFrame([], schema)
    return ranked(found.withColumn("_by", F.round("score", 9)), k, by="_by").drop("_by")


def ranked(scores: DataFrame, k: int | None = None, by: str = "score", tie: str = "chunk_id") -> DataFrame:
    """Ranks from 1 within each query, score descending then id; only the first ``k`` if given."""
    out = scores.withColumn("rank", F.row_number().over(_query().orderBy(F.col(by).desc(), F.col(tie))))
    return out if k is None else out.where(F.col("rank") <= k)


def union_candidates(hits: dict[str, DataFrame]) -> DataFrame:
    """One row per query and chunk with ``<source>_raw`` of each source and the sorted ``sources`` that found it."""
    parts = [
        df.select("query_id", "chunk_id", F.lit(source).alias("source"), *(F.col("score").alias(f"{s}_raw") if s == source else F.lit(None).cast("double").alias(f"{s}_raw") for s in hits))
        for source, df in hits.items()
    ]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("query_id", "chunk_id").agg(*(F.max(f"{s}_raw").alias(f"{s}_raw") for s in hits), F.array_sort(F.collect_set("source")).alias("sources"))


def backfilled(candidates: DataFrame, scores: dict[str, DataFrame], zero: tuple[str, ...] = ("lexical",)) -> DataFrame:
    """``candidates`` with raw scores a source's own top list did not give; sources in ``zero`` count as 0 where there is none."""
    out = candidates
    for source, df in scores.items():
        column = f"{source}_raw"
        out = out.join(df.select("query_id", "chunk_id", F.col("score").alias("_found")), ["query_id", "chunk_id"], "left")
        filled = F.coalesce(F.col(column), F.col("_found"), F.lit(0.0)) if source in zero else F.coalesce(F.col(column), F.col("_found"))
        out = out.withColumn(column, filled).drop("_found")
    return out


def min_max(raw: Column) -> Column:
    """Per query to [0, 1]; a flat list is 1 where positive, else 0; null stays null."""
    low, high = F.min(raw).over(_query()), F.max(raw).over(_query())
    flat = F.when(high > 0, 1.0).otherwise(0.0)
    return F.when(raw.isNull(), F.lit(None).cast("double")).when(high - low < 1e-12, flat).otherwise((raw - low) / (high - low))


def max_scaled(raw: Column) -> Column:
    """Per query by the largest value, not below 0; 0 where that is not positive."""
    high = F.max(raw).over(_query())
    return F.when(raw.isNull(), F.lit(None).cast("double")).when(high <= 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), raw / high))


def clipped(raw: Column) -> Column:
    return F.when(raw.isNull(), F.lit(None).cast("double")).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))


def normalized(raw: Column, method: str) -> Column:
    """By name: ``minmax``, ``max``, or ``none`` (clipped to [0, 1])."""
    ways = {"minmax": min_max, "max": max_scaled, "none": clipped}
    if method not in ways:
        raise ValueError(f"unknown normalization {method!r}; there are {sorted(ways)}")
    return ways[method](raw)


def weighted_fusion(candidates: DataFrame, weights: Weights) -> DataFrame:
    """``final_score``: the weighted mean of the signals' scores, missing ones as 0."""
    w = weights.normalized()
    parts = [F.coalesce(F.col(f"{s}_score"), F.lit(0.0)) * getattr(w, s) for s in ("vector", "lexical", "entity") if getattr(w, s) > 0]
    return candidates.withColumn("final_score", reduce(Column.__add__, parts))


def rrf_fusion(candidates: DataFrame, weights: Weights, k: int = 60) -> DataFrame:
    """``final_score``: weighted reciprocal ranks of the raw signals; a signal a chunk lacks adds nothing.

    A raw score of 0 counts as lacking.
    """
    w, out, parts = weights.normalized(), candidates, []
    for signal in ("vector", "lexical", "entity"):
        if getattr(w, signal) <= 0:
            continue
        raw = F.col(f"{signal}_raw")
        there = raw.isNotNull() & (raw != 0)
        place = F.row_number().over(_query().orderBy(F.coalesce(there, F.lit(False)).desc(), raw.desc(), F.col("chunk_id")))
        out = out.withColumn(f"{signal}_rank", F.when(there, place))
        parts.append(F.coalesce(getattr(w, signal) / (k + F.col(f"{signal}_rank")), F.lit(0.0)))
    return out.withColumn("final_score", reduce(Column.__add__, parts))
