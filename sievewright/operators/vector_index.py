"""An approximate vector index: inverted lists by centroid.

Centroids are fitted on a sample of at most ``sample_rows`` vectors; every vector
is then put into the list of its nearest centroid, and the table is laid out by
list.  A search reads only the lists whose centroids are nearest to a query of
the batch.  More ``probes`` find more; with all lists the result is exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.operators.fusion import best_of_batches, matrix, ranked
from sievewright.sources.shared import shared_dir, stored


def centroids_of(vectors: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """Means of ``n`` clusters (fewer if there are fewer vectors), from evenly spaced first choices."""
    centers = vectors[np.linspace(0, len(vectors) - 1, min(n, len(vectors))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(vectors, centers, 1)[:, 0]
        sums = np.zeros_like(centers)
        np.add.at(sums, near, vectors)
        sizes = np.bincount(near, minlength=len(centers))
        centers = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centers)
    return centers


def nearest(vectors: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the ``n`` centers that are nearest to each vector, the nearest first."""
    distance = (centers**2).sum(1)[None, :] - 2 * vectors @ centers.T
    return np.argsort(distance, axis=1, kind="stable")[:, :n]


@dataclass
class VectorIndex:
    """``lists (chunk_id, embedding, list)`` and the centers of the lists."""

    lists: DataFrame
    centers: np.ndarray

    @classmethod
    def build(cls, chunks: DataFrame, n_lists: int = 64, sample_rows: int = 20_000, path: str | None = None) -> VectorIndex:
        """An index of all ``chunks (chunk_id, embedding)`` that have a vector; vectors are of one length."""
        spark, own = chunks.sparkSession, chunks.where("embedding is not null").select("chunk_id", "embedding")
        sample = own.where(F.pmod(F.xxhash64("chunk_id"), F.lit(4)) < 2).select("embedding").limit(sample_rows).toArrow()
        sample = sample if sample.num_rows else own.select("embedding").limit(sample_rows).toArrow()
        vectors = sample.column(0).combine_chunks()
        dim = len(vectors[0]) if len(vectors) else 0
        centers = centroids_of(matrix(vectors, dim)[1], n_lists) if dim else np.zeros((0, 0))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, v = matrix(batch.column(1), dim)
                kept = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(nearest(v, centers, 1)[:, 0], pa.int32())], ["chunk_id", "embedding", "list"])

        at = path or f"{shared_dir(spark)}/sievewright-vectors-{uuid.uuid4().hex}"
        schema = f"chunk_id {dict(own.dtypes)['chunk_id']}, embedding {dict(own.dtypes)['embedding']}, list int"
        own.mapInArrow(assign, schema).write.partitionBy("list").parquet(at)
        return cls(spark.read.schema(schema).parquet(at), centers)

    def top_k(self, queries: DataFrame, k: int, probes: int = 8, block: int = 1000) -> DataFrame:
        """``query_id, chunk_id, score, rank``: the ``k`` best of the ``probes`` lists nearest to each query, in blocks of queries."""
        asked = stored(queries.where("embedding is not null").select("query_id", "embedding"), "query-vectors")
        blocks = max(1, -(-asked.count() // block))
        number = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
        schema = f"query_id {dict(asked.dtypes)['query_id']}, chunk_id {dict(self.lists.dtypes)['chunk_id']}, score double"
        parts = []
        for i in range(blocks):
            table = (asked.where(number == i) if blocks > 1 else asked).toArrow().combine_chunks()
            if not table.num_rows or not len(self.centers):
                continue
            dim = self.centers.shape[1]
            _, q = matrix(table.column("embedding").combine_chunks(), dim)
            probed = nearest(q, self.centers, probes)
            asks = {int(c): np.flatnonzero((probed == c).any(1)) for c in np.unique(probed)}

            def pick(batch: pa.RecordBatch, q=q, asks=asks, dim=dim) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                rows, vectors = matrix(batch.column(1), dim)
                lists = batch.column(2).to_numpy()[rows]
                scores = np.full((len(rows), len(q)), np.nan)
                for c in np.unique(lists).tolist():
                    scores[np.ix_(lists == c, asks[c])] = vectors[lists == c] @ q[asks[c]].T
                if len(rows):
                    yield rows, scores

            near = self.lists.where(F.col("list").isin(sorted(asks)))  # only these folders are read
            parts.append(near.mapInArrow(best_of_batches(pick, table.column("query_id").combine_chunks(), k), schema))
        found = reduce(DataFrame.unionByName, parts) if parts else asked.sparkSession.createDataFrame([], schema)
        return ranked(found.withColumn("_by", F.round("score", 9)), k, by="_by").drop("_by")
