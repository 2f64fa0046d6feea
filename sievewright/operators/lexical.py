"""BM25 over a postings table, for whole batches of queries.

``postings(chunk_id, term, tf, dl)`` is the inverted index; ``term_stats(term,
df)`` and ``corpus_stats(n_docs, avgdl)`` are its aggregates.  A query batch is
``query_terms(query_id, term)``.  Where its terms are counted to be few enough,
they are broadcast: the index is scanned where it lies, only matches are
aggregated and only their partial sums move.  Beyond that both sides are
shuffled by term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewright.functions import text as tx
from sievewright.sources.shared import stored


#: Query terms of up to so many rows are broadcast against the postings.
MAX_BROADCAST_TERMS = 200_000


#: Words whose terms a task remembers.
MAX_KNOWN = 1 << 20


def _indexed(stem: bool):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for batch in batches:
            rows, terms, counts, lengths = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                found: Counter[str] = Counter()
                for word, n in Counter(tx.words_in(text.as_py() or "")).items():
                    if word not in known:
                        if len(known) >= MAX_KNOWN:
                            known.clear()
                        known[word] = tx.terms_of_word(word, stem)
                    for term in known[word]:
                        found[term] += n
                rows += [i] * len(found)
                terms += found
                counts += found.values()
                lengths += [found.total()] * len(found)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(terms, pa.string()), pa.array(counts, pa.int64()), pa.array(lengths, pa.int64())], ["chunk_id", "term", "tf", "dl"])

    return index


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "search_text", stem: bool = True) -> DataFrame:
    """``chunk_id, term, tf, dl`` of all chunks.

    A chunk's counts need no other chunk, so nothing is shuffled; every word is
    taken apart (and stemmed) once a task.  Chunks have different ids.
    """
    kind = dict(chunks.dtypes)[id_col]
    rows = chunks.select(F.col(id_col).alias("chunk_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_indexed(stem), f"chunk_id {kind}, term string, tf long, dl long")


def term_stats(post: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``term, df, cf``: chunks that have a term, and its occurrences; with ``of (term)``, of these terms alone."""
    if of is not None:
        post = post.join(_few(of.select("term").distinct()), "term", "left_semi")
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _few(terms: DataFrame) -> DataFrame:
    return F.broadcast(terms) if terms.limit(MAX_BROADCAST_TERMS + 1).count() <= MAX_BROADCAST_TERMS else terms


def corpus_stats(chunks: DataFrame, post: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """One row: number of chunks and their mean length in terms (1 for an empty corpus)."""
    n = chunks.agg(F.count(F.lit(1)).alias("n_docs"))
    total = post.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    avgdl = F.when(F.col("n_docs") > 0, F.col("total") / F.col("n_docs")).otherwise(1.0)
    return n.crossJoin(total).select("n_docs", avgdl.alias("avgdl"))


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "query", stem: bool = True) -> DataFrame:
    """Distinct terms of every query."""
    rows = queries.select(F.col(id_col).alias("query_id"), F.explode(tx.query_terms(F.col(text_col))).alias("term"))
    return (tx.stemmed(rows) if stem else rows).distinct()


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def document_frequencies(terms: DataFrame, stats: DataFrame) -> DataFrame:
    """``df`` of every query term; 0 for terms the corpus lacks."""
    return terms.join(stats, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))


def unknown_terms(terms: DataFrame, stats: DataFrame) -> DataFrame:
    """Query terms that occur nowhere in the corpus."""
    return terms.join(stats, "term", "left_anti")


def weighted_terms(terms: DataFrame, stats: DataFrame, corpus: DataFrame) -> DataFrame:
    """``query_id, term, df, idf, n_docs, avgdl`` of a batch; ``corpus`` has one row."""
    return document_frequencies(terms, stats.select("term", "df")).crossJoin(F.broadcast(corpus)).withColumn("idf", idf(F.col("n_docs"), F.col("df")))


def bm25_scores(terms: DataFrame, post: DataFrame, stats: DataFrame, corpus: DataFrame, k1: float = 1.2, b: float = 0.75, candidates: DataFrame | None = None) -> DataFrame:
    """``query_id, chunk_id, score`` of all chunks that share a term with the query.

    ``candidates (query_id, chunk_id)`` restricts the chunks scored.
    """
    matched = post.join(_few(stored(weighted_terms(terms, stats, corpus), "query-terms")), "term")
    if candidates is not None:
        matched = matched.join(candidates, ["query_id", "chunk_id"], "left_semi")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return matched.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))


def ts_rank_scores(terms: DataFrame, post: DataFrame) -> DataFrame:
    """The ablation scorer without idf: a tenth for every occurrence of a query term."""
    return post.join(_few(terms), "term").groupBy("query_id", "chunk_id").agg((F.sum("tf") * 0.1).alias("score"))


def top_k(scores: DataFrame, k: int, by: str = "score", tie: str = "chunk_id") -> DataFrame:
    """The ``k`` best rows of every query with their ``rank``; ties by the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.col(by).desc(), F.col(tie))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def coverage(candidates: DataFrame, terms: DataFrame, post: DataFrame, stats: DataFrame, corpus: DataFrame) -> DataFrame:
    """Share of a query's idf that a candidate chunk holds: ``query_id, chunk_id, coverage``; 0 for queries without terms."""
    weighted = stored(weighted_terms(terms, stats, corpus).select("query_id", "term", F.col("idf").alias("w")), "query-terms")
    totals = weighted.groupBy("query_id").agg(F.sum("w").alias("all"))
    pairs = stored(candidates.select("query_id", "chunk_id").distinct(), "candidates")
    held = post.select("chunk_id", "term").join(_few(weighted), "term").join(_few(pairs), ["query_id", "chunk_id"])
    held = held.groupBy("query_id", "chunk_id").agg(F.sum("w").alias("held"))
    out = pairs.join(held, ["query_id", "chunk_id"], "left").join(totals, "query_id", "left")
    return out.select("query_id", "chunk_id", F.when(F.col("all") > 0, F.coalesce("held", F.lit(0.0)) / F.col("all")).otherwise(0.0).alias("coverage"))
