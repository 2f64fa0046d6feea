"""Answers made of the evidence's own sentences, with citations that are checked."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewright.config import Generation
from sievewright.functions.text import sentences
from sievewright.functions.udf import arrow
from sievewright.functions.vectors import Embedder, HashingEmbedder, dot, embedded
from sievewright.operators.confidence import ABSTAIN_MESSAGE


class Generator(Protocol):
    """``evidence (query_id, query, marker, text)`` to ``query_id, answer``."""

    def answers(self, evidence: DataFrame) -> DataFrame: ...


@arrow("array<string>")
def _sentences(texts: pd.Series) -> pd.Series:
    return pd.Series([[s for s in sentences(t or "")] for t in texts], dtype=object)


class ExtractiveGenerator:
    """The sentences nearest to the query, each with its source's marker ``[n]``.

    Sentences of ``min_words`` words or more; the best is always given, further
    ones (up to ``max_sentences``) from ``min_similarity`` on.
    """

    def __init__(self, embedder: Embedder | None = None, s: Generation = Generation()):
        self.embedder, self.s = embedder or HashingEmbedder(), s

    def answers(self, evidence: DataFrame) -> DataFrame:
        rows = evidence.select("query_id", "query", "marker", F.posexplode(_sentences("text")).alias("place", "sentence"))
        rows = rows.where(F.size(F.split(F.trim("sentence"), r"\s+")) >= self.s.min_words)
        asked = evidence.select("query_id", "query").distinct().withColumn("q", embedded(self.embedder, F.col("query")))
        rated = rows.join(asked.select("query_id", "q"), "query_id").withColumn("similarity", dot(F.col("q"), embedded(self.embedder, F.col("sentence"))))
        order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "marker", "place")
        best = rated.withColumn("nth", F.row_number().over(order)).where((F.col("nth") == 1) | ((F.col("nth") <= self.s.max_sentences) & (F.col("similarity") >= self.s.min_similarity)))
        cited = F.concat(F.trim("sentence"), F.format_string(" [%d]", F.col("marker").cast("int")))
        said = best.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", cited.alias("s")))), lambda x: x["s"]), " ").alias("answer"))
        return evidence.select("query_id").distinct().join(said, "query_id", "left").select("query_id", F.coalesce("answer", F.lit("")).alias("answer"))


class GenerationError(RuntimeError):
    """The language model did not answer."""


def http_completion(url: str, model: str, timeout: float = 60.0) -> Callable[[str], str]:
    """A completion by a server that takes ``model, prompt, stream, options`` as JSON and gives ``response``."""

    def complete(text: str) -> str:
        body = json.dumps({"model": model, "prompt": text, "stream": False, "options": {"temperature": 0}}).encode()
        try:
            with urlopen(Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as reply:
                said = json.loads(reply.read()).get("response", "").strip()
        except (OSError, ValueError) as e:
            raise GenerationError(f"no completion from {url}: {e}") from e
        if not said:
            raise GenerationError(f"an empty completion from {url}")
        return said

    return complete


class PromptedGenerator:
    """Answers of a language model: ``complete`` gives the text for a prompt, on the executors, one query after the other."""

    def __init__(self, complete: Callable[[str], str]):
        self.complete = complete

    def answers(self, evidence: DataFrame) -> DataFrame:
        complete = self.complete

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame({"query_id": f["query_id"], "answer": [complete(p) for p in f["prompt"]]})

        asked = prompt(evidence)
        return asked.mapInPandas(run, f"query_id {dict(asked.dtypes)['query_id']}, answer string")


def generator_by_name(name: str, embedder: Embedder | None = None, url: str | None = None, model: str | None = None, s: Generation = Generation()) -> Generator:
    """``extractive``, or ``http`` with the address and model of a server."""
    if name == "extractive":
        return ExtractiveGenerator(embedder, s)
    if name == "http" and url and model:
        return PromptedGenerator(http_completion(url, model))
    raise ValueError(f"no generator {name!r} with url {url!r} and model {model!r}")


def cited_markers(answer):
    """The numbers in ``[n]``, each once, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda m: m.cast("int"))))


def prompt(evidence: DataFrame) -> DataFrame:
    """``query_id, prompt`` for a language model: the question and the numbered sources."""
    line = F.concat(F.lit("["), F.col("marker").cast("string"), F.lit("] ("), "source", F.lit(") "), "text")
    listed = evidence.groupBy("query_id", "query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("marker", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("sources"))
    return listed.select("query_id", F.concat(F.lit("Answer the question from the numbered sources alone and cite them as [n].\n\nSources:\n"), "sources", F.lit("\n\nQuestion: "), "query", F.lit("\nAnswer:")).alias("prompt"))


def answered(outcomes: DataFrame, results: DataFrame, generator: Generator | None = None, s: Generation = Generation()) -> DataFrame:
    """``query_id, status, answer, cited, unsupported`` of a batch.

    Only queries that succeeded reach the generator, with their first
    ``max_evidence`` results; markers beyond the evidence are unsupported.
    """
    good = outcomes.where("status = 'success'").select("query_id", "query")
    evidence = results.where(F.col("rank") <= s.max_evidence).join(good, "query_id").select("query_id", "query", F.col("rank").alias("marker"), F.col("filename").alias("source"), "text")
    said = (generator or ExtractiveGenerator(s=s)).answers(evidence)
    sizes = evidence.groupBy("query_id").agg(F.max("marker").alias("n"))
    marks = cited_markers(F.col("answer"))
    rows = outcomes.select("query_id", "status").join(said, "query_id", "left").join(sizes, "query_id", "left").withColumn("marks", F.coalesce(marks, F.array().cast("array<int>")))
    ok = lambda m: (m >= 1) & (m <= F.coalesce(F.col("n"), F.lit(0)))
    return rows.select(
        "query_id", "status", F.when(F.col("status") == "success", F.col("answer")).otherwise(ABSTAIN_MESSAGE).alias("answer"),
        F.filter("marks", ok).alias("cited"), F.filter("marks", lambda m: ~ok(m)).alias("unsupported"),
    )
