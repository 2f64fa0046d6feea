"""Query entity linking: spans of a query to entities, longest first, without overlap.

The n-grams of a query batch meet the alias index in joins, so the index may be
of any size; what is left for Arrow is the greedy choice among the matches of
one query.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewright.config import EntityRetrieval
from sievewright.functions import names as nm
from sievewright.functions.text import STOPWORDS
from sievewright.functions.udf import arrow
from sievewright.operators.extraction import Extractor, RuleExtractor, extract

MAX_NGRAM = 5
# Words that begin a question; types of spans that are reported when nothing matches.
QUESTION_WORDS = frozenset("who what which where when why how does did is are".split())
REPORTED = ("PERSON", "ORGANIZATION", "PROJECT", "EVENT", "LOCATION")
TOKEN = re.compile(r"[A-Za-z0-9][\w.&'-]*")

_GRAM = "array<struct<n: int, start: int, end: int, surface: string, key: string>>"


def grams_of(query: str) -> list[tuple[int, int, int, str, str]]:
    """``(n, start, end, surface, key)`` of all n-grams that may name something."""
    tokens = [(m.start(), m.start() + len(m[0].rstrip(".'"))) for m in TOKEN.finditer(query)]
    out = []
    for n in range(1, min(MAX_NGRAM, len(tokens)) + 1):
        for i in range(len(tokens) - n + 1):
            start, end = tokens[i][0], tokens[i + n - 1][1]
            key = nm.basic(query[start:end])
            if key and not all(t in STOPWORDS or t in QUESTION_WORDS for t in key.split()) and (n > 1 or len(key) >= 3):
                out.append((n, start, end, query[start:end], key))
    return out


@arrow(_GRAM)
def _grams(queries: pd.Series) -> pd.Series:
    return pd.Series([grams_of(q or "") for q in queries], dtype=object)


def choose(matches: list[dict], partial_confidence: float) -> list[tuple]:
    """Non-overlapping matches of one query, longest n-gram first, then names by one word.

    A match is exact or fuzzy at any length; a word that an exact match of one
    word names also brings the entities of which it is a part.
    """
    taken: list[tuple[int, int]] = []
    out = []

    def free(m: dict) -> bool:
        return not any(m["start"] < e and s < m["end"] for s, e in taken)

    for m in sorted((m for m in matches if m["ids"] or m["fuzzy_ids"]), key=lambda m: (-m["n"], m["start"])):
        if free(m):
            ids = set(m["ids"]) | (set(m["token_ids"]) if m["n"] == 1 else set()) if m["ids"] else set(m["fuzzy_ids"])
            base, method = (1.0, "exact") if m["ids"] else (0.9 * m["ratio"] / 100, "fuzzy")
            out += [(i, m["surface"], round(base / len(ids), 4), method, m["start"], m["end"]) for i in sorted(ids)]
            taken.append((m["start"], m["end"]))
    for m in sorted((m for m in matches if m["n"] == 1 and m["token_ids"]), key=lambda m: m["start"]):
        if free(m):
            ids = sorted(set(m["token_ids"]))
            out += [(i, m["surface"], round(partial_confidence / len(ids), 4), "partial", m["start"], m["end"]) for i in ids]
            taken.append((m["start"], m["end"]))
    return out


def fuzzy_matches(grams: DataFrame, exact_keys: DataFrame, threshold: float) -> DataFrame:
    """``key, alias, ratio``: the best alias of every n-gram key by the indel ratio, at or above ``threshold``.

    Strings of that ratio are at most d insertions and deletions apart, so one of
    d + 1 pieces of the key is found whole in the alias; the join is on such
    pieces.
    """
    r = threshold / 100

    @F.pandas_udf("array<string>")
    def parts(keys: pd.Series) -> pd.Series:
        out = []
        for k in keys:
            d = int(2 * (1 - r) / r * len(k)) + 1
            step = max(1, len(k) // (d + 1))
            out.append(sorted({k[i : i + step] for i in range(0, len(k) - step + 1, step)}))
        return pd.Series(out, dtype=object)

    @F.pandas_udf("array<string>")
    def substrings(keys: pd.Series) -> pd.Series:
        out = []
        for k in keys:
            sizes = set()
            for n in range(max(1, int(len(k) * r / (2 - r))), int(len(k) * (2 - r) / r) + 1):
                sizes.add(max(1, n // (int(2 * (1 - r) / r * n) + 2)))
            out.append(sorted({k[i : i + s] for s in sizes for i in range(len(k) - s + 1)}))
        return pd.Series(out, dtype=object)

    asked = grams.select("key").distinct().withColumn("piece", F.explode(parts("key")))
    held = exact_keys.select(F.col("key").alias("alias")).distinct().withColumn("piece", F.explode(substrings("alias")))
    fits = F.least(F.length("key"), F.length("alias")) * 2 >= r * (F.length("key") + F.length("alias"))
    pairs = asked.join(held, "piece").where(fits).select("key", "alias").distinct()
    rated = pairs.withColumn("ratio", nm.indel_ratio_udf("key", "alias")).where(F.col("ratio") >= threshold)
    order = Window.partitionBy("key").orderBy(F.col("ratio").desc(), "alias")
    return rated.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def link(queries: DataFrame, index: DataFrame, entities: DataFrame, s: EntityRetrieval = EntityRetrieval(), exact_only: bool = False) -> DataFrame:
    """``query_id, entity_id, canonical_name, entity_type, surface, confidence, method, start, end`` of a batch of queries."""
    grams = queries.select("query_id", F.inline(_grams("query")))
    ids = lambda name: F.array_sort(F.collect_set("entity_id")).alias(name)
    exact = index.where("index = 'exact'").groupBy("key").agg(ids("exact_ids"))
    compact = index.where("index = 'compact'").groupBy("key").agg(ids("compact_ids")).withColumnRenamed("key", "compact")
    token = index.where("index = 'token'").groupBy("key").agg(ids("token_ids"))
    rows = grams.withColumn("compact", F.replace("key", F.lit(" "), F.lit(""))).join(exact, "key", "left").join(compact, "compact", "left").join(token, "key", "left")
    rows = rows.withColumn("ids", F.coalesce("exact_ids", "compact_ids"))
    if exact_only:
        rows = rows.withColumn("fuzzy_ids", F.lit(None).cast("array<string>")).withColumn("ratio", F.lit(None).cast("double"))
    else:
        able = rows.where(F.col("ids").isNull() & (F.col("n") <= 4) & F.substring("surface", 1, 1).rlike(r"\p{Lu}") & (F.length("key") >= 5))
        best = fuzzy_matches(able, index.where("index = 'exact'"), s.fuzzy_link_threshold).join(exact.withColumnRenamed("key", "alias"), "alias")
        allowed = F.substring("surface", 1, 1).rlike(r"\p{Lu}") & (F.col("n") <= 4) & F.col("ids").isNull()
        rows = rows.join(best.select("key", F.col("exact_ids").alias("f_ids"), "ratio"), "key", "left").withColumn("fuzzy_ids", F.when(allowed, F.col("f_ids")))
    empty = F.array().cast("array<string>")
    rows = rows.withColumn("token_ids", F.coalesce("token_ids", empty)).where(F.col("ids").isNotNull() | F.col("fuzzy_ids").isNotNull() | ((F.col("n") == 1) & (F.size("token_ids") > 0)))
    match = F.struct("n", "start", "end", "surface", F.coalesce("ids", empty).alias("ids"), F.coalesce("fuzzy_ids", empty).alias("fuzzy_ids"), "token_ids", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))
    gathered = rows.groupBy("query_id").agg(F.collect_list(match).alias("matches"))  # a query's n-grams
    partial = 0.0 if exact_only else s.partial_name_confidence

    @F.pandas_udf("array<struct<entity_id: string, surface: string, confidence: double, method: string, start: int, end: int>>")
    def pick(matches: pd.Series) -> pd.Series:
        lists = ("ids", "fuzzy_ids", "token_ids")
        plain = lambda m: m | {k: list(m[k]) for k in lists}
        return pd.Series([[x for x in choose([plain(m) for m in ms], partial) if not (exact_only and x[3] == "partial")] for ms in matches], dtype=object)

    linked = gathered.select("query_id", F.inline(pick("matches"))).where(F.col("confidence") >= s.min_link_confidence)
    return linked.join(entities.select("entity_id", "canonical_name", "entity_type"), "entity_id").select("query_id", "entity_id", "canonical_name", "entity_type", "surface", "confidence", "method", "start", "end")


def unmatched(queries: DataFrame, links: DataFrame, extractors: tuple[Extractor, ...] = (RuleExtractor(),)) -> DataFrame:
    """``query_id, surface`` of named spans in queries that no link covers."""

    @F.pandas_udf("array<struct<surface: string, start: int, end: int>>")
    def named(queries: pd.Series) -> pd.Series:
        out = []
        for q in queries:
            spans = [x for x in extract(q or "", extractors) if x.kind in REPORTED and nm.basic(x.surface).split()[:1][0:1] and nm.basic(x.surface).split()[0] not in QUESTION_WORDS]
            out.append([(x.surface, x.start, x.end) for x in spans])
        return pd.Series(out, dtype=object)

    spans = queries.select("query_id", F.inline(named("query")))
    taken = links.select("query_id", F.col("start").alias("s"), F.col("end").alias("e")).distinct()
    over = spans.join(taken, "query_id").where("start < e and s < end").select("query_id", "start", "end").distinct()
    return spans.join(over, ["query_id", "start", "end"], "left_anti").select("query_id", "surface")
