"""The engine: ingest, entity rebuild, search, answers and evaluation over one table store.

Everything takes and returns DataFrames; a query is a row of a batch
(``query_id, query``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.config import MODES, Settings, Weights
from sievewright.functions.vectors import Embedder, HashingEmbedder, embedded
from sievewright.operators import confidence, evaluation, extraction, fusion, generation, graph, lexical, linking, relations, resolution
from sievewright.sources import ingest, parsers
from sievewright.sources.storage import TableStore, cut


@dataclass
class Outcome:
    """``results`` (one row per query and rank) and ``outcomes`` (one row per query)."""

    results: DataFrame
    outcomes: DataFrame


def header_mentions(chunks: DataFrame, index: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities that a chunk's title or section path names exactly and alone; no dates."""
    header = F.trim(F.substring("search_text", F.lit(1), F.length("search_text") - F.length("text")))
    heads = chunks.select("chunk_id", "document_id", header.alias("query")).where("query <> ''")
    distinct = heads.select(F.col("query").alias("query_id"), "query").distinct()
    found = linking.link(distinct, index, entities, exact_only=True).where("confidence >= 1.0 and entity_type <> 'DATE'")
    one = found.groupBy("query_id", "entity_id", "entity_type").agg(F.min_by("surface", "start").alias("surface"), F.min("start").alias("start"))
    rows = heads.join(one, heads["query"] == one["query_id"])
    ident = F.concat("chunk_id", F.lit(":h"), F.substring("entity_id", 5, 12))
    return rows.select(ident.alias("mention_id"), "chunk_id", "document_id", "surface", "entity_type", F.lit(0).alias("char_start"), F.lit(0).alias("char_end"), F.lit("header").alias("extractor"), F.lit(1.0).alias("confidence"), "entity_id")


class Engine:
    """All operations on the tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings(), embedder: Embedder | None = None, extractors: tuple = (extraction.RuleExtractor(),)):
        self.spark, self.store, self.s = spark, TableStore(spark, root), settings
        self.embedder = embedder or HashingEmbedder(settings.embedding_dim)
        self.extractors = extractors

    # Ingest

    def ingest(self, files: DataFrame, read_pdf=parsers.read_pdf, rebuild: bool = True) -> DataFrame:
        """Adds new files; returns ``filename, document_id, status (indexed | duplicate | error), error`` of each."""
        rows = cut(ingest.parsed(files, self.s, read_pdf))
        fresh = cut(ingest.without_known(rows, self.store.read("documents")))
        chunks = cut(ingest.chunks_of(fresh, self.embedder))
        self.store.append_all(
            {
                "documents": ingest.documents_of(fresh),
                "chunks": chunks,
                "mentions": extraction.mentions(chunks, self.extractors).withColumn("entity_id", F.lit(None).cast("string")),
                "postings": lexical.postings(chunks, stem=self.s.use_stems),
            }
        )
        self.refresh_statistics()
        if rebuild:
            self.rebuild_entities()
        known = fresh.where("error is null").select("filename", "content_hash").distinct().withColumn("new", F.lit(True))
        first = F.row_number().over(_by_file())
        out = rows.join(known, ["filename", "content_hash"], "left").withColumn("nth", first)
        status = F.when(F.col("error").isNotNull(), "error").when(F.col("new").isNotNull() & (F.col("nth") == 1), "indexed").otherwise("duplicate")
        return out.select("filename", "document_id", status.alias("status"), "error")

    def ingest_directory(self, path: str, **options) -> DataFrame:
        return self.ingest(ingest.read_directory(self.spark, path), **options)

    def bootstrap(self, path: str, **options) -> bool:
        """Ingests a folder if the index is empty; tells whether it did."""
        if not self.store.read("documents").isEmpty():
            return False
        self.ingest_directory(path, **options)
        return True

    def refresh_statistics(self) -> None:
        """The aggregates of the inverted index; postings come and go with their chunks."""
        chunks, post = self.store.read("chunks"), self.store.read("postings")
        self.store.replace_all({"term_stats": lexical.term_stats(post), "corpus_stats": lexical.corpus_stats(chunks, post)})

    def documents(self, limit: int = 100) -> DataFrame:
        """The newest documents, without their texts."""
        return self.store.read("documents").drop("text").orderBy(F.col("created_at").desc(), "document_id").limit(limit)

    def document(self, document_id: str) -> dict[str, DataFrame]:
        """A document and its chunks in order, without their vectors."""
        own = F.col("document_id") == document_id
        return {"document": self.store.read("documents").where(own), "chunks": self.store.read("chunks").where(own).drop("embedding").orderBy("chunk_index")}

    def delete(self, document_ids: DataFrame) -> None:
        self.store.delete_documents(document_ids)
        self.refresh_statistics()
        self.rebuild_entities()

    def reset(self) -> None:
        self.store.reset()

    # Entities

    def rebuild_entities(self) -> None:
        """Names, clusters, header mentions and relationships of the whole corpus, anew."""
        chunks = self.store.read("chunks")
        base = self.store.read("mentions").where("extractor not in ('known_name', 'header')").drop("entity_id")
        known = extraction.known_name_mentions(chunks, base, extraction.known_names(base))
        mentions = cut(base.unionByName(known))
        found = resolution.resolve(mentions, chunks, self.s.resolution)
        entities, assigned = cut(found["entities"]), found["assignments"]
        placed = cut(mentions.join(assigned, "mention_id", "left"))
        header = cut(header_mentions(chunks, graph.alias_index(entities), entities)) if self.s.entity_retrieval.header_context else None
        related = cut(relations.relationships(chunks, placed, entities, header))
        decisions = cut(found["decisions"])
        everyone = placed if header is None else placed.unionByName(header)
        # Edges and names to look up are made once here, not by every search.
        derived = {"edges": graph.edges(related, entities), "alias_index": graph.alias_index(entities)}
        self.store.replace_all({"mentions": everyone, "entities": entities, "relationships": related, "decisions": decisions} | derived)

    def resolve(self, mentions: DataFrame) -> dict[str, DataFrame]:
        """Resolution of given mentions alone, without touching the tables."""
        return resolution.resolve(mentions, None, self.s.resolution)

    def entity_list(self, kind: str | None = None, contains: str | None = None, limit: int = 100) -> DataFrame:
        return graph.listed_entities(self.store.read("entities"), kind, contains, limit)

    def entity_graph(self, min_weight: float = 0.0, limit: int = 200) -> DataFrame:
        return graph.listed_edges(self.store.read("edges"), min_weight, limit)

    def entity_detail(self, entity_id: str, limit: int = 200) -> dict[str, DataFrame]:
        """The entity, its mentions with what stands around them, and its relationships with names."""
        entities, own = self.store.read("entities"), F.col("entity_id") == entity_id
        related = self.store.read("relationships").where((F.col("source_entity_id") == entity_id) | (F.col("target_entity_id") == entity_id))
        mentions = graph.in_context(self.store.read("mentions").where(own), self.store.read("chunks"))
        return {
            "entity": entities.where(own),
            "mentions": mentions.orderBy("document_id", "chunk_id", "mention_id").limit(limit),
            "relationships": graph.named_relationships(related, entities).orderBy(F.col("confidence").desc(), "relationship_type").limit(limit),
        }

    # Search

    def search(self, queries: DataFrame, mode: str = "hybrid_entity", top_k: int | None = None, weights: Weights | None = None, threshold: float | None = None, pool: int | None = None) -> Outcome:
        """Ranked evidence of every query, and whether it suffices."""
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}; there are {MODES}")
        r = self.s.retrieval
        w = (weights or r.weights(mode)).for_mode(mode)
        top_k, pool = top_k or r.top_k, pool or r.candidate_pool
        queries = cut(queries.select("query_id", F.trim("query").alias("query")))
        if not queries.where("query is null or query = ''").isEmpty():
            raise ValueError("a query is empty")
        chunks, documents = self.store.read("chunks"), self.store.read("documents")
        post, stats, corpus = (self.store.read(n) for n in ("postings", "term_stats", "corpus_stats"))

        hits: dict[str, DataFrame] = {}
        terms = cut(lexical.query_terms(queries, stem=self.s.use_stems))
        if w.lexical > 0:
            scores = lexical.bm25_scores(terms, post, stats, corpus, r.k1, r.b) if r.lexical_scorer == "bm25" else lexical.ts_rank_scores(terms, post)
            lexical_scores = cut(scores)
            hits["lexical"] = cut(lexical.top_k(lexical_scores, pool))
        if w.vector > 0:
            asked = cut(queries.withColumn("embedding", embedded(self.embedder, F.col("query"))))
            hits["vector"] = cut(fusion.vector_top_k(asked, chunks, pool))
        plans = unknown = None
        if w.entity > 0:
            entities, mentions = self.store.read("entities"), self.store.read("mentions")
            links = cut(linking.link(queries, self.store.read("alias_index"), entities, self.s.entity_retrieval))
            plans = cut(graph.plan(queries, links, self.store.read("edges"), entities, self.s.entity_retrieval))
            in_chunks = graph.chunk_entities(mentions, entities)
            entity_scores = cut(graph.entity_scores(plans, in_chunks, entities))
            hits["entity"] = lexical.top_k(entity_scores.where("score > 0"), pool)
            spans = linking.unmatched(queries, links, self.extractors)
            keyed = spans.withColumn("span", F.concat_ws("\x00", "query_id", "surface"))
            odd = lexical.unknown_terms(lexical.query_terms(keyed.select(F.col("span").alias("query_id"), F.col("surface").alias("query")), stem=self.s.use_stems), stats)
            unknown = cut(keyed.join(odd.select(F.col("query_id").alias("span")).distinct(), "span", "left_semi").select("query_id", "surface"))

        candidates = cut(fusion.union_candidates(hits))
        fills = {}
        if w.lexical > 0:
            fills["lexical"] = lexical_scores
        if w.vector > 0:
            fills["vector"] = fusion.vector_scores(asked, chunks, candidates)
        if w.entity > 0:
            fills["entity"] = entity_scores
        filled = fusion.backfilled(candidates, fills, zero=("lexical", "entity"))
        for signal in hits:
            raw = F.col(f"{signal}_raw")
            filled = filled.withColumn(f"{signal}_score", raw if signal == "entity" else fusion.normalized(raw, r.normalization))
        fused = fusion.rrf_fusion(filled, w, r.rrf_k) if r.fusion == "rrf" else fusion.weighted_fusion(filled, w)
        top = cut(fusion.ranked(fused, top_k, by="final_score"))
        for signal in ("vector", "lexical", "entity"):
            for column in (f"{signal}_raw", f"{signal}_score"):
                if column not in top.columns:
                    top = top.withColumn(column, F.lit(None).cast("double"))

        placed = top.join(chunks.drop("embedding"), "chunk_id").join(documents.select("document_id", "filename", "source_type", "title"), "document_id", "left")
        if w.lexical > 0:
            near = top.where(F.col("rank") <= confidence.BEST_OF)
            placed = placed.join(lexical.coverage(near, terms, post, stats, corpus), ["query_id", "chunk_id"], "left")
        else:
            placed = placed.withColumn("coverage", F.lit(None).cast("double"))
        linked = None
        if plans is not None:
            seen = top.where(F.col("rank") <= confidence.BEST_OF).join(in_chunks, "chunk_id").select("query_id", "entity_id").distinct().withColumn("in_top", F.lit(True))
            linked = plans.where("kind = 'direct'").join(seen, ["query_id", "entity_id"], "left").select("query_id", "entity_id", "weight", F.col("in_top").isNotNull().alias("in_top"))
            placed = placed.join(entity_scores.select("query_id", "chunk_id", "matched_entities"), ["query_id", "chunk_id"], "left")
        else:
            placed = placed.withColumn("matched_entities", F.lit(None).cast("array<string>"))
        placed = cut(placed)
        outcomes = confidence.evaluate(queries, placed, mode, hits.get("lexical"), hits.get("vector"), linked, unknown, self.s.confidence, threshold)
        considered = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates_considered"))
        outcomes = queries.join(outcomes, "query_id").join(considered, "query_id", "left").withColumn("mode", F.lit(mode))
        four = lambda c, name=None: F.round(c, 4).alias(name or c)
        results = placed.select(
            "query_id", "rank", "chunk_id", "document_id", "filename", "source_type", "title", "chunk_index", "text", "char_start", "char_end",
            F.map_filter("metadata", lambda k, v: k.isin("heading_path", "section", "page_start", "page_end", "json_path", "record_index")).alias("location"), "metadata",
            four("vector_score"), four("lexical_score"), four("entity_score"), four("vector_raw", "vector_similarity"), four("lexical_raw"), four("final_score"),
            F.col("sources").alias("retrieved_by"), "matched_entities",
        )
        return Outcome(results, outcomes)

    def visible(self, found: Outcome, show_evidence: bool = False) -> DataFrame:
        """Results of queries that succeeded; of all if asked for."""
        return found.results if show_evidence else confidence.visible(found.results, found.outcomes)

    def answer(self, queries: DataFrame, generator: generation.Generator | None = None, **options) -> DataFrame:
        found = self.search(queries, **options)
        return generation.answered(cut(found.outcomes), found.results, generator or generation.ExtractiveGenerator(self.embedder, self.s.generation), self.s.generation)

    # Evaluation

    def evaluate(self, queries: DataFrame, modes: tuple[str, ...] = MODES, ks: tuple[int, ...] = (1, 3, 5, 10)) -> dict[str, DataFrame]:
        """``per_query`` and ``summary`` of an evaluation set in every mode."""
        good = cut(evaluation.relevance(queries, self.store.read("chunks"), self.store.read("documents")))
        parts = []
        for mode in modes:
            found = self.search(queries.select("query_id", "query"), mode, top_k=max(ks))
            metrics = evaluation.rank_metrics(queries, found.results, good, ks)
            parts.append(metrics.join(found.outcomes.select("query_id", "confidence", "status"), "query_id").join(queries.select("query_id", "category", "split", "answerable"), "query_id").withColumn("mode", F.lit(mode)))
        per_query = parts[0]
        for p in parts[1:]:
            per_query = per_query.unionByName(p)
        per_query = cut(per_query.withColumn("abstained", F.col("status") != "success"))
        names = ("rr", "ndcg", *(f"recall_{k}" for k in ks), *(f"hit_{k}" for k in ks))
        return {"provenance": self.spark.createDataFrame([evaluation.provenance()], "commit string, dirty boolean"), "per_query": per_query, "summary": evaluation.rolled_up(per_query.where("answerable"), names), "abstention": evaluation.abstention(per_query, ("mode",)), "sweep": evaluation.threshold_sweep(per_query.withColumn("gated", F.lit(False)))}

    def health(self) -> dict[str, int]:
        return {r["name"]: r["n"] for r in self.store.counts().collect()}


def _by_file():
    from pyspark.sql.window import Window

    return Window.partitionBy("filename", "content_hash").orderBy(F.lit(1))
