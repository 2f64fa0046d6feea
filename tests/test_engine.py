"""The engine end to end on a small corpus, and the operators of the entity layer."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sievewright.config import Resolution, Settings, Weights
from sievewright.operators import evaluation, extraction, graph, linking, relations, resolution
from sievewright.plans.engine import Engine
from sievewright.sources import ingest

NOTES = b"""# Project Tamarind

Alice Chen leads Project Tamarind at Northwind Labs.

## Storage

Tamarind uses PostgreSQL and Redis for its queue. The migration finished on 2024-03-05.

## People

Dr. Chen reviews every release. Marta Okafor joined Northwind Labs from Oslo.
"""
GUIDE = b"""# Harbor guide

## Boats

Boats moor at the quay before the tide turns.

## Weather

Storm warnings close the harbor office.
"""
TXT = b"Onboarding checklist for new engineers.\n\nEvery laptop must use disk encryption with AES-256.\n\nAsk the help desk about badges."
TEAM = json.dumps({"title": "Directory", "people": [{"name": "Alice Chen", "organization": "Northwind Labs", "project": "Tamarind"}, {"name": "Boris Vale", "organization": "Quay Analytics", "project": "Lantern"}]}).encode()


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")), Settings())
    files = [("notes.md", NOTES), ("guide.md", GUIDE), ("onboarding.txt", TXT), ("team.json", TEAM), ("bad.json", b"{"), ("x.bin", b"1"), ("empty.txt", b"")]
    status = {r["filename"]: r["status"] for r in e.ingest(ingest.from_bytes(spark, files)).collect()}
    assert status == {"notes.md": "indexed", "guide.md": "indexed", "onboarding.txt": "indexed", "team.json": "indexed", "bad.json": "error", "x.bin": "error", "empty.txt": "error"}
    return e


def ask(engine, *queries, **options):
    frame = engine.spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(queries)], "query_id string, query string")
    return engine.search(frame, **options)


def test_offsets_and_counts(engine):
    rows = engine.store.read("chunks").join(engine.store.read("documents").select("document_id", F.col("text").alias("whole")), "document_id")
    assert rows.where("substring(whole, char_start + 1, char_end - char_start) <> text").isEmpty()
    counts = engine.health()
    assert counts["documents"] == 4 and counts["entities"] > 5 and counts["relationships"] > 2


def test_duplicate_is_not_indexed_again(engine):
    status = engine.ingest(ingest.from_bytes(engine.spark, [("guide.md", GUIDE)]), rebuild=False).collect()
    assert [r["status"] for r in status] == ["duplicate"] and engine.health()["documents"] == 4


def test_entities(engine):
    rows = {r["canonical_name"]: r for r in engine.store.read("entities").collect()}
    assert "Alice Chen" in rows and "Dr. Chen" in rows["Alice Chen"]["aliases"]
    assert rows["Project Tamarind"]["entity_type"] == "PROJECT" and "Tamarind" in rows["Project Tamarind"]["aliases"]
    assert rows["PostgreSQL"]["entity_type"] == "TECHNOLOGY"
    related = {(r["relationship_type"], r["method"]) for r in engine.store.read("relationships").collect()}
    assert ("works_on", "pattern_between") in related
    detail = engine.entity_detail(rows["Alice Chen"]["entity_id"])
    assert detail["mentions"].count() >= 2 and detail["relationships"].where("target_name = '?'").isEmpty()
    assert engine.entity_list("PERSON", "chen").count() == 1 and engine.entity_graph().count() > 0


@pytest.mark.parametrize("mode", ["lexical_only", "vector_only", "hybrid", "hybrid_entity"])
def test_search_modes(engine, mode):
    found = ask(engine, "When do boats moor at the quay?", "Which database does Tamarind use?", mode=mode)
    rows = found.results.collect()
    first = {r["query_id"]: r for r in rows if r["rank"] == 1}
    assert first["q0"]["filename"] == "guide.md" and first["q1"]["filename"] == "notes.md"
    assert all(0 <= r["final_score"] <= 1 for r in rows)
    if mode == "hybrid":
        for r in rows:
            assert r["final_score"] == pytest.approx(0.5 * (r["vector_score"] or 0) + 0.5 * (r["lexical_score"] or 0), abs=2e-4)
    outcomes = {r["query_id"]: r for r in found.outcomes.collect()}
    assert set(outcomes) == {"q0", "q1"} and all(0 <= r["confidence"] <= 1 for r in outcomes.values())


def test_abstention_on_unknown_entity(engine):
    found = ask(engine, "What did Project Nimbus decide?", "zzz qqq")
    rows = {r["query_id"]: r for r in found.outcomes.collect()}
    assert rows["q0"]["status"] == "insufficient_evidence" and "unknown_entity" in rows["q0"]["gates"]
    assert rows["q1"]["status"] == "insufficient_evidence"
    assert engine.visible(found).where("query_id = 'q0'").isEmpty()


def test_rrf_and_weights(engine, spark):
    e = Engine(spark, engine.store.root, Settings(retrieval=engine.s.retrieval.__class__(fusion="rrf")))
    found = ask(e, "storm warnings harbor")
    assert found.results.agg(F.max("final_score")).first()[0] < 0.05
    only = ask(engine, "storm warnings harbor", mode="hybrid", weights=Weights(lexical=1.0))
    assert only.results.where("vector_score is not null").isEmpty()
    with pytest.raises(ValueError):
        ask(engine, " ")


def test_answers(engine):
    frame = engine.spark.createDataFrame([("a", "When do boats moor at the quay?"), ("b", "What did Project Nimbus decide?")], "query_id string, query string")
    rows = {r["query_id"]: r for r in engine.answer(frame).collect()}
    assert rows["a"]["status"] == "success" and "Boats moor" in rows["a"]["answer"] and 1 in rows["a"]["cited"] and rows["a"]["unsupported"] == []
    assert rows["b"]["status"] == "insufficient_evidence" and rows["b"]["cited"] == []


def test_evaluation(engine):
    schema = "query_id string, query string, category string, split string, answerable boolean, relevant_sources array<string>, evidence array<string>, relevant_chunk_ids array<string>"
    rows = [("1", "When do boats moor?", "lexical", "test", True, ["guide.md"], ["moor at the  Quay"], []), ("2", "Which unicorn won the lottery?", "lexical", "test", False, [], [], [])]
    out = engine.evaluate(engine.spark.createDataFrame(rows, schema), modes=("lexical_only", "hybrid"))
    assert out["summary"].where("level = 'mode' and mode = 'lexical_only'").first()["rr"] == 1.0
    assert out["abstention"].count() == 2 and out["sweep"].count() == 34
    assert evaluation.markdown(out["summary"], "Run").startswith("# Run")
    with pytest.raises(evaluation.EvaluationError):
        engine.evaluate(engine.spark.createDataFrame([("1", "x", "c", "test", True, ["guide.md"], ["not there"], [])], schema))


def test_delete_and_reset(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    e.ingest(ingest.from_bytes(spark, [("a.txt", TXT), ("b.md", GUIDE)]))
    e.delete(e.store.read("documents").where("filename = 'b.md'").select("document_id"))
    assert e.health()["documents"] == 1 and e.store.read("postings").where("term = 'boat'").isEmpty()
    e.reset()
    assert e.health()["chunks"] == 0


# Operators of the entity layer


def test_extraction_rules():
    found = {(s.surface, s.kind) for s in extraction.extract("On 2024-03-05 Dr. Mira Sol and Meanwhile Acme Robotics Inc. met at the Data Summit 2024 in New York; Project Lantern uses k8s.")}
    assert {("2024-03-05", "DATE"), ("Dr. Mira Sol", "PERSON"), ("Project Lantern", "PROJECT"), ("k8s", "TECHNOLOGY"), ("New York", "LOCATION")} <= found
    assert any(s.startswith("Acme Robotics") and k == "ORGANIZATION" for s, k in found)
    spans = [extraction.Span("ab", "X", 0, 2, "t", 1, 10), extraction.Span("abc", "Y", 0, 3, "t", 1, 10), extraction.Span("c", "Z", 2, 3, "t", 1, 20)]
    assert [s.kind for s in extraction.without_overlaps(spans)] == ["X", "Z"]


def mentions_of(spark, rows):
    return spark.createDataFrame([(f"m{i:03d}", f"c{d}", d, s, k, 0.9) for i, (s, k, d) in enumerate(rows)], "mention_id string, chunk_id string, document_id string, surface string, entity_type string, confidence double")


def resolved(spark, rows):
    out = resolution.resolve(mentions_of(spark, rows))
    by = {r["mention_id"]: r["entity_id"] for r in out["assignments"].collect()}
    return [by.get(f"m{i:03d}") for i in range(len(rows))], out


def test_resolution(spark):
    ids, out = resolved(spark, [
        ("Open AI", "ORGANIZATION", "a"), ("OpenAI Inc.", "ORGANIZATION", "b"), ("Kubernetes", "TECHNOLOGY", "a"), ("k8s", "TECHNOLOGY", "b"),
        ("Quill Labs", "ORGANIZATION", "a"), ("Quill Health", "ORGANIZATION", "a"), ("Alice Chen", "PERSON", "a"), ("A. Chen", "PERSON", "a"),
        ("Chen", "PERSON", "a"), ("Bob Stone", "PERSON", "c"), ("Ann Stone", "PERSON", "d"), ("Stone", "PERSON", "e"),
    ])
    assert ids[0] == ids[1] and ids[2] == ids[3] and ids[4] != ids[5]
    assert ids[6] == ids[7] == ids[8] and len({ids[9], ids[10], ids[11]}) == 3
    names = {r["canonical_name"] for r in out["entities"].collect()}
    assert {"Kubernetes", "Alice Chen"} <= names
    assert resolution.statistics(out, mentions_of(spark, [("X", "PERSON", "a")])).count() == 1


def test_types_are_harmonized(spark):
    ids, out = resolved(spark, [("Tamarind", "PROJECT", "a"), ("Tamarind", "PROJECT", "b"), ("Tamarind", "ORGANIZATION", "c")])
    assert len(set(ids)) == 1 and not out["decisions"].where("decision = 'type_harmonized'").isEmpty()


def test_merging_by_component_equals_merging_at_once():
    def whole(pairs, threshold):
        return resolution.merge_component(pairs, threshold)

    rng = random.Random(3)
    for _ in range(200):
        nodes = [f"n{i}" for i in range(9)]
        pairs = [(round(rng.random(), 2), a, b, rng.random() < 0.2) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if rng.random() < 0.35]
        reps, _ = whole(pairs, 0.6)
        strong = [(a, b) for s, a, b, _ in pairs if s >= 0.6]
        part = {n: {n} for n in nodes}
        for a, b in strong:
            joined = part[a] | part[b]
            for x in joined:
                part[x] = joined
        split = {}
        for group in {frozenset(g) for g in part.values()}:
            split |= resolution.merge_component([p for p in pairs if p[1] in group and p[2] in group], 0.6)[0]
        same = lambda d: {frozenset(x for x in nodes if d.get(x, x) == d.get(n, n)) for n in nodes}
        assert same(reps) == same(split)


def test_graph_values(spark):
    entities = spark.createDataFrame([("a", "Alice Chen", "PERSON", ["Alice"]), ("b", "Alice Moreno", "PERSON", ["Alice"]), ("p", "Project Tamarind", "PROJECT", ["Tamarind"]), ("d", "2024-01-01", "DATE", [])], "entity_id string, canonical_name string, entity_type string, aliases array<string>")
    rel = [("a", "p", "works_on", 0.5, "c1"), ("p", "a", "related_to", 0.5, "c2"), ("a", "d", "related_to", 0.9, "c1"), ("a", "zz", "x", 0.9, "c1")]
    rel += [("b", "p", "works_on", 0.99, f"c{i}") for i in range(3)]
    edges = graph.edges(spark.createDataFrame(rel, "source_entity_id string, target_entity_id string, relationship_type string, confidence double, supporting_chunk_id string"), entities)
    weight = {(r["src"], r["dst"]): r["weight"] for r in edges.collect()}
    assert weight["a", "p"] == weight["p", "a"] == pytest.approx(0.75) and weight["b", "p"] == 0.95
    queries = spark.createDataFrame([("q1", "Alice Chen at the harbor"), ("q2", "which project does Alice Chen lead"), ("q3", "Alice"), ("q4", "Alicee Chen and others")], "query_id string, query string")
    links = linking.link(queries, graph.alias_index(entities), entities)
    found = {(r["query_id"], r["entity_id"]): (r["confidence"], r["method"]) for r in links.collect()}
    assert found["q1", "a"] == (1.0, "exact") and found["q3", "a"] == found["q3", "b"] == (0.5, "exact")
    assert found["q4", "a"][1] == "fuzzy" and 0.8 < found["q4", "a"][0] < 0.9
    plan = {(r["query_id"], r["entity_id"]): r["weight"] for r in graph.plan(queries, links, edges, entities).where("kind = 'expanded'").collect()}
    assert plan["q1", "p"] == pytest.approx(0.45) and plan["q2", "p"] == pytest.approx(0.75) and ("q1", "d") not in plan
    held = spark.createDataFrame([("c1", "a"), ("c2", "p")], "chunk_id string, entity_id string")
    scores = {(r["query_id"], r["chunk_id"]): r["score"] for r in graph.entity_scores(graph.plan(queries, links, edges, entities), held, entities).collect()}
    assert scores["q1", "c1"] == pytest.approx(1.0) and scores["q1", "c2"] == pytest.approx(0.45)


def test_relations(spark):
    chunks = spark.createDataFrame([("c", "Alice leads Lantern. Bob likes tea with Lantern.", {}), ("r", "name: Alice\nproject: Lantern", {"kind": "record"})], "chunk_id string, text string, metadata map<string,string>")
    entities = spark.createDataFrame([("a", "PERSON"), ("b", "PERSON"), ("l", "PROJECT")], "entity_id string, entity_type string")
    rows = [("1", "c", "a", 0, 5), ("2", "c", "l", 12, 19), ("3", "c", "b", 21, 24), ("4", "c", "l", 40, 47), ("5", "r", "a", 6, 11), ("6", "r", "l", 21, 28)]
    mentions = spark.createDataFrame(rows, "mention_id string, chunk_id string, entity_id string, char_start int, char_end int")
    found = {(r["source_entity_id"], r["target_entity_id"], r["supporting_chunk_id"]): (r["relationship_type"], r["confidence"], r["method"]) for r in relations.relationships(chunks, mentions, entities).collect()}
    assert found["a", "l", "c"] == ("works_on", 0.85, "pattern_between")
    assert found["b", "l", "c"] == ("related_to", 0.35, "cooccurrence")
    assert found["a", "l", "r"] == ("works_on", 0.75, "record")
    header = spark.createDataFrame([("c", "l")], "chunk_id string, entity_id string")
    assert relations.classify("PROJECT", "PERSON", "Bob leads it.", "", "context", 2)[1:] == ("works_on", 0.52, "context")
    assert relations.relationships(chunks, mentions, entities, header).count() == len(found)


def test_pairwise_metric(spark):
    rows = spark.createDataFrame([("g1", "x"), ("g1", "x"), ("g1", "y"), ("g2", "y"), ("g2", None)], "gold_id string, predicted string")
    out = evaluation.pairwise_resolution(rows).first()
    assert (out["tp"], out["said"], out["true"]) == (1.0, 2.0, 4.0) and out["precision"] == 0.5


def test_settings_are_the_defaults():
    assert Resolution().auto_merge == 0.85 and Settings().retrieval.candidate_pool == 30


def test_components_over_all_lines(spark):
    """The registered query takes every line of the table; brute force over all of them."""
    from sievewright.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_partkey").collect()
    comp = {}

    def find(x):
        while comp.setdefault(x, x) != x:
            x = comp[x]
        return x

    for s, p in lines:
        low, high = sorted((find(2 * s), find(2 * p + 1)))
        comp[high] = low
    out = {r["node"]: r["comp"] for r in QUERIES["components_whole"](spark, sf).collect()}
    assert out == {x: find(x) for x in list(comp)}


def test_components_of_a_hub_and_a_chain(spark):
    from sievewright.operators.graph import connected_components

    edges = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(5)] + [(1003, 299), (5000, 5001), (5001, 5000)]
    out = {r["node"]: r["comp"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {x: 5000 if x >= 5000 else 0 for e in edges for x in e}
