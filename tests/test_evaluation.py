"""Evaluation operators on small tables."""

import math

import pytest

from sievewright.operators import confidence, evaluation


def test_gold_assignment_takes_the_majority(spark):
    gold = spark.createDataFrame([("g1", "a.md", "Chen"), ("g2", "a.md", "Vale"), ("g3", "b.md", "Chen")], "gold_id string, source string, surface string")
    documents = spark.createDataFrame([("d1", "a.md"), ("d2", "b.md")], "document_id string, filename string")
    rows = [("d1", "Chen", "e1", "rules"), ("d1", "Chen", "e2", "rules"), ("d1", "Chen", "e2", "rules"), ("d1", "Chen", "e1", "header"), ("d1", "Chen", "e1", "header"), ("d2", "Chen", None, "rules")]
    mentions = spark.createDataFrame(rows, "document_id string, surface string, entity_id string, extractor string")
    found = {r["gold_id"]: r["predicted"] for r in evaluation.gold_assignments(gold, mentions, documents).collect()}
    assert found == {"g1": "e2", "g2": None, "g3": None}


def test_rank_metrics_values(spark):
    queries = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    results = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 1)], "query_id string, chunk_id string, rank int")
    relevant = spark.createDataFrame([("a", "y"), ("b", "z")], "query_id string, chunk_id string")
    rows = {r["query_id"]: r for r in evaluation.rank_metrics(queries, results, relevant).collect()}
    assert rows["a"]["rr"] == 0.5 and rows["a"]["ndcg"] == pytest.approx(1 / math.log2(3)) and rows["a"]["recall_1"] == 0 and rows["a"]["hit_3"] == 1
    assert rows["b"]["rr"] == 0 and rows["b"]["ndcg"] == 0 and rows["c"]["n_relevant"] == 0 and rows["c"]["recall_5"] == 0


def test_undefined_rates_are_null(spark):
    rows = spark.createDataFrame([(False, True), (False, True)], "abstained boolean, answerable boolean")
    out = evaluation.abstention(rows).first()
    assert out["abstention_precision"] is None and out["abstention_recall"] is None and out["false_abstention_rate"] == 0.0


def test_best_threshold_ties(spark):
    rows = [("m", "dev", 0.3, 0.5, 0.2), ("m", "dev", 0.4, 0.5, 0.1), ("m", "dev", 0.5, 0.5, 0.1), ("m", "test", 0.3, None, None), ("m", "test", 0.4, 0.1, 0.9)]
    sweep = spark.createDataFrame(rows, "mode string, split string, threshold double, abstention_f1 double, false_abstention_rate double")
    assert {r["split"]: r["threshold"] for r in evaluation.best_threshold(sweep).collect()} == {"dev": 0.4, "test": 0.4}
    assert evaluation.compared({"a": sweep, "b": sweep.drop("split")}).count() == 10


def facts(spark, rows):
    return spark.createDataFrame(rows, "query_id string, chunk_id string, document_id string, rank int, final_score double, vector_raw double, coverage double")


def test_confidence_signals(spark):
    queries = spark.createDataFrame([("q",), ("w",), ("e",)], "query_id string")
    top = facts(spark, [("q", "c1", "d1", 1, 0.9, 0.6, 0.8), ("q", "c2", "d2", 2, 0.8, 0.5, 0.4), ("w", "c3", "d1", 1, 0.5, 0.1, 0.1)])
    ranks = spark.createDataFrame([("q", "c1", 1), ("w", "c9", 1)], "query_id string, chunk_id string, rank int")
    rows = {r["query_id"]: r for r in confidence.evaluate(queries, top, "hybrid", ranks, ranks).collect()}
    q = rows["q"]
    assert q["signals"]["relevance"] == pytest.approx(0.9) and q["signals"]["margin"] == pytest.approx(1 / 9, abs=1e-4)
    assert q["signals"]["agreement"] == pytest.approx(0.5 * 0.2 + 0.5) and q["signals"]["support"] == 1.0 and "entity_consistency" not in q["signals"]
    total = (0.45 * 0.9 + 0.1 / 9 + 0.2 * 0.6 + 0.1 * 1.0) / 0.85
    assert q["confidence"] == pytest.approx(total, abs=1e-4) and q["status"] == "success" and q["reasons"] == []
    assert rows["w"]["gates"] == ["weak_evidence"] and rows["w"]["status"] == "insufficient_evidence" and "0.10 < 0.25" in rows["w"]["reasons"][0]
    assert rows["e"]["gates"] == ["no_results"] and rows["e"]["confidence"] == 0.0


def test_entity_signal_and_unknown_names(spark):
    queries = spark.createDataFrame([("q",)], "query_id string")
    top = facts(spark, [("q", "c1", "d1", 1, 0.9, 0.6, 0.8)])
    linked = spark.createDataFrame([("q", "a", 1.0, True), ("q", "b", 0.5, False)], "query_id string, entity_id string, weight double, in_top boolean")
    unknown = spark.createDataFrame([("q", "Project Nimbus")], "query_id string, surface string")
    out = confidence.evaluate(queries, top, "hybrid_entity", None, None, linked, unknown).first()
    assert out["signals"]["entity_consistency"] == pytest.approx(2 / 3, abs=1e-4) and out["gates"] == ["unknown_entity"] and "Project Nimbus" in out["reasons"][0]
    assert confidence.evaluate(queries, top, "vector_only", None, None, threshold=0.99).first()["status"] == "insufficient_evidence"
