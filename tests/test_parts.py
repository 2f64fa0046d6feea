"""Storage states, components, vector index, the statistical extractor, and what is chosen by name."""

import json
import random

import pytest

from sievewright.functions.vectors import HashingEmbedder, OnnxEmbedder, embedder_by_name, verify_file
from sievewright.operators import evaluation, extraction, fusion, generation, graph, lexical
from sievewright.operators.vector_index import VectorIndex
from sievewright.sources.storage import TableStore

SF = "/root/testdata/sf0.01"


def test_components_of_long_chains_in_few_rounds(spark, monkeypatch):
    rounds = []
    stored = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: rounds.append(name) or stored(df, name))
    edges = [(i, i + 1) for i in range(1000)] + [(2000, i) for i in range(2001, 2300)] + [(7, 7), (5000, 5000)]
    out = {r["node"]: r["comp"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(1001)} | {i: 2000 for i in range(2000, 2300)}
    assert rounds.count("links") - 1 <= 12
    named = {r["node"]: r["comp"] for r in graph.connected_components(spark.createDataFrame([("b", "c"), ("a", "b"), ("y", "x")], "a string, b string")).collect()}
    assert named == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_store_states(spark, tmp_path):
    store = TableStore(spark, f"{tmp_path}/tables")
    row = lambda *ids: spark.createDataFrame([(i, 1) for i in ids], "term string, df long")
    terms = lambda: sorted(r["term"] for r in store.read("term_stats").collect())
    assert terms() == [] and not store.exists("term_stats")
    store.append("term_stats", row("a"))
    first = store.tables()["term_stats"]
    reader = store.read("term_stats")
    store.append_all({"term_stats": row("b"), "corpus_stats": spark.createDataFrame([(1, 1.0)], "n_docs long, avgdl double")})
    assert store.tables()["term_stats"][:1] == first and terms() == ["a", "b"]  # nothing is written again
    store.snapshot("two")
    with pytest.raises(ValueError):
        store.snapshot("two")
    store.replace("term_stats", row("c"))
    assert terms() == ["c"] and [r["term"] for r in reader.collect()] == ["a"]  # an older reader goes on
    store.compact("term_stats")
    store.restore("two")
    assert terms() == ["a", "b"]
    store.compact("term_stats")
    assert len(store.tables()["term_stats"]) == 1 and terms() == ["a", "b"]
    store.reset()
    assert terms() == []
    store.vacuum()
    store.restore("two")
    assert terms() == ["a", "b"]
    TableStore.MAX_PARTS, held = 3, TableStore.MAX_PARTS
    for i in range(5):
        store.append("term_stats", row(f"x{i}"))
    TableStore.MAX_PARTS = held
    assert len(store.tables()["term_stats"]) <= 3 and len(terms()) == 7


def test_vector_index_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id AS chunk_id", "embedding")
    rows = rows.unionByName(spark.createDataFrame([(10_000, None), (10_001, [1.0])], rows.schema))
    asked = rows.where("chunk_id % 100 = 0 and size(embedding) > 1").selectExpr("chunk_id AS query_id", "embedding")
    exact = {(r["query_id"], r["chunk_id"]) for r in fusion.vector_top_k(asked, rows, 10).collect()}
    index = VectorIndex.build(rows, 16)
    assert index.lists.count() == 500
    found = {(r["query_id"], r["chunk_id"]) for r in index.top_k(asked, 10, probes=8).collect()}
    assert len(exact & found) >= 0.9 * len(exact) and index.top_k(asked, 10, probes=16, block=2).count() == len(exact)
    assert {(r["query_id"], r["chunk_id"]) for r in index.top_k(asked, 10, probes=16, block=2).collect()} == exact
    assert VectorIndex.build(rows.limit(0), 4).top_k(asked, 3).count() == 0 == fusion.vector_top_k(asked.limit(0), rows, 3).count()


def test_equal_vectors_tie_by_id(spark):
    rows = spark.createDataFrame([(f"c{i:03d}", [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(400)], "chunk_id string, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("p", [0.0, 2.0]), ("n", None)], "query_id string, embedding array<float>")
    out = [(r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in fusion.vector_top_k(asked, rows, 3, block=1).collect()]
    assert sorted(out) == [("p", 1, "c000", 2.0), ("p", 2, "c002", 2.0), ("p", 3, "c004", 2.0), ("q", 1, "c001", 1.0), ("q", 2, "c003", 1.0), ("q", 3, "c005", 1.0)]


def test_statistical_extractor():
    names = ["Samantha Reyes", "the Harbor Board's", "Team\n\nSamantha Reyes", "API", "Collapse", "next week", "March 2024", "lower case", "Lagos"]

    def recognize(text):
        labels = {"next week": "DATE", "March 2024": "DATE", "the Harbor Board's": "ORG", "API": "ORG", "Lagos": "GPE"}
        return [(text.index(n), text.index(n) + len(n), labels.get(n, "PERSON")) for n in names if n in text] + [(0, 1, "CARDINAL")]

    text = "## Team\nSamantha Reyes met the Harbor Board's API.\n- Collapse the tree next week\nOn March 2024, lower case\n\nTo: Lagos\nin Lagos"
    found = extraction.StatisticalExtractor(recognize).spans(text)
    assert [(s.surface, s.kind) for s in found] == [("Samantha Reyes", "PERSON"), ("Harbor Board", "ORGANIZATION"), ("March 2024", "DATE")]
    assert all(text[s.start : s.end] == s.surface and s.confidence == 0.6 for s in found)
    both = extraction.extract("Dr. Ada Byrne moved to Lagos.", (extraction.RuleExtractor(), extraction.StatisticalExtractor(recognize)))
    assert [(s.surface, s.extractor) for s in both] == [("Dr. Ada Byrne", "rules"), ("Lagos", "rules")]
    assert len(extraction.extractors_by_name("rules")) == 1 and extraction.extractors_by_name("auto")
    with pytest.raises(ValueError):
        extraction.extractors_by_name("other")


def test_names_choose(tmp_path):
    assert isinstance(embedder_by_name("hashing", dim=16), HashingEmbedder) and embedder_by_name("onnx", model_path="m", tokenizer_path="t").dim == 384
    assert embedder_by_name("sentence-transformers").embed([]).shape == (0, 384)
    (tmp_path / "m").write_bytes(b"x")
    verify_file(str(tmp_path / "m"), "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881")
    with pytest.raises(ValueError):
        OnnxEmbedder(str(tmp_path / "m"), "t", sha256="00").embed(["a"])
    for name in ("embedder", "other"):
        with pytest.raises(ValueError):
            embedder_by_name(name)
        with pytest.raises(ValueError):
            generation.generator_by_name(name)


def test_http_generator(spark):
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    class Reply(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"response": f" {asked['model']} says [1] " if "boats" in asked["prompt"] else ""}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Reply)
    Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    evidence = spark.createDataFrame([("q", "Where are boats?", 1, "a.txt", "Boats are here.")], "query_id string, query string, marker int, source string, text string")
    assert [tuple(r) for r in generation.generator_by_name("http", url=url, model="m").answers(evidence).collect()] == [("q", "m says [1]")]
    with pytest.raises(generation.GenerationError):
        generation.http_completion(url, "m")("nothing")
    server.shutdown()


def test_reports_and_provenance(spark):
    commit, dirty = evaluation.provenance()
    assert (commit is None) == (dirty in (True, None)) and evaluation.provenance("/") == (None, None)
    assert json.loads(evaluation.as_json({"a": spark.createDataFrame([(1, "x")], "n int, s string")})) == {"a": [{"n": 1, "s": "x"}]}


def test_evidence_of_few_words(spark):
    texts = spark.createDataFrame([(1, "aa bb cc dd"), (2, "xaa bbx"), (3, "bb cc"), (4, "")], "chunk_id long, hay string")
    needles = spark.createDataFrame([(1, "a bb cc d"), (2, "aa bb"), (3, "b"), (4, "zz bb zz"), (5, "bb cc")], "query_id long, needle string")
    assert sorted((r["query_id"], r["chunk_id"]) for r in evaluation.holding(texts, needles).collect()) == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3), (5, 1), (5, 3)]


def test_strings_in_texts_by_brute_force(spark, monkeypatch):
    """Random strings of every length against random texts, in steps of any size, with colliding hashes, and in several parts."""
    import random

    import numpy as np
    import pyarrow as pa

    from sievewright.functions import search

    r = random.Random(5)
    made = lambda n: "".join(r.choices("ab é", k=r.randrange(n))).encode()

    def check(times):
        for _ in range(times):
            texts = [made(90) for _ in range(r.randrange(6))]
            strings = sorted({made(r.choice((3, 12, 40))) for _ in range(8)} | {t[r.randrange(9) : r.randrange(1, 80)] for t in texts})
            found = search.Strings(np.arange(len(strings)), pa.array(strings, pa.binary())).found(*search._bytes_of(pa.array(texts, pa.binary())))
            assert list(zip(*(x.tolist() for x in found), strict=True)) == [(i, j) for i, t in enumerate(texts) for j, s in enumerate(strings) if s in t]

    for step in (5, 64, search.STEP):
        monkeypatch.setattr(search, "STEP", step)
        check(60)
    monkeypatch.setattr(search, "_mix", lambda a, b: np.zeros(np.broadcast(a, b).shape, np.uint64))
    check(60)
    monkeypatch.undo()
    monkeypatch.setattr(search, "MAX_BYTES", 64)
    texts = [(i, f"one {i} two {i * i}") for i in range(40)] + [(40, None)]
    needles = [(i, f"{i} two") for i in range(40)] + [(40, None), (41, "")]
    rows = search.holding_ids(spark.createDataFrame(texts, "chunk_id long, hay string"), spark.createDataFrame(needles, "needle_id long, needle string")).collect()
    assert sorted(map(tuple, rows)) == sorted((i, j) for i, t in texts for j, s in needles if t is not None and s is not None and s in t)


def test_relevance_of_odd_chunks(spark):
    """Chunks without a document count for queries without sources; several sources, strings and given chunks give a pair once."""
    chunks = spark.createDataFrame([("a", "d1", "The  quay of boats"), ("b", "d2", "a quay of boats here"), ("c", None, "QUAY of boats"), ("d", "d9", "quay of boats"), ("e", "d1", None)], "chunk_id string, document_id string, text string")
    documents = spark.createDataFrame([("d1", "f1"), ("d2", "f2")], "document_id string, filename string")
    queries = [("free", True, [], ["Quay of boats"], None), ("one", True, ["f1"], ["quay of boats", "the quay"], None), ("two", True, ["f1", "f2", "f1"], ["quay of"], ["z", "a"]), ("none", False, ["f1"], ["unheard of"], None)]
    asked = spark.createDataFrame(queries, "query_id string, answerable boolean, relevant_sources array<string>, evidence array<string>, relevant_chunk_ids array<string>")
    out = evaluation.relevance(asked, chunks, documents)
    assert sorted(map(tuple, out.collect())) == [*(("free", c) for c in "abcd"), ("one", "a"), ("two", "a"), ("two", "b"), ("two", "z")]
    with pytest.raises(evaluation.EvaluationError):
        evaluation.relevance(asked.selectExpr("query_id", "answerable", "array('f2') AS relevant_sources", "evidence", "relevant_chunk_ids"), chunks, documents)


def test_postings_of_odd_chunks(spark):
    rows = [("a", None), ("b", ""), ("c", "The state-of-the-art x 7 X.y’s 7"), ("d", " ".join(f"word{i % 50}" for i in range(20_000)))]
    post = lexical.postings(spark.createDataFrame(rows, "chunk_id string, search_text string"), stem=False)
    found = {(r["chunk_id"], r["term"]): (r["tf"], r["dl"]) for r in post.collect()}
    assert {t for c, t in found if c == "c"} == {"state-of-the-art", "state", "art", "7", "x.y"} and found["c", "7"] == (2, 6)
    assert found["d", "word3"] == (400, 20_000) and {c for c, _ in found} == {"c", "d"}
    assert random.Random(1).random() and lexical.postings(spark.createDataFrame([], "chunk_id string, search_text string")).count() == 0
