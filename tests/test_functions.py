"""Text, names, vectors, parsers: values and properties."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievewright.config import Chunking, Weights
from sievewright.functions import names as nm
from sievewright.functions import text as tx
from sievewright.functions.stemmer import stem
from sievewright.functions.vectors import HashingEmbedder, l2_normalized
from sievewright.sources import parsers


@pytest.mark.parametrize(
    ("word", "expected"),
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("gas", "gas"), ("agreed", "agre"), ("feed", "feed"),
        ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("conditional", "condit"), ("generously", "generous"), ("communism", "communism"),
        ("running", "run"), ("national", "nation"), ("happy", "happi"), ("say", "say"), ("dying", "die"), ("succeeding", "succeed"),
        ("consistency", "consist"), ("knightly", "knight"), ("adjustment", "adjust"), ("controlled", "control"), ("rate", "rate"), ("by", "by"), ("news", "news"),
    ],
)
def test_stems(word, expected):
    assert stem(word) == expected


def test_terms(spark):
    rows = spark.createDataFrame([("The QL-5031 ticket, and retrieval.top_k a 7 x’s",)], "t string")
    assert rows.select(tx.terms(F.col("t"))).first()[0] == ["ql-5031", "ql", "5031", "ticket", "retrieval.top_k", "retrieval", "top", "7"]
    assert tx.plain_terms("Running tests") == ["run", "test"]
    assert rows.select(tx.token_count(F.lit("Größe, 3.5 km!"))).first()[0] == tx.count_tokens("Größe, 3.5 km!") == 7


def test_sentences_and_spans():
    text = "Dr. Chen met A. Moreno. They agreed!\n09:00 Standup\n09:30 Review\nThis line is quite long and has been wrapped by an editor at a\nfixed width. Done."
    found = tx.sentences(text)
    assert found[:2] == ["Dr. Chen met A. Moreno.", "They agreed!"] and "09:00 Standup" in found
    assert any("at a fixed width." in s for s in found)
    for a, b in tx.sentence_spans(text):
        assert 0 <= a < b <= len(text)


def test_normalize_text():
    assert tx.normalize_text("ﬁne\r\n\r\n\r\n\r\nx\t\x07y  \n") == "fine\n\nx    y"


def test_names():
    assert nm.basic("The Café & Co.'s") == "the cafe and co"
    assert nm.tokens_of("The OpenWorks Inc.", "ORGANIZATION") == ["openworks"]
    assert nm.tokens_of("Dr. Alice Chen", "PERSON") == ["alice", "chen"]
    assert nm.tokens_of("Project", "PROJECT") == ["project"]
    assert nm.may_be(["chen"], ["alice", "chen"]) and nm.may_be(["a", "chen"], ["alice", "chen"]) and nm.may_be(["sam", "okafor"], ["samuel", "okafor"])
    assert not nm.may_be(["bob", "chen"], ["alice", "chen"]) and not nm.may_be(["a"], ["alice", "chen"])
    assert nm.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert nm.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert nm.indel_ratio("abcd", "abxd") == pytest.approx(75.0)


def test_embedder(spark):
    e = HashingEmbedder()
    a, b, c = e.embed(["postgres database tuning", "tuning the postgres databases", "birthday cake recipe"])
    assert abs(float(a @ a) - 1) < 1e-5 and a @ b > a @ c
    assert not e.embed([""]).any()
    assert spark.range(1).select(l2_normalized(F.array(F.lit(0.0), F.lit(0.0)))).first()[0] == [0.0, 0.0]


def test_weights():
    assert Weights(2, 2).normalized() == Weights(0.5, 0.5)
    assert Weights(0.4, 0.4, 0.2).for_mode("hybrid") == Weights(0.4, 0.4)
    for bad in (lambda: Weights(-1, 2), lambda: Weights(), lambda: Weights(vector=1).for_mode("lexical_only"), lambda: Weights(1).for_mode("x")):
        with pytest.raises(ValueError):
            bad()


MARKDOWN = b"""# Design notes

Owner: Mira Sol

## Storage

Rows go to disk.
They stay there.

```
# no heading

code
```

### Detail

Deep text.
"""


def test_markdown():
    doc = parsers.parse("a_b.md", MARKDOWN)
    assert doc.title == "Design notes"
    assert [doc.text[b.start : b.end] == b.text for b in doc.blocks] == [True] * len(doc.blocks)
    paths = [b.metadata["heading_path"] for b in doc.blocks]
    assert paths[0] == ["Design notes"] and paths[-1] == ["Design notes", "Storage", "Detail"]
    assert any("# no heading\n\ncode" in b.text for b in doc.blocks)
    assert sum(b.breaks for b in doc.blocks) == 2
    chunks = parsers.chunks_of(doc)
    assert chunks[1].search_text.startswith("Design notes > Storage\n")


def test_json_and_text_and_errors():
    data = json.dumps({"title": "Team", "office": "north", "people": [{"name": "A", "skills": ["x", "y"], "at": {"city": "Oslo"}}, {"name": "B", "list": [[1, 2], {"k": 3}]}]}).encode()
    doc = parsers.parse("t.json", data)
    assert [b.metadata["json_path"] for b in doc.blocks] == ["/", "/people/0", "/people/1"]
    assert doc.blocks[1].text == "name: A\nskills: x, y\nat.city: Oslo" and doc.blocks[2].text == "name: B\nlist: 1, 2; k: 3" and doc.blocks[1].breaks
    assert parsers.parse("n.json", b"[1, 2]").text == "1, 2"
    assert len(parsers.parse("x.txt", "one\n\n two \n\n\nthree".encode("utf-16")).blocks) == 3
    for name, bad in (("x.json", b"{"), ("x.txt", b"  \n "), ("x.exe", b"x"), ("x.pdf", b"no pdf")):
        with pytest.raises(parsers.ParseError):
            parsers.parse(name, bad)


def test_pdf_pages():
    pages = ["First line\nsecond sen-\ntence.\nNew paragraph:", "Page two text."]
    doc = parsers.parse_pdf("r.pdf", b"", lambda data: (pages, "Report"))
    assert [b.text for b in doc.blocks] == ["First line second sentence.", "New paragraph:", "Page two text."]
    assert doc.blocks[2].breaks and doc.metadata == {"page_count": 2}
    assert parsers.chunks_of(doc)[0].metadata == {"page_start": 1, "page_end": 1}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab .!?\nA1"), min_size=1, max_size=120), min_size=1, max_size=8), st.integers(3, 30))
def test_chunks_are_slices(parts, budget):
    try:
        doc = parsers.parse("x.txt", "\n\n".join(parts).encode())
    except parsers.ParseError:
        return
    chunks = parsers.chunks_of(doc, Chunking(budget, budget // 3, 1))
    assert chunks and [c.index for c in chunks] == list(range(len(chunks)))
    for c in chunks:
        assert doc.text[c.start : c.end] == c.text
    covered = set()
    for c in chunks:
        covered.update(range(c.start, c.end))
    assert all(i in covered or doc.text[i].isspace() for b in doc.blocks for i in range(b.start, b.end))
