"""The pipeline, stage by stage, against plain brute force."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm.test_operators import LINES, PLAIN, brute_classes, brute_lines, brute_quality, brute_targets, prose, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _sw_extra int"


def row(i, text, source):
    return i, text, "en", source, len(text or ""), i


ITEM = " ".join(prose(700, 25))
LONG = " ".join(prose(1, 200))
ROWS = [
    row(0, LONG, "a"),
    row(1, LONG.replace(LONG.split()[100], "other"), "a"),
    row(2, "short", "a"),
    row(3, None, "b"),
    row(4, "one two " * 40, "b"),
    row(5, "intro words here\n" + LINES + "\nlast line of it", "b"),
    row(6, LINES, "b"),
    row(7, LINES + "\n" + " ".join(prose(88, 60)), "c"),
    row(8, " ".join(prose(90, 60)) + " " + ITEM + " " + " ".join(prose(91, 60)), "c"),
    *(row(20 + i, " ".join(prose(300 + i, 40 + 3 * i)), "abc"[i % 3]) for i in range(30)),
    row(60, LONG, None),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def brute(rows):
    def good(t):
        n, chars, symbols, dups, repeats = brute_quality(t)
        lines = len([x for x in (t or "").split("\n") if PLAIN.search(x)])
        return not (n < 20 or 100 * repeats > 30 * n or 10 * symbols > n or dups >= 3 and 100 * dups > 30 * lines or not 2 * n <= chars <= 20 * n)

    docs = {r[0]: r[1] for r in rows if good(r[1])}
    yield docs
    report = {i: (n, cut) for i, n, cut, _ in brute_lines(list(docs.items()))}
    cut_texts = {}
    lines = {i: [x for x in t.split("\n")] for i, t in docs.items()}
    first, gone = {}, defaultdict(set)
    for i in sorted(docs):
        for k in range(len(lines[i]) - 2):
            if first.setdefault(tuple(lines[i][k : k + 3]), (i, k)) != (i, k):
                gone[i].update((k, k + 1, k + 2))
    for i in docs:
        if report[i][1] < report[i][0] or not report[i][1]:
            cut_texts[i] = "\n".join(x for k, x in enumerate(lines[i]) if k not in gone[i])
    yield cut_texts
    classes = dict(brute_classes(list(cut_texts.items())))
    kept = {i: t for i, t in cut_texts.items() if classes[i] == i}
    yield kept
    item = Counter(tuple(words(ITEM)[j : j + 5]) for j in range(21))
    yield {i: t for i, t in kept.items() if not any(sum((item & Counter(tuple(words(t)[j : j + 5]) for j in range(s, s + 21))).values()) > 18 for s in range(max(1, len(words(t)) - 24)))}


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    expected = list(brute(ROWS))
    for (name, stage), want in zip(corpus_pipeline.STAGES, expected, strict=False):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert {r["doc_id"]: r["text"] for r in rows} == want, name
        assert all(r["n_chars"] == len(r["text"]) and r["_sw_extra"] == r["doc_id"] for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    assert set(expected[0]) - set(expected[1]) == {6} and 1 not in expected[2] and 60 not in expected[2] and 8 in expected[2] and 8 not in expected[3]

    mixed = {r["doc_id"]: r["copies"] for r in corpus_pipeline.run(spark, folder).collect()}
    left, source = expected[3], {r[0]: r[3] for r in ROWS}
    assert set(mixed) <= set(left)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, t in left.items():
        n = len(PLAIN.findall(t))
        sizes[source[i]] += n
        taken[source[i]] += mixed.get(i, 0) * n
        largest[source[i]] = max(largest[source[i]], n)
    for s, target in brute_targets(sizes).items():
        assert abs(taken[s] - target) <= largest[s] and max(mixed.values()) <= 3


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
