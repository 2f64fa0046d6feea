"""Every corpus operator over the same odd rows: nulls, empty and very long texts, ties, repeated rows, clashing columns, empty tables."""

import pytest
from pyspark.sql import functions as F

from sievewright.llm import decontaminate, html_extract, licenses, line_dedup, lm_score, minhash, mixing, quality, queries, secret_scan, suffix_dedup
from tests.llm.test_operators import prose

CLASHING = "id key text_key node comp h g row group slice bucket votes tokens spans n size digits copies taken kept class_id i start end target score _sw_text _sw_key _sw_rows _sw_copies _sw_stays _sw_starts _sw_m".split()
LONG = "\n".join(" ".join(prose(i, 40)) for i in range(9000))  # more than 2 MB, 360,000 words
ROWS = [(1, "one two three four five six", "a"), (1, "one two three four five six", "a"), (1, "another text of this id", "a"), (None, None, None), (None, None, None), (None, "", "b"), (2, "", None), (3, " \t\n\x0b ", "b"), (4, LONG, "b"), (5, LONG, "c"), (6, "é🙂" * 30_000, "c"), (7, "x\ny\nz\nx\ny\nz", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return frame.select("*", *(F.lit(f"c{i}").alias(c) for i, c in enumerate(CLASHING))).repartition(3).cache()


BENCH = [(1, "one two three four five six"), (None, "nothing of this kind stands there"), (3, None), (4, "")]
EACH = {
    "decontaminate": lambda d: decontaminate.find_leaks(d, d.sparkSession.createDataFrame(BENCH, "item_id long, text string")),
    "mix": mixing.mix_sources,
    "html": lambda d: html_extract.extract_pages(d.selectExpr("doc_id AS page_id", "text AS html", "source AS url", "host", "ref", "votes") if "host" in d.columns else d.withColumnsRenamed({"doc_id": "page_id", "text": "html", "source": "url"})),
    "lines": line_dedup.line_report,
    "licenses": licenses.scan_licenses,
    "quality": quality.score_quality,
    "near": minhash.near_report,
    "secrets": secret_scan.scan_secrets,
    "suffixes": suffix_dedup.repeat_report,
    "lm": lambda d: lm_score.score_documents(d, d.where("doc_id = 4").select("doc_id")),
}


@pytest.mark.parametrize("name", EACH)
def test_odd_rows(odd, name):
    out = EACH[name](odd).collect()
    if name == "decontaminate":
        assert sorted((r["doc_id"], r["item_id"]) for r in out) == [(1, 1), (1, 1)]
    else:
        ids = sorted(str(r["page_id" if name == "html" else "doc_id"]) for r in out)
        assert ids == sorted(str(i) for i, *_ in ROWS)
    if name == "near":
        assert {r["class_id"] for r in out if r["doc_id"] in (4, 5)} == {4} and sum(r["kept"] for r in out if r["doc_id"] in (4, 5)) == 1
    if name == "lines":
        assert sorted((r["n_lines"], r["n_removed"]) for r in out if r["doc_id"] in (4, 5)) == [(9000, 0), (9000, 9000)] and [r["n_removed"] for r in out if r["doc_id"] == 7] == [3]
    if name == "suffixes":
        found = {r["doc_id"]: r["n_removed"] for r in out}
        assert found[4] == 0 and found[5] == len(LONG.encode())
    if name == "quality":
        assert {r["n_words"] for r in out if r["doc_id"] in (4, 5)} == {360_000} and not any(r["kept"] for r in out if r["doc_id"] in (None, 1, 2, 3))
    if name == "lm":
        assert {r["n_words"] for r in out if r["doc_id"] in (4, 5)} == {360_000}


@pytest.mark.parametrize("name", EACH)
def test_empty_table(odd, name):
    assert EACH[name](odd.limit(0)).count() == 0


def test_whole_rows_come_back(odd):
    """Operators that return their table's columns keep all of them, whatever their names."""
    spark, names = odd.sparkSession, odd.columns
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    for out in (quality.keep_good(odd), minhash.keep_one(odd), decontaminate.without_leaks(odd, bench)):
        assert out.columns == names
        first = CLASHING[0]
        assert {r[first] for r in out.select(first).collect()} <= {"c0"}
    assert minhash.keep_one(odd).count() == 7
    assert decontaminate.without_leaks(odd, bench).count() == len(ROWS) - 2
    lines, mixed = line_dedup.dedup_lines(odd), mixing.mix_sources(odd, keep=True)
    assert lines.columns[: len(names)] == names and lines.count() == len(ROWS) and mixed.columns[:-1] == names
    assert {r["_sw_text"] for r in lines.select("_sw_text").collect()} == {f"c{CLASHING.index('_sw_text')}"}


def test_queries_of_empty_tables(spark, tmp_path):
    schemas = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "benchmark": "item_id long, text string", "pages": "page_id long, url string, html string", "labels": "doc_id long, quality int, toxic int"}
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
