"""Line dedup by overlapping three-line windows.

Lines with a word, trimmed, are hashed; every three that follow one another
form a window.  A window that occurs more than once in the corpus keeps its
first occurrence (smallest document id, then position); the lines that any
later occurrence covers are removed.  Windows are judged on the input, not on
what is left.

Defined results: a null text counts as empty; texts of fewer than three lines
with a word have no window and stay whole; lines without a word are no part of
any window and stay; a null id comes after all others; rows with equal ids are
told apart by their text's hash, which also orders them; of rows with equal ids
and texts one (any) comes first and the others repeat all its windows; an empty
table gives an empty result; a text whose lines are all removed is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm._common import SPACE, let, stored, unused

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def _filled(text: Column) -> Column:
    """The lines with a word, trimmed."""
    return F.filter(F.transform(_lines(text), _trimmed), lambda line: line != "")


def _windows(text: Column) -> Column:
    """``array<struct<i, h>>``: windows by the number of their first line among the lines with a word; ``h`` is a 128-bit hash."""

    def of_hashes(hashes: Column) -> Column:
        h = lambda i, seed: F.xxhash64(*([F.lit(seed)] * bool(seed)), *(F.get(hashes, i + j) for j in range(WINDOW)))
        windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.struct(i.alias("i"), h(i, 0).alias("h"), h(i, 1).alias("g")))
        return F.when(F.size(hashes) >= WINDOW, windows)

    return let(F.transform(_filled(text), lambda line: F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))), of_hashes)


def _covered(starts: Column) -> Column:
    """The numbers of all lines that windows at ``starts`` cover, each once."""
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(i, i + WINDOW - 1))))


def _kept_text(text: Column, starts: Column) -> Column:
    """``text`` without the lines that windows at ``starts`` cover."""

    def of(lines: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(lines) - 1)
        filled = F.filter(places, lambda p: _trimmed(F.get(lines, p)) != "")
        gone = let(filled, lambda at: F.transform(_covered(starts), lambda n: F.get(at, n)))
        return F.array_join(F.transform(F.array_except(places, gone), lambda p: F.get(lines, p)), "\n")

    return F.when(starts.isNull(), text).otherwise(let(_lines(text), of))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with three more columns: ``_sw_text`` (what is left), ``_sw_n_lines`` and ``_sw_n_removed`` (lines with a word).

    They have underscores behind their names where ``docs`` has such columns.
    """
    text, own = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`")
    key = F.concat_ws(":", own.cast("string"), F.xxhash64(F.coalesce(text, F.lit(""))).cast("string"))
    windows = docs.select(own.isNull().alias("last"), own.alias("id"), key.alias("key"), F.inline(_windows(text)))
    windows = stored(windows, "line-windows")
    occurrence = F.struct("last", "id", "key", "i")
    firsts = windows.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(occurrence).alias("first")).where("n > 1")
    firsts = stored(firsts.select("h", "g", F.col("first")["key"].alias("first_key"), F.col("first")["i"].alias("first_i")), "line-repeats")
    later = windows.join(firsts, ["h", "g"]).where("key <> first_key or i <> first_i")
    own_key, hit, starts, copy = unused(docs, "_sw_key", "_sw_hit", "_sw_starts", "_sw_copy")
    later = later.groupBy("key").agg(F.sort_array(F.collect_set("i"))).toDF(hit, starts)
    keyed = docs.withColumn(own_key, key)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # Rows with equal ids and texts, where there are any: they are numbered in a stored table.
    repeated = stored(windows.where("i = 0").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "line-copies").toDF(copy)
    rows = keyed.join(later, F.col(own_key) == F.col(hit), "left")
    if not repeated.isEmpty():
        number, least = unused(docs, "_sw_number", "_sw_least")
        several = stored(keyed.join(repeated, F.col(own_key) == F.col(copy), "left_semi").withColumn(number, F.monotonically_increasing_id()), "line-copies")
        first = several.groupBy(own_key).agg(F.min(number)).toDF(copy, least)
        several = several.join(first, F.col(own_key) == F.col(copy)).join(later, F.col(own_key) == F.col(hit), "left")
        every = F.sequence(F.lit(0), F.size(_filled(text)) - WINDOW)
        several = several.select(*columns, F.when(F.col(number) == F.col(least), F.col(starts)).otherwise(every).alias(starts))
        rows = rows.join(repeated, F.col(own_key) == F.col(copy), "left_anti").select(*columns, starts).unionByName(several)
    removed = F.when(F.col(starts).isNull(), 0).otherwise(F.size(_covered(F.col(starts))))
    found = (_kept_text(text, F.col(starts)), F.size(_filled(text)).cast("long"), removed.cast("long"))
    return rows.select(*columns, *(c.alias(name) for c, name in zip(found, unused(docs, "_sw_text", "_sw_n_lines", "_sw_n_removed"), strict=True)))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_removed, kept_text_md5``."""
    rows = dedup_lines(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    return rows.select("doc_id", F.col("_sw_n_lines").alias("n_lines"), F.col("_sw_n_removed").alias("n_removed"), F.md5(F.coalesce("_sw_text", F.lit(""))).alias("kept_text_md5"))
