"""Quality rules as a short-circuit cascade.

Each rule is a Spark SQL expression that is true for a document to reject.
``plan_cascade`` measures every rule's cost and rejection rate on a sample and
orders the rules by rejection per cost; ``passes`` evaluates them in that order
and stops at the first that rejects.  The order changes the cost, never the
verdict.

``keep_good`` computes a measure when its rule is reached, so that a document
that a cheap rule rejects never pays for a dear one.  ``score_quality`` reports
five measures of every document, rejected or not; for the cascade these are at
hand and cost a comparison, and only what is not reported is computed on the way.

Defined results: a null text counts as empty; an empty text has no words and is
rejected; repeated rows are judged alike; extra columns are kept as they are; an
empty table gives an empty result (its rules are ordered by name).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm._common import SPACE, SPACES, let, stored

WINDOW = 8
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES, -1))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    """Code points that are not white space."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{SYMBOLS}]+", "")).cast("long")


def _filled_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: F.btrim(line, F.lit(SPACE)) != "")


def n_lines(text: Column) -> Column:
    return F.size(_filled_lines(text)).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(_filled_lines(text), lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))


def _covered(windows: Column) -> Column:
    """Positions that lie in a window whose hash occurs twice or more."""

    def of_sorted(s: Column) -> Column:
        twin = lambda k: (F.get(s, k)["h"] == F.get(s, k - 1)["h"]) | (F.get(s, k)["h"] == F.get(s, k + 1)["h"])
        starts = F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.when(F.coalesce(twin(k), F.lit(False)), F.get(s, k)["i"])), lambda i: i.isNotNull())
        first = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))
        step = lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).alias("n"), (i + WINDOW).alias("end"))
        return F.aggregate(F.sort_array(starts), first, step, lambda acc: acc["n"].cast("long"))

    return let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_sorted)


def repeated(tokens: Column) -> Column:
    """Words in eight-word windows that occur at least twice in the text, the first occurrence included."""

    def of_hashes(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(WINDOW))))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(_covered(w)))

    return F.when(F.size(tokens) <= WINDOW, F.lit(0).cast("long")).otherwise(let(F.transform(tokens, lambda w: F.xxhash64(w)), of_hashes))


def n_repeat_words(text: Column) -> Column:
    return let(words(text), repeated)


def measures(text: Column) -> Column:
    """A struct of all counts, with the text split into words once."""
    of = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated(w).alias("n_repeat_words"))
    return let(words(text), of)


@dataclass(frozen=True)
class Rule:
    """``rejects`` takes a function that gives a named measure as a column."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


#: Base rules come first in name only: the order of evaluation is measured.
RULES: tuple[Rule, ...] = (
    Rule("too_short", lambda m: m("n_words") < 20),
    Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    #: A fraction of a few lines says little: at least three lines must be repeats.
    Rule("repeated_lines", lambda m: F.when(m("n_dup_lines") >= 3, 100 * m("n_dup_lines") > 30 * m("n_lines")).otherwise(False)),
    Rule("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 20 * m("n_words"))),
)
BASE_RULES = ("too_short", "repeated_words")
#: One text in so many may be in the sample, if it is no longer than that.
SAMPLE_SHARE, SAMPLE_CHARS = 4, 100_000
_FROM_TEXT = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_lines": n_lines, "n_repeat_words": n_repeat_words}


def from_text(text: Column) -> Callable[[str], Column]:
    """Measures computed from the text on demand, so that a rule that is not reached costs nothing."""
    return lambda name: _FROM_TEXT[name](text)


def from_words(tokens: Column, text: Column) -> Callable[[str], Column]:
    """As ``from_text``, where the words are at hand."""
    of_words = {"n_words": lambda: F.size(tokens).cast("long"), "word_chars": lambda: F.length(F.array_join(tokens, "")).cast("long"), "n_repeat_words": lambda: repeated(tokens)}
    return lambda name: of_words[name]() if name in of_words else _FROM_TEXT[name](text)


def passes(order: Sequence[Rule], measure: Callable[[str], Column]) -> Column:
    """True if no rule rejects; rules after the first that rejects are not evaluated."""
    verdict = None
    for rule in order:
        verdict = (F if verdict is None else verdict).when(rule.rejects(measure), F.lit(False))
    return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))


def sampled(docs: DataFrame, text_col: str, sample_rows: int) -> DataFrame:
    """At most ``sample_rows`` texts, chosen by a hash, of at most ``SAMPLE_CHARS`` characters each.

    Tables are read partition by partition until there are enough, so that the
    sample costs the same however large the table is.
    """
    text = F.col(f"`{text_col}`").cast("string")
    chosen = docs.select(text.alias("text")).where((F.pmod(F.xxhash64("text"), F.lit(SAMPLE_SHARE)) == 0) & (F.length("text") <= SAMPLE_CHARS))
    return docs.sparkSession.createDataFrame([(r["text"],) for r in chosen.head(sample_rows)], "text string")


def plan_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", sample_rows: int = 400, at_hand: Sequence[str] = ()) -> list[tuple[Rule, float, float]]:
    """Rules with cost (seconds) and rejection rate on ``sample_rows`` rows, best rejection per cost first.

    The sample is the only bounded thing here, and it decides the order alone.
    Measures ``at_hand`` cost nothing.  Each rule runs twice, and the second run
    counts, when its code is compiled.
    """
    sample = sampled(docs, text_col, sample_rows)
    ready = sample.select("text", *(_FROM_TEXT[name](F.col("text")).alias(name) for name in at_hand)) if at_hand else sample
    ready = stored(ready.coalesce(1), "quality-sample")
    measure = lambda name: F.col(name) if name in at_hand else _FROM_TEXT[name](F.col("text"))

    def timed(column: Column) -> tuple[float, float]:
        frame = ready.agg(F.avg(F.when(column, 1.0).otherwise(0.0)).alias("rate"))
        rate, took = 0.0, []
        for _ in range(2):
            began = time.perf_counter()
            rate = frame.first()["rate"] or 0.0
            took.append(time.perf_counter() - began)
        return took[-1], rate

    floor, _ = timed(F.length("text") < 0)
    found = []
    for rule in rules:
        cost, rate = timed(rule.rejects(measure))
        found.append((rule, max(cost - floor, 1e-4), rate))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[0].name))


#: Measures that ``score_quality`` reports of every document.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per document: its id, all measures, ``base_failed`` and ``kept``."""
    order = [rule for rule, _, _ in plan_cascade(docs, rules, text_col, at_hand=REPORTED)]
    text = F.col("_sw_text")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("_sw_text"))
    rows = rows.select("doc_id", "_sw_text", measures(text).alias("_sw_m"), n_symbols(text).alias("n_symbols"), n_dup_lines(text).alias("n_dup_lines"))
    rows = rows.select("doc_id", "_sw_text", "_sw_m.*", "n_symbols", "n_dup_lines")
    measure = lambda name: F.col(name) if name in REPORTED else _FROM_TEXT[name](text)
    base = ~passes([r for r in rules if r.name in BASE_RULES], measure)
    return rows.select("doc_id", *REPORTED[:4], "n_repeat_words", base.alias("base_failed"), passes(order, measure).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` without the rows that a rule rejects, with all their columns."""
    order = [rule for rule, _, _ in plan_cascade(docs, rules, text_col)]
    text = F.col(f"`{text_col}`").cast("string")
    return docs.where(let(words(text), lambda w: passes(order, from_words(w, text))))
