"""Mixing sources to target weights by hash-threshold histograms.

A document's place in its source is a hash of its id, read as hexadecimal
digits.  Tokens are summed by source and the first digits (the histogram), the
bucket in which a source's budget ends is found from the running sums, and only
that bucket is looked at again with the next digits.  What is left is one
threshold per source: documents whose hash lies below it are taken.  Nothing is
sorted but the histogram and the table of sources, whose sizes do not depend on
the documents.  Thresholds are nested: a smaller budget takes a subset of what a
larger takes.  There may be as many sources as there are hosts: their order and
running sums come from a distributed sort, and from sums by its partitions.

Defined results: a null text has size 0; a null source is a source of its own,
the last; rows with the same id (null ids too) are taken together; an empty
table gives an empty result; a source of size 0 has target 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewright.llm._common import bounded_broadcast, column_or_null, stored, unused
from sievewright.llm.quality import n_words

#: Hexadecimal digits of each level of the histogram, and levels.
DIGITS, LEVELS = 3, 4
#: Source tables of up to so many rows are broadcast.
MAX_BROADCAST_SOURCES = 20_000


def hash_digits(id_col: Column, seed: str = "mix") -> Column:
    """The hexadecimal digits by which a document's place is decided."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null"))))


def running(df: DataFrame, order: Sequence[Column], **sums: Column) -> DataFrame:
    """``df`` with ``nth``, a row's place from 0, and under each name of ``sums`` the sum over all rows before it.

    Each task sums its own part of the sorted rows; only a row of sums for each
    part meets the others.
    """
    parted = stored(df.orderBy(*order).withColumn("_part", F.spark_partition_id()), "mix-sorted")
    sums = {"nth": F.lit(1).cast("long")} | sums
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parted.groupBy("_part").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    parts = parts.select("_part", *(F.coalesce(F.sum(f"_{n}").over(before(Window.orderBy("_part"))), F.lit(0)).alias(f"_{n}") for n in sums))
    within = before(Window.partitionBy("_part").orderBy(*order))
    rows = parted.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(n) for n, c in sums.items()))
    rows = rows.join(F.broadcast(parts), "_part")  # a row for each task of the sort
    return rows.select(*(F.col(c) for c in df.columns), *((F.col(n) + F.col(f"_{n}")).alias(n) for n in sums))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """One row per source: ``source, source_size, weight, target``.

    Sources by code point, null last, take the weights in turn.  Targets share
    ``share`` of all sizes by weight; none exceeds ``cap`` times its source's
    size: with sources in the order of cap per weight, those that the level
    reached so far would overfill are capped, and the rest share what is left.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = [F.col("source").isNull(), F.encode("source", "UTF-8")]
    weighed = running(totals, by_name).withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("nth") % len(weights) + 1).cast("int"))).drop("nth")
    full = weighed.withColumn("cap", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("cap") / F.col("weight"))
    rows = stored(running(full, [F.col("ratio"), *by_name], caps=F.col("cap"), weights=F.col("weight")), "mix-levels")
    total = rows.agg(F.sum("source_size").alias("all_sizes"), F.sum("weight").alias("all_weights"))
    level = (F.col("all_sizes") * F.lit(float(share)) - F.col("caps")) / (F.col("all_weights") - F.col("weights"))
    leveled = rows.crossJoin(F.broadcast(total)).withColumn("level", level)  # one row of totals
    final = leveled.agg(F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", (-F.col("level")).alias("less"))))["less"].alias("less")).select((-F.col("less")).alias("final"))  # the first of equal ratios
    target = F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap")))
    return rows.crossJoin(F.broadcast(final)).select("source", "source_size", "weight", target.alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with ``copies`` (whole times a source is taken) and ``below``, the threshold of one more time.

    ``sized`` has ``source, size, digits``.  After the first level only the
    documents of the buckets in which budgets end are read; the last bucket is
    taken if that comes nearer to the target.
    """
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = targets.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("prefix", F.lit(""))
    state = stored(state, "mix-state")
    for level in range(LEVELS):
        at, last = level * DIGITS, level + 1 == LEVELS
        edge = bounded_broadcast(state.where("rest > 0").select(F.col("source").alias("s"), "prefix", "rest"), MAX_BROADCAST_SOURCES)
        match = sized["source"].eqNullSafe(edge["s"])
        here = sized.join(edge, match & (F.substring(sized["digits"], 1, at) == edge["prefix"]) if level else match)
        if level == 1:
            sized = stored(here.select("source", "size", "digits"), "mix-edges")
            here = sized.join(edge, sized["source"].eqNullSafe(edge["s"]))
        histogram = here.groupBy("source", F.substring("digits", at + 1, DIGITS).alias("bucket")).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
        order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        run = histogram.withColumn("upto", F.sum("n").over(order)).withColumn("under", F.col("upto") - F.col("n"))
        cross = run.where((F.col("under") < F.col("rest")) & (F.col("rest") <= F.col("upto")))
        if last:
            take = (F.col("upto") - F.col("rest")) <= (F.col("rest") - F.col("under"))
            cross = cross.select("source", F.when(take, F.concat("bucket", F.lit("g"))).otherwise(F.col("bucket")).alias("bucket"), F.lit(0.0).alias("left"))
        else:
            cross = cross.select("source", "bucket", (F.col("rest") - F.col("under")).alias("left"))
        cross = cross.groupBy("source").agg(F.min_by("bucket", "bucket").alias("bucket"), F.min_by("left", "bucket").alias("left")).withColumnRenamed("source", "s")
        joined = state.join(cross, state["source"].eqNullSafe(cross["s"]), "left")
        state = stored(joined.select("source", "source_size", "weight", "target", "copies", F.coalesce("left", F.lit(0.0)).alias("rest"), F.concat("prefix", F.coalesce("bucket", F.lit(""))).alias("prefix")), "mix-state")
    return state.select("source", "source_size", "weight", "target", "copies", F.col("prefix").alias("below"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), share: float = 1.0, cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = False) -> DataFrame:
    """How often the mix takes each document.

    One row per row of ``docs``: ``doc_id, size, source_size, target, copies,
    taken``; with ``keep``, all columns of ``docs`` and behind them
    ``_sw_copies`` (with underscores behind it where ``docs`` has such a
    column), for the documents that are taken at all.
    """
    sized = docs.select(F.col(f"`{id_col}`").alias("doc_id"), column_or_null(docs, source_col, "string").alias("source"), n_words(F.col(f"`{text_col}`").cast("string")).alias("size"))
    sized = stored(sized.withColumn("digits", hash_digits(F.col("doc_id"))), "mix-sizes")
    cuts = thresholds(sized, source_targets(sized, weights, share, cap))
    if keep:
        digits, key, source, below, copies, out = unused(docs, "_sw_digits", "_sw_key", "_sw_source", "_sw_below", "_sw_whole", "_sw_copies")
        own = docs.withColumn(digits, hash_digits(F.col(f"`{id_col}`"))).withColumn(key, column_or_null(docs, source_col, "string"))
        named = bounded_broadcast(cuts.select("source", "below", "copies").toDF(source, below, copies), MAX_BROADCAST_SOURCES)
        rows = own.join(named, F.col(key).eqNullSafe(F.col(source)))
        rows = rows.withColumn(out, (F.col(copies) + F.when(F.col(digits) < F.col(below), 1).otherwise(0)).cast("long"))
        return rows.where(F.col(out) > 0).select(*(F.col(f"`{c}`") for c in docs.columns), out)
    cuts = bounded_broadcast(cuts.withColumnRenamed("source", "_source"), MAX_BROADCAST_SOURCES)
    rows = sized.join(cuts, F.col("source").eqNullSafe(F.col("_source")))
    rows = rows.withColumn("copies", (F.col("copies") + F.when(F.col("digits") < F.col("below"), 1).otherwise(0)).cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
