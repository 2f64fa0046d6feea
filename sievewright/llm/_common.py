"""What the operators share: tables in the shared folder, bounded broadcasts, let-bindings."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.sources.shared import stored

__all__ = ["SPACE", "SPACES", "bounded_broadcast", "column_or_null", "let", "release", "stored", "unused"]

#: White space of the word definition ``[^\x20\x09-\x0D]+``.
SPACE = " \t\n\x0b\x0c\r"
#: The same as a regular expression that both Java and Python read.
SPACES = r"[\x20\x09-\x0D]+"


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of finished jobs whose frames are out of scope."""
    gc.collect()
    spark._jvm.System.gc()


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``rows`` rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """Column ``name`` as ``kind``, or null where ``df`` lacks it."""
    return (df[f"`{name}`"] if name in df.columns else F.lit(None)).cast(kind)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as make it no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
