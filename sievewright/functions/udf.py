"""Arrow column functions that need no session until they are used."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(kind: str):
    """Makes a function on pandas Series a function on columns of type ``kind``."""

    def wrap(f):
        @wraps(f)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        return call

    return wrap
