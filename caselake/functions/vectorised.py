"""Arrow-batched functions that are built when first used, so that Python workers can import their modules."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def vectorised(kind: str) -> Callable:
    """A decorator: the function over pandas Series becomes one over columns."""

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def call(*columns: Column) -> Column:
            return pandas_udf(f, kind)(*columns)

        return call

    return wrap
