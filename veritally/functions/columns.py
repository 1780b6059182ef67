"""How large expressions are worked out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def apart(value: Column) -> Column:
    """The same value, kept out of the code that Spark generates for a stage.

    A stage is one method; beyond 8,000 bytes of it the JVM never compiles it, so all of the stage runs many times slower.
    """
    return F.transform(F.array(F.lit(0)), lambda _: value)[0]


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that it may name many times: a row works it out once, :func:`apart` from generated code."""
    return F.transform(F.array(value), then)[0]
