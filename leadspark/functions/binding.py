"""Bind an intermediate value inside one Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body mentions it.

    Column expressions are trees: naming a sub-expression in Python copies it at every mention, and nested
    copies grow until the generated code no longer compiles. A lambda variable is a real binding.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
