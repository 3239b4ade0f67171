"""Expressions that are computed once and named."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row. Inside a lambda an expression would be computed again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)
