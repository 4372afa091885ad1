"""Naming an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with *value* computed once per row.

    A plain column used in several places is copied into each of them, also when a
    filter on the result is pushed down. A lambda variable is bound once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
