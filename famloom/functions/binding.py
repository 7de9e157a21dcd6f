"""Naming an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is computed once per row.

    Without it an array used inside a lambda would be rebuilt for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
