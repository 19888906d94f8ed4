"""Helpers for expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    A column used several times in a lambda is computed at each use, for every element. A one-element array
    binds it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
