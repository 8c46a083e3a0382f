"""One evaluation of an expression that is read many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once.

    The optimizer may merge projections and push filters through them, repeating an aliased
    expression at every reference; a lambda variable cannot be repeated that way.
    """
    return F.element_at(F.transform(F.array(value), use), 1)
