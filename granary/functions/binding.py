"""Binding a column expression to a name inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once however often the body names it: a lambda over a one-element array.

    Without it, an expression that is used k times is written k times into the plan, and nested uses multiply.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
