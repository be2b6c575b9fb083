"""Small scalar functions."""

from __future__ import annotations

from pyspark.sql import Column


def add(a: Column, b: Column) -> Column:
    return a + b


def sum_as_string(a: Column, b: Column) -> Column:
    return (a + b).cast("string")
