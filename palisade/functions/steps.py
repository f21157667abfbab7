"""Keeping long column derivations in separate steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(frame: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns by way of a one-row generator.

    Later steps use each of them many times; Spark does not substitute expressions through a
    generator, so they are evaluated once and the plan stays small.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return frame.select("*", F.inline(F.array(row)))
