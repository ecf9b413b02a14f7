"""A fence for the optimizer: an expression that is computed once, where it stands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fence(expression: Column) -> Column:
    """The same value, as an expression that isn't deterministic.

    Catalyst puts what a projection computes into every place above that uses it, filters among them; of a large CASE
    over a large CASE that makes code that can't be compiled. It leaves expressions that aren't deterministic alone.
    No filter moves below a fence, so fences stand only where there is nothing to be filtered out.
    """
    return F.when(F.spark_partition_id() >= 0, expression)
