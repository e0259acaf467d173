"""Bind a column value to a name inside an expression.

Spark may evaluate a column expression once per mention; ``let`` evaluates ``value`` once per
row (or per element, inside a lambda) and hands it to ``body`` as a lambda variable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))
