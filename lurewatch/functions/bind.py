"""Evaluate an expression once and use it several times inside a larger one.

Catalyst merges neighbouring projections and moves filters below them, which
copies a costly expression into every place that mentions it.  A lambda
variable is evaluated once however often it is used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)
