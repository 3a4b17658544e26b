"""Matching-block similarity of two texts (Ratcliff-Obershelp).

Not expressible with built-ins (edit distance is a different measure), so the
ratio itself runs in an Arrow function.  Pairs that cannot reach the threshold
by length alone are removed before any text leaves the JVM.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lurewatch.functions.text import strip_space


def clean(reply: Column) -> Column:
    return strip_space(F.lower(reply))


def seq_ratio(a: Column, b: Column) -> Column:
    """Similarity of two strings, 0 to 1."""
    return max_ratio(a, F.array(b))


def max_ratio(text: Column, others: Column) -> Column:
    """Largest similarity of ``text`` to any of ``others``; null without any."""

    @F.arrow_udf(DoubleType())
    def ratio(left: pa.Array, right: pa.Array) -> pa.Array:
        from difflib import SequenceMatcher

        out = []
        for a, past in zip(left.to_pylist(), right.to_pylist()):
            best = None
            for b in past or []:
                if a is not None and b is not None:
                    r = SequenceMatcher(None, a, b).ratio()
                    best = r if best is None or r > best else best
            out.append(best)
        return pa.array(out, type=pa.float64())

    return ratio(text, others)


def reachable(text: Column, others: Column, threshold: float) -> Column:
    """Those of ``others`` whose length still allows ``threshold``."""
    n = F.length(text)
    bound = lambda o: F.least(n, F.length(o)) * 2 / (n + F.length(o))
    return F.filter(others, lambda o: (n + F.length(o) == 0) | (bound(o) >= threshold))
