"""Greedy top-k with exclusion over bounded arrays (non-maximum suppression)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def greedy_top_k(ranked: Column, position: str, gap: Column, k: int, element: str) -> Column:
    """Keeps an element of ``ranked`` (an array, best first) if its field ``position`` is at least
    ``gap`` from that of all kept before, until ``k`` are kept. ``element`` is the array's SQL type.

    The fold is sequential by nature; it runs inside a row, over arrays that are short by construction.
    A null array stays null.
    """
    empty = F.array().cast(element)
    far = lambda kept, x: F.forall(kept, lambda y: F.abs(y[position] - x[position]) >= gap)
    return F.aggregate(ranked, empty, lambda kept, x: F.when((F.size(kept) < k) & far(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
