"""Dominance predicates between two tuples of columns, all minimised.

``q`` is the tuple that may dominate, ``p`` the one that may be dominated.
Every builder returns a plain Column, so joins and filters stay in codegen.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

Tuple = Sequence[Column]


def every(conditions: Sequence[Column]) -> Column:
    return reduce(and_, conditions)


def some(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions)


def weakly_dominates(q: Tuple, p: Tuple) -> Column:
    """``q`` is nowhere worse than ``p``."""
    return every([a <= b for a, b in zip(q, p, strict=True)])


def strictly_dominates(q: Tuple, p: Tuple) -> Column:
    """``q`` is nowhere worse than ``p`` and better somewhere."""
    return weakly_dominates(q, p) & some([a < b for a, b in zip(q, p, strict=True)])


def equal_tuples(q: Tuple, p: Tuple) -> Column:
    return every([a == b for a, b in zip(q, p, strict=True)])


def dominates_unless_equal(q: Tuple, p: Tuple) -> Column:
    """The filter test: nowhere worse and not the same tuple."""
    return weakly_dominates(q, p) & ~equal_tuples(q, p)


def cell_totally_dominates(q: Tuple, p: Tuple) -> Column:
    """Every coordinate smaller: any row in ``q`` beats any row in ``p``."""
    return every([a < b for a, b in zip(q, p, strict=True)])


def cell_may_dominate(q: Tuple, p: Tuple) -> Column:
    """Some row in cell ``q`` could beat some row in the other cell ``p``."""
    return weakly_dominates(q, p) & ~equal_tuples(q, p)


def precedes(q: Tuple, p: Tuple) -> Column:
    """``q`` comes strictly before ``p`` in lexicographic order."""
    return F.struct(*_named(q)) < F.struct(*_named(p))


def dominates_in_order(q: Tuple, p: Tuple) -> Column:
    """Weak dominance by a strictly earlier tuple of the sorted sequence.

    An earlier tuple differs from ``p``, so this is strict dominance; it is the
    form a sorted pass that stops at its own row evaluates.
    """
    return precedes(q, p) & weakly_dominates(q, p)


def _named(columns: Tuple) -> list[Column]:
    return [c.alias(f"v{i}") for i, c in enumerate(columns)]
