"""Optimal string alignment distance: edits and swaps of neighbours, no substring edited twice.  Built-ins only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def may_be_within(a: Column, b: Column, most: int) -> Column:
    """A quick test that every pair within `most` passes: a swap is two plain edits at most."""
    return F.levenshtein(a, b, 2 * most) >= 0


def within_one(a: Column, b: Column) -> Column:
    """Distance of at most 1: one edit or one swap of neighbours."""
    swap = F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b)
    return (F.levenshtein(a, b, 1) >= 0) | ((F.length(a) == F.length(b)) & (F.levenshtein(a, b, 2) == 2) & swap)


def osa(a: Column, b: Column) -> Column:
    """The distance; null if either is null.  Rows of the table are folded one after the other, each from the two before it,
    which is for pairs of words that passed may_be_within()."""
    at = lambda s, i: F.substring(s, i, F.lit(1))
    numbers = F.sequence(F.lit(0), F.length(b))
    start = F.struct(numbers.alias("older"), numbers.alias("old"))

    def row(s: Column, i: Column) -> Column:
        def cell(new: Column, j: Column) -> Column:
            change = F.get(s["old"], j - 1) + F.when(at(a, i) == at(b, j), F.lit(0)).otherwise(F.lit(1))
            swapped = (i > 1) & (j > 1) & (at(a, i) == at(b, j - 1)) & (at(a, i - 1) == at(b, j))
            return F.concat(new, F.array(F.least(F.get(s["old"], j) + 1, F.get(new, j - 1) + 1, change, F.when(swapped, F.get(s["older"], j - 2) + 1))))

        return F.struct(s["old"].alias("older"), F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(i), cell).alias("old"))

    table = F.aggregate(F.sequence(F.lit(1), F.length(a)), start, row, lambda s: F.element_at(s["old"], -1))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), table).when(a.isNotNull() & b.isNotNull(), F.greatest(F.length(a), F.length(b)))
