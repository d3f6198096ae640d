"""Quantiles under the different rules that results are defined by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RULES = ("linear", "nearest", "floor", "half_even", "fraction")


def quantile(values: Column, q: float, rule: str = "linear") -> Column:
    """A quantile of a group as an aggregate expression.

    linear interpolates; nearest, floor and half_even pick the sorted value at (n-1)q rounded half up, down or half
    to even; fraction picks the one at floor(n*q). Nulls are left out; a group without values gives null.
    """
    if rule == "linear":
        return F.percentile(values, F.lit(q))
    ordered = F.array_sort(F.collect_list(values))
    n = F.size(ordered)
    place = {
        "nearest": F.floor((n - 1) * F.lit(q) + 0.5),
        "floor": F.floor((n - 1) * F.lit(q)),
        "half_even": F.bround((n - 1) * F.lit(q)),
        "fraction": F.least(F.floor(n * F.lit(q)), n - 1),
    }[rule]
    return F.get(ordered, place.cast("int"))
