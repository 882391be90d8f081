"""Names for values inside expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once.

    An expression that body uses several times would be copied into the plan as often, and
    one inside a lambda would be computed for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
