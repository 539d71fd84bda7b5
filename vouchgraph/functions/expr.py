"""Column expressions shared by the graph operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import EPSILON

KINDS = {"U": "User", "B": "Beacon", "C": "Comment", "O": "Opinion", "V": "PollVariant", "P": "Poll"}


def kind_of(name: Column) -> Column:
    """Node kind as its letter, by the name's first character; null when unknown."""
    first = F.substring(name, 1, 1)
    return F.when(first.isin(*KINDS), first)


def sign(x: Column) -> Column:
    """-1, 0 or 1; values within EPSILON of zero are 0."""
    return F.when(x > EPSILON, 1).when(x < -EPSILON, -1).otherwise(0)


def micro(weight: Column) -> Column:
    """Absolute weight in millionths: integers add up alike in any order."""
    return F.round(F.abs(weight) * 1e6).cast("long")
