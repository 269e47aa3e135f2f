"""Columns by their exact name, also when it holds dots or spaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(name: str) -> Column:
    return F.col(f"`{name}`")
