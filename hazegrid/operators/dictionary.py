"""Distributed category dictionaries: each distinct value of a column with its number.

A dictionary is a stored table, made by range-partitioning the distinct values, so it
takes any number of them and none reaches the driver. Numbers follow the values' order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder as MLOneHotEncoder
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.functions.names import named
from hazegrid.operators.joins import join_lookup
from hazegrid.session import materialize

#: Rows of one task among the numbers that ``monotonically_increasing_id`` gives out.
_ROWS = 2**33


@dataclass(frozen=True)
class Dictionary:
    """``table`` (value, index from 0) of a column's ``size`` distinct non-null values."""

    column: str
    table: DataFrame
    size: int

    @classmethod
    def of(cls, df: DataFrame, column: str) -> Dictionary:
        """Distinct values in order, numbered task by task.

        A task's rows are numbered as they lie after the sort; only the tasks' row counts
        meet, to say where each one's numbers begin.
        """
        values = df.select(named(column).alias("value")).where("value IS NOT NULL").distinct()
        ordered = values.repartitionByRange("value").sortWithinPartitions("value")
        placed = materialize(ordered.withColumn("place", F.monotonically_increasing_id()), "dictionary")
        task = F.floor(F.col("place") / _ROWS)
        # One row a task. Tasks without rows have none, and need none.
        counts = placed.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n"))
        starts = counts.select("task", F.expr("sum(n) OVER (ORDER BY task) - n").alias("start"), "n")
        starts = materialize(starts, "dictionary-starts")
        size = starts.agg(F.sum("n")).first()[0] or 0
        numbered = placed.withColumn("task", task).join(F.broadcast(starts), "task")
        index = (F.col("start") + F.col("place") % _ROWS).alias("index")
        return cls(column, materialize(numbered.select("value", index), "dictionary"), size)

    def attach(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with the value's number; null for null and for a value that is not listed."""
        lookup = self.table.select(F.col("value").alias(self.column), F.col("index").alias(name))
        return join_lookup(df, lookup, [self.column])

    def values(self, most: int) -> list:
        """All values in order; more than ``most`` of them are an error."""
        if self.size > most:
            raise ValueError(f"{self.column} has {self.size} categories, too many for a column each; use vectors")
        return [r["value"] for r in self.table.orderBy("index").collect()]


def one_hot_vectors(df: DataFrame, dictionaries: Sequence[Dictionary], name: str) -> DataFrame:
    """``df`` with one sparse vector: a 1 for each column's value, none for null or an unlisted value.

    The vector is as long as all dictionaries together, in their order.
    """
    indexed, made = df, []
    for i, known in enumerate(dictionaries):
        if known.size:
            # The number after the last one is the encoder's for what it does not know.
            indexed = known.attach(indexed, f"__i{i}").withColumn(f"__i{i}", F.coalesce(f"__i{i}", F.lit(known.size)).cast("double"))
            encoder = MLOneHotEncoder(inputCol=f"__i{i}", outputCol=f"__v{i}", handleInvalid="keep", dropLast=True)
            last = df.sparkSession.range(known.size - 1, known.size).select(F.col("id").cast("double").alias(f"__i{i}"))
            indexed = encoder.fit(last).transform(indexed)
            made.append(i)
    joined = VectorAssembler(inputCols=[f"__v{i}" for i in made], outputCol=name).transform(indexed)
    return joined.drop(*[f"__{x}{i}" for i in made for x in "iv"])


def refuse_unknown(index: Column, column: str) -> Column:
    """The index, or an error that names the value."""
    text = F.coalesce(named(column).cast("string"), F.lit("null"))
    refused = F.raise_error(F.concat(F.lit(f"unknown category in {column}: "), text)).cast("bigint")
    return F.coalesce(index, refused)
