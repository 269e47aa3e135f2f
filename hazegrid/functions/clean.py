"""Casts and text clean-up."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.functions.names import named


def cast_present(
    df: DataFrame, columns: Iterable[str], dtype: str, required: bool = False
) -> DataFrame:
    """Cast the listed columns that exist; others are skipped.

    Nulls stay null unless ``required``, which fails the job on a null instead.
    """
    have = dict(df.dtypes)
    out = {}
    for c in columns:
        if c in have and (have[c] != dtype or required):
            value = named(c).cast(dtype)
            if required:
                value = F.when(
                    named(c).isNull(), F.raise_error(F.lit(f"null in column {c}")).cast(dtype)
                ).otherwise(value)
            out[c] = value
    return df.withColumns(out) if out else df


def parse_point(text: Column) -> tuple[Column, Column]:
    """``"(lat, lon)"`` to two doubles."""
    parts = F.split(F.regexp_replace(text, "[()]", ""), ",", 2)
    return F.trim(parts[0]).cast("double"), F.trim(parts[1]).cast("double")


def fill_parent(df: DataFrame, id_col: str, parent_col: str, place_col: str) -> DataFrame:
    """A missing parent is the row itself; a missing device place is ``missing``."""
    parent = F.coalesce(
        F.col(parent_col).cast("double").cast("bigint"), F.col(id_col).cast("bigint")
    )
    return df.withColumns(
        {
            parent_col: parent.cast("string"),
            id_col: F.col(id_col).cast("string"),
            place_col: F.coalesce(F.col(place_col), F.lit("missing")),
        }
    )


def code_prefix(code: Column, length: int = 12) -> Column:
    return F.substring(code.cast("string"), 1, length)


def canonical_code(code: Column) -> Column:
    """Undo a float round trip of a numeric code: ``170.0`` becomes ``170``.

    DECIMAL keeps all digits of 15-digit block codes.
    """
    return code.cast("decimal(38,1)").cast("decimal(38,0)").cast("string")


def rename_or_drop(
    df: DataFrame, rename: dict[str, str] | None = None, drop: Iterable[str] = ()
) -> DataFrame:
    return df.drop(*drop).withColumnsRenamed(rename or {})
