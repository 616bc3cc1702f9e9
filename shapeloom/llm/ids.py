"""Ids of any type as values that have an order and no null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAST, LAST_TEXT = (1 << 63) - 1, chr(0x10FFFF) * 4


def is_whole(docs: DataFrame, id_col: str) -> bool:
    return docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")


def last_id(docs: DataFrame, id_col: str) -> Column:
    """What stands for null: the largest 64-bit integer, or a text behind all others."""
    return F.lit(LAST if is_whole(docs, id_col) else LAST_TEXT)


def ordered_id(docs: DataFrame, id_col: str) -> Column:
    """The id as an integer, or else as a text; null as the last of them."""
    return F.coalesce(F.col(id_col).cast("long" if is_whole(docs, id_col) else "string"), last_id(docs, id_col))
