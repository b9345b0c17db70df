"""Numbers as text: half-up rounding, percentages, lists, and which numbers a text may show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"\d[\d.,]*\d|\d"


def half_up(x: Column, digits: int = 0) -> Column:
    """With thousands separators; ties go up, also where the binary value would go to even."""
    return F.format_number(F.round(x.cast("string").cast(f"decimal(30,{max(digits + 8, 10)})"), digits), digits)


def percent(x: Column, digits: int = 0) -> Column:
    return F.concat(half_up((x.cast("string").cast("decimal(28,10)") * 100).cast("decimal(30,10)"), digits), F.lit("%"))


def listed(items: Column, last: str = "and") -> Column:
    """a, b and c."""
    head = F.array_join(F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0))), ", ")
    return F.when(F.size(items) < 2, F.array_join(items, "")).otherwise(F.concat(head, F.lit(f" {last} "), F.element_at(items, -1)))


def unknown_numbers(texts: DataFrame, allowed: DataFrame, text_col: str = "text", allowed_col: str = "number") -> DataFrame:
    """Number tokens of the texts that no fact has: empty if every number shown can be traced."""
    shown = texts.select(F.explode(F.regexp_extract_all(text_col, F.lit(NUMBER), F.lit(0))).alias(allowed_col)).distinct()
    return shown.join(allowed.select(F.col(allowed_col).cast("string").alias(allowed_col)).distinct(), allowed_col, "left_anti")
