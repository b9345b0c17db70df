"""Checks for what is shown: contrast of colours, and how many lines a text takes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of WCAG 2: channel weights and the linear part of sRGB.
WEIGHTS = (0.2126, 0.7152, 0.0722)


def luminance(colour: Column) -> Column:
    """Relative luminance of #rrggbb."""
    digits = F.regexp_replace(colour, "^#", "")
    total = F.lit(0.0)
    for k, weight in enumerate(WEIGHTS):
        c = F.conv(F.substring(digits, 2 * k + 1, 2), 16, 10).cast("double") / 255
        total = total + weight * F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
    return total


def contrast(a: Column, b: Column) -> Column:
    """Contrast ratio, 1 to 21."""
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def line_count(text: Column, width: int) -> Column:
    """Lines of a text wrapped at spaces to a width in characters; a longer word has a line of its own."""

    def fold(acc: Column, word: Column) -> Column:
        longer = F.when(acc["used"] == 0, F.length(word)).otherwise(acc["used"] + 1 + F.length(word))
        fits = (acc["used"] == 0) | (longer <= width)
        return F.when(fits, F.struct(acc["n"].alias("n"), longer.alias("used"))).otherwise(F.struct((acc["n"] + 1).alias("n"), F.length(word).alias("used")))

    start = F.struct(F.lit(1).alias("n"), F.lit(0).alias("used"))
    paragraphs = F.transform(F.split(text, "\n"), lambda p: F.aggregate(F.split(p, " "), start, fold, lambda acc: acc["n"]))
    return F.aggregate(paragraphs, F.lit(0), lambda n, x: n + x)
