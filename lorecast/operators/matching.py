"""Joins on one text holding another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorecast.operators.skew import HOT_ROWS, salted_join

#: Texts are joined on runs of so many signs.
GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """The distinct runs of ``n`` signs of ``text``."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1)), lambda i: F.substring(text, i, F.lit(n))))


def containing(needles: DataFrame, needle: str, texts: DataFrame, text: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows of ``texts`` with each needle that their text holds, as written: the needle's column is added.

    Both sides are joined on a run of signs that any text holding the needle must have (its last three, or all of a shorter
    one), and only what meets there is compared. Null texts and null or empty needles match nothing; needles are distinct.
    """
    asked = needles.select(F.col(needle).alias(needle)).where(F.length(needle) > 0).distinct().withColumn("_gram", F.when(F.length(needle) < GRAM, F.col(needle)).otherwise(F.right(needle, F.lit(GRAM))))
    short = F.concat(*(_grams(F.col(text), n) for n in range(1, GRAM + 1)))
    held = texts.where(F.col(text).isNotNull()).withColumn("_gram", F.explode(F.array_distinct(short)))
    met = salted_join(held, asked, ["_gram"], "inner", F.xxhash64(text), hot_rows)
    return met.where(F.contains(F.col(text), F.col(needle))).drop("_gram")
