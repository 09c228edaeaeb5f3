"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorecast.session import write_shared

#: A key with more rows than this is spread over several tasks, about so many rows for each.
HOT_ROWS = 500_000
#: The table of hot keys is broadcast: 16 bytes a key, so at most 16 MB.
MOST_HOT = 1_000_000


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int = HOT_ROWS, most: int = MOST_HOT) -> tuple[DataFrame, int]:
    """(key_hash, salts) of every key with ``min_rows`` rows or more, and how many they are; null keys are left out.

    ``salts`` is the number of tasks that the key's rows need. There are at most rows / min_rows such keys; should that be
    above ``most``, the limit is doubled until the table is small enough to be broadcast. It is written, not collected.
    """
    counts = df.select(*keys).dropna().groupBy(*keys).count().where(F.col("count") >= min_rows)
    hot = write_shared(counts.select(F.xxhash64(*keys).alias("key_hash"), "count").groupBy("key_hash").agg(F.sum("count").alias("count")), "hot")
    while (n := hot.count()) > most:
        min_rows *= 2
        hot = hot.where(F.col("count") >= min_rows)
    return hot.select("key_hash", F.ceil(F.col("count") / min_rows).cast("int").alias("salts")), n


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str,
    spread: Column,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """``left.join(right, keys, how)`` where every hot key of ``left`` is spread over as many tasks as its rows need.

    ``how`` keeps left rows as they are: inner, left, left_semi or left_anti. ``spread`` is an expression of ``left`` that
    differs among the rows of one key; keys have the same types on both sides. Rows of ``right`` are repeated for hot keys only. No key is hot: a plain join.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join can't do {how!r}")
    hot, n = hot_keys(left, keys, min_rows)
    if not n:
        return left.join(right, list(keys), how)
    hot = F.broadcast(hot.withColumnsRenamed({"key_hash": "_hot", "salts": "_salts"}))  # at most MOST_HOT rows
    salt = F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts")), F.lit(0)).cast("int")
    salted = left.join(hot, F.xxhash64(*keys) == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot", "_salts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    repeated = right.join(hot, F.xxhash64(*keys) == F.col("_hot"), "left").withColumn("_salt", copies).drop("_hot", "_salts")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
