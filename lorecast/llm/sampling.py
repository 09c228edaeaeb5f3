"""Bounded samples of labelled rows, on which models are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: The first try takes so many times the rows that are wanted.
MARGIN = 1.25


def sampled(rows: DataFrame, id_col: str, most: int, seed: str, total: int) -> list[Row]:
    """The ``most`` rows with the least hash of their id, or all if there are fewer: the same ones in whatever order rows come.

    ``total`` says about how many rows there are; it sets the hash below which rows are looked at, so that the driver gets few
    more than ``most`` however many tasks there are. Were they too few, the limit is raised until there are enough or none is
    left out: a sample is never empty unless ``rows`` are.
    """
    h, share = F.xxhash64(F.lit(seed), id_col), min(1.0, MARGIN * most / max(1, total))
    while True:
        near = rows if share >= 1 else rows.where(h <= F.lit(int(-(2**63) + share * 2**64)))
        if share >= 1:  # few rows in all, or nearly all are needed: sorted before they come
            return near.orderBy(h, id_col).limit(most).collect()
        found = near.withColumn("_hash", h).limit(8 * most).collect()
        if most <= len(found) < 8 * most:
            return sorted(found, key=lambda r: (r["_hash"], r[id_col]))[:most]
        share = min(1.0, share * (MARGIN * most / max(1, len(found)) if len(found) >= most / 64 else 64)) if len(found) < most else share / 4
