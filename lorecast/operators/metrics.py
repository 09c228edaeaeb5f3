"""Ranking measures over result lists, as column expressions and as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hit_at_k(got: Column, want: Column, k: int) -> Column:
    """1 if one of the first ``k`` results is wanted, else 0; 0 if nothing is wanted."""
    return F.coalesce(F.arrays_overlap(F.slice(got, 1, k), want), F.lit(False)).cast("int")


def reciprocal_rank(got: Column, want: Column) -> Column:
    """1 over the place of the first wanted result, 0 without one; no cutoff."""
    places = F.filter(F.transform(got, lambda x, i: F.when(F.array_contains(want, x), i + 1)), lambda p: p.isNotNull())
    return F.coalesce(1 / F.array_min(places), F.lit(0.0))


def recall_at_k(got: Column, want: Column, k: int, total: Column | None = None) -> Column:
    """Wanted results among the first ``k`` over the number wanted; null if nothing is wanted.

    ``total`` is that number where ``want`` holds only those of the wanted results that were found.
    """
    total = F.size(want) if total is None else total
    return F.when(total > 0, F.size(F.array_intersect(F.slice(got, 1, k), want)) / total)


def ndcg_at_k(got: Column, want: Column, k: int, total: Column | None = None) -> Column:
    """Binary gains, each wanted result counted where it first occurs, over the best order; 0 if nothing is wanted. ``total``: see recall_at_k."""
    total = F.size(F.array_distinct(want)) if total is None else total
    first = F.slice(got, 1, k)
    gain = lambda p: 1 / F.log2(p + 1)
    sums = F.aggregate(F.transform(F.array_distinct(want), lambda w: F.array_position(first, w)), F.lit(0.0), lambda a, p: a + F.when(p > 0, gain(p)).otherwise(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(total.cast("int"), F.lit(k)))), F.lit(0.0), lambda a, i: a + gain(i))
    return F.when(total > 0, sums / ideal).otherwise(0.0)


def measured(lists: DataFrame, k: int) -> DataFrame:
    """``lists`` (query, got, want[, total]) with hit, mrr, ndcg and recall of each query; ``total``: see recall_at_k."""
    got, want = F.col("got"), F.col("want")
    total = F.col("total") if "total" in lists.columns else None
    return lists.select("query", hit_at_k(got, want, k).alias("hit"), reciprocal_rank(got, want).alias("mrr"), ndcg_at_k(got, want, k, total).alias("ndcg"), recall_at_k(got, want, k, total).alias("recall"))


def summary(per_query: DataFrame) -> DataFrame:
    """Means over all queries, rounded to 4 places; recall over those that want something."""
    mean = lambda c: F.coalesce(F.round(F.avg(c), 4), F.lit(0.0)).alias(c)
    return per_query.agg(F.count("*").alias("queries"), mean("hit"), mean("mrr"), mean("ndcg"), F.round(F.avg("recall"), 4).alias("recall"), F.coalesce(F.round(F.stddev_pop("mrr"), 4), F.lit(0.0)).alias("mrr_deviation"))
