"""Mixing sources to target weights, measured in tokens.

Documents are counted by exact token length; a bounded knapsack over these counts says how many of each length fill a
source's budget; seeded documents are then taken by length.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorecast.llm.tokens import VOCABULARY, token_counts
from lorecast.operators.skew import HOT_ROWS, salted_join
from lorecast.session import write_shared

#: The part of a budget that the knapsack fills exactly; what is above is taken in proportion to the lengths' counts.
KNAPSACK_TOKENS = 1 << 16
#: Of one source and length more documents than this are ranked in parts by the first bits of their hash, which changes no rank.
RANK_ROWS = 10_000
PART_BITS = 12


def fill_budget(lengths: Sequence[int], counts: Sequence[int], budget: int, seed: int = 0) -> list[int]:
    """How many documents of each length to take: at most as many as there are, together as near below ``budget`` as may be.

    Lengths are taken in proportion, rounded down, until the last ``KNAPSACK_TOKENS``; these are filled by a bounded knapsack
    over what is left of each length, whose reachable sums are the bits of a number. Beyond the knapsack's window the result is
    exact whenever some sum of the remaining documents hits the budget.
    """
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    if budget <= 0:
        return [0] * len(lengths)
    share = max(0, budget - KNAPSACK_TOKENS // 2) / total
    taken = [int(c * share) for c in counts]
    rest = budget - sum(n * k for n, k in zip(lengths, taken))
    order = sorted(range(len(lengths)), key=lambda i: (taken[i] - counts[i] * share, lengths[i]))
    for i in order:  # largest remainders first
        if rest <= KNAPSACK_TOKENS:
            break
        if taken[i] < counts[i] and lengths[i] <= rest - KNAPSACK_TOKENS // 2:
            taken[i] += 1
            rest -= lengths[i]
    for i in sorted(order, key=lambda i: -lengths[i]):
        more = min(counts[i] - taken[i], max(0, rest - KNAPSACK_TOKENS) // lengths[i])
        taken[i] += more
        rest -= more * lengths[i]
    window = min(rest, 2 * KNAPSACK_TOKENS)
    mask, bits = (1 << (window + 1)) - 1, 1
    small = [i for i in range(len(lengths)) if lengths[i] <= window and taken[i] < counts[i]]
    random.Random(seed).shuffle(small)
    steps: list[tuple[int, int, int]] = []  # length's place, copies, the sums reachable before
    for i in small:
        left, piece = min(counts[i] - taken[i], window // lengths[i]), 1
        while left and not bits >> window & 1:
            piece = min(piece, left)
            grown = bits | bits << piece * lengths[i] & mask
            if grown != bits:
                steps.append((i, piece, bits))
                bits = grown
            left -= piece
            piece *= 2
        if bits >> window & 1:
            break
    at = bits.bit_length() - 1
    for i, piece, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += piece
            at -= piece * lengths[i]
    return taken


def mix_budgets(hist: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per mix and source: target_share, max_repeats, available tokens, budget.

    The total of a mix is ``total_tokens``, or else the most, up to the tokens of its sources, at which every source that has
    documents can give its share within its repeats. A source without documents has nothing available and gives nothing;
    targets written twice count once; shares or repeats that are null, or not above 0, ask for nothing.
    """
    available = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("docs")).alias("available"))
    wanted = targets.select("mix_name", "source", "target_share", "max_repeats").distinct().where((F.col("target_share") > 0) & (F.col("max_repeats") > 0))
    rows = wanted.join(available, "source", "left").fillna(0, ["available"])
    most = F.min(F.when(F.col("available") > 0, F.col("available") * F.col("max_repeats") / F.col("target_share")))
    totals = rows.groupBy("mix_name").agg((F.lit(total_tokens).cast("double") if total_tokens is not None else F.least(most, F.sum("available").cast("double"))).alias("total"))
    budget = F.least(F.floor(F.col("target_share") * F.col("total") + 1e-6), F.col("available") * F.col("max_repeats"))
    return rows.join(totals, "mix_name").withColumn("budget", F.coalesce(budget, F.lit(0)).cast("bigint")).drop("total")


def _fill(seed: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("n")
        first = group.iloc[0]
        whole = int(first.budget) // int(first.available)
        rest = int(first.budget) - whole * int(first.available)
        extra = fill_budget([int(n) for n in group.n], [int(c) for c in group.docs], rest, seed) if whole < first.max_repeats else [0] * len(group)
        return pd.DataFrame({"mix_name": group.mix_name, "source": group.source, "n": group.n, "docs": group.docs, "whole": whole, "extra": extra})

    return run


def mixed(docs: DataFrame, id_col: str, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(mix_name, source, id, n_tokens, uses): each document used in a mix and how many times, from (id, source, n_tokens).

    Documents without source or tokens are never used; ids occur once. Every document of a source is used as often as the
    budget holds the whole source; of the rest, documents are chosen by a seeded hash among those of one length. An empty
    table gives no rows.
    """
    known = docs.select(F.col(id_col).alias("id"), "source", F.col("n_tokens").alias("n")).where((F.col("n") > 0) & F.col("source").isNotNull())
    hist = known.groupBy("source", "n").agg(F.count("*").alias("docs"))
    budgets = mix_budgets(hist, targets, total_tokens).where("budget > 0")
    lengths = hist.join(F.broadcast(budgets), "source")  # a row per target of the given mixes
    quota = lengths.groupBy("mix_name", "source").applyInPandas(_fill(seed), "mix_name string, source string, n bigint, docs bigint, whole bigint, extra bigint")
    quota = write_shared(quota.where("whole > 0 or extra > 0"), "quota").hint("merge")  # a row per length and target: never broadcast
    joined = salted_join(known, quota, ["source", "n"], "inner", F.col("id"), hot_rows)
    h = F.xxhash64(F.lit(seed), "mix_name", "id")
    part = F.when(F.col("docs") > RANK_ROWS, F.shiftright("h", 64 - PART_BITS)).otherwise(0)  # parts are in the order of the hash
    hashed = joined.withColumn("h", h).withColumn("part", part.cast("int"))
    group = ["mix_name", "source", "n"]
    sizes = hashed.where(F.col("docs") > RANK_ROWS).groupBy(*group, "part").agg(F.count("*").alias("rows"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 ** PART_BITS rows
    sizes = sizes.select(*group, "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    placed = hashed.join(sizes, [*group, "part"], "left")
    rank = F.row_number().over(Window.partitionBy(*group, "part").orderBy("h", "id")) + F.coalesce("offset", F.lit(0))
    uses = F.col("whole") + F.when(rank <= F.col("extra"), 1).otherwise(0)
    return placed.withColumn("uses", uses.cast("int")).where("uses > 0").select("mix_name", "source", F.col("id").alias(id_col), F.col("n").alias("n_tokens"), "uses")


def actual_shares(mix: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: target_share, max_repeats, available_tokens, used_tokens, most_uses and actual_share (0 without use)."""
    available = docs.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    used = mix.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"), F.max("uses").alias("most_uses"))
    rows = targets.select("mix_name", "source", "target_share", "max_repeats").distinct().join(available, "source", "left").join(used, ["mix_name", "source"], "left").fillna(0)
    total = F.sum("used_tokens").over(Window.partitionBy("mix_name"))  # a row per target
    return rows.withColumn("actual_share", F.when(total > 0, F.col("used_tokens") / total).otherwise(0.0))


def counted(documents: DataFrame, id_col: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """(id, source, n_tokens), written to the shared folder as it is read several times."""
    return write_shared(token_counts(documents, [id_col, "source"], "text", path=path), "lengths")
