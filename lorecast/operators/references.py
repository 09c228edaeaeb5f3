"""References to records that do not exist, also over composite keys with partial nulls."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorecast.functions.keys import key
from lorecast.operators.skew import HOT_ROWS, salted_join

MATCHES = ("simple", "partial", "full")


def orphan_references(
    refs: DataFrame, records: DataFrame, keys: Sequence[str], match: str = "simple", hot_rows: int = HOT_ROWS, times: tuple[str, str] | None = None
) -> DataFrame:
    """Rows of ``refs`` whose key leads to no row of ``records``.

    References are grouped by null mask (which key columns are null) and each mask is anti-joined on its non-null columns.
    What a null in the key means is declared by ``match``, as in SQL:

    * ``simple``: a key with any null refers to nothing and is no orphan.
    * ``partial``: the non-null columns must occur together in a record; a key of nulls only is no orphan.
    * ``full``: a key is null throughout (no orphan) or not at all; a key that is null in part is an orphan.

    ``times`` names the time of a reference and that of a record: then a reference is also an orphan while its record does not
    exist yet, and the column ``late`` tells these from those without any record. A null time is never late.

    Repeated rows are kept as often as they occur; empty ``records`` make every complete key an orphan; empty ``refs`` give
    no rows; columns of ``records`` besides the keys, also those named like columns of ``refs``, play no part. Record keys
    with nulls count as records under ``partial`` for the masks that don't use the null columns. Keys of which many
    references are alike are spread over many tasks.
    """
    if match not in MATCHES:
        raise ValueError(f"match is one of {MATCHES}, not {match!r}")
    named = records.select(*keys, *([F.col(times[1]).alias("_first")] if times else []))
    late = [F.lit(False).alias("late")] if times else []
    order = refs.columns
    spread = F.struct(*(F.col(c) for c in order if not isinstance(refs.schema[c].dataType, _unhashable())))
    parts = []
    for mask in product((False, True), repeat=len(keys)):
        used = [k for k, null in zip(keys, mask) if not null]
        rows = refs.where(reduce(lambda a, b: a & b, (F.col(k).isNull() if null else F.col(k).isNotNull() for k, null in zip(keys, mask))))
        if not used:
            continue
        if len(used) == len(keys) or match == "partial":
            if times:  # the anti-join, and what would be left of it had later records not come yet
                first = named.dropna(subset=used).groupBy(*used).agg(F.min("_first").alias("_first"), F.lit(True).alias("_there"))
                met = salted_join(rows, first, used, "left", spread, hot_rows).where(F.col("_there").isNull() | (F.col("_first") > F.col(times[0])))
                parts.append(met.select(*order, F.col("_there").isNotNull().alias("late")))
            else:
                parts.append(salted_join(rows, named.dropna(subset=used).select(*used).distinct(), used, "left_anti", spread, hot_rows).select(*order))
        elif match == "full":
            parts.append(rows.select(*order, *late))
    return reduce(DataFrame.unionByName, parts)


def _unhashable() -> tuple:
    from pyspark.sql.types import MapType, VariantType

    return (MapType, VariantType)


def pair_references(pairs: DataFrame) -> DataFrame:
    """(qa_id, ref_field, ref_id, created_at): each distinct non-blank reference of each pair, keys in one spelling."""
    one = pairs.select(key("id").alias("qa_id"), F.lit("dataset_id").alias("ref_field"), key("dataset_id").alias("ref_id"), "created_at")
    many = pairs.select(
        key("id").alias("qa_id"), F.lit("expected_chunk_ids").alias("ref_field"), F.explode("expected_chunk_ids").alias("raw"), "created_at"
    ).select("qa_id", "ref_field", key("raw").alias("ref_id"), "created_at")
    return one.unionByName(many)


def pair_records(datasets: DataFrame, chunks: DataFrame) -> DataFrame:
    """(ref_field, ref_id, record_at): what the two reference fields can lead to."""
    return datasets.select(F.lit("dataset_id").alias("ref_field"), key("id").alias("ref_id"), F.col("created_at").alias("record_at")).unionByName(
        chunks.select(F.lit("expected_chunk_ids").alias("ref_field"), key("id").alias("ref_id"), F.col("created_at").alias("record_at"))
    )


def deletions(logs: DataFrame) -> DataFrame:
    """(ref_id, was_deleted): ids with a deletion, of single records or many at once, in any spelling of the action."""
    action = F.lower("action")
    return logs.where(action.contains("delet") & ~action.contains("undelet")).select(key("resource_id").alias("ref_id")).dropna().distinct().withColumn("was_deleted", F.lit(True))


def pair_orphans(pairs: DataFrame, datasets: DataFrame, chunks: DataFrame, logs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Orphan references of evaluation pairs: qa_id, ref_field, ref_id, orphan_kind, created_at of the pair.

    All come from the join by null mask under simple match on (ref_field, ref_id), given the times of pairs and records. Blank
    references are null and so no case; a null time is never late. Of pairs or records written several times the copies count
    once.
    """
    keys = ["ref_field", "ref_id"]
    orphans = orphan_references(pair_references(pairs), pair_records(datasets, chunks), keys, "simple", hot_rows, ("created_at", "record_at"))
    told = salted_join(orphans.where(F.col("qa_id").isNotNull()), deletions(logs), ["ref_id"], "left", F.col("qa_id"), hot_rows)
    kind = F.when(F.col("late"), "late").when(F.col("was_deleted"), "deleted").otherwise("missing")
    return told.select("qa_id", *keys, kind.alias("orphan_kind"), "created_at").distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per referenced table, month of the pair (null if it has no time) and kind."""
    table_of = F.when(F.col("ref_field") == "dataset_id", "eval_datasets").otherwise("document_chunks")
    return orphans.groupBy(
        table_of.alias("ref_table"), F.date_format("created_at", "yyyy-MM").alias("month"), "orphan_kind"
    ).agg(F.count("*").alias("orphans"), F.countDistinct("qa_id").alias("pairs"))
