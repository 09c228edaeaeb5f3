"""Tables out: partitions that replace themselves, latest rows, deletions as snapshots, reports."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_partitions(df: DataFrame, path: str, by: str = "kb_id") -> None:
    """Writes ``df`` as Parquet by partition; partitions in ``df`` are replaced, all others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def latest(rows: DataFrame, keys: Sequence[str], newest: Sequence[Column]) -> DataFrame:
    """Of the rows of one key the first by ``newest`` stays (an upsert of old and new rows together)."""
    order = Window.partitionBy(*keys).orderBy(*newest)
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def without(rows: DataFrame, deleted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The snapshot after deletion of the keys in ``deleted``."""
    return rows.join(deleted.select(*keys).distinct(), list(keys), "left_anti")


def cascade(parents: DataFrame, children: DataFrame, deleted: DataFrame, key: str, parent_key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables after deletion of parents with all their children."""
    gone = deleted.select(F.col(key)).distinct()
    return without(parents, gone, [key]), children.join(gone.withColumnRenamed(key, parent_key), parent_key, "left_anti")


def remapped(rows: DataFrame, canonical: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` replaced where ``canonical`` (old, new) names another."""
    return rows.join(canonical.select(F.col("old").alias(column), "new").dropDuplicates([column]), column, "left").withColumn(column, F.coalesce("new", column)).drop("new")


def with_columns_of(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """``rows`` with missing columns added and nulls in them filled."""
    for name, value in defaults.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    return rows


def cascaded(deleted: DataFrame, tables: Sequence[tuple[str, DataFrame, str, str | None]]) -> dict[str, DataFrame]:
    """What is left of ``tables`` (name, rows, key, key of the parent) after deletion of the first one's keys in ``deleted``,
    each level taking with it what hangs on the one before."""
    left, gone, above = {}, deleted, ""
    for name, rows, of, parent in tables:
        link = parent or of
        keys = gone.withColumnRenamed(above, link)
        left[name] = rows.join(keys, link, "left_anti")
        gone, above = rows.join(keys, link, "left_semi").select(of).distinct(), of
    return left


def verified(rows: DataFrame, index: DataFrame, id_col: str, by: str) -> DataFrame:
    """Per ``by``: how many ids there are, how many of them ``index`` holds, and whether these are all."""
    there = rows.join(index.select(id_col).distinct().withColumn("_there", F.lit(True)), id_col, "left")
    sums = there.groupBy(by).agg(F.count("*").alias("expected"), F.count_if("_there").alias("indexed"))
    return sums.withColumn("complete", F.col("expected") == F.col("indexed"))


def reindexed(old: DataFrame, new: DataFrame, asked: DataFrame, of: str) -> DataFrame:
    """The chunks after a reindex of the documents in ``asked``: those for which ``new`` has chunks get them, all others,
    also those that failed, keep their old ones."""
    done = new.join(asked.select(of).distinct(), of, "left_semi")
    return old.join(done.select(of).distinct(), of, "left_anti").unionByName(done, allowMissingColumns=True)


def rebuilt(chunks: DataFrame, path: str, by: str = "kb_id") -> DataFrame:
    """An index written anew from its table, so that nothing but what the table holds is in it, and its check."""
    chunks.write.mode("overwrite").partitionBy(by).parquet(path)
    return verified(chunks, chunks.sparkSession.read.parquet(path).select(F.col("chunk_id")), "chunk_id", by)


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines, replacing the one before."""
    report.write.mode("overwrite").json(path)


#: A table of text is made of at most so many rows; a longer report is an error.
REPORT_ROWS = 1000


def markdown_table(report: DataFrame) -> str:
    """A small report (a row per configuration or base) as a Markdown table; more than ``REPORT_ROWS`` rows are an error."""
    got = report.limit(REPORT_ROWS + 1).collect()
    if len(got) > REPORT_ROWS:
        raise ValueError(f"a report of more than {REPORT_ROWS} rows is no table to read")
    rows = [[("" if v is None else str(v)) for v in r] for r in got]
    head = ["| " + " | ".join(report.columns) + " |", "|" + " --- |" * len(report.columns)]
    return "\n".join(head + ["| " + " | ".join(r) + " |" for r in rows])


def latex_table(report: DataFrame) -> str:
    """The same as a LaTeX tabular."""
    lines = [line.strip("| ").split(" | ") for line in markdown_table(report).split("\n")]
    body = [" & ".join(re.sub(r"([&%$#_{}])", r"\\\1", c) for c in line) + r" \\" for k, line in enumerate(lines) if k != 1]
    return "\n".join([r"\begin{tabular}{" + "l" * len(report.columns) + "}", *body, r"\end{tabular}"])
