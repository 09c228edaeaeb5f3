"""Streams: activity per hour, ingest without duplicates, and review states kept up to date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorecast.operators.reviews import START, STATE, Review


def hourly_counts(events: DataFrame, time_col: str, kind_col: str, late: str = "2 hours") -> DataFrame:
    """(hour, kind, events) of a stream; rows later than ``late`` behind the newest are dropped, rows without time too."""
    timed = events.withColumn("_at", F.col(time_col).cast("timestamp")).where("_at is not null").withWatermark("_at", late)
    return timed.groupBy(F.window("_at", "1 hour").alias("w"), F.col(kind_col).alias("kind")).agg(F.count("*").alias("events")).select(F.col("w.start").alias("hour"), "kind", "events")


def fresh_documents(docs: DataFrame, base_col: str, text_col: str, time_col: str, late: str = "1 day") -> DataFrame:
    """The first row of each base and text of a stream of documents, within the time that state is kept."""
    timed = docs.withColumn("_at", F.col(time_col).cast("timestamp")).withColumn("doc_hash", F.sha2(text_col, 256)).withWatermark("_at", late)
    return timed.dropDuplicatesWithinWatermark([base_col, "doc_hash"]).drop("_at")


def append_to(path: str):
    """A foreachBatch sink that appends each batch to Parquet under its own name, so that a batch run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def _review(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = Review(*state.get) if state.exists else START
    for rows in batches:
        for quality, difficulty in rows.sort_values(["at", "id"])[["quality", "difficulty"]].itertuples(index=False):
            now = now.answered(int(quality), difficulty)
    state.update(tuple(now))
    yield pd.DataFrame([(str(key[0]), str(key[1]), *now)], columns=["learner", "exercise", *Review._fields])


def review_stream(answers: DataFrame) -> DataFrame:
    """The review states that changed in each batch, from a stream of (learner, exercise, at, id, quality[, difficulty])."""
    difficulty = F.coalesce("difficulty", F.lit("")) if "difficulty" in answers.columns else F.lit("medium")
    known = answers.select(F.col("learner").cast("string"), F.col("exercise").cast("string"), "at", "id", F.col("quality").cast("int"), difficulty.alias("difficulty")).dropna()
    return known.groupBy("learner", "exercise").applyInPandasWithState(_review, f"learner string, exercise string, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)
