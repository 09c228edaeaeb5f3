"""Spaced repetition: the state of each learner and exercise after their answers in order.

Answers are sorted within partitions and folded as they stream by: a task holds one state, never a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ease after the first success by difficulty, for others and at least; days after the first two successes; what is
# left of an interval after a success with difficulty; successes in a row and accuracy from which an exercise is mastered;
# misses in a row from which it is weak; and the ranks of priorities.
FIRST_EASE = {"easy": 2.5, "medium": 2.3, "hard": 2.0}
OTHER_EASE, LEAST_EASE = 2.5, 1.3
FIRST_DAYS, PASS, HARD_PASS, HARD_SHARE = (1, 6), 3, 3, 0.8
MASTERED_AFTER, MASTERED_ACCURACY, WEAK_AFTER = 5, 0.85, 3
PRIORITY = {"high": 0, "medium": 1, "low": 2}


class Review(NamedTuple):
    """What is known of one learner and exercise."""

    reviews: int = 0
    correct: int = 0
    streak: int = 0
    misses: int = 0
    repetitions: int = 0
    interval_days: int = 0
    ease: float = OTHER_EASE
    last_quality: int = -1
    mastered: bool = False

    def answered(self, quality: int, difficulty: str | None = "medium") -> Review:
        """The state after one more answer of quality 0 to 5; ``difficulty`` sets the ease at the first success."""
        q = min(max(quality, 0), 5)
        passed, short = int(q >= PASS), 5 - q
        done = self.repetitions
        grown = int(self.interval_days * self.ease)
        days = FIRST_DAYS[done] if done < len(FIRST_DAYS) else max(1, int(grown * HARD_SHARE)) if q == HARD_PASS else grown
        base = FIRST_EASE.get(difficulty or "", OTHER_EASE) if passed > done else self.ease
        reviews, correct, repetitions = self.reviews + 1, self.correct + passed, passed * (done + 1)
        known = repetitions >= MASTERED_AFTER and correct / reviews >= MASTERED_ACCURACY
        return Review(
            reviews, correct, passed * (self.streak + 1), (1 - passed) * (self.misses + 1), repetitions, passed * days,
            max(LEAST_EASE, base + 0.1 - short * (0.08 + short * 0.02)), q, bool(passed and (self.mastered or known)),
        )


START = Review()
STATE = "reviews int, correct int, streak int, misses int, repetitions int, interval_days int, ease double, last_quality int, mastered boolean"
_SCHEMA = pa.schema([("learner", pa.string()), ("exercise", pa.string()), ("last_at", pa.timestamp("us")), *((n, pa.float64() if n == "ease" else pa.bool_() if n == "mastered" else pa.int32()) for n in Review._fields)])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    who, at, state, out = None, None, START, []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)

    for batch in batches:
        for learner, exercise, t, quality, difficulty in zip(*(c.to_pylist() for c in batch.columns)):
            if (learner, exercise) != who:
                if who:
                    out.append((*who, at, *state))
                who, state = (learner, exercise), START
            at, state = t, state.answered(quality, difficulty)
        if len(out) > 5000:
            yield made()
            out.clear()
    if who:
        out.append((*who, at, *state))
    yield made()


def review_states(answers: DataFrame) -> DataFrame:
    """One row per learner and exercise from answers (learner, exercise, at, id, quality[, difficulty]); equal times go by id.

    Rows with a null among learner, exercise, time or quality are left out; without difficulty exercises are of medium one; an
    empty table gives no rows. ``due_at`` is the last answer's time and the interval.
    """
    difficulty = F.col("difficulty") if "difficulty" in answers.columns else F.lit("medium")
    rows = answers.select(F.col("learner").cast("string"), F.col("exercise").cast("string"), F.col("at").cast("timestamp_ntz"), F.col("quality").cast("int"), difficulty.alias("difficulty"), "id").dropna(subset=["learner", "exercise", "at", "quality"])
    ordered = rows.repartition("learner", "exercise").sortWithinPartitions("learner", "exercise", "at", "id").drop("id")
    states = ordered.mapInArrow(_fold, f"learner string, exercise string, last_at timestamp_ntz, {STATE}")
    due = F.expr("last_at + make_dt_interval(interval_days)")
    return states.withColumn("due_at", due).withColumn("weak", F.col("misses") >= WEAK_AFTER).withColumn("accuracy", F.col("correct") / F.col("reviews"))


def quality_of(correct: Column) -> Column:
    """The quality of an answer that is only right or wrong."""
    return F.when(correct, 4).otherwise(1)


def is_right(answer: Column, expected: Column) -> Column:
    """Whether an answer is the expected one, without regard to case; a null is wrong."""
    return F.coalesce(F.upper(answer) == F.upper(expected), F.lit(False))


def in_mode(mode: str, now: Column) -> Column:
    """Whether an exercise left-joined to its state belongs to a session of this mode: new, due, review, wrong or all."""
    tried, due = F.col("reviews").isNotNull(), F.coalesce(F.col("due_at") <= now, F.lit(False))
    wrong = F.coalesce(F.col("reviews") > F.col("correct"), F.lit(False))
    modes = {"new": ~tried, "due": tried & due & ~F.coalesce("mastered", F.lit(False)), "review": tried & due, "wrong": wrong, "all": F.lit(True)}
    if mode not in modes:
        raise ValueError(f"mode is one of {tuple(modes)}, not {mode!r}")
    return modes[mode]


def session_order(priority: Column, due: Column) -> list[Column]:
    """By priority, then by due date, what was never tried first."""
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in PRIORITY.items() for x in pair)), priority), F.lit(len(PRIORITY)))
    return [rank, due.asc_nulls_first()]
