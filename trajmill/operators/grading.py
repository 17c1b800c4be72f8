"""Grading from recorded outputs. No program is run here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajmill import constants as C
from trajmill.functions.feedback import all_passed, error_feedback, passed, passed_private
from trajmill.operators import skew


def attach_problem(
    rollouts: DataFrame, problems: DataFrame, keys: list[str], limit: int = skew.HOT_ROWS
) -> DataFrame:
    """Problem columns for each rollout. A problem's rollouts may be many."""
    return skew.skew_join(rollouts, problems, keys, ["ID"], "inner", limit)


def expected_outputs(problems: DataFrame) -> DataFrame:
    """Tests of a contest problem, one row each: ``visibility, test_id, input, expected``."""

    def side(name: str) -> DataFrame:
        tests = F.arrays_zip(
            F.col(f"{name}_tests.input").alias("input"),
            F.col(f"{name}_tests.output").alias("output"),
        )
        return problems.select(
            "data_id", F.lit(name).alias("visibility"), F.posexplode(tests).alias("test_id", "t")
        ).select("data_id", "visibility", "test_id", "t.input", F.col("t.output").alias("expected"))

    return side("public").unionByName(side("private"))


def grade_outputs(
    rollouts: DataFrame, problems: DataFrame, outputs: DataFrame, limit: int = skew.HOT_ROWS
) -> DataFrame:
    """Feedback per rollout from recorded outputs.

    ``rollouts``: ``ID, data_id``; ``outputs``: ``ID, visibility, test_id, actual``, with a
    null output for a run that timed out or crashed. Outputs are compared without line
    ends at either side; the first failing test of a side gives its message.
    """
    tests = skew.skew_join(
        rollouts.select("ID", "data_id"), expected_outputs(problems), ["data_id"], ["ID"],
        "inner", limit,
    )
    runs = tests.join(outputs, ["ID", "visibility", "test_id"], "left")
    expected, actual = F.btrim("expected", F.lit("\n")), F.btrim("actual", F.lit("\n"))
    mismatch = F.concat(
        F.lit("Expected output="), expected, F.lit(" for input="), F.col("input"),
        F.lit(", but got actual_output="), actual,
    )
    error = F.when(
        F.col("actual").isNull(),
        error_feedback(F.lit("TimeoutError"), F.lit("Code execution timed out")),
    ).when(expected != actual, error_feedback(F.lit("AssertionError"), mismatch))
    graded = runs.withColumn("_error", error)
    first = F.when(F.col("_error").isNotNull(), F.col("test_id"))

    def verdict(name: str):
        mine = F.col("visibility") == name
        return F.coalesce(
            F.min_by("_error", F.when(mine, first)), F.lit(C.SUCCESS)
        ).alias(name)

    return graded.groupBy("ID", "data_id").agg(verdict("public"), verdict("private"))


def rollout_outcome(df: DataFrame) -> DataFrame:
    """Success and reward of each rollout: its last turn has no failing part."""
    success = all_passed(F.col("feedbacks"))
    return df.withColumn("success", success).withColumn("reward", success.cast("int"))


def outcome_from_parts(df: DataFrame) -> DataFrame:
    """The same from flat ``public`` and ``private`` texts."""
    success = passed(F.col("public")) & passed_private(F.col("private"))
    return df.withColumn("success", success).withColumn("reward", success.cast("int"))
