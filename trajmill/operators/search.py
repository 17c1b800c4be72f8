"""Multi-turn best-of-N search, followed turn by turn.

Input: one row per ``(data_id, search_id, turn)`` with the feedbacks of the rollout that
won that turn; ``turn`` counts from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajmill.functions.feedback import passed, passed_private

SEARCH = ["data_id", "search_id"]


def _verdicts(df: DataFrame) -> DataFrame:
    step = F.get("feedbacks", F.lit(0))
    return df.select(
        *SEARCH,
        "turn",
        passed(step["public"]).alias("public_ok"),
        passed_private(step["private"]).alias("private_ok"),
    )


def align_turns(df: DataFrame, turns: int) -> DataFrame:
    """One row per search with the verdicts of all its turns side by side."""
    wide = [
        F.max(F.when(F.col("turn") == t, F.col(c))).alias(f"{c}_{t}")
        for t in range(1, turns + 1)
        for c in ("public_ok", "private_ok")
    ]
    return _verdicts(df).groupBy(*SEARCH).agg(*wide)


def check_turn_chain(df: DataFrame) -> DataFrame:
    """One row with the number of violations of each rule of a turn table.

    A search has one row per turn, so the window sorts a handful of rows per search.
    """
    turns = Window.partitionBy(*SEARCH).orderBy("turn")
    before = F.struct("turn", "prompt")
    linked = df.withColumn("_before", F.lag(before).over(turns))
    earlier = F.when(F.col("_before.turn") == F.col("turn") - 1, F.col("_before.prompt"))
    linked = linked.withColumn("_earlier", earlier)
    prefix = F.slice("prompt", F.lit(1), F.size("_earlier"))

    def count_bad(ok: Column) -> Column:
        return F.count_if(~F.coalesce(ok, F.lit(False)))

    first = F.col("turn") == 1
    found = F.col("_earlier").isNotNull()
    return linked.agg(
        F.count(F.lit(1)).alias("rows"),
        count_bad(F.size("prompt") == 2 * F.col("turn") - 1).alias("bad_prompt_length"),
        count_bad(F.size("completion") == 1).alias("bad_completion"),
        count_bad(F.size("feedbacks") == 1).alias("bad_feedback"),
        count_bad(first | found).alias("missing_earlier_turn"),
        F.count_if(F.when(found, prefix != F.col("_earlier"))).alias("broken_prefix"),
    )


def search_outcomes(df: DataFrame) -> DataFrame:
    """Per search: the first turn whose public tests passed and whether it is right."""
    decided = F.when(F.col("public_ok"), F.col("turn"))
    return (
        _verdicts(df)
        .groupBy(*SEARCH)
        .agg(
            F.min(decided).alias("decided_turn"),
            F.min_by("private_ok", decided).alias("private_ok"),
        )
    )


def _turns(df: DataFrame, turns: int) -> DataFrame:
    numbers = F.sequence(F.lit(1), F.lit(turns))
    return df.withColumn("turn", F.explode(numbers))


def turn_report(df: DataFrame, turns: int) -> DataFrame:
    """Per turn: searches solved by then, searches that passed the public tests by then,
    and problems that any search has solved by then, as shares, from one aggregate."""
    by_turn = F.coalesce(F.col("decided_turn") <= F.col("turn"), F.lit(False))
    solved = (by_turn & F.coalesce("private_ok", F.lit(False))).cast("int")
    problems = (
        _turns(search_outcomes(df), turns)
        .groupBy("data_id", "turn")
        .agg(
            F.count(F.lit(1)).alias("searches"),
            F.sum(solved).alias("solved"),
            F.sum(by_turn.cast("int")).alias("passed"),
            F.max(solved).alias("any"),
        )
    )
    searches = F.sum("searches")
    return problems.groupBy("turn").agg(
        (F.sum("solved") / searches).alias("success"),
        (F.sum("passed") / searches).alias("public_success"),
        F.avg("any").alias("any_success"),
    )


def turn_success(df: DataFrame, turns: int) -> DataFrame:
    """Share of searches solved by each turn: the first turn that passes the public tests
    decides, and it counts if it passes the private ones too."""
    return turn_report(df, turns).select("turn", "success")


def turn_public_success(df: DataFrame, turns: int) -> DataFrame:
    return turn_report(df, turns).select("turn", "public_success")


def turn_any_success(df: DataFrame, turns: int) -> DataFrame:
    """Share of problems that at least one search has solved by each turn."""
    return turn_report(df, turns).select("turn", "any_success")
