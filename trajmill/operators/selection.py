"""Selection of rollouts per prompt and relabelling.

Top-K windows carry a ``row_number() <= K`` filter, which Spark turns into a partial
group limit before the shuffle: a hot prompt sends at most K rows per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajmill.functions.draws import draw
from trajmill.functions.feedback import positive, public_passed
from trajmill.operators import skew

BONUS = 100

MODES = ("reward", "ground_truth", "public_truth", "public_and_reward_truth")


def selection_score(mode: str = "reward") -> Column:
    """The field rollouts are ranked by."""
    scores = {
        "reward": lambda: F.col("reward"),
        "reward_and_label": lambda: F.col("reward")
        + BONUS * positive(F.col("label")).cast("int"),
        "ground_truth": lambda: positive(F.col("label")).cast("double"),
        "public_truth": lambda: public_passed(F.col("feedbacks")).cast("double"),
        "public_and_reward_truth": lambda: F.col("reward")
        + BONUS * public_passed(F.col("feedbacks")).cast("int"),
    }
    if mode not in scores:
        raise ValueError(f"unknown selection mode {mode!r}")
    return scores[mode]().cast("double")


def score_bonus(df: DataFrame, mode: str, name: str = "score") -> DataFrame:
    return df.withColumn(name, selection_score(mode))


def take_first(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def select_topk(
    df: DataFrame, k: int = 1, mode: str = "reward", keys: tuple[str, ...] = ("data_id",)
) -> DataFrame:
    """Top ``k`` rows per group by the mode's score, ties by id."""
    return take_first(df, list(keys), [selection_score(mode).desc(), F.col("ID")], k)


def assign_searches(df: DataFrame, searches: int, limit: int = skew.HOT_ROWS) -> DataFrame:
    """Deal the rollouts of a prompt, in id order, round the searches."""
    numbered = skew.number_by_id(df, ["data_id"], "ID", "_no", limit)
    return numbered.withColumn("experiment_group", F.col("_no") % searches).drop("_no")


def select_topk_per_search(
    df: DataFrame, k: int, searches: int, mode: str = "reward", limit: int = skew.HOT_ROWS
) -> DataFrame:
    dealt = assign_searches(df, searches, limit)
    return select_topk(dealt, k, mode, ("data_id", "experiment_group"))


def select_all_ranked(
    df: DataFrame, searches: int, mode: str = "reward", limit: int = skew.HOT_ROWS
) -> DataFrame:
    """All rows of each search with their 1-based ``rank`` instead of a file order."""
    dealt = assign_searches(df, searches, limit).withColumn("_score", selection_score(mode))
    ranked = skew.number_by_score(
        dealt.withColumnRenamed("_score", "score"),
        ["data_id", "experiment_group"],
        "score",
        "ID",
        "_no",
        limit,
    )
    return ranked.withColumn("rank", F.col("_no") + 1).drop("_no")


def select_random_k(
    df: DataFrame, k: int, searches: int, seed: int = 0, limit: int = skew.HOT_ROWS
) -> DataFrame:
    """``k`` rows per search, chosen by a seeded draw."""
    dealt = assign_searches(df, searches, limit).withColumn("_draw", draw(seed, F.col("ID")))
    order = [F.col("_draw"), F.col("ID")]
    return take_first(dealt, ["data_id", "experiment_group"], order, k).drop("_draw")


def topk_completions(df: DataFrame, k: int = 1) -> DataFrame:
    """Best completions of each problem, right ones first."""
    return select_topk(df, k, "reward_and_label").select("data_id", "completion")


def relabel_candidates(df: DataFrame, count: int = 3) -> DataFrame:
    """Trajectories to relabel: failures first, then by reward, ties by id."""
    order = [
        positive(F.col("label")).cast("int").asc(),
        selection_score("reward_and_label").desc(),
        F.col("ID"),
    ]
    return take_first(df.drop("completion"), ["data_id"], order, count)


def relabel_join(
    candidates: DataFrame, completions: DataFrame, limit: int = skew.HOT_ROWS
) -> DataFrame:
    """Give each candidate the chosen completions of its problem, keeping its own label."""
    joined = skew.skew_join(candidates, completions, ["data_id"], ["ID"], "left", limit)
    return joined.withColumn("relabelled", F.lit(True))


def merge_positive_data(relabelled: DataFrame, rollouts: DataFrame) -> DataFrame:
    """Relabelled failures and all original positives."""
    negatives = relabelled.where(~positive(F.col("label")))
    positives = rollouts.where(positive(F.col("label"))).withColumn("relabelled", F.lit(False))
    return negatives.unionByName(positives.select(*negatives.columns))


def drop_rank_columns(df: DataFrame) -> DataFrame:
    """Final projection of a training set."""
    extra = ["relabelled"] if "relabelled" in df.columns else []
    label = positive(F.col("label")).alias("label")
    return df.select("data_id", "prompt", "completion", label, *extra)


def build_relabelled_set(
    df: DataFrame, k: int = 1, count: int = 3, merge_positives: bool = False
) -> DataFrame:
    """Relabel ``count`` trajectories per problem with its ``k`` best completions.

    Both sides hold a fixed number of rows per problem, so the join cannot be skewed.
    """
    chosen = relabel_candidates(df, count)
    best = topk_completions(df, k)
    rows = chosen.join(best, "data_id", "left").withColumn("relabelled", F.lit(True))
    if merge_positives:
        rows = merge_positive_data(rows, df)
    return drop_rank_columns(rows)


def order_rollouts(df: DataFrame, mode: str | None = None) -> DataFrame:
    """Global order by id, or by problem and score."""
    if mode is None:
        return df.orderBy("ID")
    return df.orderBy("data_id", selection_score(mode).desc(), "ID")
