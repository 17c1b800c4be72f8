"""Whole stages: each function is one lazy plan over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajmill.operators import conversations as V
from trajmill.operators import metrics as M
from trajmill.operators import sampling as P
from trajmill.operators import search as R
from trajmill.operators import selection as E
from trajmill.operators.merge import merge_datasets, union_runs
from trajmill.sources.sinks import write_once


def preference_pairs(rollouts: DataFrame, store: str, samples: int = 32) -> DataFrame:
    """Rollouts to preference pairs: every turn answers the first message, then draws.

    The flattened rows are written to ``store`` once: drawing reads only their ids, keys
    and labels, and the texts are looked up at the end. A row's id is its rollout's ID and
    its place in the conversation.
    """
    flat = M.with_prompt_key(V.flatten_to_first_prompt(rollouts, "_place"))
    rows = write_once(
        flat.select(
            F.struct("ID", F.col("_place").alias("place")).alias("ID"),
            "prompt_key",
            "prompt",
            "completion",
            "label",
        ),
        store,
    )
    return P.sample_pairs(rows, samples, "prompt_key")


def iteration_training_set(
    scored: DataFrame, base: DataFrame | None = None, k: int = 1, count: int = 3
) -> DataFrame:
    """One iteration's training rows: relabel failures, keep positives, expand every turn,
    add the rows of earlier iterations."""
    rows = E.build_relabelled_set(scored, k, count, merge_positives=True).drop("relabelled")
    rows = V.expand_relabeled(rows)
    return rows if base is None else merge_datasets(base, rows)


def rejection_training_set(rollouts: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """The variant without a verifier: positives only, expanded, merged."""
    rows = V.expand_positive(rollouts).select("data_id", "prompt", "completion", "label")
    return rows if base is None else merge_datasets(base, rows)


def search_winners(
    scored: DataFrame, mode: str = "public_and_reward_truth"
) -> DataFrame:
    """Best rollout of each search at each turn, ready for the search report."""
    return E.select_topk(scored, 1, mode, ("data_id", "search_id", "turn"))


def search_report(winners: DataFrame, turns: int) -> DataFrame:
    """``(metric, x, value)`` of a multi-turn search."""
    shares = ("success", "public_success", "any_success")
    return _long(R.turn_report(winners, turns), "turn", {f"turn_{c}": c for c in shares})


def rollout_report(scored: DataFrame, key: str = "data_id") -> DataFrame:
    """``(metric, x, value)`` of a table of scored rollouts."""
    top = {"best_k_accuracy": "accuracy", "best_k_precision": "precision"}
    return union_runs(
        _long(M.pass_at_k_curve(scored, key), "k", {"pass_at_k": "pass_at_k"}),
        _long(M.best_of_n_exact(scored, key=key), "n", {"best_of_n": "solve_rate"}),
        _long(M.best_of_n_oracle(scored, key=key), "n", {"best_of_n_oracle": "solve_rate"}),
        _long(M.best_k_of_n(scored, key=key), "k", top),
    )


def _long(df: DataFrame, x: str, metrics: dict[str, str]) -> DataFrame:
    """One row per metric and ``x`` from a column per metric."""
    cells = [
        F.struct(
            F.lit(metric).alias("metric"),
            F.col(x).cast("int").alias("x"),
            F.col(value).cast("double").alias("value"),
        )
        for metric, value in metrics.items()
    ]
    return df.select(F.inline(F.array(*cells)))
