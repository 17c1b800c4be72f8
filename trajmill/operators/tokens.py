"""Token features, length limits and length statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajmill import constants as C
from trajmill.functions.draws import draw
from trajmill.functions.messages import joined
from trajmill.functions.stats import histogram_bin


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "\\s+"), lambda w: w != "")


def word_tokens(text: Column, vocabulary: int = 32000) -> Column:
    """Stand-in tokens: one hashed id per word. Callers may bring real token columns."""
    return F.transform(_words(text), lambda w: (draw("tok", w) % vocabulary).cast("int"))


def token_lengths(df: DataFrame) -> DataFrame:
    """The lengths of the columns ``prompt_code`` and ``input_ids`` of build_token_features, under
    the same names: words are counted, not hashed."""
    prompt = F.size(_words(joined(F.col("prompt"))))
    answer = F.size(_words(joined(F.col("completion"))))
    return df.withColumns({"prompt_code": prompt, "input_ids": prompt + answer})


def mask_labels(ids: Column, prompt_length: Column, mask: str = "prompt") -> Column:
    """Labels with the prompt's tokens (or all of them) replaced by the ignore value."""
    if mask == "all":
        return F.transform(ids, lambda _: F.lit(C.IGNORE_LABEL))
    return F.transform(
        ids, lambda t, i: F.when(i < prompt_length, C.IGNORE_LABEL).otherwise(t)
    )


def build_token_features(
    df: DataFrame,
    train_only_on_prompt: bool = False,
    mask: str = "prompt",
    source: str = "HumanEval",
) -> DataFrame:
    """Training columns for the messages of ``prompt`` and ``completion``."""
    # Messages are joined by line ends, so tokens never reach across them.
    ids = df.withColumn("prompt_code", word_tokens(joined(F.col("prompt")))).withColumn(
        "input_ids", F.concat("prompt_code", word_tokens(joined(F.col("completion"))))
    )
    labels = (
        mask_labels(F.col("input_ids"), F.size("prompt_code"), mask)
        if train_only_on_prompt
        else F.col("input_ids")
    )
    return ids.withColumns(
        {
            "attention_mask": F.transform("input_ids", lambda _: F.lit(1)),
            "labels": labels,
            "dataset": F.lit(source),
        }
    )


def binary_token_features(df: DataFrame) -> DataFrame:
    """Verifier input: the first message and the completion."""
    text = joined(F.concat(F.slice("prompt", 1, 1), F.col("completion")))
    return df.withColumn("prompt_code", word_tokens(text))


def pair_token_features(df: DataFrame) -> DataFrame:
    """Token columns of ``prompt + chosen``, ``prompt + rejected`` and the prompt."""
    prompted = df.withColumn("input_ids_prompt", word_tokens(joined(F.col("prompt"))))
    return prompted.withColumns(
        {
            f"input_ids_{side}": F.concat("input_ids_prompt", word_tokens(joined(F.col(side))))
            for side in ("chosen", "rejected")
        }
    )


def has_labels(labels: Column) -> Column:
    return F.exists(labels, lambda t: t != C.IGNORE_LABEL)


def _length(df: DataFrame, column: str) -> Column:
    """The length of a token column; a column of numbers holds lengths already."""
    counted = not df.schema[column].dataType.simpleString().startswith("array")
    return F.col(column) if counted else F.size(column)


def within_limits(
    df: DataFrame,
    limits: list[tuple[str, int | None]],
    mode: str = "all",
    labels: str | None = None,
) -> Column:
    """Whether a row keeps to its token limits.

    ``limits`` pairs a column of tokens, or of their number, with its limit or None.
    ``mode="all"`` needs all set limits; ``mode="chained"`` looks at the first set one only.
    """
    checks = [_length(df, c) <= n for c, n in limits if n is not None]
    if mode == "chained":
        checks = checks[:1]
    if labels is not None:
        checks.append(has_labels(F.col(labels)))
    return reduce(Column.__and__, checks, F.lit(True))


def filter_by_length(df: DataFrame, limits, mode: str = "all", labels: str | None = None) -> DataFrame:
    return df.where(within_limits(df, limits, mode, labels))


def filter_report(df: DataFrame, keep: Column, split: str = "split") -> DataFrame:
    """Per split: rows dropped by a filter, all rows, and the percentage."""
    return (
        df.groupBy(split)
        .agg(F.count_if(~keep).alias("dropped"), F.count(F.lit(1)).alias("total"))
        .withColumn(
            "percentage",
            F.when(F.col("total") > 0, 100.0 * F.col("dropped") / F.col("total")).otherwise(0.0),
        )
    )


def _lengths(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("feature"), _length(df, c).alias("length")) for c in columns]
    return df.select(F.inline(F.array(*cells)))


def token_length_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Length statistics of each token column. Lengths are first counted per value, so
    the exact percentiles work on that small table."""
    counts = _lengths(df, columns).groupBy("feature", "length").agg(
        F.count(F.lit(1)).alias("rows")
    )
    return counts.groupBy("feature").agg(
        F.min("length").alias("min"),
        F.max("length").alias("max"),
        (F.sum(F.col("length") * F.col("rows")) / F.sum("rows")).alias("mean"),
        F.percentile("length", 0.5, F.col("rows")).alias("p50"),
        F.percentile("length", 0.95, F.col("rows")).alias("p95"),
    )


def token_length_histogram(df: DataFrame, columns: list[str], bins: int = 30) -> DataFrame:
    """Histogram of the lengths of each token column, empty bins left out."""
    counts = _lengths(df, columns).groupBy("feature", "length").agg(
        F.count(F.lit(1)).alias("rows")
    )
    ranges = counts.groupBy("feature").agg(
        F.min("length").alias("low"), F.max("length").alias("high")
    )
    # One row per token column.
    placed = counts.join(F.broadcast(ranges), "feature").withColumn(
        "bin", histogram_bin(F.col("length"), F.col("low"), F.col("high"), bins)
    )
    return placed.groupBy("feature", "bin").agg(F.sum("rows").alias("rows"))
