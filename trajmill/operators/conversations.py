"""Conversations and rollouts: building, continuing, expanding into training rows.

A conversation is one row with an array of messages. Its length is bounded by the turn
limit of the search that produced it, so array expressions are the natural form and no
expansion needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajmill import constants as C
from trajmill.functions.code import first_code_or_empty
from trajmill.functions.feedback import positive
from trajmill.functions.messages import assistant_turns, message


def build_rollout_rows(df: DataFrame, conversation: str = "conversation") -> tuple[DataFrame, DataFrame]:
    """Split conversations that end ``..., assistant, user`` into prompt and completion.

    Returns the rows and the rejects: conversations whose last but one message is not
    the assistant's.
    """
    conv = F.col(conversation)
    answer = F.get(conv, F.size(conv) - 2)
    good = (F.size(conv) >= 2) & F.coalesce(answer["role"] == C.ASSISTANT, F.lit(False))
    rows = (
        df.where(good)
        .withColumn("prompt", F.slice(conv, F.lit(1), F.greatest(F.size(conv) - 2, F.lit(0))))
        .withColumn("completion", F.array(answer))
        .drop(conversation)
    )
    return rows, df.where(~good)


def continue_conversations(df: DataFrame) -> DataFrame:
    """Next-turn input: prompt, completion and the last public feedback as a user message."""
    last = F.try_element_at("feedbacks", F.lit(-1))["public"]
    reply = message(C.USER, F.concat(F.lit(C.FEEDBACK_PREFIX), F.coalesce(last, F.lit(""))))
    return df.withColumn("messages", F.concat("prompt", "completion", F.array(reply)))


def assemble_conversations(
    turns: DataFrame, first: DataFrame, key: str = "rollout_id", max_steps: int = 3
) -> DataFrame:
    """Turn log to one conversation per rollout, ended by the first success or ``max_steps``.

    ``turns``: key, ``step`` (0-based), ``action``, ``public``, ``private``, ``success``;
    ``first``: key, ``prompt`` (opening text) and whatever else to keep. Steps past the
    limit never happened, so each group holds at most ``max_steps`` rows.
    """
    step = F.struct("step", "action", "public", "private", "success")
    log = (
        turns.where(F.col("step") < max_steps)
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(step)).alias("_log"))
    )
    solved = F.transform(F.filter("_log", lambda t: t["success"]), lambda t: t["step"])
    upto = F.coalesce(F.array_min(solved), F.lit(max_steps))
    log = log.withColumn("_log", F.filter("_log", lambda t: t["step"] <= upto))

    def exchange(t: Column) -> Column:
        reply = F.concat(F.lit(C.FEEDBACK_PREFIX), t["public"])
        return F.array(message(C.ASSISTANT, t["action"]), message(C.USER, reply))

    return (
        first.join(log, key)
        .withColumn(
            "conversation",
            F.concat(
                F.array(message(C.USER, F.col("prompt"))),
                F.flatten(F.transform("_log", exchange)),
            ),
        )
        .withColumn(
            "feedbacks",
            F.transform(
                "_log",
                lambda t: F.struct(t["public"].alias("public"), t["private"].alias("private")),
            ),
        )
        .withColumn("label", F.try_element_at("_log", F.lit(-1))["success"])
        .drop("_log", "prompt")
    )


def filter_positive(df: DataFrame) -> DataFrame:
    return df.where(positive(F.col("label"), df))


def parse_completions(df: DataFrame, columns: tuple[str, ...] = ("completion",)) -> DataFrame:
    """Replace each completion's text by its first code block, empty if there is none."""

    def parse(m: Column) -> Column:
        return F.struct(
            m["role"].alias("role"), first_code_or_empty(m["content"]).alias("content")
        )

    return df.withColumns({c: F.transform(c, parse) for c in columns})


def chat_template(m: Column) -> Column:
    """Default rendering of one message."""
    return F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("\n"))


def render_sft_text(
    df: DataFrame, template: Callable[[Column], Column] = chat_template
) -> DataFrame:
    """Mark the completion and render all messages to one ``text``."""

    def mark(m: Column) -> Column:
        return F.struct(
            m["role"].alias("role"),
            F.concat(F.lit(C.RESPONSE_MARKER + " "), m["content"]).alias("content"),
        )

    marked = F.transform("completion", mark)
    return df.withColumn("completion", marked).withColumn(
        "text", F.array_join(F.transform(F.concat("prompt", "completion"), template), "")
    )


def _at_assistant_turns(df: DataFrame) -> DataFrame:
    """One row per assistant message of the prompt, at position ``_i``."""
    return df.withColumn("_i", F.explode(assistant_turns(F.col("prompt"))))


def expand_intermediate(df: DataFrame, position: str | None = None) -> DataFrame:
    """Each earlier assistant turn as a negative completion, plus the rollout itself.

    ``position`` names an extra column for the completion's place in its conversation.
    """
    place = [] if position is None else [position]
    turns = (
        _at_assistant_turns(df)
        .withColumn("completion", F.array(F.get("prompt", F.col("_i"))))
        .withColumn("prompt", F.slice("prompt", F.lit(1), F.col("_i")))
        .withColumn("label", F.lit(False))
        .select(*df.columns, *[F.col("_i").cast("bigint").alias(c) for c in place])
    )
    whole = df.withColumn("label", positive(F.col("label"))).select(
        *df.columns, *[F.size("prompt").cast("bigint").alias(c) for c in place]
    )
    return turns.unionByName(whole)


def expand_relabeled(df: DataFrame) -> DataFrame:
    """Each earlier prompt with the final completion and label, plus the rollout itself."""
    turns = (
        _at_assistant_turns(df)
        .withColumn("prompt", F.slice("prompt", F.lit(1), F.col("_i")))
        .select(*df.columns)
    )
    return turns.unionByName(df)


def expand_positive(df: DataFrame) -> DataFrame:
    """``expand_relabeled`` over positive rollouts only."""
    return expand_relabeled(filter_positive(df))


def flatten_to_first_prompt(df: DataFrame, position: str | None = None) -> DataFrame:
    """Every assistant turn as a negative answer to the first message, and the final
    completion with its own label."""
    return expand_intermediate(df, position).withColumn("prompt", F.slice("prompt", 1, 1))


def turn_rows(df: DataFrame, conversation: str = "conversation") -> DataFrame:
    """Every assistant turn of a conversation as a ``(prompt, completion)`` row."""
    conv = F.col(conversation)
    return (
        df.withColumn("_i", F.explode(assistant_turns(conv)))
        .withColumn("prompt", F.slice(conv, F.lit(1), F.col("_i")))
        .withColumn("completion", F.array(F.get(conv, F.col("_i"))))
        .drop(conversation, "_i")
    )
