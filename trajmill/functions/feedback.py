"""Feedback texts and verdicts from recorded runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajmill import constants as C


def positive(label: Column, of: DataFrame | None = None) -> Column:
    """Whether a label is over one half; labels may be booleans, 0/1 or shares.

    Given the table, a boolean column ``label`` is used as it is, so that it pushes down.
    """
    if of is not None and of.schema["label"].dataType.simpleString() == "boolean":
        return label
    return label.cast("double") > 0.5


def passed(feedback: Column) -> Column:
    return feedback == C.SUCCESS


def passed_private(feedback: Column) -> Column:
    """An empty text means there was no private test, which counts as passed."""
    return feedback.isin(C.SUCCESS, "")


def public_passed(feedbacks: Column) -> Column:
    """Whether the first turn's public feedback is the success text."""
    return F.coalesce(passed(F.get(feedbacks, F.lit(0))["public"]), F.lit(False))


def feedback_from_run(tests: Column, stdout: Column, stderr: Column, sentinel: Column) -> Column:
    """Success text if the run printed its sentinel, else what it wrote to stderr."""
    none = tests.isNull() | (tests == "")
    done = F.coalesce(F.contains(stdout, sentinel), F.lit(False))
    return (
        F.when(none, "").when(done, C.SUCCESS).otherwise(F.coalesce(stderr, F.lit("")))
    )


def error_feedback(kind: Column, text: Column) -> Column:
    detail = F.when(F.length(text) > 0, F.concat(F.lit(": "), text)).otherwise("")
    return F.concat(F.lit("[Error] "), kind, detail)


def time_limit_seconds(limit: Column) -> Column:
    """Seconds of a ``{seconds, nanos}`` limit; one second without a limit."""
    return F.coalesce(limit["seconds"] + F.lit(1e-9) * limit["nanos"], F.lit(1.0))


def time_budget(limit: Column, tests: Column) -> Column:
    return time_limit_seconds(limit) * (F.size(tests["input"]) + 1)


def all_passed(feedbacks: Column) -> Column:
    """No part of the last turn's feedback failed."""
    last = F.try_element_at(feedbacks, F.lit(-1))
    return F.coalesce(passed(last["public"]) & passed_private(last["private"]), F.lit(False))
