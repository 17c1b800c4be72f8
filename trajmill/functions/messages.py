"""Expressions over arrays of ``{role, content}`` messages and over plain texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajmill import constants as C


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def strip(text: Column) -> Column:
    """Remove whitespace, Unicode blanks included, from both ends."""
    return F.btrim(text, F.lit(C.WHITESPACE))


def joined(messages: Column) -> Column:
    """All messages as one text, ``role:content`` per message; a null part counts as empty."""

    def part(m: Column) -> Column:
        return F.concat_ws(":", *[F.coalesce(m[c], F.lit("")) for c in ("role", "content")])

    return F.array_join(F.transform(messages, part), "\n")


def prompt_key(prompt: Column) -> Column:
    """Grouping key of a prompt: digest of its first message, role and content."""
    first = F.get(prompt, F.lit(0))
    return F.md5(F.concat(first["role"], F.lit("\n"), first["content"]))


def assistant_turns(messages: Column) -> Column:
    """0-based positions of the assistant's messages."""
    return F.filter(
        F.sequence(F.lit(0), F.size(messages) - 1),
        lambda i: F.get(messages, i)["role"] == C.ASSISTANT,
    )


def combine_roles(messages: Column, keep_first: bool = False) -> Column:
    """Join neighbouring messages of the same role with a line end.

    ``keep_first`` never joins the second message to the first one.
    """
    positions = F.sequence(F.lit(1), F.size(messages))

    def starts_run(i: Column) -> Column:
        changed = F.element_at(messages, i)["role"] != F.get(messages, i - 2)["role"]
        fresh = (i == 1) | changed
        return fresh | (i == 2) if keep_first else fresh

    starts = F.filter(positions, starts_run)

    def run(start: Column, n: Column) -> Column:
        end = F.coalesce(F.get(starts, n + 1), F.size(messages) + 1)
        texts = F.transform(F.slice(messages, start, end - start), lambda m: m["content"])
        return F.struct(
            F.element_at(messages, start)["role"].alias("role"),
            F.array_join(texts, "\n").alias("content"),
        )

    return F.when(F.size(messages) == 0, messages).otherwise(F.transform(starts, run))


def shared_prefix_length(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two whole texts.

    Doubling steps find the power of two that brackets the answer, halving steps the
    rest, so the work follows the length of the prefix and not that of the texts.
    """

    def same(p: Column, length: Column) -> Column:
        return (length <= p["n"]) & (F.left(p["a"], length) == F.left(p["b"], length))

    def search(p: Column) -> Column:
        powers = F.array(*[F.lit(1 << bit) for bit in range(31)])
        start = F.struct(F.lit(0).alias("done"), F.lit(True).alias("more"))
        reached = F.aggregate(
            powers,
            start,
            lambda s, step: F.when(
                s["more"] & same(p, step), F.struct(step.alias("done"), F.lit(True).alias("more"))
            ).otherwise(F.struct(s["done"].alias("done"), F.lit(False).alias("more"))),
            lambda s: s["done"],
        )
        return F.aggregate(
            F.reverse(powers),
            F.struct(reached.alias("first"), reached.alias("done")),
            lambda s, step: F.struct(
                s["first"].alias("first"),
                F.when((step < s["first"]) & same(p, s["done"] + step), s["done"] + step)
                .otherwise(s["done"])
                .alias("done"),
            ),
            lambda s: s["done"],
        )

    shorter = F.least(F.length(a), F.length(b))
    pair = F.struct(a.alias("a"), b.alias("b"), shorter.alias("n"))
    return F.get(F.transform(F.array(pair), search), F.lit(0))


def shared_prefix(a: Column, b: Column) -> Column:
    return F.left(a, shared_prefix_length(a, b))


def response_suffix(text: Column, prefix_length: Column, pad: str = "") -> Column:
    """Text after the shared prefix; a pad token is removed first when given."""
    clean = F.replace(text, F.lit(pad), F.lit("")) if pad else text
    return F.substr(clean, prefix_length + 1)
