"""Chat formatting in budgeted windows.

A conversation is laid out along the prefix sums of its turns' tokens, the system turn
apart. The sums are cut into a grid as wide as a window has room for; a turn that crosses
the end of its cell gets a window of its own, so a window never exceeds the room unless
one turn does alone. Every window starts with the system turn, repeats the turns just before
it within the history budget, and then has its new turns. Repeated turns are masked: the
loss covers each target turn once.

Template: ``### role: text </turn>`` and a line end. Backslashes and the control strings
inside texts and roles are escaped by a backslash, so a formatted text parses in one way.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, MID, TAIL = "### ", ": ", " </turn>\n"
#: Tokens that the template adds to a turn.
MARK_TOKENS = 4
#: Turns per block of the prefix sums.
BLOCK_BITS = 10

_STEP = re.compile(r"\\.|</turn>\n|: ", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: Column, *more: str) -> Column:
    out = text
    for control in ("\\", "###", "</turn>", *more):
        out = F.replace(out, F.lit(control), F.lit("\\" + control))
    return out


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text; raises ValueError if it isn't one."""
    turns, start, role = [], 0, None
    for step in _STEP.finditer(formatted):
        token = step.group()
        if token == MID and role is None:
            if not formatted.startswith(HEAD, start):
                raise ValueError(f"no turn starts at {start}")
            role, body = formatted[start + len(HEAD) : step.start()], step.end()
        elif token == "</turn>\n":
            if role is None:
                raise ValueError(f"a turn without a role at {start}")
            turns.append((unescape(role), unescape(formatted[body : step.start() - 1])))
            start, role = step.end(), None
    if start != len(formatted):
        raise ValueError("the last turn has no end")
    return turns


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def _prefix_sums(turns: DataFrame) -> DataFrame:
    """Add ``pos`` (from 0) and ``before``, the tokens of the turns before, without the
    system turn. Long conversations are summed block by block."""
    block = F.shiftright(F.coalesce(F.col("turn"), F.lit(-1)), BLOCK_BITS)
    cut = turns.withColumn("block", block)
    within = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    past = within.rowsBetween(Window.unboundedPreceding, -1)
    order = F.struct("turn", "role", "text")
    sizes = cut.groupBy("conv", "block").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("tokens").alias("t"),
        F.min(order).alias("first"),
        F.min_by("tokens", order).alias("first_tokens"),
    )
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv")
    shifts = sizes.select(
        F.col("conv").alias("conv2"),
        F.col("block").alias("block2"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_shift"),
        F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t_shift"),
        F.min(F.struct("block", F.col("first.role").alias("role"), "first_tokens")).over(whole).alias("lead"),
    )
    same = F.col("conv").eqNullSafe(F.col("conv2")) & (F.col("block") == F.col("block2"))
    return (
        cut.withColumn("n_in", F.row_number().over(within) - 1)
        .withColumn("t_in", F.coalesce(F.sum("tokens").over(past), F.lit(0)))
        .join(shifts, same)
        .select(
            "conv",
            "role",
            "text",
            "tokens",
            (F.col("n_in") + F.col("n_shift")).cast("bigint").alias("pos"),
            (F.col("t_in") + F.col("t_shift")).cast("bigint").alias("before"),
            F.when(F.col("lead.role") == "system", F.col("lead.first_tokens")).otherwise(0).alias("system"),
        )
    )


def format_windows(
    turns: DataFrame,
    budget: int = 1024,
    history: int = 128,
    target: str = "assistant",
    tokens: Callable[[Column], Column] = count_words,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """(conv id, window, n_turns, n_repeated, tokens, text, loss): the windows of every
    conversation, numbered in order but not without gaps.

    ``text`` is the formatted window of ``n_turns`` turns, of which the first ``n_repeated``
    are in an earlier window too; ``loss`` has (start, end) code points of the target
    texts, still escaped. A window has at most ``budget`` tokens, unless its one new turn, or
    the system turn, is longer than that leaves room for; turns are never cut. Rows are
    ordered by turn (null first), then role and text; null roles and texts are empty, a null conversation id is a
    conversation like any other, a leading turn with role ``system`` is the system turn.
    Repeated rows are turns of their own. Other columns are not read. No rows give no windows.
    """
    plain = turns.select(
        F.col(conv_id).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).withColumn("tokens", (tokens(F.col("text")) + MARK_TOKENS).cast("bigint"))
    laid = _prefix_sums(plain)
    leads = (F.col("pos") == 0) & (F.col("system") > 0)
    room = F.greatest(F.lit(budget - history) - F.col("system"), F.lit(max(budget // 4, 1)))
    spans = F.floor(F.col("before") / F.col("room"))
    cross = (F.col("before") + F.col("tokens") > (F.col("cell") + 1) * F.col("room")).cast("bigint")
    placed = (
        laid.withColumn("lead", leads)
        .withColumn("room", room)
        .withColumn("before", F.when(F.col("lead"), 0).otherwise(F.col("before") - F.col("system")))
        .withColumn("cell", F.when(F.col("lead"), 0).otherwise(spans))
        .withColumn("window", F.when(F.col("lead"), 0).otherwise(2 * F.col("cell") + cross))
    )
    body = placed.where(~F.col("lead"))
    starts = body.groupBy("conv", "window").agg(F.min("before").alias("start"))
    # The windows that may repeat a turn: those whose start is within its reach.
    end = F.col("before") + F.col("tokens")
    reach = F.sequence(
        2 * F.floor(end / F.col("room")), 2 * F.floor((end + history) / F.col("room")) + 1
    )
    later = body.where(F.col("tokens") <= history).withColumn("later", F.explode(reach))
    wins = starts.select(F.col("conv").alias("conv2"), F.col("window").alias("later2"), "start")
    repeated = (
        later.join(wins, F.col("conv").eqNullSafe(F.col("conv2")) & (F.col("later") == F.col("later2")))
        .where((F.col("start") >= end) & (F.col("start") - F.col("before") <= history))
        .select("conv", F.col("later").alias("window"), "pos", "role", "text", "tokens", F.lit(False).alias("new"))
    )
    first = Window.partitionBy("conv")
    heads = placed.where("lead").select(
        F.col("conv").alias("conv2"), "role", "text", "tokens", F.lit(0).cast("bigint").alias("pos")
    )
    with_first = starts.withColumn("first", F.min("window").over(first))
    systems = heads.join(
        with_first.select("conv", "window", "first"), F.col("conv").eqNullSafe(F.col("conv2")), "left"
    ).select(
        F.col("conv2").alias("conv"),
        F.coalesce("window", F.lit(0).cast("bigint")).alias("window"),
        "pos",
        "role",
        "text",
        "tokens",
        F.coalesce(F.col("window") == F.col("first"), F.lit(True)).alias("new"),
    )
    fresh = body.select("conv", "window", "pos", "role", "text", "tokens", F.lit(True).alias("new"))
    rows = fresh.unionByName(repeated).unionByName(systems)
    head = F.concat(F.lit(HEAD), escape(F.col("role"), MID), F.lit(MID))
    inner = escape(F.col("text"))
    pieces = rows.select(
        "conv",
        "window",
        "tokens",
        "new",
        F.struct(
            "pos",
            F.length(head).alias("head"),
            F.length(inner).alias("body"),
            (F.col("new") & (F.col("role") == target)).alias("target"),
            F.concat(head, inner, F.lit(TAIL)).alias("piece"),
        ).alias("turn"),
    )
    windows = pieces.groupBy("conv", "window").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.sum((~F.col("new")).cast("bigint")).alias("n_repeated"),
        F.sum("tokens").alias("tokens"),
        F.array_sort(F.collect_list("turn")).alias("turns"),
    )
    lengths = F.transform("turns", lambda t: t["head"] + t["body"] + len(TAIL))
    ends = F.aggregate(
        lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
    )
    loss = F.transform(
        F.filter(
            F.arrays_zip(F.col("turns").alias("t"), F.slice("ends", 1, F.size("turns")).alias("at")),
            lambda z: z["t"]["target"],
        ),
        lambda z: F.struct(
            (z["at"] + z["t"]["head"]).alias("start"),
            (z["at"] + z["t"]["head"] + z["t"]["body"]).alias("end"),
        ),
    )
    return windows.withColumn("ends", ends).select(
        F.col("conv").alias(conv_id),
        "window",
        "n_turns",
        "n_repeated",
        "tokens",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("text"),
        loss.alias("loss"),
    )


def read_windows(windows: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv id, window, turns, loss, chars) parsed from the formatted windows: the turns that are
    new in each, as ``role, line end, text, line end``, and the unescaped text under the loss mask."""
    kind = windows.schema[conv_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                turns = parse(row.text)
                if len(turns) != row.n_turns:
                    raise ValueError(f"{len(turns)} turns where {row.n_turns} were written")
                new = turns[row.n_repeated :] if row.n_repeated < len(turns) else []
                masked = [unescape(row.text[span["start"] : span["end"]]) for span in row.loss]
                said = "".join(f"{role}\n{text}\n" for role, text in new)
                out.append((row.conv, row.window, len(new), said, "".join(masked), len(row.text)))
            yield pd.DataFrame(out, columns=["conv", "window", "n_new", "turns", "loss", "chars"])

    parsed = windows.withColumnRenamed(conv_id, "conv").mapInPandas(
        run, f"conv {kind}, window long, n_new long, turns string, loss string, chars long"
    )
    return parsed.withColumnRenamed("conv", conv_id)
