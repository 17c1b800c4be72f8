"""Evaluation metrics over rollouts: pass@k, best-of-N, best-K-of-N, distributions.

All of them start from a per-prompt aggregate or a top-K window, so only counts or K
rows per prompt and map task are shuffled. ``key`` is the prompt's id or digest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajmill.functions.draws import RANGE_BITS, draw
from trajmill.functions.feedback import positive
from trajmill.functions.messages import prompt_key, response_suffix, shared_prefix_length
from trajmill.functions.stats import histogram_bin, none_better, pass_at, softplus
from trajmill.operators import skew

#: Points of a curve that one task sums up.
CURVE_BLOCK = 65_536
#: Buckets of the draws of one prompt and trial, as a power of two.
DRAW_BITS = 12
#: Draws that one task of best_of_n_sampled makes, sorts or adds up.
DRAWS_A_TASK = 1 << 20


def with_prompt_key(df: DataFrame, name: str = "prompt_key") -> DataFrame:
    return df.withColumn(name, prompt_key(F.col("prompt")))


def prompt_counts(df: DataFrame, key: str = "data_id") -> DataFrame:
    """Rollouts ``n`` and right ones ``c`` of each prompt."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(positive(F.col("label"))).alias("c")
    )


def _same_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many prompts share each ``(n, c)``: the curves depend on nothing else."""
    return df.groupBy(*keys, "n", "c").agg(F.count(F.lit(1)).alias("prompts"))


def pass_at_k(
    df: DataFrame, k: int, key: str = "data_id", n_override: int | None = None
) -> DataFrame:
    """Mean chance that one of ``k`` drawn rollouts is right, over prompts with n >= k.

    ``n_override`` uses one n for all prompts. ``skipped`` counts prompts left out.
    """
    counts = prompt_counts(df, key)
    if n_override is not None:
        counts = counts.withColumn("n", F.lit(n_override).cast("bigint"))
    fits = F.col("n") >= k
    value = F.when(fits, pass_at(F.col("n"), F.col("c"), F.lit(k)))
    return counts.agg(
        F.lit(k).alias("k"),
        F.avg(value).alias("pass_at_k"),
        F.count_if(fits).alias("prompts"),
        F.count_if(~fits).alias("skipped"),
    )


def _curve(same: DataFrame, keys: list[str], max_k: int | None) -> DataFrame:
    """Mean of 1 - C(n-c, k) / C(n, k) per k. The ratio gains one factor with each k, so
    a running sum of logarithms replaces a product per point. A long curve is summed in
    blocks of k, each on its own, and shifted by the sums of the blocks before."""
    last = F.col("n") if max_k is None else F.least(F.col("n"), F.lit(max_k))
    first_k = F.col("_block") * CURVE_BLOCK + 1
    points = same.withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.floor((last - 1) / CURVE_BLOCK)))
    ).withColumn("k", F.explode(F.sequence(first_k, F.least(first_k + CURVE_BLOCK - 1, last))))
    left = F.col("n") - F.col("k") + 1
    factor = F.when(left > F.col("c"), F.log1p(-F.col("c") / left))
    curve = [*keys, "n", "c"]
    within = (
        Window.partitionBy(*curve, "_block")
        .orderBy("k")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = (
        Window.partitionBy(*curve).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = points.groupBy(*curve, "_block").agg(F.sum(factor).alias("_sum"))
    # Curves of one block need no shift.
    shifts = sums.withColumn("_shift", F.sum("_sum").over(earlier)).where("_block > 0").drop("_sum")
    log_fail = F.sum(factor).over(within)
    placed = points.withColumn("_log", log_fail).join(shifts, [*curve, "_block"], "left")
    fail = F.when(left > F.col("c"), F.exp(F.col("_log") + F.coalesce("_shift", F.lit(0.0))))
    value = (1 - F.col("_fail")) * F.col("prompts")
    return (
        placed.withColumn("_fail", F.coalesce(fail, F.lit(0.0)))
        .withColumn("k", F.col("k").cast("int"))
        .groupBy(*keys, "k")
        .agg((F.sum(value) / F.sum("prompts")).alias("pass_at_k"), F.sum("prompts").alias("prompts"))
    )


def pass_at_k_curve(df: DataFrame, key: str = "data_id", max_k: int | None = None) -> DataFrame:
    """pass@k for k = 1..n, or up to ``max_k`` on request; prompts with n < k are left out.

    Every prompt counts whatever its n.
    """
    return _curve(_same_counts(prompt_counts(df, key), []), [], max_k)


def pass_at_k_overlay(
    runs: dict[str, DataFrame], key: str = "data_id", max_k: int | None = None
) -> DataFrame:
    """The curves of several tables in one result, tagged ``dataset_label``."""
    tagged = [
        prompt_counts(df, key).select(F.lit(label).alias("dataset_label"), "n", "c")
        for label, df in runs.items()
    ]
    counts = reduce(DataFrame.unionByName, tagged)
    return _curve(_same_counts(counts, ["dataset_label"]), ["dataset_label"], max_k)


def _ranked(df: DataFrame, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col("reward").desc(), F.col("ID"))
    narrow = df.select(key, "ID", "reward", positive(F.col("label")).alias("label"))
    return narrow.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_k_of_n(df: DataFrame, ks: tuple[int, ...] = (1, 2, 3, 4), key: str = "data_id") -> DataFrame:
    """Accuracy and precision of the top K by reward, for every K in one ranked pass.

    Accuracy divides by K even when a prompt has fewer rows; precision is the share of
    rows where ``reward > 0`` agrees with the label.
    """
    top = _ranked(df, key, max(ks)).withColumn(
        "k", F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: k >= F.col("rank")))
    )
    agrees = ((F.col("reward") > 0) == F.col("label")).cast("int")
    per_prompt = top.groupBy(key, "k").agg(
        (F.sum(F.col("label").cast("int")) / F.col("k")).alias("accuracy"),
        F.avg(agrees).alias("precision"),
    )
    return per_prompt.groupBy("k").agg(
        F.avg("accuracy").alias("accuracy"), F.avg("precision").alias("precision")
    )


def doubling(most: int | None) -> tuple[int, ...]:
    """1, 2, 4, ... below ``most``, and ``most``."""
    powers = []
    while most and 2 ** len(powers) < most:
        powers.append(2 ** len(powers))
    return (*powers, most) if most else (1,)


def _sizes(counts: DataFrame, sizes: tuple[int, ...] | None) -> tuple[int, ...]:
    """The sizes asked for, or doubling up to the rollouts of the largest prompt: one number
    comes to the driver."""
    return sizes or doubling(counts.agg(F.max("n")).first()[0])


def best_of_n_sampled(
    df: DataFrame,
    sizes: tuple[int, ...] | None = None,
    trials: int = 25,
    seed: int = 42,
    order_by: str = "reward",
    key: str = "data_id",
) -> DataFrame:
    """Repeated experiment: draw min(N, n) rollouts per prompt, keep the best, is it right.

    The N rows of the least draws are the sample. Draws are counted in buckets of their range, each with
    its best row, so a sample is some whole buckets and a part of one more; only the rows of that
    one are put in order, a few thousandths of a prompt. For N > n the sample is the whole prompt. ``sizes``
    double up to n if not given. Each trial repeats the table: prefer best_of_n_exact on large data.
    """
    counts = prompt_counts(df, key).agg(F.max("n").alias("most"), F.sum("n").alias("rows")).first()
    sizes = sizes or doubling(counts["most"])
    # The draws are many times the rows: tasks are as many as they need, so that none grows with the table.
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-(counts["rows"] or 0) * trials // DRAWS_A_TASK))
    good = positive(F.col("label"))
    score = F.col("reward") if order_by == "reward" else good.cast("double")
    row = F.struct(score.alias("score"), (-F.col("ID")).alias("tie"), good.alias("label"))
    rows = df.where(F.col(key).isNotNull()).select(key, row.alias("_row")).repartition(tasks, "_row.tie")
    # A draw is never null; as Spark knows it, no filter keeps its two readers from sharing one shuffle.
    taken = F.coalesce(draw(seed, F.col("trial"), -F.col("_row.tie")), F.lit(0))
    drawn = rows.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("_draw", taken)
    bucket = F.shiftright("_draw", RANGE_BITS - DRAW_BITS)
    # Both readers below find the rows of a bucket in one task, so this is shuffled once.
    drawn = drawn.repartition(tasks, key, "trial", bucket).withColumn("_bucket", bucket)
    cells = drawn.groupBy(key, "trial", "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.max("_row").alias("_best"))
    cells = cells.repartition(tasks, key, "trial")
    along = Window.partitionBy(key, "trial").orderBy("_bucket")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    summed = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn(
        "_best_before", F.max("_best").over(before)
    )
    # The bucket in which the sample of each size ends, and how many of its rows belong to it.
    upto = F.col("_before") + F.col("_n")
    ending = F.filter(F.array(*map(F.lit, sizes)), lambda n: (F.col("_before") < n) & (n <= upto))
    ends = summed.withColumn("n", F.explode(ending)).select(
        key, "trial", "_bucket", "n", (F.col("n") - F.col("_before")).alias("_need"), "_best_before"
    )
    order = Window.partitionBy(key, "trial", "n").orderBy("_draw", F.col("_row.tie").desc())
    # Sizes are estimated from the table's columns, before the trials: without the hint Spark may broadcast all draws.
    inside = drawn.hint("merge").join(ends.hint("merge"), [key, "trial", "_bucket"])
    inside = inside.withColumn("_no", F.row_number().over(order))
    best = (
        inside.where(F.col("_no") <= F.col("_need"))
        .groupBy(key, "trial", "n")
        .agg(F.greatest(F.max("_best_before"), F.max("_row")).alias("_top"))
    )
    sampled = best.groupBy("n").agg((F.sum(F.col("_top.label").cast("int")) / trials).alias("_right"))
    # Prompts with fewer rows than the size are drawn whole.
    best_of_all = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), F.max("_row").alias("_all"))
    short = [F.count_if((F.col("_rows") < n) & F.col("_all.label")).alias(f"_{n}") for n in sizes]
    totals = best_of_all.agg(F.count(F.lit(1)).alias("_prompts"), *short)
    per_size = F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"_{n}").alias("_short"), F.col("_prompts")) for n in sizes])
    rate = (F.coalesce("_right", F.lit(0.0)) + F.col("_short")) / F.nullif("_prompts", F.lit(0))
    return totals.select(F.inline(per_size)).join(sampled, "n", "left").select("n", rate.alias("solve_rate"))


def _by_size(df: DataFrame, sizes: tuple[int, ...], value) -> DataFrame:
    wide = df.agg(*[F.avg(value(n)).alias(f"_{n}") for n in sizes])
    cells = [
        F.struct(F.lit(n).alias("n"), F.col(f"_{n}").alias("solve_rate")) for n in sizes
    ]
    return wide.select(F.inline(F.array(*cells)))


def best_of_n_exact(
    df: DataFrame,
    sizes: tuple[int, ...] | None = None,
    order_by: str = "reward",
    key: str = "data_id",
    limit: int = skew.HOT_ROWS,
) -> DataFrame:
    """Expectation of best_of_n_sampled: each right row weighted by its chance to be the
    best of the drawn ones, which depends on its rank alone."""
    good = positive(F.col("label"))
    score = F.col("reward") if order_by == "reward" else good.cast("double")
    narrow = df.select(key, "ID", score.alias("score"), good.alias("label"))
    ranked = skew.number_by_score(narrow, [key], "score", "ID", "rank", limit)
    sizes_of = narrow.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    sizes = _sizes(sizes_of, sizes)
    # Only right rows carry weight; prompts without any still count as zero.
    right = ranked.where("label").select(key, "rank")
    placed = skew.skew_join(right, sizes_of, [key], ["rank"], "inner", limit)
    # The chance depends on (n, rank) alone, which many prompts share.
    shared = placed.groupBy("n", "rank").agg(F.count(F.lit(1)).alias("rows"))
    chance = _best_chances(shared, sizes).agg(
        *[F.sum(F.col(f"_{n}") * F.col("rows")).alias(f"_{n}") for n in sizes]
    )
    total = sizes_of.agg(F.count(F.lit(1))).scalar()
    cells = [
        F.struct(
            F.lit(n).alias("n"),
            (F.coalesce(F.col(f"_{n}"), F.lit(0.0)) / F.col("_total")).alias("solve_rate"),
        )
        for n in sizes
    ]
    return chance.withColumn("_total", total).select(F.inline(F.array(*cells)))


def _best_chances(df: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """Add ``_N``: the chance that the row of ``rank`` is the best of min(N, n) drawn ones.
    Each N goes on from the product of the one before."""
    before, done = 1, F.lit(1.0)
    for size in sorted(sizes):
        step = none_better(F.col("n"), F.col("rank"), before, size)
        df = df.withColumn(f"_no_{size}", F.when(done == 0, 0.0).otherwise(done * step))
        before, done = size, F.col(f"_no_{size}")
    drawn = {
        f"_{n}": F.least(F.lit(n), F.col("n")) / F.col("n") * F.col(f"_no_{n}") for n in sizes
    }
    return df.withColumns(drawn)


def best_of_n_oracle(
    df: DataFrame, sizes: tuple[int, ...] | None = None, key: str = "data_id"
) -> DataFrame:
    """best_of_n_exact with the label as the score. The best of a draw is right as soon
    as any drawn row is, which is pass@N of the counts: no ranking needed."""
    counts = prompt_counts(df, key)
    sizes = _sizes(counts, sizes)

    def solved(n: int) -> Column:
        return pass_at(F.col("n"), F.col("c"), F.least(F.lit(n), F.col("n")))

    return _by_size(counts, sizes, solved)


def label_distribution(df: DataFrame, bins: int = 10, key: str = "data_id") -> DataFrame:
    """Histogram of right rollouts per prompt, empty bins left out."""
    counts = prompt_counts(df, key).groupBy("c").agg(F.count(F.lit(1)).alias("prompts"))
    ends = counts.agg(F.struct(F.min("c").alias("low"), F.max("c").alias("high"))).scalar()
    place = histogram_bin(F.col("c"), F.col("_ends.low"), F.col("_ends.high"), bins)
    return (
        counts.withColumn("_ends", ends)
        .withColumn("bin", place)
        .groupBy("bin")
        .agg(F.sum("prompts").alias("prompts"))
    )


def reward_distribution(df: DataFrame, bins: int = 50) -> DataFrame:
    """Histogram of the reward for each label over that label's own range."""
    narrow = df.select(positive(F.col("label")).alias("label"), "reward")
    ranges = narrow.groupBy("label").agg(
        F.min("reward").alias("low"), F.max("reward").alias("high")
    )
    # Two labels, hence two rows.
    placed = narrow.join(F.broadcast(ranges), "label").withColumn(
        "bin", histogram_bin(F.col("reward"), F.col("low"), F.col("high"), bins)
    )
    return placed.groupBy("label", "bin").agg(F.count(F.lit(1)).alias("rollouts"))


def unique_prompts(df: DataFrame) -> DataFrame:
    """Distinct texts of the first message."""
    return df.select(F.get("prompt", F.lit(0))["content"].alias("content")).distinct()


def dedupe_scored(df: DataFrame, order: str = "seq") -> DataFrame:
    """One row per ``ID``, the first in ``order``: a partial group limit drops copies
    before the shuffle."""
    w = Window.partitionBy("ID").orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def binary_verifier_metrics(df: DataFrame) -> DataFrame:
    """Accuracy of the reward's sign and logistic loss, averaged over rows."""
    good = positive(F.col("label"))
    x = F.col("reward").cast("double")
    loss = softplus(x) - x * good.cast("double")
    return df.agg(
        F.avg(((x > 0) == good).cast("int")).alias("accuracy"), F.avg(loss).alias("loss")
    )


def pair_verifier_metrics(df: DataFrame, l2: float = 0.0) -> DataFrame:
    """Accuracy, loss, mean rewards and margin over pairs, and the training penalty."""
    chosen, rejected = F.col("chosen_reward"), F.col("rejected_reward")
    margin = chosen - rejected
    return df.agg(
        F.avg((chosen > rejected).cast("int")).alias("accuracy"),
        F.avg(softplus(-margin)).alias("loss"),
        F.avg(chosen).alias("chosen_rewards"),
        F.avg(rejected).alias("rejected_rewards"),
        F.avg(margin).alias("reward_margin"),
        (l2 * F.avg((chosen * chosen + rejected * rejected) / 2)).alias("penalty"),
    )


def pair_report(df: DataFrame, pad: str = "") -> DataFrame:
    """Per pair: shared text, both suffixes, rounded rewards, whether the order is right."""
    def clean(c: str) -> Column:
        return F.replace(F.col(c), F.lit(pad), F.lit("")) if pad else F.col(c)

    texts = df.withColumns(
        {"chosen_text": clean("chosen_text"), "rejected_text": clean("rejected_text")}
    ).withColumn("_shared", shared_prefix_length(F.col("chosen_text"), F.col("rejected_text")))
    return texts.select(
        "ID",
        F.left("chosen_text", F.col("_shared")).alias("shared_text"),
        response_suffix(F.col("chosen_text"), F.col("_shared")).alias("chosen_response"),
        response_suffix(F.col("rejected_text"), F.col("_shared")).alias("rejected_response"),
        F.round("chosen_reward", 4).alias("chosen_reward"),
        F.round("rejected_reward", 4).alias("rejected_reward"),
        (F.col("chosen_reward") > F.col("rejected_reward")).alias("correct"),
    )
