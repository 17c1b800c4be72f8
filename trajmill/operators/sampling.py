"""Seeded sampling, pairing, padding and shuffling.

Rows are drawn as those of the least hash, one hash a draw, in one partial aggregate: no group is
numbered or sorted, however large. Padding picks positions. Only ids travel that far; texts are
attached to the drawn rows at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajmill.functions.draws import draw, fine_draw
from trajmill.functions.feedback import positive
from trajmill.operators import skew


def side_counts(df: DataFrame, key: str = "data_id") -> DataFrame:
    """Positives and negatives of each prompt."""
    label = positive(F.col("label"))
    return df.groupBy(key).agg(
        F.count_if(label).alias("n_pos"), F.count_if(~label).alias("n_neg")
    )


def prompts_with_both(df: DataFrame, key: str = "data_id") -> DataFrame:
    """Prompts with at least one positive and one negative."""
    return side_counts(df, key).where((F.col("n_pos") > 0) & (F.col("n_neg") > 0))


def missing_side_counts(df: DataFrame, key: str = "data_id") -> DataFrame:
    """One row: prompts without a pair, without positives, without negatives, all."""
    no_pos, no_neg = F.col("n_pos") == 0, F.col("n_neg") == 0
    return side_counts(df, key).agg(
        F.count_if(no_pos | no_neg).alias("no_pairs"),
        F.count_if(no_pos).alias("no_pos"),
        F.count_if(no_neg).alias("no_neg"),
        F.count(F.lit(1)).alias("prompts"),
    )


def _least(df: DataFrame, key: str, samples: int, seed: str) -> DataFrame:
    """(key, draw, _h, ID, ...): every row once for each draw, with its hash there. The row of the least
    hash is a uniform draw with replacement, and draws are independent of each other."""
    numbers = F.sequence(F.lit(0).cast("bigint"), F.lit(samples - 1).cast("bigint"))
    return df.withColumn("draw", F.explode(numbers)).withColumn("_h", fine_draw(seed, F.col("draw"), F.col("ID")))


def sample_pair_ids(df: DataFrame, samples: int = 32, key: str = "data_id") -> DataFrame:
    """``samples`` draws with replacement of one positive and one negative per prompt.

    Returns ``(key, draw, chosen_ID, rejected_ID, first_ID)``; ``first_ID`` is the first
    positive, whose prompt stands for the group. No group is ranked: minima are kept per task, and
    two ids a prompt, draw and task are shuffled.
    """
    label = positive(F.col("label"))
    tried = _least(df.where(F.col(key).isNotNull()).select(key, "ID", label.alias("label")), key, samples, "p")

    def pick(side: Column) -> Column:
        return F.min_by(F.when(side, F.col("ID")), F.when(side, F.col("_h")))

    good = F.col("label")
    return (
        tried.groupBy(key, "draw")
        .agg(
            pick(good).alias("chosen_ID"),
            pick(~good).alias("rejected_ID"),
            F.min(F.when(good, F.col("ID"))).alias("first_ID"),
        )
        .where("chosen_ID IS NOT NULL AND rejected_ID IS NOT NULL")
    )


def _attach(df: DataFrame, rows: DataFrame, id_col: str, **columns: str) -> DataFrame:
    """Look up columns of the row an id points to. A row may be drawn many times, so
    the drawn side is the one that may repeat a key."""
    picked = rows.select(
        F.col("ID").alias(id_col), *[F.col(c).alias(n) for n, c in columns.items()]
    )
    return df.join(picked, id_col)


def sample_pairs(df: DataFrame, samples: int = 32, key: str = "data_id") -> DataFrame:
    """Preference pairs ``prompt, chosen, rejected`` (and the ids they came from)."""
    pairs = sample_pair_ids(df, samples, key)
    pairs = _attach(pairs, df, "chosen_ID", chosen="completion")
    pairs = _attach(pairs, df, "rejected_ID", rejected="completion")
    firsts = df.select(F.col("ID").alias("first_ID"), "prompt")
    return pairs.join(firsts, "first_ID").select(
        key, "draw", "chosen_ID", "rejected_ID", "prompt", "chosen", "rejected"
    )


def upsample_positives(df: DataFrame, samples: int = 100, key: str = "data_id") -> DataFrame:
    """``samples`` draws with replacement from the positives of each prompt; id, prompt
    and label come from the first positive."""
    good = df.where(positive(F.col("label"), df))
    tried = _least(good.where(F.col(key).isNotNull()).select(key, "ID"), key, samples, "u")
    drawn = tried.groupBy(key, "draw").agg(
        F.min_by("ID", "_h").alias("source_ID"), F.min("ID").alias("first_ID")
    )
    drawn = _attach(drawn, good, "source_ID", completion="completion")
    firsts = good.select(F.col("ID").alias("first_ID"), "data_id", "prompt", "label")
    return drawn.drop("data_id", "prompt", "label").join(firsts, "first_ID").select(
        "data_id", "draw", "source_ID", "prompt", "completion", "label"
    )


def pad_to_multiple(
    df: DataFrame, batch: int, seed: int = 0, strict: bool = False, id_col: str = "ID"
) -> DataFrame:
    """Add randomly drawn rows until the number of rows is a multiple of ``batch``.

    A table that fits already gets a whole extra batch unless ``strict``. Ids are unique
    integers; draws pick their positions. Added rows have ``padding`` set. An empty table stays
    empty.
    """
    n = df.agg(F.count(F.lit(1))).scalar()
    missing = F.lit(batch) - n % batch
    if strict:
        missing = missing % batch
    slots = df.sparkSession.range(batch).where(F.col("id") < missing)
    # A draw of a 32-bit hash covers small tables evenly; two of them cover any.
    wide = draw(seed, F.col("id")) * (1 << 30) + F.shiftright(draw(seed, "low", F.col("id")), 2)
    at = F.when(n < (1 << 32), draw(seed, F.col("id")) % F.nullif(n, F.lit(0))).otherwise(wide % F.nullif(n, F.lit(0)))
    drawn = slots.select(at.alias("_no"))
    places = skew.number_by_id(df.select(id_col), [], id_col, "_no")
    padding = df.join(places.join(drawn, "_no").select(id_col), id_col).select(*df.columns, F.lit(True).alias("padding"))
    return df.withColumn("padding", F.lit(False)).unionByName(padding)


def shuffle_key(seed: int, epoch: int, id_col: str = "ID") -> Column:
    return draw(seed, epoch, F.col(id_col))


def shuffle_rows(df: DataFrame, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Epoch shuffle: the same order for the same seed on any cluster."""
    return df.orderBy(shuffle_key(seed, epoch), "ID")


def limit_rows(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows by id, for a report's sample table."""
    return df.orderBy("ID").limit(n)


def add_row_id(df: DataFrame, order: str, name: str = "ID") -> DataFrame:
    """Dense 0-based id in the order of a unique integer column, without a global sort."""
    return skew.number_by_id(df, [], order, name)


def drop_canonical(df: DataFrame) -> DataFrame:
    """Remove the trailing canonical rollouts: the last U rows by dense id, where U is the
    number of different first messages."""
    return df.where(F.col("ID") < _first_canonical(df))


def _first_canonical(df: DataFrame) -> Column:
    opening = F.get("prompt", F.lit(0))["content"]
    return df.agg(F.count(F.lit(1)) - F.count_distinct(opening)).scalar()


def canonical_violations(df: DataFrame) -> DataFrame:
    """One row: how many of the trailing rows that drop_canonical removes are not positive."""
    tail = df.where(F.col("ID") >= _first_canonical(df))
    return tail.agg(
        F.count(F.lit(1)).alias("canonical"),
        F.count_if(~positive(F.col("label"))).alias("violations"),
    )
