"""Numbering and joins that stay balanced when one group holds much of the table.

A plain ``row_number()`` window sorts each group in one task. That is right for
ordinary groups and fatal for a group with billions of rows. Here groups with more
than ``limit`` rows are cut into slots that follow the requested order; each slot is
numbered on its own and shifted by the size of the slots before it. The result is the
exact row number. At most ``rows / limit`` groups can be that large, which bounds every
broadcast below; nothing is sampled, dropped or capped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajmill.functions.draws import RANGE_BITS

HOT_ROWS = 1_000_000
#: No list of hot groups is longer: with more rows than this many limits, the limit grows.
MOST_HOT = 100_000
#: Bytes of one key's rows that a join puts into one share.
HOT_BYTES = 32 * 2**20


def hot_groups(df: DataFrame, keys: list[str], limit: int = HOT_ROWS) -> DataFrame:
    """Groups with more than ``limit`` rows and their sizes (partial counts, no sort)."""
    return _hot(df, keys, limit)


def _hot(df: DataFrame, keys: list[str], limit: int, *facts: Column) -> DataFrame:
    """The hot groups with their sizes and facts. A group is hot if it has more than ``limit`` rows
    and more than 1 / MOST_HOT of all rows, which bounds the list whatever the table's size."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    large = groups.where(F.col("_rows") > limit)
    total = df.agg(F.count(F.lit(1))).scalar()
    hot = large.where(F.col("_rows") > total / MOST_HOT)
    if not facts:
        return hot
    # Facts are sketches: only the rows of hot groups go through them.
    inside = _mark_hot(df, hot, keys).where(F.col("_rows").isNotNull())
    return _join_null_safe(hot, inside.groupBy(*keys).agg(*facts), keys)


def _mark_hot(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``_rows``, the size of a hot group, and its other facts; null for any other group."""
    return _join_null_safe(df, F.broadcast(hot), keys)


def _join_null_safe(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which a null key is a group like any other."""
    renamed = small.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    )
    return df.join(renamed, same, "left").drop(*[f"_of_{k}" for k in keys])


def number_rows(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    slot: Column,
    name: str = "row_no",
    limit: int = HOT_ROWS,
    marks: Column | None = None,
) -> DataFrame:
    """Add the 0-based position of each row within its group.

    ``slot`` must not decrease along ``order`` and must hold few rows per value; it may use
    ``_rows``, the size of the group, and ``_marks``, the aggregate ``marks`` over it.
    Without ``keys`` the whole table is one group and is always cut into slots.
    """
    facts = [] if marks is None else [marks.alias("_marks")]
    if keys:
        marked = _mark_hot(df, _hot(df, keys, limit, *facts), keys)
        marked = marked.withColumn("_slot", F.when(F.col("_rows").isNotNull(), slot))
        cut = marked.where(F.col("_slot").isNotNull())
    else:
        whole = df.agg(F.struct(F.count(F.lit(1)).alias("_rows"), *facts)).scalar()
        marked = df.withColumn("_whole", whole).withColumn("_rows", F.col("_whole._rows"))
        if facts:
            marked = marked.withColumn("_marks", F.col("_whole._marks"))
        marked = marked.withColumn("_slot", slot)
        cut = marked
    sizes = cut.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_size"))
    earlier = (
        Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = sizes.select(
        *keys, "_slot", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_shift")
    )
    within = Window.partitionBy(*keys, "_slot").orderBy(*order)
    numbered = marked.withColumn("_pos", F.row_number().over(within) - 1)
    return (
        _join_null_safe(numbered, shifts, [*keys, "_slot"])
        .withColumn(name, (F.col("_pos") + F.coalesce("_shift", F.lit(0))).cast("bigint"))
        .select(*df.columns, name)
    )


def number_by_id(
    df: DataFrame,
    keys: list[str],
    id_col: str = "ID",
    name: str = "row_no",
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Position by a unique integer id, or by a struct of which the first field is one.

    Slots lie between quantiles of the ids and are cut evenly further on, so their number
    follows the rows, however the ids are spread.
    """
    head = _head(df, id_col)
    return number_rows(
        df, keys, [F.col(id_col)], _id_slot(head, limit), name, limit, _id_marks(head)
    )


def _head(df: DataFrame, id_col: str) -> Column:
    kind = df.schema[id_col].dataType
    return F.col(id_col)[kind.names[0]] if isinstance(kind, T.StructType) else F.col(id_col)


_ID_PARTS = 256


def _id_marks(ids: Column) -> Column:
    at = F.array(*[F.lit(i / _ID_PARTS) for i in range(_ID_PARTS + 1)])
    return F.percentile_approx(ids, at, F.lit(10_000))


def _id_slot(ids: Column, limit: int, marks: Column | None = None) -> Column:
    marks = F.col("_marks") if marks is None else marks
    part = F.size(F.filter(marks, lambda m: m <= ids))
    low, high = F.get(marks, part - 1), F.get(marks, part)
    cuts = F.ceil(2.0 * F.col("_rows") / limit / _ID_PARTS)
    even = F.floor((ids - low) / (high - low) * cuts)
    return F.struct(part.alias("part"), F.coalesce(even, F.lit(0)).alias("cut"))


def number_by_draw(
    df: DataFrame,
    keys: list[str],
    draw_col: str,
    id_col: str = "ID",
    name: str = "row_no",
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Position by a uniform 32-bit draw, ties by id: slots are equal parts of its range, as
    many as the group's rows need."""
    slot = F.floor(F.col(draw_col) / float(1 << RANGE_BITS) * F.ceil(2.0 * F.col("_rows") / limit))
    return number_rows(df, keys, [F.col(draw_col), F.col(id_col)], slot, name, limit)


def number_by_score(
    df: DataFrame,
    keys: list[str],
    score: str,
    id_col: str = "ID",
    name: str = "row_no",
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Position by score, best first, ties by a unique integer id.

    Each hot group has its own borders, quantiles of its scores kept with the group, so
    groups on different scales are cut alike. A score equal to a border gets a slot of its own
    that is cut again by ids, so one heavily repeated score spreads too. NaN comes first, null
    scores last. The borders may err as sketches do: every row is compared with the same ones.
    """
    # Negative zero equals zero in SQL but not for the border search.
    value = F.when(F.col(score) == 0, 0.0).otherwise(F.col(score).cast("double"))
    order = [value.desc(), F.col(id_col)]
    facts = F.struct(_score_marks(value).alias("scores"), _id_marks(F.col(id_col)).alias("ids"))
    return number_rows(df, keys, order, _score_slot(value, F.col(id_col), limit), name, limit, facts)


_SCORE_PARTS = 256


def _score_marks(value: Column) -> Column:
    at = F.array(*[F.lit(i / _SCORE_PARTS) for i in range(_SCORE_PARTS + 1)])
    return F.percentile_approx(F.when(~F.isnan(value), value), at, F.lit(10_000))


def _score_slot(value: Column, ids: Column, limit: int) -> Column:
    none, odd = value.isNull(), F.coalesce(F.isnan(value), F.lit(False))
    marks = F.coalesce(F.col("_marks.scores"), F.array().cast("array<double>"))
    part = F.size(F.filter(marks, lambda m: m <= value))
    edge, above = F.get(marks, part - 1), F.get(marks, part)
    on_edge = none | odd | F.coalesce(edge == value, F.lit(False))
    cuts = F.ceil(2.0 * F.col("_rows") / limit / _SCORE_PARTS)
    finite = (F.abs(edge) < float("inf")) & (F.abs(above) < float("inf")) & (above > edge)
    even = F.when(~on_edge & finite, F.floor((above - value) / (above - edge) * cuts))
    # Within a part the border value itself is the lowest score, so it comes last.
    return F.struct(
        F.when(none, 1).when(odd, -_SCORE_PARTS - 2).otherwise(-part).alias("part"),
        on_edge.alias("on_edge"),
        F.coalesce(even, F.lit(0)).alias("cut"),
        F.when(on_edge, _id_slot(ids, limit, F.col("_marks.ids"))).alias("ids"),
    )


def _with_shares(hot: DataFrame, limit: int) -> DataFrame:
    return hot.withColumn("_rows", F.ceil(F.col("_rows") / limit).cast("int"))


def _bytes(value: Column, kind: T.DataType) -> Column:
    """Bytes of the texts in a value, however nested; a number counts as none."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value).cast("bigint")
    elif isinstance(kind, T.StructType):
        size = reduce(lambda a, b: a + b, [_bytes(value[f.name], f.dataType) for f in kind], F.lit(0).cast("bigint"))
    elif isinstance(kind, T.ArrayType) and _has_text(kind):
        size = F.aggregate(value, F.lit(0).cast("bigint"), lambda n, v: n + _bytes(v, kind.elementType))
    elif isinstance(kind, T.MapType) and _has_text(kind):
        size = _bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + _bytes(
            F.map_values(value), T.ArrayType(kind.valueType)
        )
    else:
        return F.lit(0).cast("bigint")
    return F.coalesce(size, F.lit(0).cast("bigint"))


def _has_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_text(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _has_text(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_text(kind.keyType) or _has_text(kind.valueType)
    return isinstance(kind, (T.StringType, T.BinaryType))


def _large_groups(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The hot groups of a table whose rows are moved whole. With texts, ``HOT_BYTES`` of them weigh as
    much as ``limit`` rows, so a share is bounded in rows and in bytes."""
    texts = [f for f in df.schema if _has_text(f.dataType)]
    if not texts:
        return hot_groups(df, keys, limit)
    size = reduce(lambda a, b: a + b, [_bytes(F.col(f.name), f.dataType) for f in texts])
    weighed = df.select(*keys, size.alias("_size"))
    groups = weighed.groupBy(*keys).agg(
        F.ceil(F.count(F.lit(1)) + F.sum("_size") * (limit / HOT_BYTES)).alias("_rows")
    )
    total = groups.agg(F.sum("_rows")).scalar()
    return groups.where(F.col("_rows") > limit).where(F.col("_rows") > total / MOST_HOT)


def _deal(df: DataFrame, hot: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    share = F.pmod(F.xxhash64(*spread), F.col("_rows")).cast("int")
    return _mark_hot(df, hot, keys).withColumn("_share", share).drop("_rows")


def deal_hot(
    df: DataFrame, keys: list[str], spread: list[str], limit: int = HOT_ROWS
) -> DataFrame:
    """Add ``_share``: null for ordinary groups; the rows of a hot one are dealt over
    ``rows / limit`` shares by a hash of the ``spread`` columns."""
    return _deal(df, _with_shares(hot_groups(df, keys, limit), limit), keys, spread)


def spread_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Give every core a share of a table read from fewer splits than there are cores.

    Heavy per-row work on a small input would run in one task otherwise. Large inputs
    have splits enough and pass unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def skew_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    spread: list[str],
    how: str = "inner",
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Equi-join where a key may repeat without bound in ``big`` but only a few times in
    ``small``. Rows of a hot key are dealt over shares of up to ``limit`` rows and ``HOT_BYTES`` of text by a
    hash of the ``spread`` columns, which must tell rows apart, and the matching small rows are
    repeated once per share."""
    hot = _with_shares(_large_groups(big, keys, limit), limit)
    dealt = _deal(big, hot, keys, spread).withColumn("_share", F.coalesce("_share", F.lit(0)))
    repeated = (
        _mark_hot(small, hot, keys)
        .withColumn(
            "_share",
            F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_rows"), F.lit(1)) - 1)),
        )
        .drop("_rows")
    )
    return dealt.join(repeated, [*keys, "_share"], how).drop("_share")
