"""Mixing sources to target weights by Pareto order sampling.

A source's target gives every document an expected number of copies. Its whole part is
certain; the rest is an inclusion probability p. Documents are ranked by the odds of a
uniform draw u over the odds of p, ``u/(1-u) : p/(1-p)``, and the lowest ranks are taken until
the source has its words: a sample of fixed size, in words, with unequal probabilities.

No source is sorted as a whole. Ranks fall into as many buckets as the square root of the
source's rows; sums over buckets tell which ones are in, and only the bucket at the border is
sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajmill.llm.shared import draw, store


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _numbered(sources: DataFrame) -> DataFrame:
    """Add ``place``, from 0: sources by code point, null last. Each task numbers a range."""
    order = [F.col("source").isNull(), F.col("source")]
    parts = store(
        sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sources"
    )
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.groupBy("part").count().select(
        "part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("shift")
    )
    within = Window.partitionBy("part").orderBy(*order)
    return (
        parts.withColumn("in_part", F.row_number().over(within) - 1)
        .join(shifts, "part")
        .withColumn("place", F.col("in_part") + F.col("shift"))
        .drop("part", "in_part", "shift")
    )


def source_targets(
    sources: DataFrame, weights: list[float], share: float, most: float
) -> DataFrame:
    """(source, words, n) -> the same with ``target``.

    Targets share ``share`` times all words in the ratio of the sources' weights, and none
    exceeds ``most`` times its source's words: what is over is shared out again by weight
    until none is above. Each round reads one row of sums.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    cap = F.col("words") * float(most)
    table = store(
        _numbered(sources)
        .withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights)).cast("int") + 1))
        .drop("place"),
        "weights",
    )
    total, level, capped = None, 0.0, -1
    while True:
        over = F.col("weight") * level > cap
        full, left, count, words = table.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)),
            F.coalesce(F.sum(over.cast("bigint")), F.lit(0)),
            F.coalesce(F.sum("words"), F.lit(0)),
        ).first()
        if total is None:
            total = share * words
        elif count == capped or not left:
            break
        capped = count
        level = (total - full) / left if left else 0.0
    return table.withColumn("target", F.least(F.col("weight") * level, cap)).drop("weight")


def _per_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Join facts of sources to rows; a null source is a source like any other."""
    named = table.withColumnRenamed("source", "source2")
    return rows.join(named, F.col("source").eqNullSafe(F.col("source2"))).drop("source2")


def _expected(rows: DataFrame, most: float) -> DataFrame:
    """Expected copies in proportion to ``liking`` within each source, ``most`` at the most:
    what the favourites cannot take is shared out again until none is above."""
    table, done = None, -1
    while True:
        current = rows.withColumn("level", F.lit(0.0)) if table is None else _per_source(rows, table)
        over = F.col("liking") * F.col("level") > most
        sums = store(
            current.groupBy("source").agg(
                F.min("target").alias("goal"),
                F.coalesce(F.sum(F.when(over, F.col("size") * most)), F.lit(0.0)).alias("full"),
                F.coalesce(F.sum(F.when(~over, F.col("size") * F.col("liking"))), F.lit(0.0)).alias("left"),
                F.sum(over.cast("bigint")).alias("count"),
            ),
            "likings",
        )
        count = sums.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
        if count == done:
            wanted = F.least(F.col("liking") * F.col("level"), F.lit(most))
            liked = F.when(F.col("liking") > 0, wanted).otherwise(0.0)
            return current.withColumn("expected", liked).drop("level")
        # Where all documents are at the most, any level above keeps them there.
        share = F.when(F.col("left") > 0, (F.col("goal") - F.col("full")) / F.col("left"))
        table = sums.select("source", F.coalesce(share, F.lit(float("inf"))).alias("level"))
        done = count


def allocate(
    docs: DataFrame,
    size: Column,
    source: str = "source",
    id_col: str = "doc_id",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2,
    liking: Column | None = None,
    seed: int = 0,
) -> DataFrame:
    """(row, size, source_size, target, copies) of every row of the documents.

    ``row`` holds all columns, whatever their names. Sources by code point, null last, take
    the weights in turn. ``liking`` is a positive preference of documents within
    their source (null and negative: 0); without it all documents of a source are alike. A source's
    taken words differ from its target by half a document at most. Reruns agree: the
    draw is a hash of seed and id (null ids share one draw; ties are ordered by id, then
    size). Null and empty texts have size 0 and their copies hold no words. Repeated rows
    are documents of their own. An empty table gives an empty result.
    """
    plain = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        docs[source].cast("string").alias("source"),
        size.cast("bigint").alias("size"),
        docs[id_col].alias("id"),
        F.lit(1.0).alias("liking") if liking is None else F.greatest(F.coalesce(liking.cast("double"), F.lit(0.0)), F.lit(0.0)).alias("liking"),
    )
    rows = store(plain, "documents")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    table = store(source_targets(sizes, list(weights), share, most), "targets")
    joined = _per_source(rows, table)
    if liking is None:
        # Two documents of a source differ in nothing: the copies of all are target / words.
        mean = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0)
        expected = joined.withColumn("expected", mean)
        whole = F.floor("expected")
        chance = F.when(F.col("words") > 0, (F.col("target") - whole * F.col("words")) / F.col("words"))
    else:
        expected = _expected(joined, float(most))
        whole = F.floor("expected")
        chance = F.col("expected") - whole
    u = draw(F.col("id"), seed=seed)
    odds = F.col("chance") / (1 - F.col("chance"))
    ranked = (
        expected.withColumn("whole", whole.cast("bigint"))
        .withColumn("chance", F.when(chance > 0, chance))
        .withColumn("rank", u / (1 - u) / odds)
    )
    # Chances near 0 or 1 crowd the ranks; the source's mean chance spreads them again.
    mean = ranked.groupBy("source").agg(
        F.sum(F.col("whole") * F.col("size")).alias("certain"),
        F.avg("chance").alias("mean_chance"),
    )
    ranked = _per_source(store(ranked, "ranks"), store(mean, "certain"))
    spread = F.col("rank") * F.col("mean_chance") / (1 - F.col("mean_chance"))
    ranked = ranked.withColumn("budget", F.col("target") - F.col("certain")).withColumn(
        "bucket", F.floor(spread / (1 + spread) * F.ceil(F.sqrt("n"))).cast("bigint")
    )
    sums = ranked.where("bucket IS NOT NULL").groupBy("source", "bucket").agg(
        F.sum("size").alias("words"), F.min("budget").alias("budget")
    )
    running = Window.partitionBy("source").orderBy("bucket")
    border = (
        sums.withColumn("end", F.sum("words").over(running))
        .where("end > budget")
        .groupBy("source")
        .agg(F.min(F.struct("bucket", F.col("end") - F.col("words"))).alias("at"))
        .select("source", F.col("at.bucket").alias("border"), F.col("at.col2").alias("start"))
    )
    placed = ranked.join(
        store(border, "borders").withColumnRenamed("source", "source2"),
        F.col("source").eqNullSafe(F.col("source2")),
        "left",
    )
    inside = F.col("bucket").isNotNull() & (F.col("border").isNull() | (F.col("bucket") < F.col("border")))
    at_border = F.coalesce(F.col("bucket") == F.col("border"), F.lit(False))
    order = Window.partitionBy("source").orderBy("rank", "id", "size")
    before = F.col("start") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    extra = placed.where(at_border).withColumn("extra", before + F.col("size") / 2 <= F.col("budget"))
    clear = placed.where(~at_border).withColumn("extra", inside)
    return clear.unionByName(extra).select(
        "row",
        "size",
        F.col("words").alias("source_size"),
        "target",
        (F.col("whole") + F.col("extra").cast("bigint")).alias("copies"),
    )


def mix(docs: DataFrame, size: Column, **options) -> DataFrame:
    """The documents that the mix takes, all columns, and how often: ``copies``, last (and under
    the name ``mix_copies`` if there is such a column already). Options as in allocate()."""
    name = "copies" if "copies" not in docs.columns else "mix_copies"
    taken = allocate(docs, size, **options).where("copies > 0")
    return taken.select("row.*", F.col("copies").alias(name))
