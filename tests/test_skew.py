"""Exact numbering and joins when groups are cut into slots, against plain windows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from trajmill.functions.draws import draw
from trajmill.operators import caller_code, metrics, sampling, selection, skew


def hot_table(spark, n=3000, seed=1, ids=None):
    """One group with a third of the rows, one null group, many small ones, tied scores."""
    rng = random.Random(seed)
    data = []
    for i in range(n):
        pick = rng.random()
        group = 0 if pick < 0.34 else None if pick < 0.4 else rng.randrange(1, 60)
        score = 1.0 if rng.random() < 0.4 else round(rng.gauss(0, 2), 1)
        data.append((i if ids is None else ids(i), group, score, rng.random() < 0.3))
    schema = "ID bigint, data_id bigint, reward double, label boolean"
    return spark.createDataFrame(data, schema).repartition(7)


def plain(df, keys, *order):
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("row_no", (F.row_number().over(w) - 1).cast("bigint"))


@pytest.mark.parametrize("limit", [20, 200, 10_000])
@pytest.mark.parametrize("keys", [["data_id"], ["data_id", "label"], []])
def test_number_by_id(spark, limit, keys):
    df = hot_table(spark)
    got = skew.number_by_id(df, keys, limit=limit)
    assert rows(got) == rows(plain(df, keys, "ID"))


@pytest.mark.parametrize("limit", [20, 200, 10_000])
def test_number_by_draw(spark, limit):
    df = hot_table(spark).withColumn("d", draw(5, F.col("ID")))
    got = skew.number_by_draw(df, ["data_id"], "d", limit=limit)
    assert rows(got) == rows(plain(df, ["data_id"], "d", "ID"))
    whole = skew.number_by_draw(df, [], "d")
    assert rows(whole) == rows(plain(df, [], "d", "ID"))


@pytest.mark.parametrize("limit", [1, 20, 200, 10_000])
def test_number_by_score(spark, limit):
    df = hot_table(spark)
    got = skew.number_by_score(df, ["data_id"], "reward", limit=limit)
    assert rows(got) == rows(plain(df, ["data_id"], F.desc("reward"), "ID"))


def test_number_by_score_one_value(spark):
    df = hot_table(spark).withColumn("reward", F.lit(2.5))
    got = skew.number_by_score(df, ["data_id"], "reward", limit=50)
    assert rows(got) == rows(plain(df, ["data_id"], "ID"))


def test_no_slot_is_large(spark):
    """A group with many equal scores does not end up in one window partition."""
    df = hot_table(spark)
    seen = []
    original = skew.number_rows

    def spy(df, keys, order, slot, name, limit, marks):
        hot = df.where("data_id = 0")
        marked = hot.join(hot.agg(F.count("*").alias("_rows"), marks.alias("_marks"))).withColumn("s", slot)
        seen.append(marked.groupBy("s").count().agg(F.max("count")).first()[0])
        return original(df, keys, order, slot, name, limit, marks)

    skew.number_rows = spy
    try:
        skew.number_by_score(df, ["data_id"], "reward", limit=100)
    finally:
        skew.number_rows = original
    total = df.where("data_id = 0").count()
    assert seen[0] < total / 4


def test_groups_on_different_scales_get_even_slots(spark):
    """Each hot group is cut by its own borders, and the plan is built without a job."""
    rng = random.Random(3)
    data = [(i, i % 2, rng.random() + 1000 * (i % 2), True) for i in range(4000)]
    df = spark.createDataFrame(data, "ID bigint, data_id bigint, reward double, label boolean")
    got = skew.number_by_score(df, ["data_id"], "reward", limit=100)
    assert rows(got) == rows(plain(df, ["data_id"], F.desc("reward"), "ID"))
    facts = F.struct(skew._score_marks(F.col("reward")).alias("scores"), skew._id_marks(F.col("ID")).alias("ids"))
    per_group = df.groupBy("data_id").agg(F.count("*").alias("_rows"), facts.alias("_marks"))
    slots = df.join(per_group, "data_id").withColumn("s", skew._score_slot(F.col("reward"), F.col("ID"), 100))
    sizes = slots.groupBy("data_id", "s").count().groupBy("data_id").agg(F.max("count").alias("most"), F.count("*").alias("n"))
    assert all(r["most"] <= 60 and r["n"] >= 100 for r in sizes.collect())


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("limit", [25, 10_000])
def test_skew_join(spark, how, limit):
    df = hot_table(spark)
    small = spark.range(0, 40).select(
        F.col("id").alias("data_id"), (F.col("id") * 7).alias("v"), F.lit(True).alias("there")
    )
    small = small.unionByName(small.where("data_id < 3").withColumn("v", F.lit(-1).cast("bigint")))
    got = skew.skew_join(df, small, ["data_id"], ["ID"], how, limit)
    want = df.join(small, ["data_id"], how)
    assert got.columns == want.columns
    assert rows(got) == rows(want)


def test_apply_group_on_shares(spark):
    df = hot_table(spark).where("data_id is not null").select("data_id", "ID", "reward")

    def best(rows_):
        return rows_.sort_values(["reward", "ID"], ascending=[False, True]).head(3)

    got = caller_code.apply_group(df, ["data_id"], best, ["ID"], limit=100)
    want = plain(df, ["data_id"], F.desc("reward"), "ID").where("row_no < 3").drop("row_no")
    assert rows(got) == rows(want)


def test_apply_group_merges_picks_in_levels(spark):
    """A selector that keeps half of what it gets: no call sees many more rows than the limit."""
    df = hot_table(spark, 6000).where("data_id is not null").select("data_id", "ID", "reward")

    def upper(rows_):
        # Of a part as of the whole: the best hundred of some rows.
        assert len(rows_) <= 600
        best = rows_[rows_["ID"] % 3 > 0].sort_values(["reward", "ID"], ascending=[False, True])
        return best.head(100)

    got = caller_code.apply_group(df, ["data_id"], upper, ["ID"], limit=400)
    keep = df.where("ID % 3 > 0")
    want = plain(keep, ["data_id"], F.desc("reward"), "ID").where("row_no < 100").drop("row_no")
    assert rows(got) == rows(want)
    with pytest.raises(ValueError):
        caller_code.apply_group(df, ["data_id"], lambda rows_: rows_, ["ID"], limit=400)


def test_operators_agree_hot_or_not(spark):
    df = hot_table(spark).where("data_id is not null")
    for limit in (30, 10**9):
        now = [
            rows(selection.assign_searches(df, 5, limit)),
            rows(selection.select_topk_per_search(df, 2, 5, limit=limit)),
            rows(selection.select_all_ranked(df, 5, limit=limit)),
            rows(selection.select_random_k(df, 2, 5, 3, limit)),
            rows(sampling.sample_pair_ids(df, 8)),
            [
                (n, round(v, 9))
                for n, v in rows(metrics.best_of_n_exact(df, (1, 4, 64), limit=limit))
            ],
            rows(metrics.best_of_n_sampled(df, (1, 4, 64), 3)),
        ]
        if limit == 30:
            first = now
    assert first == now


SPARSE = {"hashed": lambda i: (i * 0x9E3779B97F4A7C15) % (1 << 63), "far": lambda i: (1 << 47) * (i + 1) + 5}


@pytest.mark.parametrize("spread", sorted(SPARSE))
def test_slots_follow_rows_not_ids(spark, spread):
    """Ids far apart make as many slots as dense ones."""
    df = hot_table(spark, ids=SPARSE[spread])
    got = skew.number_by_id(df, ["data_id"], limit=20)
    assert rows(got) == rows(plain(df, ["data_id"], "ID"))
    hot = df.where("data_id = 0")
    head = F.col("ID")
    facts = hot.agg(F.count("*").alias("_rows"), skew._id_marks(head).alias("_marks"))
    slots = hot.join(facts).withColumn("s", skew._id_slot(head, 100)).groupBy("s").count()
    assert slots.agg(F.max("count")).first()[0] <= 40
    assert slots.count() <= 2 * skew._ID_PARTS


@pytest.mark.parametrize("limit", [10, 10**6])
def test_null_and_odd_scores_rank_alike(spark, limit):
    """Nulls come last and NaN first, whether the group is hot or not."""
    odd = F.when(F.col("ID") % 10 == 0, F.lit(None)).when(F.col("ID") % 17 == 0, float("nan"))
    df = hot_table(spark).withColumn("reward", odd.otherwise(F.col("reward")))
    got = skew.number_by_score(df, ["data_id"], "reward", limit=limit)
    assert rows(got.drop("reward")) == rows(plain(df, ["data_id"], F.desc("reward"), "ID").drop("reward"))


def test_apply_group_gives_the_same_rows_at_any_size(spark):
    df = hot_table(spark).where("data_id is not null").select("data_id", "ID", "reward")

    def middle(rows_):
        return rows_.sort_values(["reward", "ID"]).iloc[[len(rows_) // 2]]

    whole = [rows(caller_code.apply_group(df, ["data_id"], middle, limit=n)) for n in (50, 10**6)]
    assert whole[0] == whole[1] and len(whole[0]) == df.select("data_id").distinct().count()


def test_pairs_of_far_ids(spark):
    """Ids as far apart as 2**47 keep their own rows."""
    ids = [5, (1 << 47) + 5, (1 << 62) + 5]
    data = [(i, 0, n % 2 == 0, f"text {i}") for n, i in enumerate(ids)]
    df = spark.createDataFrame(data, "ID bigint, data_id bigint, label boolean, completion string")
    df = df.withColumn("prompt", F.lit("q"))
    for r in sampling.sample_pairs(df, 20).collect():
        assert r["chosen"] == f"text {r['chosen_ID']}" and r["rejected"] == f"text {ids[1]}"


def test_joins_deal_long_texts(spark, monkeypatch):
    """A key with few rows is dealt too if their texts are many bytes, wherever they lie in the row."""
    monkeypatch.setattr(skew, "HOT_BYTES", 10_000)
    small = spark.createDataFrame([(0, "x"), (1, "y")], "key long, other string")
    flat = spark.range(390).select("id", F.when(F.col("id") < 300, 0).otherwise(1).cast("long").alias("key"), F.repeat(F.lit("ab"), 50).alias("text"))
    nested = flat.withColumn("text", F.array(F.struct("text"), F.struct(F.lit(None).cast("string").alias("text"))))
    for big in (flat, nested):
        got = skew.skew_join(big, small, ["key"], ["id"])
        assert rows(got) == rows(big.join(small, "key").select(*got.columns))
        shares = {r["key"]: r["_rows"] for r in skew._with_shares(skew._large_groups(big, ["key"], skew.HOT_ROWS), skew.HOT_ROWS).collect()}
        assert shares == {0: 4}
    assert rows(skew.hot_groups(flat, ["key"])) == []
