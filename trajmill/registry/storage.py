"""Reading, writing and incremental ingestion.

Each query writes to a fresh folder under the session's shared work folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajmill import constants as C
from trajmill import schemas as S
from trajmill.operators import metrics as M
from trajmill.operators import merge as G
from trajmill.plans import stages
from trajmill.registry import query
from trajmill.registry import tables as t
from trajmill.registry.metric_queries import COUNTS, PASS
from trajmill.session import new_folder
from trajmill.sources import scans as R
from trajmill.sources import sinks as W
from trajmill.streaming import ingest as N

D = t.digest_sql


def _digests(df, *names):
    return df.withColumns({c: t.digest(c) for c in names})


@query(
    t.sql(
        "SELECT data_id, split, md5(text) AS text, len(test_list)::INT AS tests FROM mbpp WHERE split = 'train'",
        "mbpp",
    )
)
def scan_problems(spark, sf):
    folder = new_folder(spark, "problems")
    t.problems(spark, sf, "mbpp").write.partitionBy("split").parquet(folder)
    rows = R.scan_problems(spark, folder, "mbpp", "train")
    return rows.select("data_id", "split", F.md5("text").alias("text"), F.size("test_list").alias("tests"))


SCANNED = {
    "mbpp": ("validation", "SELECT item_id FROM benchmark WHERE item_id % 3 = 1"),
    "mbpp_train": ("train", "SELECT item_id FROM benchmark WHERE item_id % 3 = 0"),
    "evalplus/mbppplus": ("test", "SELECT item_id FROM benchmark"),
    "bigcode/humanevalpack": ("test", "SELECT item_id FROM benchmark"),
    "evalplus/humanevalplus": ("test", "SELECT item_id FROM benchmark"),
    "deepmind/code_contests": ("test", "SELECT item_id FROM benchmark WHERE item_id % 3 = 2"),
}


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS dataset, item_id AS data_id, '{split}' AS split FROM ({rows}) x{i}"
        for i, (name, (split, rows)) in enumerate(SCANNED.items())
    )
)
def scan_all_problems(spark, sf):
    def part(dataset, split):
        folder = new_folder(spark, "problems")
        t.problems(spark, sf, dataset).write.partitionBy("split").parquet(folder)
        rows = R.scan_problems(spark, folder, dataset, split)
        return rows.select(F.lit(dataset).alias("dataset"), "data_id", "split")

    return reduce(DataFrame.unionByName, [part(name, split) for name, (split, _) in SCANNED.items()])


@query(
    t.sql(
        f"""SELECT data_id, {D("prompt")} AS prompt, {D("completion")} AS completion, label,
  len(feedbacks)::INT AS turns FROM traj""",
        "traj",
    )
)
def scan_rollouts(spark, sf):
    folder = new_folder(spark, "rollouts")
    t.trajectories(spark, sf).select(*S.ROLLOUTS.names).write.parquet(folder)
    rows = R.scan_rollouts(spark, folder).withColumn("turns", F.size("feedbacks"))
    return _digests(rows.drop("feedbacks"), "prompt", "completion")


SCORED = f"""SELECT ID, data_id, {D("prompt")} AS prompt, {D("completion")} AS completion, label,
  round(reward, 6) AS reward FROM traj"""
SCORED_COLUMNS = ("ID", "data_id", "prompt", "completion", "label", "reward")


def _restored(df):
    rows = _digests(df.select(*SCORED_COLUMNS), "prompt", "completion")
    return rows.withColumn("reward", F.round("reward", 6))


@query(t.sql(SCORED, "traj"))
def scan_scored_csv(spark, sf):
    folder = new_folder(spark, "foreign")
    rows = t.trajectories(spark, sf).select(*SCORED_COLUMNS)
    cells = rows.withColumns({c: W.literal_cell(F.col(c)) for c in ("prompt", "completion")})
    labels = cells.withColumn("label", F.col("label").cast("double"))
    labels.write.option("header", True).option("escape", '"').csv(folder)
    schema = T.StructType([f for f in S.SCORED.fields if f.name in SCORED_COLUMNS])
    return _restored(R.scan_scored_csv(spark, folder, schema))


@query(t.sql(SCORED, "traj"))
def write_scored_csv(spark, sf):
    folder = new_folder(spark, "scored")
    W.write_scored_csv(t.trajectories(spark, sf).select(*SCORED_COLUMNS), folder)
    schema = T.StructType([f for f in S.SCORED.fields if f.name in SCORED_COLUMNS])
    return _restored(R.scan_scored_csv(spark, folder, schema, cells="json", multi_line=False))


@query(
    t.sql(
        """SELECT run, data_id, count(*) AS n, count(*) FILTER (label) AS c FROM (
  SELECT 'one' AS run, data_id, label FROM rollouts_ev WHERE k < 50
  UNION ALL SELECT 'one', data_id, label FROM rollouts_ev WHERE k >= 50
  UNION ALL SELECT 'two', data_id, label FROM rollouts_ev) u GROUP BY 1, 2""",
        "rollouts_ev",
    )
)
def append_rollouts(spark, sf):
    folder = new_folder(spark, "log")
    rows = t.rollouts_ev(spark, sf).select("ID", "data_id", "label", "k")
    W.append_rollouts(rows.where("k < 50"), folder, "one")
    W.append_rollouts(rows.where("k >= 50"), folder, "one")
    W.append_rollouts(rows, folder, "two")
    stored = spark.read.schema("data_id bigint, label boolean, run string").parquet(folder)
    return stored.groupBy("run", "data_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("label").alias("c")
    )


@query(t.sql("SELECT ID, reward, reward + 1 AS changed FROM rollouts_ev", "rollouts_ev"))
def write_once(spark, sf):
    rows = t.rollouts_ev(spark, sf).select("ID", "reward")
    kept, changed = new_folder(spark, "once"), new_folder(spark, "once")
    W.write_once(rows, kept)
    # The same rows in another order are the same table; others replace it only on request.
    kept = W.write_once(rows.repartition(3), kept)
    other = rows.withColumn("reward", F.col("reward") + 1)
    W.write_once(rows, changed, tag="one")
    changed = W.write_once(other, changed, tag="two", rewrite=True)
    return kept.join(changed.withColumnRenamed("reward", "changed"), "ID")


@query(
    t.sql(
        """SELECT ID, md5(to_json(prompt)) AS prompt, md5(to_json(completion)) AS completion,
  md5(to_json(feedbacks)) AS feedbacks FROM traj""",
        "traj",
    )
)
def stringify_nested(spark, sf):
    rows = W.stringify_nested(t.trajectories(spark, sf))
    return rows.select("ID", *[F.md5(c).alias(c) for c in ("prompt", "completion", "feedbacks")])


LINES = f""", c AS ({COUNTS}), ks AS (SELECT unnest(range(1, max(n) + 1)) AS k FROM c),
v AS (SELECT k, round(avg({PASS}), 3) AS v FROM c JOIN ks ON k <= n GROUP BY k)
SELECT 'events' AS run, 'pass_at_k' AS metric, 'Pass @ '||k||': '||v AS line FROM v"""


def _pass_rows(spark, sf):
    curve = M.pass_at_k_curve(t.rollouts_ev(spark, sf))
    return curve.select(
        F.lit("events").alias("run"),
        F.lit("pass_at_k").alias("metric"),
        F.col("k").alias("x"),
        F.round("pass_at_k", 3).alias("value"),
    )


@query(t.sql(LINES, "rollouts_ev"))
def write_metric_lines(spark, sf):
    folder = new_folder(spark, "lines")
    W.write_metric_lines(_pass_rows(spark, sf), folder)
    return W.read_metric_lines(spark, folder).select("run", "metric", "line")


@query(
    t.sql(
        f""", c AS (SELECT 0 AS it, 'events' AS d, * FROM ({COUNTS})
  UNION ALL SELECT 1, 'events', data_id, count(*), count(*) FILTER (label OR k >= 50) FROM rollouts_ev GROUP BY data_id),
v AS (SELECT it, d, sz AS x, round(avg(CASE WHEN c = 0 THEN 0.0 WHEN n - c < least(sz, n) THEN 1.0 ELSE 1 -
  exp(lgamma(n-c+1) - lgamma(n-c-least(sz, n)+1) - lgamma(n+1) + lgamma(n-least(sz, n)+1)) END), 6) AS v
  FROM c, (VALUES (1),(2),(4),(8)) s(sz) GROUP BY ALL)
SELECT d AS dataset, 'test' AS split, 'best_of_n_oracle' AS metric, x,
  max(v) FILTER (it = 0) AS iter0, max(v) FILTER (it = 1) AS iter1 FROM v GROUP BY ALL""",
        "rollouts_ev",
    )
)
def summarize_runs(spark, sf):
    rows = t.rollouts_ev(spark, sf)
    later = rows.withColumn("label", F.col("label") | (F.col("k") >= 50))

    def metric(df):
        curve = M.best_of_n_oracle(df, (1, 2, 4, 8))
        return curve.select(
            F.lit("best_of_n_oracle").alias("metric"),
            F.col("n").alias("x"),
            F.round("solve_rate", 6).alias("value"),
        )

    return G.summarize_runs({(0, "events", "test"): metric(rows), (1, "events", "test"): metric(later)})


# --- streaming -----------------------------------------------------------------

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def _stream(spark, sf):
    events = N.rollout_stream(spark, sf, EVENTS, "events.parquet")
    return events.select(
        F.col("event_id").alias("ID"),
        F.col("user_id").alias("data_id"),
        (F.col("value") - 35.0).alias("reward"),
        F.col("event_type").isin("purchase", "signup").alias("label"),
    )


@query(t.sql("SELECT ID, data_id, reward, label FROM rollouts_ev", "rollouts_ev"))
def ingest_rollouts(spark, sf):
    table = new_folder(spark, "ingested")
    # The second run has a checkpoint of its own: every row arrives again and is dropped.
    for attempt in ("first", "again"):
        stream = _stream(spark, sf)
        N.ingest_rollouts(stream, table, new_folder(spark, "state"), ["ID"], attempt)
    return N.ingested(spark, table, stream.schema).select("ID", "data_id", "reward", "label")


@query(t.sql(COUNTS, "rollouts_ev"))
def running_pass_rate(spark, sf):
    table = new_folder(spark, "running")
    state = new_folder(spark, "state")
    # Every row arrives twice, and counts once.
    stream = _stream(spark, sf)
    N.running_pass_rate(stream.unionByName(_stream(spark, sf)), N.batch_folder_sink(table), state, ["ID"])
    return N.latest_counts(spark, table)
