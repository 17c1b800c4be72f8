"""Ranking, relabelling, sampling, merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajmill.operators import caller_code as U
from trajmill.operators import merge as G
from trajmill.operators import sampling as P
from trajmill.operators import selection as E
from trajmill.plans import stages
from trajmill.registry import query
from trajmill.registry import tables as t
from trajmill.session import new_folder

D = t.digest_sql
OK = f"(public = '{t.SUCCESS}')::INT"

SCORES = {
    "reward": "reward",
    "ground_truth": "label::INT",
    "public_truth": OK,
    "public_and_reward_truth": f"reward + 100 * {OK}",
}


def _scored(spark, sf):
    return t.rollouts_ev(spark, sf).withColumn("feedbacks", t.feedback_column())


@query(
    t.sql(
        f"""SELECT ID, round(reward + 100 * label::INT, 6) AS reward_and_label,
  label::INT::DOUBLE AS ground_truth, {OK}::DOUBLE AS public_truth,
  round(reward + 100 * {OK}, 6) AS public_and_reward_truth FROM rollouts_ev""",
        "rollouts_ev",
    )
)
def score_bonus(spark, sf):
    rows = _scored(spark, sf)
    modes = ("reward_and_label", "ground_truth", "public_truth", "public_and_reward_truth")
    for mode in modes:
        rows = E.score_bonus(rows, mode, mode)
    return rows.select("ID", *[F.round(m, 6).alias(m) for m in modes])


@query(
    t.sql(
        "\nUNION ALL ".join(
            f"""SELECT '{m}' AS mode, data_id, ID FROM (SELECT data_id, ID FROM rollouts_ev
  QUALIFY row_number() OVER (PARTITION BY data_id ORDER BY {s} DESC, ID) <= 3) x"""
            for m, s in SCORES.items()
        ),
        "rollouts_ev",
    )
)
def select_topk(spark, sf):
    rows = _scored(spark, sf)
    return G.union_runs(
        *[
            E.select_topk(rows, 3, mode).select(F.lit(mode).alias("mode"), "data_id", "ID")
            for mode in SCORES
        ]
    )


DEALT = """, d AS (SELECT *, (row_number() OVER (PARTITION BY data_id ORDER BY ID) - 1) % 5 AS experiment_group
  FROM rollouts_ev)"""
PER = "PARTITION BY data_id, experiment_group ORDER BY"


@query(t.sql(f"{DEALT}\nSELECT data_id, ID, experiment_group FROM d", "rollouts_ev"))
def assign_searches(spark, sf):
    return E.assign_searches(_scored(spark, sf), 5).select("data_id", "ID", "experiment_group")


@query(
    t.sql(
        f"""{DEALT}
SELECT data_id, experiment_group, ID FROM d
QUALIFY row_number() OVER ({PER} reward + 100 * {OK} DESC, ID) <= 2""",
        "rollouts_ev",
    )
)
def select_topk_per_search(spark, sf):
    rows = E.select_topk_per_search(_scored(spark, sf), 2, 5, "public_and_reward_truth")
    return rows.select("data_id", "experiment_group", "ID")


@query(
    t.sql(
        f"""{DEALT}
SELECT data_id, experiment_group, ID, row_number() OVER ({PER} reward DESC, ID) AS rank FROM d""",
        "rollouts_ev",
    )
)
def select_all_ranked(spark, sf):
    rows = E.select_all_ranked(_scored(spark, sf), 5)
    return rows.select("data_id", "experiment_group", "ID", "rank")


@query(
    t.sql(
        f"""{DEALT}
SELECT data_id, experiment_group, ID FROM d
QUALIFY row_number() OVER ({PER} {t.h("7", "ID")}, ID) <= 2""",
        "rollouts_ev",
    )
)
def select_random_k(spark, sf):
    rows = E.select_random_k(_scored(spark, sf), 2, 5, seed=7)
    return rows.select("data_id", "experiment_group", "ID")


TOPK = """SELECT data_id, completion FROM traj
  QUALIFY row_number() OVER (PARTITION BY data_id ORDER BY reward + 100 * label::INT DESC, ID) <= %d"""
CANDIDATES = """SELECT ID, data_id, prompt, label, reward FROM traj
  QUALIFY row_number() OVER (PARTITION BY data_id ORDER BY label::INT, reward DESC, ID) <= %d"""


@query(t.sql(f""", k AS ({TOPK % 2}) SELECT data_id, {D("completion")} AS completion FROM k""", "traj"))
def topk_completions(spark, sf):
    rows = E.topk_completions(t.trajectories(spark, sf), 2)
    return rows.select("data_id", t.digest("completion").alias("completion"))


@query(t.sql(f""", k AS ({CANDIDATES % 3}) SELECT data_id, ID, label FROM k""", "traj"))
def relabel_candidates(spark, sf):
    return E.relabel_candidates(t.trajectories(spark, sf), 3).select("data_id", "ID", "label")


@query(
    t.sql(
        f""", k AS ({TOPK % 2})
SELECT r.ID, r.label, {D("k.completion")} AS completion FROM traj r LEFT JOIN k USING (data_id)""",
        "traj",
    )
)
def relabel_join(spark, sf):
    rows = t.trajectories(spark, sf)
    joined = E.relabel_join(rows.drop("completion"), E.topk_completions(rows, 2))
    return joined.select("ID", "label", t.digest("completion").alias("completion"))


RELABELLED = f""", k AS ({TOPK % 2}), c AS ({CANDIDATES % 3}),
j AS (SELECT c.data_id, c.prompt, k.completion, c.label FROM c LEFT JOIN k USING (data_id))"""
OUT = f"data_id, {D('prompt')} AS prompt, {D('completion')} AS completion, label"


def _training(df, *extra):
    return df.select(
        "data_id",
        t.digest("prompt").alias("prompt"),
        t.digest("completion").alias("completion"),
        "label",
        *extra,
    )


@query(t.sql(f"{RELABELLED}\nSELECT {OUT}, true AS relabelled FROM j", "traj"))
def build_relabelled_set(spark, sf):
    return _training(E.build_relabelled_set(t.trajectories(spark, sf), 2, 3), "relabelled")


@query(
    t.sql(
        f"""{RELABELLED}
SELECT {OUT}, true AS relabelled FROM j WHERE NOT label
UNION ALL SELECT {OUT}, false FROM traj WHERE label""",
        "traj",
    )
)
def merge_positive_data(spark, sf):
    rows = E.build_relabelled_set(t.trajectories(spark, sf), 2, 3, merge_positives=True)
    return _training(rows, "relabelled")


@query(t.sql(f"SELECT {OUT} FROM traj", "traj"))
def drop_rank_columns(spark, sf):
    return _training(E.drop_rank_columns(t.trajectories(spark, sf)))


@query(
    t.sql(
        f"""{RELABELLED},
m AS (SELECT * FROM j WHERE NOT label UNION ALL SELECT data_id, prompt, completion, label FROM traj WHERE label),
u AS (SELECT *, unnest(range(0, len(prompt)::BIGINT)) AS i FROM m)
SELECT {OUT} FROM traj
UNION ALL SELECT {OUT} FROM m
UNION ALL SELECT data_id, {D("prompt[1:i]")}, {D("completion")}, label FROM u WHERE prompt[i + 1].role = 'assistant'""",
        "traj",
    )
)
def iteration_training_set(spark, sf):
    scored = t.stored_trajectories(spark, sf)
    base = scored.select("data_id", "prompt", "completion", "label")
    return _training(stages.iteration_training_set(scored, base, 2, 3))


@query(
    t.sql(
        "SELECT data_id, ID, reward FROM rollouts_ev ORDER BY data_id, reward DESC, ID",
        "rollouts_ev",
    )
)
def order_rollouts(spark, sf):
    return E.order_rollouts(_scored(spark, sf).select("data_id", "ID", "reward"), "reward")


# --- sampling ---------------------------------------------------------------


@query(
    t.sql(
        """SELECT data_id, count(*) FILTER (label) AS n_pos, count(*) FILTER (NOT label) AS n_neg
FROM doc_rollouts GROUP BY 1 HAVING count(*) FILTER (label) > 0 AND count(*) FILTER (NOT label) > 0""",
        "doc_rollouts",
    )
)
def prompts_with_both(spark, sf):
    return P.prompts_with_both(t.doc_rollouts(spark, sf))


@query(
    t.sql(
        """, s AS (SELECT count(*) FILTER (label) AS p, count(*) FILTER (NOT label) AS n
  FROM doc_rollouts GROUP BY data_id)
SELECT count(*) FILTER (p = 0 OR n = 0) AS no_pairs, count(*) FILTER (p = 0) AS no_pos,
  count(*) FILTER (n = 0) AS no_neg, count(*) AS prompts FROM s""",
        "doc_rollouts",
    )
)
def missing_side_counts(spark, sf):
    return P.missing_side_counts(t.doc_rollouts(spark, sf))


def pair_sql(source: str, key: str = "data_id", samples: int = 32, id_text: str = "ID") -> str:
    """CTEs ``p(key, draw, chosen_ID, rejected_ID)`` over a table with ID and label."""
    least = t.fine_h("'p'", "draw", id_text)
    return f"""p AS (SELECT {key} AS key, draw, arg_min(ID, {least}) FILTER (label) AS chosen_ID,
  arg_min(ID, {least}) FILTER (NOT label) AS rejected_ID
  FROM {source}, (SELECT unnest(range(0, {samples})) AS draw) s GROUP BY 1, 2
  HAVING chosen_ID IS NOT NULL AND rejected_ID IS NOT NULL)"""


@query(
    t.sql(
        f""", {pair_sql("rollouts_ev")}
SELECT key AS data_id, draw, chosen_ID, rejected_ID FROM p""",
        "rollouts_ev",
    )
)
def sample_pair_ids(spark, sf):
    pairs = P.sample_pair_ids(t.rollouts_ev(spark, sf))
    return pairs.select("data_id", "draw", "chosen_ID", "rejected_ID")


@query(
    t.sql(
        f""", {pair_sql("traj")},
f AS (SELECT data_id, arg_min(prompt, ID) AS prompt FROM traj WHERE label GROUP BY 1)
SELECT key AS data_id, draw, {D("f.prompt")} AS prompt, {D("a.completion")} AS chosen,
  {D("b.completion")} AS rejected
FROM p JOIN traj a ON a.ID = chosen_ID JOIN traj b ON b.ID = rejected_ID JOIN f ON f.data_id = key""",
        "traj",
    )
)
def sample_pairs(spark, sf):
    pairs = P.sample_pairs(t.stored_trajectories(spark, sf))
    return pairs.select(
        "data_id", "draw", *[t.digest(c).alias(c) for c in ("prompt", "chosen", "rejected")]
    )


@query(
    t.sql(
        f""", flat AS (SELECT md5('user'||chr(10)||prompt[1].content) AS key, ID * 131072 + i AS ID,
    [prompt[i + 1]] AS completion, false AS label FROM turns
  UNION ALL SELECT md5('user'||chr(10)||prompt[1].content), ID * 131072 + len(prompt), completion, label FROM traj),
{pair_sql("flat", "key", id_text="'{'||(ID // 131072)||', '||(ID % 131072)||'}'")}
SELECT p.key AS prompt_key, draw, {D("a.completion")} AS chosen, {D("b.completion")} AS rejected
FROM p JOIN flat a ON a.ID = chosen_ID JOIN flat b ON b.ID = rejected_ID""",
        "turns",
        "traj",
    )
)
def preference_pairs(spark, sf):
    # The position of a completion in its conversation makes the flattened rows unique.
    rollouts = t.trajectories(spark, sf)
    pairs = stages.preference_pairs(rollouts, new_folder(spark, "flat"))
    return pairs.select(
        "prompt_key", "draw", *[t.digest(c).alias(c) for c in ("chosen", "rejected")]
    )


@query(
    t.sql(
        f""", f AS (SELECT data_id, arg_min(prompt, ID) AS fp FROM traj WHERE label GROUP BY 1),
u AS (SELECT data_id, draw, arg_min(ID, {t.fine_h("'u'", "draw", "ID")}) AS source_ID
  FROM traj, (SELECT unnest(range(0, 100)) AS draw) s WHERE label GROUP BY 1, 2)
SELECT u.data_id, draw, source_ID, {D("f.fp")} AS prompt, {D("traj.completion")} AS completion, true AS label
FROM u JOIN f ON f.data_id = u.data_id JOIN traj ON traj.ID = source_ID""",
        "traj",
    )
)
def upsample_positives(spark, sf):
    rows = P.upsample_positives(t.stored_trajectories(spark, sf), 100)
    return rows.select(
        "data_id", "draw", "source_ID", t.digest("prompt").alias("prompt"),
        t.digest("completion").alias("completion"), "label",
    )


@query(
    t.sql(
        f""", n AS (SELECT count(*) AS n FROM rollouts_ev),
s AS (SELECT {t.h("11", "slot")} % n AS ID FROM n, (SELECT unnest(range(0, 768)) AS slot) x WHERE slot < 768 - n % 768)
SELECT ID, reward, false AS padding FROM rollouts_ev
UNION ALL SELECT ID, reward, true FROM s JOIN rollouts_ev USING (ID)""",
        "rollouts_ev",
    )
)
def pad_to_multiple(spark, sf):
    return P.pad_to_multiple(t.rollouts_ev(spark, sf).select("ID", "reward"), 768, seed=11)


@query(
    t.sql(
        f"SELECT ID, {t.h('3', '1', 'ID')} AS place FROM rollouts_ev ORDER BY place, ID",
        "rollouts_ev",
    )
)
def shuffle_rows(spark, sf):
    rows = t.rollouts_ev(spark, sf).select("ID", P.shuffle_key(3, 1).alias("place"))
    return P.shuffle_rows(rows, seed=3, epoch=1)


@query(t.sql("SELECT ID, data_id, reward FROM rollouts_ev ORDER BY ID LIMIT 100", "rollouts_ev"))
def limit_rows(spark, sf):
    # A report's sample table: the limit is the feature.
    return P.limit_rows(t.rollouts_ev(spark, sf).select("ID", "data_id", "reward"), 100)


@query("SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS ID FROM (SELECT DISTINCT conv_id FROM conversations)")
def add_row_id(spark, sf):
    ids = t.table(spark, sf, "conversations").select("conv_id").distinct()
    return P.add_row_id(ids, "conv_id", "ID")


CANONICAL = """, a AS (SELECT row_number() OVER (ORDER BY ID) - 1 AS ID, prompt, label FROM traj),
z AS (SELECT count(*) - count(DISTINCT prompt[1].content) AS cut FROM a)"""


@query(t.sql(f"{CANONICAL}\nSELECT ID, {D('prompt')} AS prompt FROM a, z WHERE ID < cut", "traj"))
def drop_canonical(spark, sf):
    rows = _dense(spark, sf)
    return P.drop_canonical(rows).select("ID", t.digest("prompt").alias("prompt"))


@query(
    t.sql(
        f"""{CANONICAL}
SELECT count(*) AS canonical, count(*) FILTER (NOT label) AS violations FROM a, z WHERE ID >= cut""",
        "traj",
    )
)
def canonical_violations(spark, sf):
    return P.canonical_violations(_dense(spark, sf))


def _dense(spark, sf):
    rows = t.trajectories(spark, sf).withColumnRenamed("ID", "old")
    return P.add_row_id(rows, "old", "ID")


# --- set operations ----------------------------------------------------------


@query(
    t.sql(
        """SELECT ID::VARCHAR AS ID, data_id::VARCHAR AS data_id, label, reward FROM rollouts_ev
UNION ALL SELECT ID::VARCHAR, data_id, label, round(reward, 6) FROM doc_rollouts""",
        "rollouts_ev",
        "doc_rollouts",
    )
)
def merge_datasets(spark, sf):
    def plain(df):
        return df.withColumns({c: F.col(c).cast("string") for c in ("ID", "data_id")})

    base = plain(t.doc_rollouts(spark, sf)).withColumn("reward", F.round("reward", 6))
    return G.merge_datasets(base, plain(t.rollouts_ev(spark, sf)))


@query(
    t.sql(
        """SELECT 'a' AS run, ID, label FROM rollouts_ev WHERE label
UNION ALL SELECT 'b', ID, label FROM rollouts_ev WHERE NOT label
UNION ALL SELECT 'c', ID, label FROM rollouts_ev""",
        "rollouts_ev",
    )
)
def union_runs(spark, sf):
    rows = t.rollouts_ev(spark, sf).select("ID", "label")
    runs = {"a": rows.where("label"), "b": rows.where("not label"), "c": rows}
    return G.union_runs(*[df.withColumn("run", F.lit(run)) for run, df in runs.items()])


# --- caller code ---------------------------------------------------------------


def _double_reward(batch):
    import pyarrow as pa
    import pyarrow.compute as pc

    doubled = pc.multiply(batch.column("reward"), 2.0)
    return pa.RecordBatch.from_arrays([batch.column("ID"), doubled], ["ID", "reward"])


@query(t.sql("SELECT ID, reward * 2 AS reward FROM rollouts_ev", "rollouts_ev"))
def apply_map(spark, sf):
    rows = t.rollouts_ev(spark, sf).select("ID", "reward")
    return U.apply_map(rows, _double_reward, rows.schema)


def _two_best(rows):
    return rows.sort_values(["reward", "ID"], ascending=[False, True]).head(2)


@query(
    t.sql(
        """SELECT data_id, ID, reward FROM rollouts_ev
QUALIFY row_number() OVER (PARTITION BY data_id ORDER BY reward DESC, ID) <= 2""",
        "rollouts_ev",
    )
)
def apply_group(spark, sf):
    rows = t.rollouts_ev(spark, sf).select("data_id", "ID", "reward")
    return U.apply_group(rows, ["data_id"], _two_best, ["ID"])


def _length_score(batch):
    answers = batch["completion"].str[0].str.get("content")
    return answers.str.len().astype("float64") - batch["prompt"].str.len()


@query(
    t.sql(
        "SELECT ID, (length(completion[1].content) - len(prompt))::DOUBLE AS reward FROM traj",
        "traj",
    )
)
def score_with(spark, sf):
    return U.score_with(t.trajectories(spark, sf), _length_score).select("ID", "reward")
