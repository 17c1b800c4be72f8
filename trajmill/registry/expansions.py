"""Conversations: building rollouts, continuing them, expanding them into rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajmill.operators import conversations as V
from trajmill.operators.skew import number_by_id
from trajmill.plans import stages
from trajmill.registry import query
from trajmill.registry import tables as t

D = t.digest_sql


def _flat(df, *extra):
    return df.select(
        "ID",
        *extra,
        F.size("prompt").alias("n_prompt"),
        t.digest("prompt").alias("prompt"),
        t.digest("completion").alias("completion"),
        "label",
    )


def _flat_sql(source: str, prompt: str, completion: str, label: str, extra: str = "") -> str:
    return (
        f"SELECT ID, {extra} len({prompt})::INT AS n_prompt, {D(prompt)} AS prompt, "
        f"{D(completion)} AS completion, {label} AS label FROM {source}"
    )


ORIGINAL = _flat_sql("traj", "prompt", "completion", "label")


@query(
    t.sql(
        f"""SELECT ID, ok, CASE WHEN ok THEN {D("conversation[1:len(conversation)-2]")} ELSE '' END AS prompt,
  CASE WHEN ok THEN {D("[conversation[len(conversation)-1]]")} ELSE '' END AS completion
FROM (SELECT *, len(conversation) >= 2 AND coalesce(conversation[len(conversation)-1].role = 'assistant', false) AS ok
      FROM convs)""",
        "convs",
    )
)
def build_rollout_rows(spark, sf):
    rows, rejects = V.build_rollout_rows(t.conversations(spark, sf))
    good = rows.select(
        "ID",
        F.lit(True).alias("ok"),
        t.digest("prompt").alias("prompt"),
        t.digest("completion").alias("completion"),
    )
    none = F.lit("")
    return good.unionByName(
        rejects.select("ID", F.lit(False).alias("ok"), none.alias("prompt"), none.alias("completion"))
    )


@query(
    t.sql(
        f"""SELECT ID, {D("messages")} AS messages, len(messages)::INT AS n FROM (
  SELECT ID, list_concat(list_concat(prompt, completion),
    [{{'role': 'user', 'content': 'Feedback: '||coalesce(feedbacks[-1].public, '')}}]) AS messages FROM traj)""",
        "traj",
    )
)
def continue_conversations(spark, sf):
    rows = V.continue_conversations(t.trajectories(spark, sf))
    return rows.select("ID", t.digest("messages").alias("messages"), F.size("messages").alias("n"))


# Four events of one user in a row are the turns of one rollout.
TURN_LOG = """, log AS (SELECT data_id||'-'||(o // 4)::BIGINT AS rollout_id, data_id, (o % 4)::INT AS step,
  'code '||ID AS action, public, private, label AS success
  FROM (SELECT *, row_number() OVER (PARTITION BY data_id ORDER BY ID) - 1 AS o FROM rollouts_ev)),
cut AS (SELECT *, min(step) FILTER (success) OVER (PARTITION BY rollout_id) AS won FROM log WHERE step < 3),
kept AS (SELECT * FROM cut WHERE won IS NULL OR step <= won)
SELECT rollout_id, max(data_id) AS data_id,
  md5('user:problem '||max(data_id)||chr(10)||string_agg('assistant:'||action||chr(10)||'user:Feedback: '||public,
    chr(10) ORDER BY step)) AS conversation,
  (1 + 2 * count(*))::INT AS n, md5(string_agg(public||'|'||private, ',' ORDER BY step)) AS feedbacks,
  arg_max(success, step) AS label FROM kept GROUP BY 1"""


@query(t.sql(TURN_LOG, "rollouts_ev"))
def assemble_conversations(spark, sf):
    events = number_by_id(t.rollouts_ev(spark, sf), ["data_id"], "ID", "o")
    log = events.select(
        F.concat_ws("-", "data_id", F.floor(F.col("o") / 4)).alias("rollout_id"),
        "data_id",
        (F.col("o") % 4).cast("int").alias("step"),
        F.concat(F.lit("code "), "ID").alias("action"),
        "public",
        "private",
        F.col("label").alias("success"),
    )
    first = log.select(
        "rollout_id", "data_id", F.concat(F.lit("problem "), "data_id").alias("prompt")
    ).distinct()
    rows = V.assemble_conversations(log.drop("data_id"), first, max_steps=3)
    told = F.transform("feedbacks", lambda f: F.concat(f["public"], F.lit("|"), f["private"]))
    return rows.select(
        "rollout_id",
        "data_id",
        t.digest("conversation").alias("conversation"),
        F.size("conversation").alias("n"),
        F.md5(F.array_join(told, ",")).alias("feedbacks"),
        "label",
    )


@query(t.sql(_flat_sql("traj", "prompt", "completion", "label") + " WHERE label", "traj"))
def filter_positive(spark, sf):
    return _flat(V.filter_positive(t.trajectories(spark, sf)))


@query(
    t.sql(
        _flat_sql("turns", "prompt[1:i]", "[prompt[i + 1]]", "false") + " UNION ALL " + ORIGINAL,
        "turns",
        "traj",
    )
)
def expand_intermediate(spark, sf):
    return _flat(V.expand_intermediate(t.trajectories(spark, sf)))


@query(
    t.sql(
        _flat_sql("turns", "prompt[1:i]", "completion", "label") + " UNION ALL " + ORIGINAL,
        "turns",
        "traj",
    )
)
def expand_relabeled(spark, sf):
    return _flat(V.expand_relabeled(t.trajectories(spark, sf)))


@query(
    t.sql(
        _flat_sql("turns", "prompt[1:i]", "completion", "label")
        + f" WHERE label UNION ALL {ORIGINAL} WHERE label",
        "turns",
        "traj",
    )
)
def expand_positive(spark, sf):
    return _flat(V.expand_positive(t.trajectories(spark, sf)))


@query(
    t.sql(
        _flat_sql("turns", "prompt[1:1]", "[prompt[i + 1]]", "false")
        + " UNION ALL "
        + _flat_sql("traj", "prompt[1:1]", "completion", "label"),
        "turns",
        "traj",
    )
)
def flatten_to_first_prompt(spark, sf):
    return _flat(V.flatten_to_first_prompt(t.trajectories(spark, sf)))


@query(
    t.sql(
        f""", u AS (SELECT *, unnest(range(0, len(conversation)::BIGINT)) AS i FROM convs)
SELECT ID, i::INT AS n_prompt, {D("conversation[1:i]")} AS prompt,
  {D("[conversation[i + 1]]")} AS completion, ID % 2 = 0 AS label
FROM u WHERE conversation[i + 1].role = 'assistant'""",
        "convs",
    )
)
def turn_rows(spark, sf):
    convs = t.conversations(spark, sf).withColumn("label", F.col("ID") % 2 == 0)
    return _flat(V.turn_rows(convs))


@query(
    t.sql(
        f"""SELECT ID, md5(array_to_string(list_transform(list_concat(prompt, [{{'role': 'assistant',
   'content': '<|response|> '||completion[1].content}}]),
   lambda m: '<|'||m.role||'|>'||chr(10)||m.content||chr(10)), '')) AS text FROM traj""",
        "traj",
    )
)
def render_sft_text(spark, sf):
    return V.render_sft_text(t.trajectories(spark, sf)).select("ID", F.md5("text").alias("text"))


BLOCK = (
    "regexp_extract_all(completion[1].content, '(?s)```python'||chr(10)||'(.*?)```', 1)"
)


@query(
    t.sql(
        f"""SELECT ID, md5(coalesce(trim({BLOCK}[1], {t.space_sql()}), '')) AS code FROM traj""",
        "traj",
    )
)
def parse_completions(spark, sf):
    rows = V.parse_completions(t.trajectories(spark, sf))
    return rows.select("ID", F.md5(F.get("completion", F.lit(0))["content"]).alias("code"))


# --- whole stages ------------------------------------------------------------

REJECTION = (
    f"SELECT data_id, {D('prompt[1:i]')} AS prompt, {D('completion')} AS completion, label "
    "FROM turns WHERE label UNION ALL "
    f"SELECT data_id, {D('prompt')}, {D('completion')}, label FROM traj WHERE label"
)


@query(
    t.sql(
        f"""SELECT data_id, {D('prompt')} AS prompt, {D('completion')} AS completion, label FROM traj
UNION ALL {REJECTION}""",
        "turns",
        "traj",
    )
)
def rejection_training_set(spark, sf):
    rollouts = t.trajectories(spark, sf)
    base = rollouts.select("data_id", "prompt", "completion", "label")
    rows = stages.rejection_training_set(rollouts, base)
    return rows.select(
        "data_id", t.digest("prompt").alias("prompt"), t.digest("completion").alias("completion"), "label"
    )
