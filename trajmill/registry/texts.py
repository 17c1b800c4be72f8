"""Text and array functions, over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajmill.functions import code as K
from trajmill.functions import feedback as B
from trajmill.functions import messages as X
from trajmill.learning.verifiers import verifier_text
from trajmill.operators import grading as G
from trajmill.operators import metrics as M
from trajmill.operators.skew import skew_join, spread_rows
from trajmill.registry import query
from trajmill.registry import tables as t
from trajmill.sources.manifest import latest_checkpoint as latest

WS = t.space_sql()
BLOCKS = (
    "list_transform(regexp_extract_all(completion[1].content, '(?s)```python'||chr(10)||'(.*?)```', 1), "
    f"lambda b: trim(b, {WS}))"
)


def _answer():
    return F.get("completion", F.lit(0))["content"]


@query(
    t.sql(
        f"SELECT ID, len(b)::INT AS n, md5(array_to_string(b, '|')) AS blocks FROM (SELECT ID, {BLOCKS} AS b FROM traj)",
        "traj",
    )
)
def extract_code_blocks(spark, sf):
    blocks = t.trajectories(spark, sf).select("ID", K.code_blocks(_answer()).alias("b"))
    return blocks.select(
        "ID", F.size("b").alias("n"), F.md5(F.array_join("b", "|")).alias("blocks")
    )


@query(
    t.sql(
        f"""SELECT ID, md5(CASE WHEN len(b) > 0 THEN b[1] WHEN fence > 0 THEN '' ELSE c END) AS code,
  md5(CASE WHEN len(b) > 0 THEN b[1] WHEN fence > 0 THEN trim(substr(c, fence + 10), {WS}) ELSE c END) AS code_rest
FROM (SELECT ID, {BLOCKS} AS b, completion[1].content AS c,
  instr(completion[1].content, '```python'||chr(10)) AS fence FROM traj)""",
        "traj",
    )
)
def first_code_or_text(spark, sf):
    return t.trajectories(spark, sf).select(
        "ID",
        F.md5(K.first_code_or_text(_answer())).alias("code"),
        F.md5(K.first_code_or_text(_answer(), "rest")).alias("code_rest"),
    )


@query(
    t.sql(
        f"SELECT ID, md5(coalesce({BLOCKS}[1], completion[1].content)) AS code FROM traj", "traj"
    )
)
def format_solution(spark, sf):
    return t.trajectories(spark, sf).select("ID", F.md5(K.format_solution(_answer())).alias("code"))


def _runs_sql(starts: str) -> str:
    return f""", m AS (SELECT ID, i, conversation[i].role AS role, conversation[i].content AS content
  FROM (SELECT ID, conversation, unnest(range(1, len(conversation)::BIGINT + 1)) AS i FROM convs)),
l AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY ID ORDER BY i) <> role, true) OR ({starts}) AS fresh FROM m),
g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY ID ORDER BY i) AS run FROM l),
j AS (SELECT ID, run, any_value(role) AS role, string_agg(content, chr(10) ORDER BY i) AS content FROM g GROUP BY 1, 2)
SELECT ID, count(*)::INT AS n, md5(string_agg(role||':'||content, chr(10) ORDER BY run)) AS messages
FROM j GROUP BY ID"""


def _doubled(spark, sf, keep_first):
    # Neighbouring messages of one role come from the synthetic opening message.
    rows = t.trajectories(spark, sf).select("ID", F.concat("prompt", "completion").alias("m"))
    merged = rows.select("ID", X.combine_roles(F.col("m"), keep_first).alias("m"))
    return merged.select("ID", F.size("m").alias("n"), t.digest("m").alias("messages"))


DOUBLED = """, convs AS (SELECT ID, list_concat(prompt, completion) AS conversation FROM traj)"""


@query(t.sql(DOUBLED + _runs_sql("false"), "traj"))
def combine_roles(spark, sf):
    return _doubled(spark, sf, False)


@query(t.sql(DOUBLED + _runs_sql("i = 2"), "traj"))
def combine_roles_keep_first(spark, sf):
    return _doubled(spark, sf, True)


@query(
    """WITH d AS (SELECT doc_id AS ID, text AS a, max(text) OVER (PARTITION BY lang) AS b FROM documents),
n AS (SELECT ID, a, b, coalesce(list_position(list_transform(list_zip(string_split(a, ''), string_split(b, '')),
  lambda z: z[1] IS NOT DISTINCT FROM z[2]), false) - 1, length(a))::INT AS n FROM d)
SELECT ID, n, md5(left(a, n)) AS shared, md5(substr(a, n + 1)) AS suffix FROM n"""
)
def shared_prefix(spark, sf):
    rows = _against_last(spark, sf)
    n = X.shared_prefix_length(F.col("a"), F.col("b"))
    return rows.withColumn("n", n).select(
        "ID",
        "n",
        F.md5(F.left("a", F.col("n"))).alias("shared"),
        F.md5(X.response_suffix(F.col("a"), F.col("n"))).alias("suffix"),
    )


def _against_last(spark, sf):
    """Every document next to the last text of its language."""
    docs = spread_rows(t.table(spark, sf, "documents"), "doc_id").select(
        "lang", F.col("doc_id").alias("ID"), F.col("text").alias("a")
    )
    last = docs.groupBy("lang").agg(F.max("a").alias("b"))
    return skew_join(docs, last, ["lang"], ["ID"])


@query(
    """SELECT doc_id AS ID, md5(replace(text, 'the', '')) AS clean, md5(substr(replace(text, 'the', ''), 9)) AS suffix
FROM documents"""
)
def response_suffix(spark, sf):
    text = F.col("text")
    return t.table(spark, sf, "documents").select(
        F.col("doc_id").alias("ID"),
        F.md5(X.response_suffix(text, F.lit(0), "the")).alias("clean"),
        F.md5(X.response_suffix(text, F.lit(8), "the")).alias("suffix"),
    )


PAIR = """, p AS (SELECT a.ID, a.text AS x, b.text AS y, a.reward AS rx, b.reward AS ry FROM
  (SELECT ID, data_id, reward, array_to_string(list_transform(list_concat(prompt[1:1], completion),
     lambda m: m.role||':'||m.content), chr(10)) AS text FROM traj) a
  JOIN (SELECT data_id, max(ID) AS ID FROM traj GROUP BY 1) z USING (data_id)
  JOIN (SELECT ID, reward, array_to_string(list_transform(list_concat(prompt[1:1], completion),
     lambda m: m.role||':'||m.content), chr(10)) AS text FROM traj) b ON b.ID = z.ID),
n AS (SELECT *, coalesce(list_position(list_transform(list_zip(string_split(x, ''), string_split(y, '')),
  lambda c: c[1] IS NOT DISTINCT FROM c[2]), false) - 1, length(x))::INT AS n FROM p)
SELECT ID, md5(left(x, n)) AS shared_text, md5(substr(x, n + 1)) AS chosen_response,
  md5(substr(y, n + 1)) AS rejected_response, round(rx, 4) AS chosen_reward,
  round(ry, 4) AS rejected_reward, rx > ry AS correct FROM n"""


@query(t.sql(PAIR, "traj"))
def pair_report(spark, sf):
    rows = t.trajectories(spark, sf).select(
        "ID", "data_id", "reward", verifier_text(F.col("prompt"), F.col("completion")).alias("text")
    )
    last = rows.groupBy("data_id").agg(F.max("ID").alias("ID"))
    other = rows.select("ID", F.col("text").alias("rejected_text"), F.col("reward").alias("rejected_reward"))
    chosen = rows.withColumnsRenamed({"text": "chosen_text", "reward": "chosen_reward"})
    pairs = skew_join(chosen, last.join(other, "ID").drop("ID"), ["data_id"], ["ID"])
    texts = ("shared_text", "chosen_response", "rejected_response")
    return M.pair_report(pairs).withColumns({c: F.md5(c) for c in texts})


# --- feedback ------------------------------------------------------------------


@query(
    t.sql(
        f"""SELECT ID, CASE WHEN k % 7 = 0 THEN '' WHEN k >= 50 THEN '{t.SUCCESS}' ELSE private END AS feedback
FROM rollouts_ev""",
        "rollouts_ev",
    )
)
def feedback_from_run(spark, sf):
    rows = t.rollouts_ev(spark, sf)
    tests = F.when(F.col("k") % 7 == 0, F.when(F.col("k") % 2 == 0, "")).otherwise("assert True")
    sentinel = F.concat(F.lit("done "), "ID")
    stdout = F.when(F.col("k") >= 50, F.concat(F.lit("noise "), "ID", F.lit("\n"), sentinel)).otherwise("done")
    return rows.select(
        "ID", B.feedback_from_run(tests, stdout, F.col("private"), sentinel).alias("feedback")
    )


@query(
    t.sql(
        "SELECT ID, '[Error] '||public||CASE WHEN private = '' THEN '' ELSE ': '||private END AS error FROM rollouts_ev",
        "rollouts_ev",
    )
)
def error_feedback(spark, sf):
    error = B.error_feedback(F.col("public"), F.col("private"))
    return t.rollouts_ev(spark, sf).select("ID", error.alias("error"))


@query(
    t.sql(
        """SELECT data_id, round(CASE WHEN limited THEN seconds + 0.5::DOUBLE ELSE 1.0 END, 6) AS seconds,
  round(CASE WHEN limited THEN seconds + 0.5::DOUBLE ELSE 1.0 END * (len(pub_in) + 1), 6) AS budget FROM contests""",
        "contests",
    )
)
def time_limit_seconds(spark, sf):
    limit = F.col("time_limit")
    return t.problems(spark, sf, "deepmind/code_contests").select(
        "data_id",
        F.round(B.time_limit_seconds(limit), 6).alias("seconds"),
        F.round(B.time_budget(limit, F.col("public_tests")), 6).alias("budget"),
    )


@query(t.sql(f"SELECT ID, public = '{t.SUCCESS}' AS passed FROM rollouts_ev", "rollouts_ev"))
def public_passed(spark, sf):
    rows = t.rollouts_ev(spark, sf).withColumn("feedbacks", t.feedback_column())
    return rows.select("ID", B.public_passed(F.col("feedbacks")).alias("passed"))


@query(
    t.sql(
        f"""SELECT ID, success, success::INT AS reward FROM (SELECT ID,
  coalesce(feedbacks[-1].public = '{t.SUCCESS}' AND feedbacks[-1].private IN ('{t.SUCCESS}', ''), false) AS success FROM traj)""",
        "traj",
    )
)
def rollout_outcome(spark, sf):
    return G.rollout_outcome(t.trajectories(spark, sf)).select("ID", "success", "reward")


@query(
    t.sql(
        f"""SELECT ID, success, success::INT AS reward FROM (SELECT ID,
  public = '{t.SUCCESS}' AND private IN ('{t.SUCCESS}', '') AS success FROM rollouts_ev)""",
        "rollouts_ev",
    )
)
def outcome_from_parts(spark, sf):
    return G.outcome_from_parts(t.rollouts_ev(spark, sf)).select("ID", "success", "reward")


GRADED = f""", o AS (SELECT ID, data_id, vis, test, data_id % 10 + test AS good,
   ID + test * 3 + length(vis) AS mix FROM rollouts_ev,
   (VALUES ('public', 0), ('public', 1), ('private', 0), ('private', 1), ('private', 2)) v(vis, test)),
e AS (SELECT *, CASE WHEN mix % 13 = 0 THEN '[Error] TimeoutError: Code execution timed out'
   WHEN mix % 11 = 0 THEN '[Error] AssertionError: Expected output='||good||' for input='||data_id||'-'||test
     ||', but got actual_output='||(good + 1) END AS err FROM o)
SELECT ID, data_id, coalesce(arg_min(err, test) FILTER (vis = 'public' AND err IS NOT NULL), '{t.SUCCESS}') AS public,
  coalesce(arg_min(err, test) FILTER (vis = 'private' AND err IS NOT NULL), '{t.SUCCESS}') AS private
FROM e GROUP BY 1, 2"""


@query(t.sql(GRADED, "rollouts_ev"))
def grade_outputs(spark, sf):
    return G.grade_outputs(
        t.rollouts_ev(spark, sf), t.graded_problems(spark, sf), t.recorded_outputs(spark, sf)
    )


@query(
    t.sql(
        """SELECT data_id, max(CASE WHEN label THEN ID END) AS last_id,
  'checkpoint-'||max(CASE WHEN label THEN ID END) AS name FROM rollouts_ev GROUP BY 1""",
        "rollouts_ev",
    )
)
def latest_checkpoint(spark, sf):
    kinds = F.when(F.col("label"), F.concat(F.lit("checkpoint-"), "ID")).otherwise(
        F.concat(F.lit("merged_checkpoint-"), "ID")
    )
    files = t.rollouts_ev(spark, sf).select("data_id", kinds.alias("name"))
    return latest(files, ["data_id"]).select("data_id", F.col("step").alias("last_id"), "name")
