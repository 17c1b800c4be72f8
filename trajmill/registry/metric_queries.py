"""Metrics over rollouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajmill.operators import metrics as M
from trajmill.operators import search as R
from trajmill.plans import stages
from trajmill.registry import query
from trajmill.registry import tables as t

PASS = (
    "CASE WHEN c = 0 THEN 0.0 WHEN n - c < k THEN 1.0 ELSE "
    "1 - exp(lgamma(n-c+1) - lgamma(n-c-k+1) - lgamma(n+1) + lgamma(n-k+1)) END"
)
COUNTS = "SELECT data_id, count(*) AS n, count(*) FILTER (label) AS c FROM rollouts_ev GROUP BY 1"
SIZES = (
    "(WITH m AS (SELECT max(n) AS m FROM (SELECT count(*) AS n FROM rollouts_ev GROUP BY data_id)) "
    "SELECT (1 << i)::INT AS sz FROM m, range(0, 31) r(i) WHERE (1 << i) < m "
    "UNION SELECT m::INT FROM m) s"
)


def _r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(
    t.sql(
        f""", c AS ({COUNTS}), ks AS (SELECT unnest(range(1, max(n) + 1)) AS k FROM c)
SELECT k::INT AS k, round(avg({PASS}), 6) AS pass_at_k, count(*) AS prompts
FROM c JOIN ks ON k <= n GROUP BY k""",
        "rollouts_ev",
    )
)
def pass_at_k_curve(spark, sf):
    return _r6(M.pass_at_k_curve(t.rollouts_ev(spark, sf)), "pass_at_k")


@query(
    t.sql(
        f""", c AS (SELECT *, 60 AS k FROM ({COUNTS}))
SELECT 60 AS k, round(avg(CASE WHEN n >= k THEN {PASS} END), 6) AS pass_at_k,
  count(*) FILTER (n >= k) AS prompts, count(*) FILTER (n < k) AS skipped FROM c""",
        "rollouts_ev",
    )
)
def pass_at_k(spark, sf):
    return _r6(M.pass_at_k(t.rollouts_ev(spark, sf), 60), "pass_at_k")


@query(
    t.sql(
        f""", a AS (SELECT 'events' AS dataset_label, data_id::VARCHAR AS data_id, label FROM rollouts_ev
  UNION ALL SELECT 'documents', data_id, label FROM doc_rollouts),
c AS (SELECT dataset_label, data_id, count(*) AS n, count(*) FILTER (label) AS c FROM a GROUP BY 1, 2),
ks AS (SELECT unnest(range(1, max(n) + 1)) AS k FROM c)
SELECT dataset_label, k::INT AS k, round(avg({PASS}), 6) AS pass_at_k, count(*) AS prompts
FROM c JOIN ks ON k <= n GROUP BY 1, 2""",
        "rollouts_ev",
        "doc_rollouts",
    )
)
def pass_at_k_overlay(spark, sf):
    runs = {"events": t.rollouts_ev(spark, sf), "documents": t.doc_rollouts(spark, sf)}
    return _r6(M.pass_at_k_overlay(runs), "pass_at_k")


@query(
    t.sql(
        """SELECT md5('user'||chr(10)||'problem '||data_id) AS prompt_key, count(*) AS n,
  count(*) FILTER (label) AS c FROM traj GROUP BY 1""",
        "traj",
    )
)
def prompt_key(spark, sf):
    return M.prompt_counts(M.with_prompt_key(t.trajectories(spark, sf)), "prompt_key")


TOP = """SELECT data_id, label, reward, row_number() OVER
  (PARTITION BY data_id ORDER BY reward DESC, ID) AS rk FROM rollouts_ev"""


def _best_k(column: str, expr: str) -> str:
    return t.sql(
        f""", r AS ({TOP}), ks AS (SELECT unnest([1, 2, 3, 4]) AS k),
p AS (SELECT k, data_id, {expr} AS v FROM r JOIN ks ON rk <= k GROUP BY k, data_id)
SELECT k, round(avg(v), 6) AS {column} FROM p GROUP BY k""",
        "rollouts_ev",
    )


@query(_best_k("accuracy", "sum(label::INT) / k::DOUBLE"))
def best_k_of_n_accuracy(spark, sf):
    return _r6(M.best_k_of_n(t.rollouts_ev(spark, sf)), "accuracy").select("k", "accuracy")


@query(_best_k("precision", "avg(((reward > 0) = label)::INT)"))
def best_k_of_n_precision(spark, sf):
    return _r6(M.best_k_of_n(t.rollouts_ev(spark, sf)), "precision").select("k", "precision")


@query(
    t.sql(
        f""", e AS (SELECT data_id, ID, reward, label, trial,
  row_number() OVER (PARTITION BY data_id, trial ORDER BY {t.h("42", "trial", "ID")}, ID) AS rn
  FROM rollouts_ev, (SELECT unnest(range(0, 25)) AS trial) x),
b AS (SELECT sz AS n, data_id, trial, arg_max(label, (reward, -ID)) AS good
  FROM e JOIN {SIZES} ON rn <= sz GROUP BY ALL)
SELECT n, round(avg(good::INT), 6) AS solve_rate FROM b GROUP BY n""",
        "rollouts_ev",
    )
)
def best_of_n_sampled(spark, sf):
    return _r6(M.best_of_n_sampled(t.rollouts_ev(spark, sf)), "solve_rate")


def _exact(score: str) -> str:
    return t.sql(
        f""", r AS (SELECT data_id, label, count(*) OVER (PARTITION BY data_id) AS n,
  row_number() OVER (PARTITION BY data_id ORDER BY {score}, ID) - 1 AS i FROM rollouts_ev),
w AS (SELECT sz, data_id, label, n, i, least(sz, n) AS m FROM r, {SIZES}),
p AS (SELECT sz, data_id, sum(CASE WHEN NOT label OR n - 1 - i < m - 1 THEN 0.0 ELSE
  exp(lgamma(n-i) - lgamma(m) - lgamma(n-i-m+1) - lgamma(n+1) + lgamma(m+1) + lgamma(n-m+1)) END) AS v
  FROM w GROUP BY 1, 2)
SELECT sz AS n, round(avg(v), 6) AS solve_rate FROM p GROUP BY sz""",
        "rollouts_ev",
    )


@query(_exact("reward DESC"))
def best_of_n_exact(spark, sf):
    return _r6(M.best_of_n_exact(t.rollouts_ev(spark, sf)), "solve_rate")


@query(_exact("label DESC"))
def best_of_n_oracle(spark, sf):
    return _r6(M.best_of_n_oracle(t.rollouts_ev(spark, sf)), "solve_rate")


def _bin(x: str, bins: int) -> str:
    return (
        f"least(floor(({x} - CASE WHEN hi = lo THEN lo - 0.5::DOUBLE ELSE lo END)"
        f" / CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE (hi - lo)::DOUBLE END * {bins}), {bins - 1})::INT"
    )


@query(
    t.sql(
        f""", c AS ({COUNTS}), b AS (SELECT min(c) AS lo, max(c) AS hi FROM c)
SELECT {_bin("c", 10)} AS bin, count(*) AS prompts FROM c, b GROUP BY 1""",
        "rollouts_ev",
    )
)
def label_distribution(spark, sf):
    return M.label_distribution(t.rollouts_ev(spark, sf))


@query(
    t.sql(
        f""", b AS (SELECT label, min(reward) AS lo, max(reward) AS hi FROM rollouts_ev GROUP BY 1)
SELECT label, {_bin("reward", 50)} AS bin, count(*) AS rollouts
FROM rollouts_ev JOIN b USING (label) GROUP BY 1, 2""",
        "rollouts_ev",
    )
)
def reward_distribution(spark, sf):
    return M.reward_distribution(t.rollouts_ev(spark, sf))


@query(
    t.sql(
        "SELECT content, count(*) OVER () AS prompts FROM (SELECT DISTINCT prompt[1].content AS content FROM traj)",
        "traj",
    )
)
def unique_prompts(spark, sf):
    prompts = M.unique_prompts(t.trajectories(spark, sf))
    return prompts.withColumn("prompts", prompts.agg(F.count(F.lit(1))).scalar())


@query(
    t.sql(
        """SELECT ID, seq, reward FROM (
  SELECT ID, 1 AS seq, reward + 1 AS reward FROM rollouts_ev WHERE label
  UNION ALL SELECT ID, 0, reward FROM rollouts_ev
  UNION ALL SELECT ID, 2, reward + 2 FROM rollouts_ev WHERE k >= 50) u
QUALIFY row_number() OVER (PARTITION BY ID ORDER BY seq) = 1""",
        "rollouts_ev",
    )
)
def dedupe_scored(spark, sf):
    rows = t.rollouts_ev(spark, sf)

    def copy(df, seq):
        return df.select("ID", F.lit(seq).alias("seq"), (F.col("reward") + seq).alias("reward"))

    again = copy(rows.where("label"), 1).unionByName(copy(rows.where("k >= 50"), 2))
    return M.dedupe_scored(again.unionByName(copy(rows, 0)))


# --- multi-turn search -------------------------------------------------------


def _winners(spark, sf):
    return stages.search_winners(t.beam(spark, sf))


@query(
    t.sql(
        """SELECT data_id, search_id,
""" + ",\n".join(
            f"bool_or({c}) FILTER (turn = {n}) AS {c}_{n}"
            for n in (1, 2, 3)
            for c in ("public_ok", "private_ok")
        ) + "\nFROM winners GROUP BY 1, 2",
        "winners",
    )
)
def align_turns(spark, sf):
    return R.align_turns(_winners(spark, sf), 3)


CHAIN = """, p AS (SELECT *,
  list_concat(CASE WHEN k % 30 = 0 THEN ['user:problem '||data_id] ELSE [] END,
   list_concat(['user:problem '||data_id], flatten(list_transform(range(1, turn::BIGINT), lambda s:
    ['assistant:step '||s||CASE WHEN k % 20 = 0 THEN ' edited' ELSE '' END, 'user:Feedback: '||s])))) AS prompt
  FROM winners)
SELECT count(*) AS rows,
  count(*) FILTER (len(a.prompt) <> 2 * a.turn - 1) AS bad_prompt_length,
  count(*) FILTER (a.k % 33 = 0) AS bad_completion,
  count(*) FILTER (a.k % 50 = 0) AS bad_feedback,
  count(*) FILTER (a.turn > 1 AND b.ID IS NULL) AS missing_earlier_turn,
  count(*) FILTER (b.ID IS NOT NULL AND a.prompt[1:len(b.prompt)] <> b.prompt) AS broken_prefix
FROM p a LEFT JOIN p b ON a.data_id = b.data_id AND a.search_id = b.search_id AND a.turn = b.turn + 1"""


@query(t.sql(CHAIN, "winners"))
def check_turn_chain(spark, sf):
    return R.check_turn_chain(_winners(spark, sf))


OUTCOME = """, o AS (SELECT data_id, search_id, min(turn) FILTER (public_ok) AS d,
  arg_min(private_ok, turn) FILTER (public_ok) AS good FROM winners GROUP BY 1, 2),
x AS (SELECT unnest([1, 2, 3]) AS turn)"""


def _share(name: str, condition: str) -> str:
    return t.sql(
        f"""{OUTCOME}
SELECT turn, round(avg(coalesce({condition}, false)::INT), 6) AS {name} FROM o, x GROUP BY turn""",
        "winners",
    )


@query(_share("success", "d <= turn AND good"))
def turn_success(spark, sf):
    return _r6(R.turn_success(_winners(spark, sf), 3), "success")


@query(_share("public_success", "d <= turn"))
def turn_public_success(spark, sf):
    return _r6(R.turn_public_success(_winners(spark, sf), 3), "public_success")


ANY = """, a AS (SELECT data_id, turn, bool_or(coalesce(d <= turn AND good, false)) AS v FROM o, x GROUP BY 1, 2)"""


@query(
    t.sql(
        f"{OUTCOME}{ANY}\nSELECT turn, round(avg(v::INT), 6) AS any_success FROM a GROUP BY turn",
        "winners",
    )
)
def turn_any_success(spark, sf):
    return _r6(R.turn_any_success(_winners(spark, sf), 3), "any_success")


# --- whole reports -------------------------------------------------------------


@query(
    t.sql(
        f"""{OUTCOME}{ANY}
SELECT 'turn_success' AS metric, turn AS x, round(avg(coalesce(d <= turn AND good, false)::INT), 6) AS value FROM o, x GROUP BY turn
UNION ALL SELECT 'turn_public_success', turn, round(avg(coalesce(d <= turn, false)::INT), 6) FROM o, x GROUP BY turn
UNION ALL SELECT 'turn_any_success', turn, round(avg(v::INT), 6) FROM a GROUP BY turn""",
        "winners",
    )
)
def search_report(spark, sf):
    return _r6(stages.search_report(_winners(spark, sf), 3), "value")


@query(
    t.sql(
        f""", c AS ({COUNTS}), ks AS (SELECT unnest(range(1, max(n) + 1)) AS k FROM c),
r AS (SELECT data_id, label, reward, ID, count(*) OVER (PARTITION BY data_id) AS n,
  row_number() OVER (PARTITION BY data_id ORDER BY reward DESC, ID) AS rk FROM rollouts_ev),
w AS (SELECT sz, data_id, label, n, rk - 1 AS i, least(sz, n) AS m FROM r, {SIZES}),
p AS (SELECT sz, data_id, sum(CASE WHEN NOT label OR n - 1 - i < m - 1 THEN 0.0 ELSE
  exp(lgamma(n-i) - lgamma(m) - lgamma(n-i-m+1) - lgamma(n+1) + lgamma(m+1) + lgamma(n-m+1)) END) AS v
  FROM w GROUP BY 1, 2),
q AS (SELECT sz, n, c, least(sz, n) AS k FROM c, {SIZES}),
b AS (SELECT y.k, data_id, sum(label::INT) / y.k::DOUBLE AS a, avg(((reward > 0) = label)::INT) AS pr
  FROM r JOIN (SELECT unnest([1, 2, 3, 4]) AS k) y ON rk <= y.k GROUP BY y.k, data_id)
SELECT 'pass_at_k' AS metric, k::INT AS x, round(avg({PASS}), 6) AS value FROM c JOIN ks ON k <= n GROUP BY k
UNION ALL SELECT 'best_of_n', sz, round(avg(v), 6) FROM p GROUP BY sz
UNION ALL SELECT 'best_of_n_oracle', sz, round(avg({PASS}), 6) FROM q GROUP BY sz
UNION ALL SELECT 'best_k_accuracy', k, round(avg(a), 6) FROM b GROUP BY k
UNION ALL SELECT 'best_k_precision', k, round(avg(pr), 6) FROM b GROUP BY k""",
        "rollouts_ev",
    )
)
def rollout_report(spark, sf):
    return _r6(stages.rollout_report(t.rollouts_ev(spark, sf)), "value")
