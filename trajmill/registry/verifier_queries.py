"""Verifier metrics, token features, and linear verifiers."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajmill.functions.draws import draw
from trajmill.functions.stats import softplus
from trajmill.learning import verifiers as L
from trajmill.operators import metrics as M
from trajmill.operators import sampling as P
from trajmill.operators import tokens as K
from trajmill.registry import query
from trajmill.registry import tables as t
from trajmill.registry.selections import pair_sql
from trajmill.session import new_folder
from trajmill.sources.sinks import write_once


@query(
    t.sql(
        """SELECT round(avg(((reward > 0) = label)::INT), 6) AS accuracy,
  round(avg(greatest(reward, 0) - reward * label::INT + ln(1 + exp(-abs(reward)))), 6) AS loss FROM rollouts_ev""",
        "rollouts_ev",
    )
)
def binary_verifier_metrics(spark, sf):
    out = M.binary_verifier_metrics(t.rollouts_ev(spark, sf))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


# Means of two-digit rewards can end in a five at the seventh digit, where the order of
# a sum would decide the rounding; with nine digits, or an uneven factor, they cannot.
DIGITS = {"chosen_rewards": 9, "rejected_rewards": 9, "reward_margin": 9}
PENALTY = 0.0069314718


@query(
    t.sql(
        f""", {pair_sql("rollouts_ev")},
m AS (SELECT a.reward AS c, b.reward AS r, a.reward - b.reward AS d
  FROM p JOIN rollouts_ev a ON a.ID = chosen_ID JOIN rollouts_ev b ON b.ID = rejected_ID)
SELECT round(avg((c > r)::INT), 6) AS accuracy,
  round(avg(greatest(-d, 0) + ln(1 + exp(-abs(d)))), 6) AS loss,
  round(avg(c), 9) AS chosen_rewards, round(avg(r), 9) AS rejected_rewards, round(avg(d), 9) AS reward_margin,
  round({PENALTY}::DOUBLE * avg((c * c + r * r) / 2), 6) AS penalty FROM m""",
        "rollouts_ev",
    )
)
def pair_verifier_metrics(spark, sf):
    rows = t.rollouts_ev(spark, sf)
    pairs = P.sample_pair_ids(rows)
    for side in ("chosen", "rejected"):
        score = rows.select(F.col("ID").alias(f"{side}_ID"), F.col("reward").alias(f"{side}_reward"))
        pairs = pairs.join(score, f"{side}_ID")
    out = M.pair_verifier_metrics(pairs, PENALTY)
    return out.select(*[F.round(c, DIGITS.get(c, 6)).alias(c) for c in out.columns])


# --- tokens -------------------------------------------------------------------


def _ids(text: str) -> str:
    return (
        f"list_transform(list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> ''), "
        f"lambda w: ({t.h(chr(39) + 'tok' + chr(39), 'w')} % 32000)::INT)"
    )


FEATURES = f""", f AS (SELECT doc_id AS ID, lang AS split, {_ids("'user:'||text")} AS p,
  {_ids("'user:'||text||chr(10)||'assistant:'||source||' '||lang")} AS f FROM documents)"""


def _text(ids):
    return F.md5(F.array_join(F.transform(ids, lambda x: x.cast("string")), ","))


@query(
    f"""WITH {FEATURES[2:]}
SELECT ID, len(f)::INT AS n, len(p)::INT AS n_prompt, md5(array_to_string(f, ',')) AS input_ids,
  md5(array_to_string(list_transform(f, lambda x, i: CASE WHEN i <= len(p) THEN -100 ELSE x END), ',')) AS labels,
  len(f)::BIGINT AS attention, 'HumanEval' AS dataset FROM f"""
)
def build_token_features(spark, sf):
    rows = K.build_token_features(t.doc_messages(spark, sf), train_only_on_prompt=True)
    ones = F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select(
        "ID",
        F.size("input_ids").alias("n"),
        F.size("prompt_code").alias("n_prompt"),
        _text("input_ids").alias("input_ids"),
        _text("labels").alias("labels"),
        ones.alias("attention"),
        "dataset",
    )


@query(
    t.sql(
        f"""SELECT ID, md5(array_to_string({_ids("'user:'||prompt[1].content||chr(10)||'assistant:'||completion[1].content")}, ',')) AS prompt_code
FROM traj""",
        "traj",
    )
)
def binary_token_features(spark, sf):
    rows = K.binary_token_features(t.trajectories(spark, sf))
    return rows.select("ID", _text("prompt_code").alias("prompt_code"))


JOINED = "array_to_string(list_transform(%s, lambda m: m.role||':'||m.content), chr(10))"


@query(
    t.sql(
        f""", {pair_sql("traj")}, f AS (SELECT data_id, arg_min(prompt, ID) AS prompt FROM traj WHERE label GROUP BY 1)
SELECT key AS data_id, draw,
  md5(array_to_string({_ids(JOINED % "list_concat(f.prompt, a.completion)")}, ',')) AS input_ids_chosen,
  md5(array_to_string({_ids(JOINED % "list_concat(f.prompt, b.completion)")}, ',')) AS input_ids_rejected,
  md5(array_to_string({_ids(JOINED % "f.prompt")}, ',')) AS input_ids_prompt
FROM p JOIN traj a ON a.ID = chosen_ID JOIN traj b ON b.ID = rejected_ID JOIN f ON f.data_id = key""",
        "traj",
    )
)
def pair_token_features(spark, sf):
    rows = K.pair_token_features(P.sample_pairs(t.stored_trajectories(spark, sf)))
    names = ("input_ids_chosen", "input_ids_rejected", "input_ids_prompt")
    return rows.select("data_id", "draw", *[_text(c).alias(c) for c in names])


LIMITS = [("prompt_code", 200), ("input_ids", 150)]


def _features(spark, sf):
    return K.token_lengths(t.doc_messages(spark, sf))


@query(
    f"""WITH {FEATURES[2:]}
SELECT 'all' AS mode, ID FROM f WHERE len(p) <= 200 AND len(f) <= 150
UNION ALL SELECT 'chained', ID FROM f WHERE len(p) <= 200"""
)
def filter_by_length(spark, sf):
    rows = _features(spark, sf)
    kept = [
        K.filter_by_length(rows, LIMITS, mode).select(F.lit(mode).alias("mode"), "ID")
        for mode in ("all", "chained")
    ]
    return reduce(DataFrame.unionByName, kept)


@query(
    f"""WITH {FEATURES[2:]}
SELECT split, count(*) FILTER (NOT (len(p) <= 200 AND len(f) <= 150)) AS dropped, count(*) AS total,
  round(100.0::DOUBLE * count(*) FILTER (NOT (len(p) <= 200 AND len(f) <= 150)) / count(*), 6) AS percentage
FROM f GROUP BY split"""
)
def filter_report(spark, sf):
    rows = K.filter_report(_features(spark, sf), K.within_limits(_features(spark, sf), LIMITS))
    return rows.withColumn("percentage", F.round("percentage", 6))


LENGTHS = f"""WITH {FEATURES[2:]}, l AS (SELECT 'prompt_code' AS feature, len(p)::INT AS length FROM f
  UNION ALL SELECT 'input_ids', len(f)::INT FROM f)"""
COLUMNS = ["prompt_code", "input_ids"]


@query(
    f"""{LENGTHS}
SELECT feature, min(length) AS min, max(length) AS max, round(avg(length), 6) AS mean,
  round(quantile_cont(length, 0.5), 6) AS p50, round(quantile_cont(length, 0.95), 6) AS p95
FROM l GROUP BY feature"""
)
def token_length_stats(spark, sf):
    rows = K.token_length_stats(_features(spark, sf), COLUMNS)
    return rows.withColumns({c: F.round(c, 6) for c in ("mean", "p50", "p95")})


@query(
    f"""{LENGTHS}, b AS (SELECT feature, min(length) AS lo, max(length) AS hi FROM l GROUP BY 1)
SELECT feature, least(floor((length - lo)::DOUBLE / (hi - lo) * 30), 29)::INT AS bin, count(*) AS rows
FROM l JOIN b USING (feature) GROUP BY 1, 2"""
)
def token_length_histogram(spark, sf):
    return K.token_length_histogram(_features(spark, sf), COLUMNS)


# --- verifiers ------------------------------------------------------------------

# The fits are checked by what must hold at a minimum, the scores from given weights.
L2 = 0.01
TEXT = "'user:'||prompt[1].content||chr(10)||'assistant:'||completion[1].content"
WORDS = (
    "list_transform(list_filter(string_split_regex(lower({0}), '\\s+'), lambda w: w <> ''), "
    "lambda w: (" + t.h("'tok'", "w") + " % 512)::INT)"
)
WEIGHTS = [((i * 7919) % 101 - 50) / 100.0 for i in range(L.DIMENSIONS)]
HELD = t.h("'held'", "ID") + " % 5 = 0"


@query(
    t.sql(
        f""", w AS (SELECT ID, unnest({WORDS.format(TEXT)}) AS i FROM traj),
c AS (SELECT ID, i, count(*) AS n FROM w GROUP BY 1, 2)
SELECT ID, md5(string_agg(i||':'||n, ',' ORDER BY i)) AS features FROM c GROUP BY ID""",
        "traj",
    )
)
def verifier_features(spark, sf):
    rows = L.verifier_features(t.trajectories(spark, sf))
    dense = vector_to_array("features")
    cells = F.filter(
        F.transform(dense, lambda n, i: F.when(n > 0, F.concat_ws(":", i, n.cast("bigint")))),
        lambda x: x.isNotNull(),
    )
    return rows.select("ID", F.md5(F.array_join(cells, ",")).alias("features"))


def _held(df, key):
    return df.withColumn("held", draw("held", key) % 5 == 0)


#: Labels that the texts determine: a known scorer's sign. The recorded ones may be noise, of which
#: nothing can be learnt for rows held out.
TAUGHT_SIZE = 32
TAUGHT = f"""taught AS (SELECT * REPLACE (coalesce(list_sum(list_transform({WORDS.format(TEXT).replace("% 512", f"% {TAUGHT_SIZE}")},
  lambda i: ((i * 7919) % 101 - 50) / 100.0::DOUBLE)), 0) > 0 AS label) FROM traj)"""


def _taught(df):
    scored = L.score_linear(df, WEIGHTS[:TAUGHT_SIZE], name="taught")
    return scored.withColumn("label", F.col("taught") > 0).drop("taught")


def _converged(model, rows):
    """Whether the fit took few passes and an independent sum of the derivatives is zero there."""
    slope = L.gradient(model, rows, L2).agg(F.max(F.abs("slope"))).scalar()
    return F.lit(model.passes <= 12) & (slope < 1e-6)


@query(
    t.sql(
        f""", {TAUGHT}, {pair_sql("taught")}
SELECT count(*) FILTER (NOT held) AS learnt, count(*) FILTER (held) AS held_out, true AS beats_chance, true AS converged
FROM (SELECT {t.h("'held'", "key")} % 5 = 0 AS held FROM p) x""",
        "traj",
    )
)
def train_pair_verifier(spark, sf):
    # Read by the fit and by both checks: stored once. Prompts are held out, not pairs of one prompt.
    pairs = P.sample_pairs(_taught(t.stored_trajectories(spark, sf)))
    pairs = _held(write_once(pairs, new_folder(spark, "pairs")), F.col("data_id"))
    learnt = pairs.where(~F.col("held"))
    model = L.train_pair_verifier(learnt, l2=L2, dimensions=TAUGHT_SIZE)
    scored = pairs
    for side in ("chosen", "rejected"):
        view = scored.withColumn("completion", F.col(side))
        scored = L.score_rollouts(model, view, f"{side}_reward").drop("completion")
    loss = M.pair_verifier_metrics(scored.where("held")).select("loss").scalar()
    counts = pairs.agg(F.count_if(~F.col("held")).alias("learnt"), F.count_if("held").alias("held_out"))
    return counts.select(
        "learnt",
        "held_out",
        F.coalesce(loss < math.log(2), F.col("held_out") == 0).alias("beats_chance"),
        _converged(model, L.pair_rows(learnt, TAUGHT_SIZE)).alias("converged"),
    )


@query(
    t.sql(
        f""", {TAUGHT}
SELECT count(*) FILTER (NOT held) AS learnt, count(*) FILTER (held) AS held_out,
  count(*) FILTER (NOT held AND label)::DOUBLE AS expected, true AS beats_chance, true AS converged
FROM (SELECT {HELD} AS held, label FROM taught) x""",
        "traj",
    )
)
def train_binary_verifier(spark, sf):
    rollouts = _held(_taught(t.stored_trajectories(spark, sf)), F.col("ID"))
    learnt = rollouts.where(~F.col("held"))
    model = L.train_binary_verifier(learnt, l2=L2, dimensions=TAUGHT_SIZE)
    scored = L.score_rollouts(model, rollouts)
    x, held = F.col("reward"), F.col("held")
    label = F.col("label").cast("int")
    # The intercept is free, so the chances of the rows learnt from add up to the right ones.
    chances = F.round(F.sum(F.when(~held, 1 / (1 + F.exp(-x)))), 4) + 0.0
    loss = F.avg(F.when(held, softplus(x) - x * label))
    counts = scored.agg(
        F.count_if(~held).alias("learnt"),
        F.count_if(held).alias("held_out"),
        chances.alias("expected"),
        F.coalesce(loss < math.log(2), F.count_if(held) == 0).alias("beats_chance"),
    )
    return counts.withColumn("converged", _converged(model, L.binary_rows(learnt, TAUGHT_SIZE)))


@query(
    t.sql(
        f""", w AS (SELECT ID, data_id, label, {WORDS.format(TEXT)} AS ids FROM traj)
SELECT ID, data_id, label,
  round(coalesce(list_sum(list_transform(ids, lambda i: ((i * 7919) % 101 - 50) / 100.0::DOUBLE)), 0), 6) AS reward
FROM w""",
        "traj",
    )
)
def score_rollouts(spark, sf):
    scored = L.score_linear(t.trajectories(spark, sf), WEIGHTS)
    return scored.select("ID", "data_id", "label", F.round("reward", 6).alias("reward"))
