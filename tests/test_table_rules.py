"""Operators on small tables whose results can be worked out by hand or by brute force."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from trajmill import constants as C
from trajmill.functions.feedback import positive
from trajmill.functions.messages import joined
from trajmill.operators import conversations as V
from trajmill.operators import grading as G
from trajmill.operators import merge
from trajmill.operators import metrics as M
from trajmill.operators import problems as Q
from trajmill.operators import sampling as P
from trajmill.operators import search as R
from trajmill.operators import selection as E
from trajmill.operators import tokens as K
from trajmill.plans import stages

SCORED = "ID bigint, data_id bigint, reward double, label boolean"


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    data = []
    for i in range(60):
        d = rng.choice([0, 0, 0, 1, 2, 3])
        data.append((i, d, round(rng.gauss(0, 1), 1) + 0.0, d != 3 and rng.random() < 0.4))
    return spark.createDataFrame(data, SCORED).cache()


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["data_id"], []).append(r)
    return out


def test_pass_at_k_brute_force(scored):
    by = groups(scored)
    want = {}
    for k in range(1, max(map(len, by.values())) + 1):
        parts = [
            1 - math.comb(len(g) - sum(r["label"] for r in g), k) / math.comb(len(g), k)
            for g in by.values()
            if len(g) >= k
        ]
        want[k] = sum(parts) / len(parts)
    curve = {r["k"]: r["pass_at_k"] for r in M.pass_at_k_curve(scored).collect()}
    assert curve == pytest.approx(want)
    one = M.pass_at_k(scored, 7).first()
    assert one["pass_at_k"] == pytest.approx(want[7])
    assert one["prompts"] + one["skipped"] == len(by)
    assert list(curve) != [] and curve[1] == pytest.approx(
        sum(sum(r["label"] for r in g) / len(g) for g in by.values()) / len(by)
    )


def test_pass_at_k_override_and_cap(scored):
    shared = M.pass_at_k(scored, 2, n_override=40).first()["pass_at_k"]
    by = groups(scored)
    want = [1 - math.comb(40 - sum(r["label"] for r in g), 2) / math.comb(40, 2) for g in by.values()]
    assert shared == pytest.approx(sum(want) / len(want))
    assert M.pass_at_k_curve(scored, max_k=3).count() == 3


def test_curves_run_to_n(spark, monkeypatch):
    """A prompt of 3,000 rollouts has 3,000 points and N = 3,000, in blocks or not."""
    df = spark.range(3000).select(
        F.col("id").alias("ID"), F.lit(1).alias("data_id"), (F.col("id") % 1000 == 0).alias("label"),
        F.sin("id").alias("reward"),
    )
    whole = {r["k"]: r["pass_at_k"] for r in M.pass_at_k_curve(df).collect()}
    assert len(whole) == 3000 and whole[3000] == pytest.approx(1.0)
    assert whole[1000] == pytest.approx(1 - math.comb(2997, 1000) / math.comb(3000, 1000))
    monkeypatch.setattr(M, "CURVE_BLOCK", 70)
    cut = {r["k"]: r["pass_at_k"] for r in M.pass_at_k_curve(df).collect()}
    assert cut == pytest.approx(whole)
    sizes = [1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 3000]
    assert sorted(r["n"] for r in M.best_of_n_oracle(df).collect()) == sizes
    exact = {r["n"]: r["solve_rate"] for r in M.best_of_n_exact(df).collect()}
    assert sorted(exact) == sizes
    best_row = df.orderBy(F.desc("reward"), "ID").first()
    assert exact[3000] == pytest.approx(float(best_row["label"]))
    drawn = {r["n"]: r["solve_rate"] for r in M.best_of_n_sampled(df, trials=2).collect()}
    assert sorted(drawn) == sizes and drawn[3000] == float(best_row["label"])


def sampled_by_sorting(df, sizes, trials, seed=42):
    """best_of_n_sampled by sorting every prompt in every trial."""
    right = {n: [] for n in sizes}
    for g in groups(df).values():
        for trial in range(trials):
            def place(r):
                return int(hashlib.md5(f"{seed}|{trial}|{r['ID']}".encode()).hexdigest()[:8], 16), r["ID"]

            order = sorted(g, key=place)
            for n in sizes:
                right[n].append(best(order[:n])["label"])
    return {n: sum(v) / len(v) for n, v in right.items()}


@pytest.mark.parametrize("bits", [0, 3, 12])
def test_sampled_best_is_that_of_sorting(spark, monkeypatch, bits):
    """One hot prompt, small ones, equal scores; buckets of any size give the same samples."""
    monkeypatch.setattr(M, "DRAW_BITS", bits)
    rng = random.Random(bits)
    data = [(i, 0 if i % 3 else rng.randrange(1, 40), float(rng.randrange(6)), rng.random() < 0.4) for i in range(900)]
    df = spark.createDataFrame(data, SCORED)
    sizes = (1, 2, 5, 64, 300, 2000)
    got = {r["n"]: r["solve_rate"] for r in M.best_of_n_sampled(df, sizes, trials=3).collect()}
    assert got == pytest.approx(sampled_by_sorting(df, sizes, 3))


def test_no_window_spans_a_prompt(scored):
    plan = M.best_of_n_sampled(scored, (1, 2))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # One over the buckets' counts of a prompt and trial, one over the rows of a bucket.
    assert len(windows) >= 2
    assert all("_bucket" in line or ", n#" in line for line in windows)


@pytest.mark.parametrize("kind, values", [("double", [0.3, 0.5, 0.51, 1.0]), ("int", [0, 0, 1, 1]), ("boolean", [False, False, True, True])])
def test_positive_is_over_one_half(spark, kind, values):
    df = spark.createDataFrame([(v,) for v in values], f"label {kind}")
    got = [r[0] for r in df.select(positive(F.col("label")), positive(F.col("label"), df)).collect()]
    assert got == [False, False, True, True]
    assert V.filter_positive(df).count() == 2


def test_null_content_is_empty(spark):
    message = "array<struct<role:string,content:string>>"
    df = spark.createDataFrame([([("user", None), (None, "b")],)], f"m {message}")
    assert df.select(joined(F.col("m"))).first()[0] == "user:\n:b"


def best(rows_):
    return max(rows_, key=lambda r: (r["reward"], -r["ID"]))


def test_best_of_n_exact_is_the_mean_over_all_draws(spark):
    rng = random.Random(9)
    data = [(i, i % 3, float(rng.randrange(4)), rng.random() < 0.5) for i in range(21)]
    df = spark.createDataFrame(data, SCORED)
    by = groups(df)
    got = {r["n"]: r["solve_rate"] for r in M.best_of_n_exact(df, (1, 2, 3, 4, 8)).collect()}
    oracle = {r["n"]: r["solve_rate"] for r in M.best_of_n_oracle(df, (1, 2, 3, 4, 8)).collect()}
    for n in got:
        total, any_right = 0.0, 0.0
        for g in by.values():
            draws = list(itertools.combinations(g, min(n, len(g))))
            total += sum(best(d)["label"] for d in draws) / len(draws)
            any_right += sum(any(r["label"] for r in d) for d in draws) / len(draws)
        assert got[n] == pytest.approx(total / len(by))
        assert oracle[n] == pytest.approx(any_right / len(by))
    via_label = M.best_of_n_exact(df, (1, 2, 3, 4, 8), order_by="label")
    assert {r["n"]: r["solve_rate"] for r in via_label.collect()} == pytest.approx(oracle)


def test_best_of_n_sampled_nears_the_exact_value(scored):
    exact = {r["n"]: r["solve_rate"] for r in M.best_of_n_exact(scored, (1, 4, 64)).collect()}
    drawn = M.best_of_n_sampled(scored, (1, 4, 64), trials=400)
    for r in drawn.collect():
        assert abs(r["solve_rate"] - exact[r["n"]]) < 0.07
    assert {r["n"]: r["solve_rate"] for r in drawn.collect()}[64] == pytest.approx(exact[64])


def test_best_k_divides_by_k(spark):
    df = spark.createDataFrame([(0, 0, 1.0, True), (1, 0, -1.0, False), (2, 1, 2.0, True)], SCORED)
    got = {r["k"]: (r["accuracy"], r["precision"]) for r in M.best_k_of_n(df, (1, 2, 4)).collect()}
    assert got == {1: (1.0, 1.0), 2: (0.5, 1.0), 4: (0.25, 1.0)}


def test_histogram_edges(spark):
    df = spark.createDataFrame([(i, 0, float(i), True) for i in range(11)], SCORED)
    bins = dict(map(tuple, M.reward_distribution(df, 10).select("bin", "rollouts").collect()))
    assert bins == {**{b: 1 for b in range(9)}, 9: 2}
    flat = df.withColumn("reward", F.lit(3.0))
    assert dict(map(tuple, M.reward_distribution(flat, 10).select("bin", "rollouts").collect())) == {5: 11}


def test_verifier_metrics_do_not_overflow(spark):
    df = spark.createDataFrame([(0, 0, 1000.0, True), (1, 0, -1000.0, False)], SCORED)
    got = M.binary_verifier_metrics(df).first()
    assert (got["accuracy"], got["loss"]) == (1.0, 0.0)
    pairs = spark.createDataFrame([(2.0, 1.0), (0.0, 0.0)], "chosen_reward double, rejected_reward double")
    got = M.pair_verifier_metrics(pairs, l2=0.1).first()
    assert got["accuracy"] == 0.5
    assert got["loss"] == pytest.approx((math.log1p(math.exp(-1)) + math.log(2)) / 2)
    assert got["penalty"] == pytest.approx(0.1 * (4 + 1) / 4)


def test_selection_ties_and_modes(spark):
    df = spark.createDataFrame(
        [(0, 0, 1.0, False, "x"), (1, 0, 1.0, True, C.SUCCESS), (2, 0, 5.0, False, "x"), (3, 0, 1.0, True, "x")],
        SCORED + ", public string",
    ).withColumn("feedbacks", F.array(F.struct(F.col("public"), F.lit("").alias("private"))))
    first = {m: E.select_topk(df, 1, m).first()["ID"] for m in E.MODES}
    assert first == {"reward": 2, "ground_truth": 1, "public_truth": 1, "public_and_reward_truth": 1}
    with pytest.raises(ValueError):
        E.select_topk(df, 1, "other")
    ordered = [r["ID"] for r in E.order_rollouts(df, "reward").collect()]
    assert ordered == [2, 0, 1, 3]


def nested(spark):
    def m(role, text):
        return {"role": role, "content": text}

    data = [
        (0, 0, [m("user", "q0")], [m("assistant", "a0")], True, 2.0),
        (1, 0, [m("user", "q0"), m("assistant", "b1"), m("user", "f")], [m("assistant", "a1")], False, 1.0),
        (2, 0, [m("user", "q0"), m("assistant", "b2"), m("user", "f")], [m("assistant", "a2")], False, 3.0),
        (3, 1, [m("user", "q1")], [m("assistant", "a3")], False, 0.0),
    ]
    message = "array<struct<role:string,content:string>>"
    return spark.createDataFrame(
        data, f"ID bigint, data_id bigint, prompt {message}, completion {message}, label boolean, reward double"
    )


def text(df, *columns):
    return sorted(
        tuple("|".join(x["content"] for x in r[c]) if isinstance(r[c], list) else r[c] for c in columns)
        for r in df.collect()
    )


def test_expansions(spark):
    df = nested(spark)
    assert text(V.expand_intermediate(df), "prompt", "completion", "label") == [
        ("q0", "a0", True), ("q0", "b1", False), ("q0", "b2", False), ("q0|b1|f", "a1", False),
        ("q0|b2|f", "a2", False), ("q1", "a3", False),
    ]
    assert text(V.expand_relabeled(df), "prompt", "completion") == [
        ("q0", "a0"), ("q0", "a1"), ("q0", "a2"), ("q0|b1|f", "a1"), ("q0|b2|f", "a2"), ("q1", "a3"),
    ]
    assert text(V.expand_positive(df), "prompt", "completion") == [("q0", "a0")]
    assert {p for p, in text(V.flatten_to_first_prompt(df), "prompt")} == {"q0", "q1"}


def test_relabelled_set(spark):
    df = nested(spark)
    got = E.build_relabelled_set(df, 1, 2)
    assert text(got, "data_id", "prompt", "completion", "label", "relabelled") == [
        (0, "q0|b1|f", "a0", False, True), (0, "q0|b2|f", "a0", False, True), (1, "q1", "a3", False, True),
    ]
    merged = E.build_relabelled_set(df, 1, 3, merge_positives=True)
    assert text(merged, "prompt", "completion", "label", "relabelled") == [
        ("q0", "a0", True, False), ("q0|b1|f", "a0", False, True), ("q0|b2|f", "a0", False, True),
        ("q1", "a3", False, True),
    ]
    stage = stages.iteration_training_set(df, k=1, count=3)
    assert stage.count() == 6


def test_pairs(spark, scored, tmp_path):
    by = groups(scored)
    both = {d for d, g in by.items() if 0 < sum(r["label"] for r in g) < len(g)}
    assert {r["data_id"] for r in P.prompts_with_both(scored).collect()} == both
    pairs = P.sample_pair_ids(scored, 16).collect()
    assert len(pairs) == 16 * len(both)
    labels = {r["ID"]: r["label"] for g in by.values() for r in g}
    assert all(labels[p["chosen_ID"]] and not labels[p["rejected_ID"]] for p in pairs)
    missing = P.missing_side_counts(scored).first()
    assert missing["prompts"] == len(by) and missing["no_pairs"] == len(by) - len(both)
    flat = stages.preference_pairs(nested(spark), str(tmp_path / "flat"), 4)
    assert text(flat.select("prompt", "chosen").distinct(), "prompt", "chosen") == [("q0", "a0")]
    assert flat.count() == 4


def test_draws_reach_every_row(spark):
    df = spark.createDataFrame([(i, 0, 0.0, i % 2 == 0) for i in range(12)], SCORED)
    drawn = P.sample_pair_ids(df, 200)
    assert drawn.select("chosen_ID").distinct().count() == 6
    assert drawn.select("rejected_ID").distinct().count() == 6


def test_draws_are_uniform_and_independent(spark):
    """Every row of a side is drawn alike often, whatever was drawn before."""
    df = spark.createDataFrame([(i, 0, 0.0, i < 4) for i in range(8)], SCORED)
    drawn = sorted((r["draw"], r["chosen_ID"]) for r in P.sample_pair_ids(df, 4000).collect())
    counts, pairs = collections.Counter(i for _, i in drawn), collections.Counter()
    for (_, a), (_, b) in zip(drawn, drawn[1:]):
        pairs[a, b] += 1
    assert all(abs(n - 1000) < 120 for n in counts.values()) and len(counts) == 4
    assert all(abs(n - 250) < 75 for n in pairs.values()) and len(pairs) == 16


def test_upsample(spark):
    got = P.upsample_positives(nested(spark), 10)
    assert got.count() == 10
    assert text(got.distinct(), "data_id", "prompt", "completion")[0] == (0, "q0", "a0")


@pytest.mark.parametrize("n, batch, strict, added", [(10, 4, False, 2), (8, 4, False, 4), (8, 4, True, 0)])
def test_pad(spark, n, batch, strict, added):
    df = spark.range(n).withColumnRenamed("id", "ID")
    for step in (1, 1000, 1 << 45):
        got = P.pad_to_multiple(df.select((F.col("ID") * step - 7).alias("ID")), batch, 5, strict)
        assert got.count() == n + added
        assert got.where("padding").count() == added
    assert P.pad_to_multiple(df.where("false"), batch, 5, strict).count() == 0


def test_shuffle_and_limit(spark):
    df = spark.range(50).withColumnRenamed("id", "ID")
    one = [r["ID"] for r in P.shuffle_rows(df, 1, 0).collect()]
    again = [r["ID"] for r in P.shuffle_rows(df.repartition(5), 1, 0).collect()]
    other = [r["ID"] for r in P.shuffle_rows(df, 1, 1).collect()]
    assert one == again != other and sorted(one) == list(range(50))
    assert [r["ID"] for r in P.limit_rows(df, 3).collect()] == [0, 1, 2]


def test_canonical_tail(spark):
    df = nested(spark)
    assert [r["ID"] for r in P.drop_canonical(df).collect()] == [0, 1]
    assert tuple(P.canonical_violations(df).first()) == (2, 2)


def test_merge(spark):
    a = spark.range(3).withColumn("x", F.lit(1))
    b = a.withColumn("y", F.lit(2)).select("y", "x", "id")
    assert merge.merge_datasets(a, b).columns == ["id", "x"]
    assert merge.merge_datasets(a, b).count() == 6
    with pytest.raises(ValueError):
        merge.merge_datasets(b, a)


def test_build_and_continue(spark):
    conv = "array<struct<role:string,content:string>>"
    data = [
        (1, [("user", "q"), ("assistant", "a"), ("user", "f")]),
        (2, [("assistant", "a")]),
        (3, [("user", "q"), ("user", "q2")]),
        (4, []),
        (5, [("assistant", "a"), ("user", "f")]),
    ]
    df = spark.createDataFrame(data, f"ID int, conversation {conv}")
    good, bad = V.build_rollout_rows(df)
    assert text(good, "ID", "prompt", "completion") == [(1, "q", "a"), (5, "", "a")]
    assert sorted(r["ID"] for r in bad.collect()) == [2, 3, 4]
    more = nested(spark).withColumn(
        "feedbacks",
        F.array(*[F.struct(F.lit(p).alias("public"), F.lit("").alias("private")) for p in ("x", "last")]),
    )
    assert text(V.continue_conversations(more), "messages")[0] == ("q0|a0|Feedback: last",)


def test_assemble_stops_at_success(spark):
    turns = spark.createDataFrame(
        [(r, s, f"code{s}", "fb", "", r == 1 and s == 1) for r in (1, 2) for s in range(4)],
        "rollout_id int, step int, action string, public string, private string, success boolean",
    )
    first = spark.createDataFrame([(1, "q"), (2, "q")], "rollout_id int, prompt string")
    got = V.assemble_conversations(turns, first, max_steps=3)
    assert text(got, "rollout_id", "conversation", "label") == [
        (1, "q|code0|Feedback: fb|code1|Feedback: fb", True),
        (2, "q|code0|Feedback: fb|code1|Feedback: fb|code2|Feedback: fb", False),
    ]
    rows_, _ = V.build_rollout_rows(got)
    assert text(rows_, "rollout_id", "completion") == [(1, "code1"), (2, "code2")]


def test_grading(spark):
    io = "struct<input:array<string>,output:array<string>>"
    problems = spark.createDataFrame(
        [(0, (["i0", "i1"], ["a", "b\n"]), (["j0"], ["c"]))],
        f"data_id bigint, public_tests {io}, private_tests {io}",
    )
    rollouts = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "ID bigint, data_id bigint")
    outputs = spark.createDataFrame(
        [
            (1, "public", 0, "a\n\n"), (1, "public", 1, "b"), (1, "private", 0, "\nc"),
            (2, "public", 0, "a"), (2, "public", 1, "x"), (2, "private", 0, None),
            (3, "public", 0, None), (3, "public", 1, "x"),
        ],
        "ID bigint, visibility string, test_id int, actual string",
    )
    late = "[Error] TimeoutError: Code execution timed out"
    wrong = "[Error] AssertionError: Expected output=b for input=i1, but got actual_output=x"
    for limit in (1, 10**6):
        got = rows(G.grade_outputs(rollouts, problems, outputs, limit))
        assert got == [(1, 0, C.SUCCESS, C.SUCCESS), (2, 0, wrong, late), (3, 0, late, late)]


def test_search_report(spark):
    ok, no = C.SUCCESS, "x"
    plays = {  # (problem, search): public/private per turn
        (0, 0): [(no, no), (ok, ok), (no, no)],
        (0, 1): [(ok, no), (ok, ok), (ok, ok)],
        (1, 0): [(no, ok), (no, no), (ok, "")],
    }
    data = [
        (d, s, t + 1, [{"public": p, "private": q}])
        for (d, s), turns in plays.items()
        for t, (p, q) in enumerate(turns)
    ]
    df = spark.createDataFrame(
        data, "data_id int, search_id int, turn int, feedbacks array<struct<public:string,private:string>>"
    )
    assert rows(R.turn_success(df, 3)) == [(1, 0.0), (2, 1 / 3), (3, 2 / 3)]
    assert rows(R.turn_public_success(df, 3)) == [(1, 1 / 3), (2, 2 / 3), (3, 1.0)]
    assert rows(R.turn_any_success(df, 3)) == [(1, 0.0), (2, 0.5), (3, 1.0)]


def test_problem_rules(spark):
    schema = "data_id bigint, initial_prompt string, solutions struct<language:array<int>,code:array<string>>"
    df = spark.createDataFrame([(0, "q", ([2, 1, 1], ["a", "b", "c"])), (1, "q", ([3], ["a"]))], schema)
    got = Q.canonical_rollouts(df, "deepmind/code_contests")
    assert text(got, "data_id", "completion", "label") == [(0, "b", True)]
    with pytest.raises(ValueError):
        Q.canonical_rollouts(df, "other")
    done = spark.createDataFrame([(0, 0), (0, 2)], "data_id bigint, rollout_no bigint")
    people = spark.range(2).withColumnRenamed("id", "data_id")
    assert rows(Q.pending_rollouts(people, done, 3)) == [(0, 1), (1, 0), (1, 1), (1, 2)]
    many = spark.range(27).select(F.lit(0).alias("data_id"), F.col("id").alias("rollout_no"))
    ten = spark.range(10).withColumnRenamed("id", "data_id")
    assert tuple(Q.rollout_progress(ten, many, 3).first()) == (27, 10, 2, 2, False)


def test_token_rules(spark):
    df = nested(spark)
    features = K.build_token_features(df, train_only_on_prompt=True)
    for r in features.collect():
        n = len(r["prompt_code"])
        assert r["input_ids"][:n] == r["prompt_code"] and len(r["attention_mask"]) == len(r["input_ids"])
        assert r["labels"] == [C.IGNORE_LABEL] * n + r["input_ids"][n:]
    counted = K.token_lengths(df)
    assert rows(counted.select("ID", "prompt_code", "input_ids")) == rows(
        features.select("ID", F.size("prompt_code"), F.size("input_ids"))
    )
    for lengths in (
        K.token_length_stats(counted, ["input_ids"]),
        K.filter_by_length(counted, [("input_ids", 2)]),
        K.token_length_histogram(counted, ["input_ids"]),
        K.filter_report(counted.withColumn("split", F.lit("a")), K.within_limits(counted, [("input_ids", 2)])),
    ):
        assert "md5" not in lengths._jdf.queryExecution().optimizedPlan().toString()
    assert rows(K.token_length_stats(counted, ["input_ids"])) == rows(K.token_length_stats(features, ["input_ids"]))
    masked = K.build_token_features(df, train_only_on_prompt=True, mask="all")
    assert K.filter_by_length(masked, [("input_ids", None)], labels="labels").count() == 0
    limits = [("prompt_code", None), ("input_ids", 2)]
    assert K.filter_by_length(features, limits).count() == 2
    limits = [("prompt_code", 3), ("input_ids", 1)]
    assert K.filter_by_length(features, limits, "chained").count() == 4
    report = K.filter_report(features.withColumn("split", F.lit("a")), F.size("input_ids") <= 2).first()
    assert (report["dropped"], report["total"], report["percentage"]) == (2, 4, 50.0)


def test_sampled_best_takes_tasks_by_its_draws(spark, monkeypatch):
    """Draws are shuffled once, into as many parts as they need; nothing sorts them where they are made."""
    monkeypatch.setattr(M, "DRAWS_A_TASK", 90)
    data = [(i, i % 7, float(i % 5), i % 3 == 0) for i in range(900)]
    df = spark.createDataFrame(data, SCORED)
    got = M.best_of_n_sampled(df, (1, 4, 200), trials=3)
    assert {r["n"]: r["solve_rate"] for r in got.collect()} == pytest.approx(sampled_by_sorting(df, (1, 4, 200), 3))
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    parts = [line for line in plan if "REPARTITION_BY_NUM" in line]
    assert parts and all(", 30)" in line for line in parts)
    # The rows, their draws, and the counts of the buckets: one shuffle each, read again by reference.
    assert sum("Reused" not in line for line in parts) == 3
    made = next(i for i, line in enumerate(plan) if "Generate explode" in line and "[trial" in line)
    nearest = next(line for line in reversed(plan[:made]) if "Exchange" in line or "Sort" in line)
    assert "REPARTITION_BY_NUM" in nearest


def test_sampled_best_broadcasts_no_draws(spark):
    """A table that looks small before it is repeated per trial: its draws are still joined by a shuffle."""
    df = spark.createDataFrame([(i, i % 7, float(i % 5), i % 3 == 0) for i in range(300)], SCORED)
    got = M.best_of_n_sampled(df, (1, 4), trials=3)
    got.collect()
    joins = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [" in line]
    assert any("SortMergeJoin [data_id" in line for line in joins)
    assert not any("BroadcastHashJoin [data_id" in line for line in joins)
