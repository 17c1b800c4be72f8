"""Problem tables: prompts, test splits, canonical answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajmill import constants as C
from trajmill.functions import code as K
from trajmill.functions.messages import message


def _need_known(dataset: str) -> None:
    if dataset not in C.BENCHMARKS:
        raise ValueError(f"unsupported dataset {dataset!r}")


def split_tests(df: DataFrame, dataset: str, literal: bool = False) -> DataFrame:
    """Add ``public_code`` and ``private_code`` by the rules of the problem family."""
    _need_known(dataset)
    col = F.col
    if dataset in ("mbpp", "mbpp_train"):
        split = K.split_tests_mbpp if dataset == "mbpp" else K.split_tests_mbpp_train
        parts = split(
            col("test_setup_code"), col("test_list"), col("challenge_test_list"), literal
        )
    elif dataset == "evalplus/mbppplus":
        parts = K.split_tests_mbppplus(col("test_imports"), col("test_list"), col("test"))
    elif dataset == "bigcode/humanevalpack":
        parts = K.split_tests_humaneval(col("example_test"), col("test"))
    elif dataset == "evalplus/humanevalplus":
        parts = K.split_tests_humaneval(col("example_test"), col("test"), col("entry_point"))
    else:
        raise ValueError("contest problems keep their tests as input/output lists")
    return df.withColumns({"public_code": parts[0], "private_code": parts[1]})


def build_prompts(df: DataFrame, dataset: str) -> DataFrame:
    """Add ``initial_prompt``: the statement with its visible tests."""
    _need_known(dataset)
    if dataset == "deepmind/code_contests":
        return build_contest_prompts(df)
    if dataset in ("bigcode/humanevalpack", "evalplus/humanevalplus"):
        prompt = K.prompt_with_tests(F.col("prompt"), F.col("example_test"))
        return df.withColumn("initial_prompt", prompt)
    statement = "prompt" if dataset == "evalplus/mbppplus" else "text"
    tested = split_tests(df, dataset)
    return tested.withColumn(
        "initial_prompt", K.prompt_with_tests(F.col(statement), F.col("public_code"))
    ).drop("public_code", "private_code")


def build_testless_prompts(df: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """Add ``initial_prompt`` with the function header of the solution instead of tests.

    Returns the rows and the rejects whose solution has no usable header.
    """
    header = {"mbpp": K.signature_line, "mbpp_train": K.signature_span}[dataset](F.col("code"))
    rows = df.withColumn("_header", header)
    prompt = K.prompt_without_tests(F.col("text"), F.col("_header"))
    good = rows.where(F.col("_header").isNotNull()).withColumn("initial_prompt", prompt)
    return good.drop("_header"), rows.where(F.col("_header").isNull()).drop("_header")


def build_contest_prompts(df: DataFrame) -> DataFrame:
    return df.withColumn("initial_prompt", K.contest_prompt(F.col("description")))


def filter_missing_public(df: DataFrame) -> DataFrame:
    """Keep problems with at least one public test input."""
    return df.where(F.size("public_tests.input") > 0)


def merge_plus_tests(base: DataFrame, plus: DataFrame, key: str = "data_id") -> DataFrame:
    """Replace the hidden tests of one problem table by those of another, by problem."""
    return base.drop("test").join(plus.select(key, "test"), key)


def canonical_code(dataset: str) -> Column:
    """A known right answer; null where a contest has no Python solution."""
    _need_known(dataset)
    if dataset in ("bigcode/humanevalpack", "evalplus/humanevalplus"):
        return F.concat_ws("\n", "prompt", "canonical_solution")
    if dataset == "deepmind/code_contests":
        at = F.array_position(F.col("solutions.language"), C.CONTEST_PYTHON)
        return F.get(F.col("solutions.code"), (at - 1).cast("int"))
    return F.col("code")


def canonical_rollouts(df: DataFrame, dataset: str) -> DataFrame:
    """One guaranteed-correct rollout per problem that has ``initial_prompt``."""
    done = F.struct(F.lit(C.SUCCESS).alias("public"), F.lit(C.SUCCESS).alias("private"))
    return (
        df.withColumn("_answer", canonical_code(dataset))
        .where(F.col("_answer").isNotNull())
        .select(
            "data_id",
            F.array(message(C.USER, F.col("initial_prompt"))).alias("prompt"),
            F.array(message(C.ASSISTANT, F.col("_answer"))).alias("completion"),
            F.lit(True).alias("label"),
            F.array(done).alias("feedbacks"),
        )
    )


def pending_rollouts(problems: DataFrame, done: DataFrame, rollouts: int) -> DataFrame:
    """``(data_id, rollout_no)`` still to be produced; ``rollouts`` numbers per problem."""
    numbers = F.sequence(F.lit(0).cast("bigint"), F.lit(rollouts - 1).cast("bigint"))
    wanted = problems.select("data_id", F.explode(numbers).alias("rollout_no"))
    found = done.select("data_id", "rollout_no").distinct()
    return wanted.join(found, ["data_id", "rollout_no"], "left_anti")


def rollout_progress(problems: DataFrame, done: DataFrame, batch: int) -> DataFrame:
    """One row: finished rows, problems, full passes, finished batches of the current pass."""
    n_problems = problems.agg(F.count(F.lit(1))).scalar()
    return done.agg(F.count(F.lit(1)).alias("done")).select(
        "done",
        n_problems.alias("problems"),
        F.floor(F.col("done") / n_problems).alias("passes"),
        F.floor(F.col("done") % n_problems / batch).alias("batches"),
        (F.col("done") % n_problems % batch == 0).alias("aligned"),
    )
