"""Table shapes, declared once."""

from __future__ import annotations

from pyspark.sql import types as T

from trajmill import constants as C

MESSAGE = T.StructType(
    [T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]
)
MESSAGES = T.ArrayType(MESSAGE)
FEEDBACKS = T.ArrayType(
    T.StructType(
        [T.StructField("public", T.StringType()), T.StructField("private", T.StringType())]
    )
)
STRINGS = T.ArrayType(T.StringType())
IO_TESTS = T.StructType([T.StructField("input", STRINGS), T.StructField("output", STRINGS)])


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


ROLLOUTS = _struct(
    data_id=T.LongType(),
    prompt=MESSAGES,
    completion=MESSAGES,
    label=T.BooleanType(),
    feedbacks=FEEDBACKS,
)

SCORED = _struct(
    ID=T.LongType(),
    data_id=T.LongType(),
    prompt=MESSAGES,
    completion=MESSAGES,
    prompt_completion=T.StringType(),
    label=T.BooleanType(),
    reward=T.DoubleType(),
    feedbacks=FEEDBACKS,
)

PAIRS = _struct(prompt=MESSAGES, chosen=MESSAGES, rejected=MESSAGES)

_MBPP = _struct(
    data_id=T.LongType(),
    split=T.StringType(),
    text=T.StringType(),
    code=T.StringType(),
    test_setup_code=T.StringType(),
    test_list=STRINGS,
    challenge_test_list=STRINGS,
)
_HUMANEVAL = _struct(
    data_id=T.LongType(),
    split=T.StringType(),
    prompt=T.StringType(),
    canonical_solution=T.StringType(),
    entry_point=T.StringType(),
    example_test=T.StringType(),
    test=T.StringType(),
)

PROBLEMS = {
    "mbpp": _MBPP,
    "mbpp_train": _MBPP,
    "evalplus/mbppplus": _struct(
        data_id=T.LongType(),
        split=T.StringType(),
        prompt=T.StringType(),
        code=T.StringType(),
        test_imports=T.StringType(),
        test=T.StringType(),
        test_list=STRINGS,
    ),
    "bigcode/humanevalpack": _HUMANEVAL,
    "evalplus/humanevalplus": _HUMANEVAL,
    "deepmind/code_contests": _struct(
        data_id=T.LongType(),
        split=T.StringType(),
        description=T.StringType(),
        public_tests=IO_TESTS,
        private_tests=IO_TESTS,
        time_limit=_struct(seconds=T.LongType(), nanos=T.LongType()),
        solutions=_struct(language=T.ArrayType(T.IntegerType()), code=STRINGS),
    ),
}

assert set(PROBLEMS) == set(C.BENCHMARKS)
