"""Edge cases of text, test-split and feedback rules on small inline tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trajmill import constants as C
from trajmill.functions import code as K
from trajmill.functions import feedback as B
from trajmill.functions import messages as X


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def value(df, column):
    return df.select(column.alias("v")).first()["v"]


def fence(text):
    return f"```python\n{text}```"


def test_code_blocks(spark):
    text = f"a {fence(' x = 1 \n')} b {fence('\u00a0y\n\u2003')} c ```python\nopen"
    assert value(one(spark, t=text), K.code_blocks(F.col("t"))) == ["x = 1", "y"]


@pytest.mark.parametrize(
    "text, empty, rest, solution",
    [
        (f"see {fence('x')}", "x", "x", "x"),
        ("see ```python\n x = 1\n", "", "x = 1", "see ```python\n x = 1\n"),
        ("  plain ", "  plain ", "  plain ", "  plain "),
        (fence(""), "", "", ""),
    ],
)
def test_first_code(spark, text, empty, rest, solution):
    df = one(spark, t=text)
    assert value(df, K.first_code_or_text(F.col("t"))) == empty
    assert value(df, K.first_code_or_text(F.col("t"), "rest")) == rest
    assert value(df, K.format_solution(F.col("t"))) == solution


def test_signatures(spark):
    text = "class A:\n    def __init__(self):\n        pass\n\ndef g(a,\n  b):\n    return a"
    df = one(spark, t=text)
    assert value(df, K.signature_span(F.col("t"))) == "def g(a,\n  b):"
    assert value(df, K.signature_line(F.col("t"))) == "    def __init__(self):"
    assert value(one(spark, t="x = 1"), K.signature_line(F.col("t"))) is None
    assert value(one(spark, t="x = 1"), K.signature_span(F.col("t"))) is None


def split(spark, fn, **values):
    df = one(spark, **values)
    public, private = fn(*[F.col(c) for c in values])
    return tuple(df.select(public.alias("a"), private.alias("b")).first())


def test_split_mbpp(spark):
    tests = ["assert f(1)", "assert f(2)", "assert f(3)"]
    got = split(spark, K.split_tests_mbpp, s="import x", t=tests, c=["hard(1)", "hard(2)"])
    assert got == ("import x\nassert f(1)", "import x\nassert f(2)\nassert f(3)\nhard(1)\nhard(2)")
    df = spark.createDataFrame([("", ["a"], [])], "s string, t array<string>, c array<string>")
    public, private = K.split_tests_mbpp(F.col("s"), F.col("t"), F.col("c"))
    assert tuple(df.select(public.alias("p"), private.alias("q")).first()) == ("\na", "\n")
    public, private = K.split_tests_mbpp_train(F.col("s"), F.col("t"), F.col("c"))
    assert tuple(df.select(public.alias("p"), private.alias("q")).first()) == ("\na", None)


def test_split_mbpp_literal(spark):
    df = one(spark, s="", t=["a"], c=["f('x')", 'g("it\'s")'])
    _, private = K.split_tests_mbpp(F.col("s"), F.col("t"), F.col("c"), literal=True)
    assert value(df, private) == "\n\n" + str(["f('x')", 'g("it\'s")'])


def test_split_mbppplus(spark):
    got = split(spark, K.split_tests_mbppplus, i="import x", t=["a", "b"], x="loop")
    assert got == ("import x\na", "import x\nb\nloop")


@pytest.mark.parametrize(
    "example, public, private",
    [
        ("print(1)\n", "print(1)", "hidden"),
        ("\nassert f(1) == 1\nprint(2)\n", "assert f(1) == 1", "print(2)\nhidden"),
        # The last line has no line end once stripped, so it is not an assert to pick.
        ("assert f(1)\nassert f(2)\n", "assert f(1)", "assert f(2)\nhidden"),
        ("assert True\nassert f(2)\nx = 1", "assert f(2)", "assert True\n\nx = 1\nhidden"),
        ("assert f(1)", "assert f(1)", "hidden"),
    ],
)
def test_split_humaneval(spark, example, public, private):
    assert split(spark, K.split_tests_humaneval, e=example, t="\nhidden\n") == (public, private)


def test_split_humaneval_plus(spark):
    got = split(spark, K.split_tests_humaneval, e="assert True\nassert f(2)\nx", t="hidden", p="f")
    assert got == ("assert True\nassert f(2)\nx", "hidden\ncheck(f)\nassert True\n\nx")
    got = split(spark, K.split_tests_humaneval, e="x", t="hidden", p="f")
    assert got == ("x", "hidden")


@pytest.mark.parametrize("text", ["plain", "it's", 'say "x"', "both ' and \"", "a\\b\nc\td\r", "", "é"])
def test_quoted_is_a_python_literal(spark, text):
    assert value(one(spark, t=text), K.quoted(F.col("t"))) == repr(text)


def test_assert_lines(spark):
    df = one(spark, i=["1", "a'b"], o=["2\n", "c", "extra"])
    lines = value(df, K.assert_lines(F.lit("f"), F.col("i"), F.col("o")))
    assert lines == f"assert f({'1'!r}) == {'2\n'!r}\nassert f({chr(34)}a'b{chr(34)}) == 'c'"


def test_compose_program(spark):
    df = one(spark, c="    return 1", t="assert f() == 1", s="import os\n\ndef f():\n", e="f")
    program = value(df, K.compose_program(F.col("c"), F.col("t"), F.lit("ok"), F.col("s"), F.col("e")))
    head = "\n".join(C.IMPORTS) + "\nimport os\n\n\n\n"
    assert program == head + "    return 1\nassert f() == 1\nprint('ok')"


def msgs(*pairs):
    return [{"role": r, "content": c} for r, c in pairs]


MESSAGES = "m array<struct<role:string,content:string>>"


@pytest.mark.parametrize(
    "given, joined, keep_first",
    [
        ([], [], []),
        ([("u", "a")], [("u", "a")], [("u", "a")]),
        (
            [("u", "a"), ("u", "b"), ("u", "c"), ("a", "d"), ("u", "e"), ("u", "f")],
            [("u", "a\nb\nc"), ("a", "d"), ("u", "e\nf")],
            [("u", "a"), ("u", "b\nc"), ("a", "d"), ("u", "e\nf")],
        ),
    ],
)
def test_combine_roles(spark, given, joined, keep_first):
    df = spark.createDataFrame([(msgs(*given),)], MESSAGES)
    for keep, want in ((False, joined), (True, keep_first)):
        got = value(df, X.combine_roles(F.col("m"), keep))
        assert [tuple(m) for m in got] == want


@pytest.mark.parametrize(
    "a, b",
    [("", ""), ("", "x"), ("abc", "abd"), ("abc", "abc"), ("abc", "abcd"), ("é🙂x", "é🙂y"),
     ("x", "y"), ("a" * 1000 + "b", "a" * 1000 + "c"), ("ab" * 333, "ab" * 333)],
)
def test_shared_prefix(spark, a, b):
    want = 0
    while want < min(len(a), len(b)) and a[want] == b[want]:
        want += 1
    df = one(spark, a=a, b=b)
    assert value(df, X.shared_prefix_length(F.col("a"), F.col("b"))) == want
    assert value(df, X.shared_prefix(F.col("a"), F.col("b"))) == a[:want]
    assert value(df, X.response_suffix(F.col("b"), F.lit(want))) == b[want:]


def test_feedback_rules(spark):
    df = spark.createDataFrame(
        [
            (1, None, "out", "err"),
            (2, "", "out", "err"),
            (3, "t", "xx done 7 yy", "err"),
            (4, "t", "done", "err"),
            (5, "t", None, None),
        ],
        "i int, tests string, out string, err string",
    )
    got = df.select(
        "i", B.feedback_from_run(F.col("tests"), F.col("out"), F.col("err"), F.lit("done 7")).alias("f")
    )
    assert dict(map(tuple, got.collect())) == {1: "", 2: "", 3: C.SUCCESS, 4: "err", 5: ""}
    df = one(spark, k="ValueError", m="bad")
    assert value(df, B.error_feedback(F.col("k"), F.col("m"))) == "[Error] ValueError: bad"
    assert value(df, B.error_feedback(F.col("k"), F.lit(""))) == "[Error] ValueError"


def test_time_limits(spark):
    df = spark.createDataFrame(
        [((2, 500000000), (["a", "b"], ["c", "d"])), (None, ([], []))],
        "l struct<seconds:bigint,nanos:bigint>, t struct<input:array<string>,output:array<string>>",
    )
    got = df.select(
        B.time_limit_seconds(F.col("l")).alias("s"), B.time_budget(F.col("l"), F.col("t")).alias("b")
    )
    assert [tuple(r) for r in got.collect()] == [(2.5, 7.5), (1.0, 1.0)]


def test_private_feedback_may_be_empty(spark):
    df = spark.createDataFrame(
        [
            ([{"public": C.SUCCESS, "private": ""}],),
            ([{"public": C.SUCCESS, "private": "x"}],),
            ([{"public": "x", "private": C.SUCCESS}],),
            ([],),
        ],
        "f array<struct<public:string,private:string>>",
    )
    got = df.select(B.all_passed(F.col("f")).alias("a"), B.public_passed(F.col("f")).alias("p"))
    assert [tuple(r) for r in got.collect()] == [
        (True, True), (False, True), (False, False), (False, False),
    ]
