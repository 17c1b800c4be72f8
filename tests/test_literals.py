"""Literal cells: the JVM reader against Python's own parser."""

from __future__ import annotations

import ast
import random

import pytest
from pyspark.sql import functions as F

from trajmill import schemas as S
from trajmill.sources import literals

KIND = S.SCORED["prompt"].dataType


def cells(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, cell string")


def values(spark, texts):
    found = cells(spark, texts).select("i", literals.parse_literal(F.col("cell"), KIND).alias("v")).collect()
    return [None if v is None else [m.asDict() for m in v] for _, v in sorted(found, key=lambda r: r[0])]


def plain(spark, texts):
    return [r[1] for r in sorted(cells(spark, texts).select("i", literals.is_plain(F.col("cell"))).collect())]


def message(*contents):
    return [{"role": "user", "content": c} for c in contents]


PIECES = ["'", '"', "\\", "\n", "\t", "\r", "\b", "\f", "n", "u", "é", "🙂", "S", "[", "]", "{", "}", ",", ":", " ", "None", "\\n", "/"]
ODD = ["\x07", "\x00", "\x1b", " ", "\x7f", "\xa0"]


def test_what_python_writes_is_read_as_python_reads_it(spark):
    rng = random.Random(1)
    make = lambda kinds: "".join(rng.choice(kinds) for _ in range(rng.randrange(12)))
    texts = [repr(message(*[make(PIECES) for _ in range(rng.randrange(4))])) for _ in range(400)]
    texts += [repr(message(make(PIECES + ODD), make(PIECES))) for _ in range(200)]
    assert values(spark, texts) == [ast.literal_eval(t) for t in texts]


def test_python_reads_only_what_json_cannot(spark):
    easy = [repr(message("it's", 'say "x"', "a\\b\n\t")), "[]", "[ ]", '[{"role": "user", "content": "\\u00e9"}]', repr(message("S S", "x" * 100000, "\n" * 50000))]
    hard = [repr(message("\x1b")), "[{'role': 'user', 'content': None}]", "[{'role': 'user', 'content': 'a' 'b'}]", "[{'role': 'user', 'content': 'a',},]", r"[{'role': 'user', 'content': '\N{BULLET}\101'}]", "[{'role': u'user', 'content': r'\\d'}]"]
    assert plain(spark, easy) == [True] * len(easy)
    assert plain(spark, hard) == [False] * len(hard)
    assert values(spark, [*easy, *hard]) == [ast.literal_eval(t) for t in [*easy, *hard]]


def test_null_and_broken_cells(spark):
    assert values(spark, [None, repr(message("a"))]) == [None, message("a")]
    with pytest.raises(Exception, match="(?i)syntax|malformed|invalid|literal"):
        values(spark, ["[{'role': user}]"])


def test_no_cell_of_the_tables_needs_python(spark, sf):
    from trajmill.registry import tables
    from trajmill.sources import sinks

    rows = tables.trajectories(spark, sf).select(sinks.literal_cell(F.col("prompt")).alias("cell"))
    assert rows.where(~literals.is_plain(F.col("cell"))).count() == 0
