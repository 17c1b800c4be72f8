"""Text expressions against plain string handling, on many generated texts with odd line
ends, blanks, quotes and fences."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from trajmill.functions import code as K
from trajmill.functions import messages as X

PIECES = [
    "```python\n", "```", "```python", "def f(a):", "  def g (b, c) :", "def __init__(self):",
    "assert True", "assert f(1) == 1", "assert ", "x = 1", "\n", "\r", "\r\n", " ", "\x85",
    "\xa0", "　", "\x0b", "\x1c", " ", "\t", "é", "🙂", "'", '"', "\\",
]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randrange(14))) for _ in range(n)]


def apply(spark, rows, schema, *columns):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    named = [c.alias(f"c{n}") for n, c in enumerate(columns)]
    return [tuple(r)[1:] for r in sorted(df.select("i", *named).collect())]


def fenced_parts(text):
    opening, parts, at = "```python\n", [], 0
    while (start := text.find(opening, at)) >= 0:
        end = text.find("```", start + len(opening))
        if end < 0:
            break
        parts.append(text[start + len(opening) : end].strip())
        at = end + 3
    return parts


def test_code_blocks_and_strip(spark):
    given = texts(400, 1)
    got = apply(spark, [(t,) for t in given], "t string", K.code_blocks(F.col("t")), X.strip(F.col("t")))
    for text, (blocks, stripped) in zip(given, got, strict=True):
        assert blocks == fenced_parts(text), repr(text)
        assert stripped == text.strip(), repr(text)


def first_header(text):
    at = 0
    while (start := text.find("def ", at)) >= 0:
        end = text.find(":", start)
        if end < 0:
            return None
        at = end + 1
        if text.find("__init__", start, at) < 0:
            return text[start:at]
    return None


def test_signature_span(spark):
    given = texts(400, 2)
    got = apply(spark, [(t,) for t in given], "t string", K.signature_span(F.col("t")))
    for text, (span,) in zip(given, got, strict=True):
        assert span == first_header(text), repr(text)


def visible_assert(example):
    """The second assert of the lines that have a line end, else the first, else None."""
    found = [
        line[line.index("assert ") :]
        for line in example.split("\n")[:-1]
        if line.partition("assert ")[2]
    ]
    return next(iter(found[1:] or found), None)


@pytest.mark.parametrize("entry", [None, "f"])
def test_split_humaneval(spark, entry):
    given = list(zip(texts(400, 3), texts(400, 4), strict=True))
    point = None if entry is None else F.lit(entry)
    columns = K.split_tests_humaneval(F.col("e"), F.col("t"), point)
    got = apply(spark, given, "e string, t string", *columns)
    chosen = 0
    for (example, test), (public, private) in zip(given, got, strict=True):
        example, test = example.strip(), test.strip()
        shown = visible_assert(example)
        if shown is None:
            assert (public, private) == (example, test)
            continue
        chosen += 1
        before, _, after = example.partition(shown)
        hidden = (before + after).strip()
        if entry is None:
            assert public == shown.strip()
            assert private.splitlines() == (hidden + "\n" + test).splitlines()
            assert private.endswith(test) and private.startswith(hidden)
        else:
            assert public == example
            assert private == test + "\ncheck(f)\n" + hidden
    assert chosen > 50


def test_quoted_evaluates_to_the_text(spark):
    given = texts(400, 5)
    got = apply(spark, [(t,) for t in given], "t string", K.quoted(F.col("t")))
    for text, (literal,) in zip(given, got, strict=True):
        assert eval(literal) == text  # noqa: S307 - our own literal


def test_shared_prefix(spark):
    rng = random.Random(6)
    given = []
    for a, b in zip(texts(400, 7), texts(400, 8), strict=True):
        head = "".join(rng.choices("ab🙂", k=rng.randrange(40)))
        given.append((head + a, head + b))
    got = apply(spark, given, "a string, b string", X.shared_prefix(F.col("a"), F.col("b")))
    for (a, b), (prefix,) in zip(given, got, strict=True):
        same = itertools.takewhile(lambda z: z[0] == z[1], zip(a, b, strict=False))
        assert prefix == "".join(z[0] for z in same)


@pytest.mark.parametrize("keep_first", [False, True])
def test_combine_roles(spark, keep_first):
    rng = random.Random(9)
    given = [
        ([(rng.choice("uas"), rng.choice("xyz")) for _ in range(rng.randrange(9))],) for _ in range(200)
    ]
    schema = "m array<struct<role:string,content:string>>"
    got = apply(spark, given, schema, X.combine_roles(F.col("m"), keep_first))
    for (messages,), (merged,) in zip(given, got, strict=True):
        alone = messages[:1] if keep_first else []
        runs = itertools.groupby(messages[len(alone) :], key=lambda m: m[0])
        want = alone + [(role, "\n".join(c for _, c in run)) for role, run in runs]
        assert [tuple(m) for m in merged] == want
