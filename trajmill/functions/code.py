"""Fenced code blocks, test splits, programs and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajmill import constants as C
from trajmill.functions.messages import strip


def code_blocks(text: Column) -> Column:
    """Contents of all closed python fences, stripped."""
    return F.transform(F.regexp_extract_all(text, F.lit(C.CODE_BLOCK), F.lit(1)), strip)


def first_code_or_text(text: Column, unclosed: str = "empty") -> Column:
    """First code block, else the whole text.

    A text with only an unclosed fence gives ``""`` (``unclosed="empty"``) or what
    follows the fence (``unclosed="rest"``).
    """
    at = F.locate(C.FENCE_OPEN, text)
    rest = {
        "empty": F.lit(""),
        "rest": strip(F.substr(text, at + len(C.FENCE_OPEN))),
    }[unclosed]
    return F.coalesce(F.get(code_blocks(text), F.lit(0)), F.when(at > 0, rest).otherwise(text))


def format_solution(text: Column) -> Column:
    """First code block, else the whole text."""
    return F.coalesce(F.get(code_blocks(text), F.lit(0)), text)


def first_code_or_empty(text: Column) -> Column:
    return F.coalesce(F.get(code_blocks(text), F.lit(0)), F.lit(""))


def signature_line(code: Column) -> Column:
    """First ``def`` header of a solution; null if there is none."""
    found = F.regexp_extract(code, C.SIGNATURE_LINE, 0)
    return F.when(found != "", found)


def signature_span(code: Column) -> Column:
    """First ``def`` up to a colon that does not mention a constructor; null if none."""
    spans = F.regexp_extract_all(code, F.lit(C.SIGNATURE_SPAN), F.lit(1))
    return F.get(F.filter(spans, lambda s: ~F.contains(s, F.lit("__init__"))), F.lit(0))


def prompt_with_tests(statement: Column, tests: Column) -> Column:
    return F.concat(
        F.lit(C.PROMPT_HEAD),
        statement,
        F.lit(C.PROMPT_TESTS),
        tests,
        F.lit(C.PROMPT_TESTS_TAIL),
    )


def prompt_without_tests(statement: Column, signature: Column) -> Column:
    return F.concat(
        F.lit(C.PROMPT_HEAD),
        statement,
        F.lit(C.PROMPT_SIGNATURE),
        signature,
        F.lit(C.PROMPT_SIGNATURE_TAIL),
    )


def contest_prompt(statement: Column) -> Column:
    return F.concat(F.lit(C.CONTEST_HEAD), statement, F.lit(C.CONTEST_TAIL))


def _lines(tests: Column) -> Column:
    return F.array_join(tests, "\n")


def _tail(tests: Column) -> Column:
    return F.slice(tests, F.lit(2), F.greatest(F.size(tests) - 1, F.lit(0)))


def _list_literal(tests: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(tests, quoted), ", "), F.lit("]"))


def split_tests_mbpp(
    setup: Column, tests: Column, challenge: Column, literal: bool = False
) -> tuple[Column, Column]:
    """Public: set-up and first test. Private: set-up, other tests, challenge tests.

    ``literal`` writes the challenge tests as one list literal instead of lines.
    """
    public = F.concat_ws("\n", setup, F.get(tests, F.lit(0)))
    private = F.concat(setup, F.lit("\n"), _lines(_tail(tests)))
    extra = _list_literal(challenge) if literal else _lines(challenge)
    return public, F.when(F.size(challenge) > 0, F.concat(private, F.lit("\n"), extra)).otherwise(
        private
    )


def split_tests_mbpp_train(
    setup: Column, tests: Column, challenge: Column, literal: bool = False
) -> tuple[Column, Column]:
    """Public: set-up and all tests. Private: set-up and challenge tests, or null."""
    public = F.concat(setup, F.lit("\n"), _lines(tests))
    extra = _list_literal(challenge) if literal else _lines(challenge)
    return public, F.when(F.size(challenge) > 0, F.concat(setup, F.lit("\n"), extra))


def split_tests_mbppplus(imports: Column, tests: Column, test: Column) -> tuple[Column, Column]:
    """Public: imports and first test. Private: imports, other tests, extended test."""
    public = F.concat_ws("\n", imports, F.get(tests, F.lit(0)))
    return public, F.concat(imports, F.lit("\n"), _lines(_tail(tests)), F.lit("\n"), test)


def _without_first(text: Column, part: Column) -> Column:
    at = F.position(part, text)
    return strip(F.concat(F.left(text, at - 1), F.substr(text, at + F.length(part))))


def split_tests_humaneval(
    example_test: Column, test: Column, entry_point: Column | None = None
) -> tuple[Column, Column]:
    """Public: the second assert (or the only one). Private: the rest and hidden tests.

    With ``entry_point`` the public tests stay whole and the private ones are the hidden
    tests, a ``check`` call and the rest. Without any assert both stay as they are.
    """
    public, private = strip(example_test), strip(test)
    asserts = F.regexp_extract_all(public, F.lit(C.ASSERT_LINE), F.lit(0))
    found = F.size(asserts) > 0
    chosen = F.get(asserts, F.least(F.lit(1), F.size(asserts) - 1))
    rest = _without_first(public, chosen)
    if entry_point is None:
        return (
            F.when(found, strip(chosen)).otherwise(public),
            F.when(found, F.concat(rest, F.lit("\n"), private)).otherwise(private),
        )
    check = F.concat(F.lit("\ncheck("), entry_point, F.lit(")\n"))
    return public, F.when(found, F.concat(private, check, rest)).otherwise(private)


def quoted(text: Column) -> Column:
    """A Python string literal: single quotes unless only those occur in the text."""
    body = text
    for char, escape in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(char), F.lit(escape))
    single, double = F.lit("'"), F.lit('"')
    return F.when(
        F.contains(text, single) & ~F.contains(text, double), F.concat(double, body, double)
    ).otherwise(F.concat(single, F.replace(body, single, F.lit("\\'")), single))


def assert_lines(function: Column, inputs: Column, outputs: Column) -> Column:
    """Input/output pairs as ``assert f(in) == out`` lines."""
    n = F.least(F.size(inputs), F.size(outputs))
    lines = F.zip_with(
        F.slice(inputs, F.lit(1), n),
        F.slice(outputs, F.lit(1), n),
        lambda i, o: F.concat(
            F.lit("assert "), function, F.lit("("), quoted(i), F.lit(") == "), quoted(o)
        ),
    )
    return F.array_join(lines, "\n")


def compose_program(
    code: Column,
    tests: Column,
    sentinel: Column,
    statement: Column | None = None,
    entry_point: Column | None = None,
) -> Column:
    """Imports, optional text before the entry point's ``def``, code, tests, sentinel print."""
    imports = "\n".join(C.IMPORTS) + "\n"
    if statement is None:
        head = F.lit(imports)
    else:
        needle = F.concat(F.lit("def "), entry_point)
        before = F.left(statement, F.position(needle, statement) - 1)
        head = F.concat(F.lit(imports), before, F.lit("\n\n"))
    return F.concat(
        head, code, F.lit("\n"), tests, F.lit("\nprint('"), sentinel, F.lit("')")
    )
