"""Cells that hold Python literals, parsed on the JVM.

Lists of dicts of strings, as Python writes them, are JSON but for their quotes and some escapes: the
JSON reader takes single quotes, and the escapes of both languages that mean the same. A cell is
read that way if nothing but strings, brackets, commas and colons is in it and each escape is one of
those. Other cells (bare words, numbers, \\x, \\U, octal or named escapes, joined strings) go through
Python's own parser, batch by batch.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_JSON = {
    "allowSingleQuotes": "true",
    "allowBackslashEscapingAnyCharacter": "true",
    "allowUnquotedControlChars": "true",
    "mode": "PERMISSIVE",
}


def is_plain(cell: Column) -> Column:
    """Whether the JSON reader gets the same value from a cell as Python's parser."""
    single = F.regexp_replace(cell, r"\\\\", "")
    odd_escape = single.rlike(r"""\\[^'"nrtbfu]""") | single.rlike(r"\\u(?![0-9a-fA-F]{4})")
    # Without escapes, a string ends at the next quote like its first.
    shape = F.regexp_replace(F.regexp_replace(cell, r"(?s)\\.", ""), r"""'[^']*'|"[^"]*\"""", "S")
    return ~odd_escape & shape.rlike(r"^[\s\[\]{},:S]*$") & ~shape.rlike(r"S\s*S|,\s*[\]}]")


def _python_parser(kind: T.DataType):
    @F.pandas_udf(kind)
    def parse(cells: pd.Series) -> pd.Series:
        return cells.map(lambda c: ast.literal_eval(c) if isinstance(c, str) else None)

    return parse


def parse_literal(cell: Column, kind: T.DataType) -> Column:
    """The value of a literal cell: null for a null cell, an error for one that is no literal."""
    plain = is_plain(cell)
    return F.when(plain, F.from_json(cell, kind, _JSON)).otherwise(_python_parser(kind)(F.when(~plain, cell)))
