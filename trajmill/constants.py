"""Texts, word lists and patterns that results depend on."""

# --- fixed values ---------------------------------------------------------

SUCCESS = "Code passed all tests"

ASSISTANT = "assistant"
USER = "user"

FEEDBACK_PREFIX = "Feedback: "
RESPONSE_MARKER = "<|response|>"
FENCE_OPEN = "```python\n"
CODE_BLOCK = "(?s)```python\n(.*?)```"

# Characters removed from both ends when code and tests are stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

ASSERT_LINE = r"(?d)assert .+?(?=\n)"
SIGNATURE_LINE = r"(?md)^\s*def\s+[a-zA-Z_][a-zA-Z0-9_]*\s*\(.*?\)\s*:"
SIGNATURE_SPAN = r"(?s)(def\s+.*?:)"
CHECKPOINT_NAME = r"^checkpoint-([0-9]+)$"

IMPORTS = [
    "import math",
    "import re",
    "import copy",
    "import datetime",
    "import itertools",
    "import collections",
    "import heapq",
    "import functools",
    "import hashlib",
    "import numpy",
    "import numpy as np",
    "import string",
    "from typing import *",
    "from collections import *",
    "import os",
    "import sys",
]

PROMPT_HEAD = "Write a Python function implementation for the following prompt:\n\n"
PROMPT_TESTS = "\n\nYour code should satisfy these tests:\n\n"
PROMPT_TESTS_TAIL = (
    "\n\nReturn only the implementation code, no tests or explanations. "
    "Be sure to include the relevant import statements:\n"
    "```python\ncode\n```\n"
)
PROMPT_SIGNATURE = "\n\nYour code should use the following function definition:\n\n"
PROMPT_SIGNATURE_TAIL = (
    "\n\nPlease follow the following instructions:\n"
    "- Reason about the problem and any base cases before writing the code.\n"
    "- You must return the implementation code in the following format:\n"
    "```python\n<CODE GOES HERE>\n```\n"
    "- You must only return a single code block since we only parse the first code block.\n"
    "- Do not include any tests in your code - we will run the suite and return any error feedback.\n"
    "- Include relevant import statements.\n"
)
CONTEST_HEAD = (
    "\nProvide a Python solution for the following competitive programming question: \\$"
)
CONTEST_TAIL = (
    ".\nYour code should be enclosed in triple backticks like so: "
    "```python YOUR CODE HERE```. Use the backticks for your code only.\n"
)

# Language code of Python 2/3 solutions in the contest tables.
CONTEST_PYTHON = 1

IGNORE_LABEL = -100

# Benchmark names accepted by scan_problems, with the splits each one has.
BENCHMARKS = {
    "mbpp": ("train", "validation", "test"),
    "mbpp_train": ("train", "validation", "test"),
    "evalplus/mbppplus": ("test",),
    "bigcode/humanevalpack": ("test",),
    "evalplus/humanevalplus": ("test",),
    "deepmind/code_contests": ("train_1k", "validation", "test"),
}

# --- end of fixed values --------------------------------------------------
