"""Problem tables: prompts, test splits, canonical answers, what is still to do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajmill import constants as C
from trajmill.functions import code as K
from trajmill.operators import grading as G
from trajmill.operators import problems as Q
from trajmill.operators.skew import number_by_id
from trajmill.registry import query
from trajmill.registry import tables as t

L = t.text
WS = t.space_sql()
HEAD, TESTS, TAIL = L(C.PROMPT_HEAD), L(C.PROMPT_TESTS), L(C.PROMPT_TESTS_TAIL)
SIG, SIG_TAIL = L(C.PROMPT_SIGNATURE), L(C.PROMPT_SIGNATURE_TAIL)
NL = "chr(10)"
MBPP_PUBLIC = f"test_setup_code||{NL}||test_list[1]"
TRAIN_PUBLIC = f"test_setup_code||{NL}||array_to_string(test_list, {NL})"
PLUS_PUBLIC = f"test_imports||{NL}||test_list[1]"


def _with_tests(statement: str, tests: str) -> str:
    return f"md5({HEAD}||{statement}||{TESTS}||{tests}||{TAIL})"


@query(
    t.sql(
        f"""SELECT 'mbpp' AS dataset, data_id, {_with_tests("text", MBPP_PUBLIC)} AS prompt FROM mbpp
UNION ALL SELECT 'mbpp_train', data_id, {_with_tests("text", TRAIN_PUBLIC)} FROM mbpp
UNION ALL SELECT 'evalplus/mbppplus', data_id, {_with_tests("prompt", PLUS_PUBLIC)} FROM mbppplus
UNION ALL SELECT 'bigcode/humanevalpack', data_id, {_with_tests("prompt", "example_test")} FROM humaneval
UNION ALL SELECT 'evalplus/humanevalplus', data_id, {_with_tests("prompt", "example_test")} FROM humaneval""",
        "mbpp",
        "mbppplus",
        "humaneval",
    )
)
def build_prompts(spark, sf):
    parts = [
        Q.build_prompts(t.problems(spark, sf, d), d).select(
            F.lit(d).alias("dataset"), "data_id", F.md5("initial_prompt").alias("prompt")
        )
        for d in C.BENCHMARKS
        if d != "deepmind/code_contests"
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


LINE = r"regexp_extract(code, '(?m)^\s*def\s+[a-zA-Z_][a-zA-Z0-9_]*\s*\(.*?\)\s*:', 0)"
SPAN = r"list_filter(regexp_extract_all(code, '(?s)(def\s+.*?:)', 1), lambda s: NOT contains(s, '__init__'))[1]"


def _testless_sql(header: str, missing: str) -> str:
    prompt = f"{HEAD}||text||{SIG}||h||{SIG_TAIL}"
    return t.sql(
        f"""SELECT data_id, coalesce(md5(CASE WHEN {missing} THEN NULL ELSE {prompt} END), '') AS prompt
FROM (SELECT *, {header} AS h FROM mbpp)""",
        "mbpp",
    )


def _testless(spark, sf, dataset):
    rows, rejects = Q.build_testless_prompts(t.problems(spark, sf, dataset), dataset)
    good = rows.select("data_id", F.md5("initial_prompt").alias("prompt"))
    return good.unionByName(rejects.select("data_id", F.lit("").alias("prompt")))


@query(_testless_sql(LINE, "h = ''"))
def build_testless_prompts(spark, sf):
    return _testless(spark, sf, "mbpp")


@query(_testless_sql(SPAN, "h IS NULL"))
def build_testless_prompts_train(spark, sf):
    return _testless(spark, sf, "mbpp_train")


@query(
    t.sql(
        f"SELECT data_id, md5({L(C.CONTEST_HEAD)}||description||{L(C.CONTEST_TAIL)}) AS prompt FROM contests",
        "contests",
    )
)
def build_contest_prompts(spark, sf):
    rows = Q.build_contest_prompts(t.problems(spark, sf, "deepmind/code_contests"))
    return rows.select("data_id", F.md5("initial_prompt").alias("prompt"))


@query(t.sql("SELECT data_id, len(pub_in)::INT AS n FROM contests WHERE len(pub_in) > 0", "contests"))
def filter_missing_public(spark, sf):
    rows = Q.filter_missing_public(t.problems(spark, sf, "deepmind/code_contests"))
    return rows.select("data_id", F.size("public_tests.input").alias("n"))


def _split(spark, sf, dataset, literal=False):
    rows = Q.split_tests(t.problems(spark, sf, dataset), dataset, literal)
    return rows.select(
        "data_id",
        F.md5("public_code").alias("public_code"),
        F.coalesce(F.md5("private_code"), F.lit("none")).alias("private_code"),
    )


EXTRA = f"array_to_string(challenge_test_list, {NL})"
LITERAL = L(str(["assert f(-1) == -1", 'assert f("it\'s")']))
REST = f"array_to_string(test_list[2:], {NL})"


def _mbpp_sql(extra: str) -> str:
    return t.sql(
        f"""SELECT data_id, md5({MBPP_PUBLIC}) AS public_code,
  md5(test_setup_code||{NL}||{REST}||CASE WHEN len(challenge_test_list) > 0 THEN {NL}||{extra} ELSE '' END) AS private_code
FROM mbpp""",
        "mbpp",
    )


@query(_mbpp_sql(EXTRA))
def split_tests_mbpp(spark, sf):
    return _split(spark, sf, "mbpp")


@query(_mbpp_sql(LITERAL))
def split_tests_mbpp_literal(spark, sf):
    return _split(spark, sf, "mbpp", literal=True)


@query(
    t.sql(
        f"""SELECT data_id, md5({TRAIN_PUBLIC}) AS public_code,
  CASE WHEN len(challenge_test_list) > 0 THEN md5(test_setup_code||{NL}||{EXTRA}) ELSE 'none' END AS private_code
FROM mbpp""",
        "mbpp",
    )
)
def split_tests_mbpp_train(spark, sf):
    return _split(spark, sf, "mbpp_train")


@query(
    t.sql(
        f"""SELECT data_id, md5({PLUS_PUBLIC}) AS public_code,
  md5(test_imports||{NL}||{REST}||{NL}||test) AS private_code FROM mbppplus""",
        "mbppplus",
    )
)
def split_tests_mbppplus(spark, sf):
    return _split(spark, sf, "evalplus/mbppplus")


# Assert lines followed by a line end; SQL regular expressions know no look-ahead.
ASSERTS = f""", a AS (SELECT *, trim(example_test, {WS}) AS pub, trim(test, {WS}) AS priv,
  trim(plus_test, {WS}) AS plus_priv FROM humaneval),
b AS (SELECT *, list_transform(regexp_extract_all(pub, 'assert [^\\n]+\\n'), lambda x: x[1:-2]) AS asserts FROM a),
c AS (SELECT *, asserts[least(2, len(asserts))] AS chosen FROM b),
d AS (SELECT *, trim(CASE WHEN chosen IS NULL THEN pub ELSE left(pub, instr(pub, chosen) - 1)
  ||substr(pub, instr(pub, chosen) + length(chosen)) END, {WS}) AS rest FROM c)"""


@query(
    t.sql(
        f"""{ASSERTS}
SELECT data_id, md5(coalesce(trim(chosen, {WS}), pub)) AS public_code,
  md5(CASE WHEN chosen IS NULL THEN priv ELSE rest||{NL}||priv END) AS private_code FROM d""",
        "humaneval",
    )
)
def split_tests_humaneval(spark, sf):
    return _split(spark, sf, "bigcode/humanevalpack")


@query(
    t.sql(
        f"""{ASSERTS}
SELECT data_id, md5(pub) AS public_code, md5(CASE WHEN chosen IS NULL THEN plus_priv
  ELSE plus_priv||{NL}||'check('||entry_point||')'||{NL}||rest END) AS private_code FROM d""",
        "humaneval",
    )
)
def split_tests_humaneval_plus(spark, sf):
    return _split(spark, sf, "evalplus/humanevalplus")


@query(
    t.sql(
        f"SELECT data_id, md5(prompt) AS prompt, md5(plus_test) AS test FROM humaneval", "humaneval"
    )
)
def merge_plus_tests(spark, sf):
    base = t.problems(spark, sf, "bigcode/humanevalpack")
    plus = t.problems(spark, sf, "evalplus/humanevalplus")
    merged = Q.merge_plus_tests(base, plus)
    return merged.select("data_id", F.md5("prompt").alias("prompt"), F.md5("test").alias("test"))


ANSWER = "[{'role': 'assistant', 'content': ?}]"
# The right answer of each family, and the table it is in.
CANONICAL = [
    ("mbpp", "code", "mbpp"),
    ("mbpp_train", "code", "mbpp"),
    ("evalplus/mbppplus", "code", "mbppplus"),
    ("bigcode/humanevalpack", "prompt||chr(10)||canonical_solution", "humaneval"),
    ("evalplus/humanevalplus", "prompt||chr(10)||canonical_solution", "humaneval"),
    ("deepmind/code_contests", "codes[list_position(langs, 1)]", "contests WHERE list_contains(langs, 1)"),
]


@query(
    t.sql(
        "UNION ALL ".join(
            f"SELECT '{name}' AS dataset, data_id, {t.digest_sql(ANSWER.replace('?', answer))} AS completion FROM {source} "
            for name, answer, source in CANONICAL
        ),
        "mbpp",
        "mbppplus",
        "humaneval",
        "contests",
    )
)
def canonical_rollouts(spark, sf):
    def part(dataset):
        prompted = Q.build_prompts(t.problems(spark, sf, dataset), dataset)
        rows = Q.canonical_rollouts(prompted, dataset)
        return rows.select(F.lit(dataset).alias("dataset"), "data_id", t.digest("completion").alias("completion"))

    return reduce(DataFrame.unionByName, [part(name) for name, _, _ in CANONICAL])


def _quote_sql(x: str) -> str:
    body = (
        f"replace(replace(replace(replace({x}, chr(92), chr(92)||chr(92)), chr(10), chr(92)||'n'), "
        "chr(13), chr(92)||'r'), chr(9), chr(92)||'t')"
    )
    return (
        f"CASE WHEN contains({x}, '''') AND NOT contains({x}, '\"') THEN '\"'||{body}||'\"' "
        f"ELSE ''''||replace({body}, '''', chr(92)||'''')||'''' END"
    )


@query(
    t.sql(
        f"""SELECT data_id, md5(array_to_string(list_transform(list_zip(pub_in, pub_out),
  lambda z: 'assert solve('||{_quote_sql("z[1]")}||') == '||{_quote_sql("z[2]")}), chr(10))) AS tests FROM contests""",
        "contests",
    )
)
def build_assert_tests(spark, sf):
    lines = K.assert_lines(F.lit("solve"), F.col("public_tests.input"), F.col("public_tests.output"))
    return t.problems(spark, sf, "deepmind/code_contests").select("data_id", F.md5(lines).alias("tests"))


IMPORTS = L("\n".join(C.IMPORTS) + "\n")


@query(
    t.sql(
        f"""SELECT 'mbpp' AS dataset, data_id,
  md5({IMPORTS}||code||{NL}||{MBPP_PUBLIC}||{NL}||'print(''done '||data_id||''')') AS program FROM mbpp
UNION ALL SELECT 'bigcode/humanevalpack', data_id, md5({IMPORTS}||'import os'||{NL}||{NL}||{NL}||{NL}
  ||canonical_solution||{NL}||test||{NL}||'print(''done '||data_id||''')') FROM humaneval""",
        "mbpp",
        "humaneval",
    )
)
def compose_program(spark, sf):
    done = F.concat(F.lit("done "), "data_id")
    plain = Q.split_tests(t.problems(spark, sf, "mbpp"), "mbpp").select(
        F.lit("mbpp").alias("dataset"),
        "data_id",
        F.md5(K.compose_program(F.col("code"), F.col("public_code"), done)).alias("program"),
    )
    program = K.compose_program(
        F.col("canonical_solution"), F.col("test"), done, F.col("prompt"), F.col("entry_point")
    )
    headed = t.problems(spark, sf, "bigcode/humanevalpack").select(
        F.lit("bigcode/humanevalpack").alias("dataset"), "data_id", F.md5(program).alias("program")
    )
    return plain.unionByName(headed)


DONE = """, r AS (SELECT data_id, ID, row_number() OVER (PARTITION BY data_id ORDER BY ID) - 1 AS no FROM rollouts_ev),
p AS (SELECT DISTINCT user_id AS data_id FROM events)"""


def _done(spark, sf):
    rows = t.rollouts_ev(spark, sf).select("data_id", "ID")
    return number_by_id(rows, ["data_id"], "ID", "rollout_no")


def _people(spark, sf):
    return t.table(spark, sf, "events").select(F.col("user_id").alias("data_id")).distinct()


@query(
    t.sql(
        f"""{DONE}
SELECT data_id, no AS rollout_no FROM p, (SELECT unnest(range(0, 80)) AS no) x
EXCEPT ALL SELECT data_id, no FROM r WHERE no < 80""",
        "rollouts_ev",
    )
)
def pending_rollouts(spark, sf):
    return Q.pending_rollouts(_people(spark, sf), _done(spark, sf), 80)


@query(
    t.sql(
        f"""{DONE}, n AS (SELECT (SELECT count(*) FROM rollouts_ev) AS done, (SELECT count(*) FROM p) AS problems)
SELECT done, problems, done // problems AS passes, (done % problems) // 16 AS batches,
  done % problems % 16 = 0 AS aligned FROM n""",
        "rollouts_ev",
    )
)
def rollout_progress(spark, sf):
    return Q.rollout_progress(_people(spark, sf), _done(spark, sf), 16)


@query(
    t.sql(
        """SELECT r.ID, r.data_id, r.reward, md5('problem '||r.data_id) AS statement FROM rollouts_ev r""",
        "rollouts_ev",
    )
)
def attach_problem(spark, sf):
    statements = _people(spark, sf).select(
        "data_id", F.md5(F.concat(F.lit("problem "), "data_id")).alias("statement")
    )
    rows = t.rollouts_ev(spark, sf).select("ID", "data_id", "reward")
    return G.attach_problem(rows, statements, ["data_id"])
