"""Rollout-shaped tables derived from the given ones, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajmill import constants as C
from trajmill.functions.draws import draw
from trajmill.functions.messages import joined
from trajmill.operators import skew
from trajmill.session import new_folder
from trajmill.sources.sinks import write_once

# --- Spark ------------------------------------------------------------------


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def digest(messages: Column | str) -> Column:
    return F.md5(joined(F.col(messages) if isinstance(messages, str) else messages))


def rollouts_ev(spark: SparkSession, sf: str) -> DataFrame:
    """Flat scored rollouts from events."""
    k = F.get_json_object("props", "$.k").cast("int")
    good = F.col("event_type").isin("purchase", "signup")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("ID"),
        F.col("user_id").alias("data_id"),
        (F.col("value") - 35.0).alias("reward"),
        good.alias("label"),
        k.alias("k"),
        F.when(k >= 50, C.SUCCESS).otherwise("AssertionError").alias("public"),
        F.when(good, C.SUCCESS).when(k % 10 == 0, "").otherwise("AssertionError").alias("private"),
    )


def feedback_column() -> Column:
    return F.array(F.struct(F.col("public"), F.col("private")))


def beam(spark: SparkSession, sf: str) -> DataFrame:
    """Every rollout dealt to 3 turns and 5 searches, with a prompt of that turn's length."""
    dealt = skew.number_by_id(rollouts_ev(spark, sf), ["data_id"], "ID", "o")
    earlier = F.sequence(F.lit(1), F.col("turn") - 1)
    edited = F.when(F.col("k") % 20 == 0, " edited").otherwise("")

    def exchange(t: Column) -> Column:
        step = t.cast("string")
        return F.array(
            F.struct(F.lit("assistant").alias("role"), F.concat(F.lit("step "), step, edited).alias("content")),
            F.struct(F.lit("user").alias("role"), F.concat(F.lit("Feedback: "), step).alias("content")),
        )

    first = F.array(
        F.struct(F.lit("user").alias("role"), F.concat(F.lit("problem "), "data_id").alias("content"))
    )
    answer = F.struct(
        F.lit("assistant").alias("role"), F.concat(F.lit("code "), "ID").alias("content")
    )
    twice = F.when(F.col("k") % 33 == 0, 2).otherwise(1)
    later = F.when(F.col("turn") > 1, F.flatten(F.transform(earlier, exchange))).otherwise(
        F.slice(first, 1, 0)
    )
    prompt = F.concat(first, later)
    return (
        dealt.withColumn("turn", (F.col("o") % 3 + 1).cast("int"))
        .withColumn("search_id", (F.floor(F.col("o") / 3) % 5).cast("int"))
        .withColumn("prompt", F.when(F.col("k") % 30 == 0, F.concat(first, prompt)).otherwise(prompt))
        .withColumn("completion", F.array_repeat(answer, twice))
        .withColumn(
            "feedbacks",
            F.flatten(F.array_repeat(feedback_column(), F.when(F.col("k") % 50 == 0, 2).otherwise(1))),
        )
        .drop("o")
    )


def trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """Nested rollouts from whole conversations, one row each, as a prompt is one array.

    The last assistant message is the answer, what precedes it the prompt, system messages
    included. Messages after it are feedback like those to the assistant's. A conversation
    without an answer is a prompt with an empty one and no feedback.
    """
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    conv = (
        table(spark, sf, "conversations")
        .groupBy("conv_id")
        .agg(
            F.array_sort(F.collect_list(turn)).alias("log"),
            F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("last"),
        )
    )
    last = F.col("last")
    answer = F.get(F.filter("log", lambda t: t["turn"] == last), F.lit(0))["content"]
    text = F.coalesce(answer, F.lit(""))
    fenced = (
        F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Answer:\n```python\n"), text, F.lit("\n```\nDone")))
        .when(F.col("conv_id") % 3 == 1, F.concat(F.lit("Answer:\n```python\n"), text))
        .otherwise(text)
    )

    def plain(t: Column) -> Column:
        return F.struct(t["role"].alias("role"), t["content"].alias("content"))

    def feedback(t: Column) -> Column:
        n = F.length(t["content"])
        public = F.when(n % 2 == 0, C.SUCCESS).otherwise(F.concat(F.lit("AssertionError: "), n))
        private = F.when(n % 3 == 0, "").when(n % 3 == 1, C.SUCCESS).otherwise("AssertionError")
        return F.struct(public.alias("public"), private.alias("private"))

    data_id = F.col("conv_id") % 5
    first = F.struct(
        F.lit("user").alias("role"), F.concat(F.lit("problem "), data_id).alias("content")
    )
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    joined_labels = conv.join(labels, conv["conv_id"] == labels["doc_id"], "left")
    return joined_labels.select(
        F.col("conv_id").alias("ID"),
        data_id.alias("data_id"),
        F.concat(
            F.array(first),
            F.transform(F.filter("log", lambda t: last.isNull() | (t["turn"] < last)), plain),
        ).alias("prompt"),
        F.array(F.struct(F.lit("assistant").alias("role"), fenced.alias("content"))).alias("completion"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("label"),
        ((draw("rw", F.col("conv_id")) % 2000 - 1000) / 100.0).alias("reward"),
        F.transform(
            F.filter("log", lambda t: (t["role"] == "assistant") | (t["turn"] > last)), feedback
        ).alias("feedbacks"),
    )


def stored_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a written table, for operators that read some columns several times."""
    return write_once(trajectories(spark, sf), new_folder(spark, "trajectories"))


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    """All messages of each conversation, whatever it ends with."""
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    log = F.array_sort(F.collect_list(turn))
    return (
        table(spark, sf, "conversations")
        .groupBy(F.col("conv_id").alias("ID"))
        .agg(
            F.transform(
                log, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))
            ).alias("conversation")
        )
    )


def doc_rollouts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    # A document without a label is not right.
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("ID"),
        F.col("source").alias("data_id"),
        F.log("n_chars").alias("reward"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("label"),
    )


def doc_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as one-message prompts with a short completion."""
    docs = skew.spread_rows(table(spark, sf, "documents"), "doc_id")
    return docs.select(
        F.col("doc_id").alias("ID"),
        F.col("lang").alias("split"),
        F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("prompt"),
        F.array(
            F.struct(
                F.lit("assistant").alias("role"), F.concat_ws(" ", "source", "lang").alias("content")
            )
        ).alias("completion"),
    )


def _pick(n: int, *values: str) -> Column:
    i = F.col("item_id") % n
    out = F.lit(values[-1])
    for at, value in reversed(list(enumerate(values[:-1]))):
        out = F.when(i == at, value).otherwise(out)
    return out


CODES = (
    "def f(x):\n    return x",
    "class A:\n    def __init__(self):\n        self.n = 1\n\ndef g(a, b = 2) :\n    return a",
    "import math\n\n  def h (y):\n   return y",
    "x = 1",
)
EXAMPLES = (
    "print(1)\n",
    "\nassert f(1) == 1\nprint(2)\n",
    "def check(f):\n    assert True\n    assert f(1) == 1\n    assert f(2) == 2\n",
    "assert f(1)",
)
SPLITS = ("train", "validation", "test")


def problems(spark: SparkSession, sf: str, dataset: str) -> DataFrame:
    """Benchmark items as problems of one family."""
    items = table(spark, sf, "benchmark")
    i = F.col("item_id")
    code = _pick(4, *CODES)
    tests = F.array(
        F.concat(F.lit("assert f("), i, F.lit(") == "), i),
        F.concat(F.lit("assert f("), i + 1, F.lit(") == "), i + 1),
        F.lit("assert f('a') == \"b\""),
    )
    if dataset in ("mbpp", "mbpp_train"):
        challenge = F.array(F.lit("assert f(-1) == -1"), F.lit("assert f(\"it's\")"))
        return items.select(
            i.alias("data_id"),
            _pick(3, *SPLITS).alias("split"),
            "text",
            code.alias("code"),
            _pick(2, "", "import math").alias("test_setup_code"),
            tests.alias("test_list"),
            F.when(i % 3 == 0, F.slice(challenge, 1, 0)).otherwise(challenge).alias("challenge_test_list"),
        )
    if dataset == "evalplus/mbppplus":
        return items.select(
            i.alias("data_id"),
            F.lit("test").alias("split"),
            F.col("text").alias("prompt"),
            code.alias("code"),
            _pick(2, "", "import math").alias("test_imports"),
            F.concat(F.lit("for x in range(9):\n    assert f(x) == x # "), i).alias("test"),
            tests.alias("test_list"),
        )
    if dataset in ("bigcode/humanevalpack", "evalplus/humanevalplus"):
        plus = F.lit("plus " if dataset == "evalplus/humanevalplus" else "")
        entry = F.concat(F.lit("f"), i)
        return items.select(
            i.alias("data_id"),
            F.lit("test").alias("split"),
            F.concat(
                F.lit("import os\n\ndef "), entry, F.lit('(x):\n    """'), "text", F.lit('"""\n')
            ).alias("prompt"),
            F.lit("    return x").alias("canonical_solution"),
            entry.alias("entry_point"),
            _pick(4, *EXAMPLES).alias("example_test"),
            F.concat(F.lit("\n\nassert f(3) == 3\n"), plus, "text").alias("test"),
        )
    sentences = F.split("text", r"\. ")
    lengths = F.transform(sentences, lambda s: F.concat(F.length(s), F.lit("\n")))
    none = F.slice(F.array(F.lit("")), 1, 0)
    empty = i % 5 == 0
    return items.select(
        i.alias("data_id"),
        _pick(3, "train_1k", "validation", "test").alias("split"),
        F.col("text").alias("description"),
        F.struct(
            F.when(empty, none).otherwise(sentences).alias("input"),
            F.when(empty, none).otherwise(lengths).alias("output"),
        ).alias("public_tests"),
        F.struct(
            F.array(F.col("text")).alias("input"),
            F.array(F.length("text").cast("string")).alias("output"),
        ).alias("private_tests"),
        F.when(
            i % 2 == 1,
            F.struct((i % 7).alias("seconds"), F.lit(500000000).cast("bigint").alias("nanos")),
        ).alias("time_limit"),
        F.struct(
            F.when(i % 4 == 3, F.array(F.lit(3), F.lit(2)))
            .otherwise(F.array(F.lit(2), F.lit(1), F.lit(1)))
            .alias("language"),
            F.array(
                F.lit("int main() {}"), F.concat(F.lit("print("), i, F.lit(")")), F.lit("pass")
            ).alias("code"),
        ).alias("solutions"),
    )


def graded_problems(spark: SparkSession, sf: str) -> DataFrame:
    """A contest problem for every prompt of the events."""
    d = F.col("data_id")

    def side(n: int) -> Column:
        numbers = F.sequence(F.lit(0), F.lit(n - 1))
        return F.struct(
            F.transform(numbers, lambda t: F.concat(d, F.lit("-"), t)).alias("input"),
            F.transform(numbers, lambda t: F.concat(d % 10 + t, F.lit("\n"))).alias("output"),
        )

    people = table(spark, sf, "events").select(F.col("user_id").alias("data_id")).distinct()
    return people.select(
        "data_id", side(2).alias("public_tests"), side(3).alias("private_tests")
    )


def recorded_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """What each rollout's program printed for each test; null when it timed out."""
    runs = rollouts_ev(spark, sf).select("ID", "data_id")
    sides = F.array(
        *[
            F.struct(F.lit(v).alias("visibility"), F.lit(t).alias("test_id"))
            for v, n in (("public", 2), ("private", 3))
            for t in range(n)
        ]
    )
    right = F.col("data_id") % 10 + F.col("test_id")
    mix = F.col("ID") + F.col("test_id") * 3 + F.length("visibility")
    actual = (
        F.when(mix % 13 == 0, F.lit(None).cast("string"))
        .when(mix % 11 == 0, F.concat(right + 1, F.lit("\n")))
        .otherwise(F.concat(right, F.lit("\n\n")))
    )
    return runs.select("ID", "data_id", F.inline(sides)).select(
        "ID", "visibility", "test_id", actual.alias("actual")
    )


# --- SQL --------------------------------------------------------------------

SUCCESS = C.SUCCESS


def text(value: str) -> str:
    """A SQL string literal."""
    parts = [p.replace("'", "''") for p in value.split("\n")]
    if len(parts) == 1:
        return f"'{parts[0]}'"
    return "(" + "||chr(10)||".join(f"'{p}'" for p in parts) + ")"


def h(*parts: str) -> str:
    return f"('0x'||substr(md5(concat_ws('|',{','.join(parts)})),1,8))::BIGINT"


def fine_h(*parts: str) -> str:
    return f"('0x'||substr(md5(concat_ws('|',{','.join(parts)})),1,15))::BIGINT"


def digest_sql(messages: str) -> str:
    return (
        f"md5(array_to_string(list_transform({messages}, "
        "lambda m: m.role||':'||m.content), chr(10)))"
    )


def pick_sql(n: int, *values: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {text(v)}" for i, v in enumerate(values))
    return f"CASE item_id % {n} {arms} END"


def space_sql() -> str:
    return "||".join(f"chr({ord(c)})" for c in C.WHITESPACE)


ANSWER = "coalesce(max(text) FILTER (turn = la), '')"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "rollouts_ev": (
        (),
        f"""SELECT event_id AS ID, user_id AS data_id, value - 35.0 AS reward,
  event_type IN ('purchase','signup') AS label, k,
  CASE WHEN k >= 50 THEN '{SUCCESS}' ELSE 'AssertionError' END AS public,
  CASE WHEN event_type IN ('purchase','signup') THEN '{SUCCESS}'
       WHEN k % 10 = 0 THEN '' ELSE 'AssertionError' END AS private
FROM (SELECT *, json_extract_string(props,'$.k')::INT AS k FROM events) e""",
    ),
    "beam": (
        ("rollouts_ev",),
        """SELECT *, (o % 3 + 1)::INT AS turn, ((o // 3) % 5)::INT AS search_id
FROM (SELECT *, row_number() OVER (PARTITION BY data_id ORDER BY ID) - 1 AS o FROM rollouts_ev) r""",
    ),
    "winners": (
        ("beam",),
        f"""SELECT *, public = '{SUCCESS}' AS public_ok, private IN ('{SUCCESS}','') AS private_ok
FROM beam
QUALIFY row_number() OVER (PARTITION BY data_id, search_id, turn
  ORDER BY reward + 100 * (public = '{SUCCESS}')::INT DESC, ID) = 1""",
    ),
    "traj": (
        (),
        f"""SELECT c.conv_id AS ID, c.conv_id % 5 AS data_id,
  list_concat([{{'role': 'user', 'content': 'problem '||(c.conv_id % 5)}}],
    coalesce(list({{'role': role, 'content': text}} ORDER BY turn) FILTER (la IS NULL OR turn < la), [])) AS prompt,
  [{{'role': 'assistant', 'content':
     CASE c.conv_id % 3
      WHEN 0 THEN 'Answer:'||chr(10)||'```python'||chr(10)||{ANSWER}||chr(10)||'```'||chr(10)||'Done'
      WHEN 1 THEN 'Answer:'||chr(10)||'```python'||chr(10)||{ANSWER} ELSE {ANSWER} END}}]
   AS completion,
  coalesce(max(l.quality), 0) = 1 AS label,
  ({h("'rw'", "c.conv_id")} % 2000 - 1000) / 100.0::DOUBLE AS reward,
  coalesce(list({{'public': CASE WHEN length(text) % 2 = 0 THEN '{SUCCESS}' ELSE 'AssertionError: '||length(text) END,
        'private': CASE length(text) % 3 WHEN 0 THEN '' WHEN 1 THEN '{SUCCESS}' ELSE 'AssertionError' END}}
       ORDER BY turn) FILTER (role = 'assistant' OR turn > la), []) AS feedbacks
FROM (SELECT *, max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS la
      FROM conversations) c
LEFT JOIN labels l ON l.doc_id = c.conv_id
GROUP BY c.conv_id""",
    ),
    "convs": (
        (),
        f"""SELECT conv_id AS ID, list({{'role': role, 'content': text}} ORDER BY turn) AS conversation
FROM conversations GROUP BY conv_id""",
    ),
    "doc_rollouts": (
        (),
        """SELECT d.doc_id AS ID, source AS data_id, ln(n_chars) AS reward,
  coalesce(quality, 0) = 1 AS label FROM documents d LEFT JOIN labels l USING (doc_id)""",
    ),
    "turns": (
        ("traj",),
        """SELECT ID, data_id, prompt, completion, label, reward, i
FROM (SELECT *, unnest(range(0, len(prompt)::BIGINT)) AS i FROM traj) t
WHERE prompt[i + 1].role = 'assistant'""",
    ),
    "mbpp": (
        (),
        f"""SELECT item_id AS data_id, {pick_sql(3, *SPLITS)} AS split, text, {pick_sql(4, *CODES)} AS code,
  {pick_sql(2, "", "import math")} AS test_setup_code,
  ['assert f('||item_id||') == '||item_id, 'assert f('||(item_id+1)||') == '||(item_id+1),
   'assert f(''a'') == "b"'] AS test_list,
  CASE WHEN item_id % 3 = 0 THEN []::VARCHAR[] ELSE ['assert f(-1) == -1', 'assert f("it''s")'] END
   AS challenge_test_list FROM benchmark""",
    ),
    "mbppplus": (
        (),
        f"""SELECT item_id AS data_id, text AS prompt, {pick_sql(4, *CODES)} AS code,
  {pick_sql(2, "", "import math")} AS test_imports,
  'for x in range(9):'||chr(10)||'    assert f(x) == x # '||item_id AS test,
  ['assert f('||item_id||') == '||item_id, 'assert f('||(item_id+1)||') == '||(item_id+1),
   'assert f(''a'') == "b"'] AS test_list FROM benchmark""",
    ),
    "humaneval": (
        (),
        f"""SELECT item_id AS data_id, 'f'||item_id AS entry_point,
  'import os'||chr(10)||chr(10)||'def f'||item_id||'(x):'||chr(10)||'    \"\"\"'||text||'\"\"\"'||chr(10) AS prompt,
  '    return x' AS canonical_solution, {pick_sql(4, *EXAMPLES)} AS example_test,
  chr(10)||chr(10)||'assert f(3) == 3'||chr(10)||text AS test,
  chr(10)||chr(10)||'assert f(3) == 3'||chr(10)||'plus '||text AS plus_test FROM benchmark""",
    ),
    "contests": (
        (),
        """SELECT item_id AS data_id, text AS description,
  CASE WHEN item_id % 5 = 0 THEN []::VARCHAR[] ELSE string_split(text, '. ') END AS pub_in,
  CASE WHEN item_id % 5 = 0 THEN []::VARCHAR[] ELSE
   list_transform(string_split(text, '. '), lambda s: length(s)||chr(10)) END AS pub_out,
  item_id % 2 = 1 AS limited, item_id % 7 AS seconds,
  CASE WHEN item_id % 4 = 3 THEN [3, 2] ELSE [2, 1, 1] END AS langs,
  ['int main() {}', 'print('||item_id||')', 'pass'] AS codes FROM benchmark""",
    ),
}


def sql(body: str, *names: str) -> str:
    """``body`` with the CTEs it uses and theirs."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in CTES[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    ctes = ",\n".join(f"{name} AS ({CTES[name][1]})" for name in order)
    if not ctes:
        return body
    extra = body.lstrip()
    return f"WITH {ctes},\n{extra[1:]}" if extra.startswith(",") else f"WITH {ctes}\n{body}"
