"""Operators on conversations, pages and embeddings, and the pipeline."""

from __future__ import annotations

import hashlib
import random

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trajmill.llm import chat, decontaminate, queries, topk, toxicity, warc
from trajmill.llm.shared import store
from trajmill.session import new_folder


def same_as_sql(spark, sf, name, digits=None):
    con = duckdb.connect()
    for table in ("documents", "conversations", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = sorted(cursor.fetchall(), key=str)
    got = queries.QUERIES[name](spark, sf)
    assert set(got.columns) == set(names)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == want


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_is_its_sql(spark, sf, name):
    same_as_sql(spark, sf, name)


PIECES = ["\\", "###", "</turn>", "### ", ": ", "\n", " ", "<", "a", "### user: ", " </turn>\n", "\\</turn>", "é", "😀"]


def turns_of(spark, rows):
    schema = "conv_id long, turn int, role string, text string, tokens int, pos int, window string"
    return spark.createDataFrame([(*r, 1, 2, "w") for r in rows], schema)


def test_chat_round_trip_of_hostile_texts(spark):
    rng = random.Random(8)
    make = lambda: "".join(rng.choice(PIECES) for _ in range(rng.randrange(9)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", make()]), make()) for c in range(30) for t in range(rng.randrange(1, 9))]
    windows = chat.format_windows(turns_of(spark, rows), budget=40, history=12).cache()
    said, loss = {}, {}
    for w in sorted(windows.collect(), key=lambda w: (w["conv_id"], w["window"])):
        turns = chat.parse(w["text"])
        assert len(turns) == w["n_turns"]
        said.setdefault(w["conv_id"], []).extend(turns[w["n_repeated"] :])
        loss.setdefault(w["conv_id"], []).extend(chat.unescape(w["text"][s["start"] : s["end"]]) for s in w["loss"])
    for c in {r[0] for r in rows}:
        own = [(r[2], r[3]) for r in sorted(rows) if r[0] == c]
        assert said[c] == own
        assert loss[c] == [t for r, t in own if r == "assistant"]


def test_chat_windows_keep_the_budget(spark):
    rng = random.Random(9)
    rows = [(1, 0, "system", "be brief now")]
    rows += [(1, t, "user" if t % 2 else "assistant", "word " * rng.randrange(1, 30)) for t in range(1, 3000)]
    rows += [(2, 0, "user", "word " * 500), (2, 1, "assistant", "ok")]
    found = chat.format_windows(turns_of(spark, rows), budget=200, history=50).collect()
    assert sum(w["n_turns"] - w["n_repeated"] for w in found) == len(rows)
    for w in found:
        new = w["n_turns"] - w["n_repeated"]
        assert w["tokens"] <= 200 or new == 1
        if w["conv_id"] == 1:
            assert chat.parse(w["text"])[0] == ("system", "be brief now")
    assert any(w["n_repeated"] > 1 for w in found)


def test_chat_odd_cases(spark):
    rows = [
        (None, 0, "user", "who am i"),
        (None, None, "assistant", None),
        (1, 0, None, None),
        (1, 0, None, None),
        (2, 5, "system", "alone"),
        (3, 1, "user", "x"),
        (3, 1, "assistant", "a long one " * 30000),
    ]
    back = chat.read_windows(chat.format_windows(turns_of(spark, rows))).collect()
    found = {}
    for r in sorted(back, key=lambda r: r["window"]):
        found[r["conv_id"]] = found.get(r["conv_id"], "") + r["turns"]
    assert found[None] == "assistant\n\nuser\nwho am i\n"
    assert found[1] == "\n\n\n\n" and found[2] == "system\nalone\n"
    assert found[3].startswith("assistant\na long one") and found[3].endswith("user\nx\n")
    assert chat.format_windows(turns_of(spark, rows).where("false")).count() == 0


def page_table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, type string, seq int")


TRICKY = [
    "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc",
    "ends in cr\r",
    "\r\n\r\n",
    "\r\r\n\n\r",
    "",
    "é😀" * 400,
    "x" * 1000,
    "x" * 999,
    "y" * 300_000,
]


def test_warc_round_trip(spark):
    rows = [(i, f"http://h/{i}?a b\r\nX: y", t) for i, t in enumerate(TRICKY * 3)] + [(99, None, None), (None, None, "x" * 1000)]
    raw, lean, again = (new_folder(spark, n) for n in ("raw", "lean", "again"))
    warc.write_responses(page_table(spark, rows), raw, per_file=4)
    warc.deduplicate(spark, raw, lean, per_file=4)
    warc.deduplicate(spark, lean, again)
    payloads = {i: (t or "").encode() for i, _, t in rows}
    for folder in (lean, again):
        found = warc.resolve(spark, folder).collect()
        assert len(found) == len(rows)
        for r in found:
            page = None if r["page"] is None else int(r["page"])
            own = payloads[page]
            assert (r["payload_bytes"], r["payload_digest"]) == (len(own), hashlib.sha1(own).hexdigest())
            last = max(i for i, p in payloads.items() if i is not None and p == own)
            revisit = len(own) >= 1000 and page != last
            assert r["type"] == ("revisit" if revisit else "response")
            assert r["refers_to"] == (str(last) if revisit else None)
    assert sum(len(r["payload"]) for r in warc.read_records(spark, lean, payload=True).collect()) < sum(map(len, payloads.values()))
    ids = [r["record_id"] for r in warc.read_records(spark, lean).collect()]
    assert len(set(ids)) == len(ids)


def test_warc_of_no_pages(spark):
    raw, lean = new_folder(spark, "raw"), new_folder(spark, "lean")
    warc.write_responses(page_table(spark, []), raw)
    warc.deduplicate(spark, raw, lean)
    assert warc.resolve(spark, lean).count() == 0


def test_warc_repeated_rows(spark):
    raw, lean = new_folder(spark, "raw"), new_folder(spark, "lean")
    warc.write_responses(page_table(spark, [(5, "u", "z" * 2000)] * 3), raw)
    warc.deduplicate(spark, raw, lean)
    found = sorted((r["type"], r["refers_to"]) for r in warc.resolve(spark, lean).collect())
    assert [t for t, _ in found] == ["response", "revisit", "revisit"] and found[1][1] == found[2][1] == "5"


def best(rows, k, every):
    out = []
    for q, v in rows:
        if q % every:
            continue
        scores = sorted((-int(np.dot(v, w)), i) for i, w in rows if i != q)
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [1.0, 8.0])
def test_top_k_over_blocks(spark, spread):
    rng = np.random.default_rng(6)
    table = rng.normal(size=(700, 12)) * rng.uniform(1, spread, size=(700, 1))
    table[100:220] = table[100]
    whole = [(i, np.floor(64 * v).astype(np.int64)) for i, v in enumerate(table)]
    df = spark.createDataFrame([(i, v.tolist(), "x", 1) for i, v in enumerate(table)], "vec_id long, embedding array<double>, block string, length int")
    found = topk.top_k(df, F.col("vec_id") % 20 == 0, k=5, scale=64, block_rows=90, query_rows=8)
    got = sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect())
    assert got == best(whole, 5, 20)


def test_top_k_odd_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [3.0]), (6, []), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(df, F.col("vec_id") % 100 == 0, k=3, scale=1).orderBy("rank")
    assert [tuple(r)[1:] for r in found.collect()] == [(1, 7, 5), (2, 7, 5), (3, 5, 3)]
    assert topk.top_k(df.where("false"), F.lit(True)).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), F.lit(True)).count() == 0


def test_top_k_with_large_components():
    rng = np.random.default_rng(7)
    vectors = rng.integers(-(2**29), 2**29, size=(50, 3))
    found = topk.search_block(np.arange(2), vectors[:2], np.full(2, -np.inf), np.arange(50), vectors, np.eye(3), 4)
    want = [(q, i, -s) for q in range(2) for s, i in sorted((-int(vectors[q] @ vectors[i]), i) for i in range(50) if i != q)[:4]]
    assert found == want


def test_pipeline_stage_by_stage(spark, sf):
    """Each stage against brute force on what the one before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    stages = dict(corpus_pipeline.STAGES)

    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    before = rows(docs)
    scores = dict(zip(before, model.scores(list(before.values()))))
    docs = store(stages["toxicity"](spark, docs, sf), "stage")
    assert docs.columns == columns and set(rows(docs)) == {d for d, s in scores.items() if s < 0.7}

    before = list(rows(docs).items())
    gone = brute.dropped_lines(before)
    docs = store(stages["line_dedup"](spark, docs, sf), "stage")
    texts = {d: (t, brute.kept_text(d, t, gone)) for d, t in before}
    assert docs.columns == columns
    assert rows(docs) == {d: new for d, (old, new) in texts.items() if old == new or brute.plain(new)}
    assert gone

    before = rows(docs)
    ids = sorted(before)
    group = brute.groups(len(ids), brute.near([brute.simhash(before[d], 3) for d in ids], 3))
    docs = store(stages["simhash"](spark, docs, sf), "stage")
    assert docs.columns == columns and set(rows(docs)) == {ids[g] for g in group}

    before = rows(docs)
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    index = decontaminate.build([r["item_id"] for r in items], [r["text"] for r in items])
    leaks = {i for i, t in before.items() if decontaminate.search(index, [t])}
    docs = store(stages["decontamination"](spark, docs, sf), "stage")
    assert docs.columns == columns and set(rows(docs)) == set(before) - leaks
    assert not [d for d, t in rows(docs).items() if any(brute.plain(r["text"]) in brute.plain(t) for r in items)]

    mixed = stages["mixing"](spark, docs, sf).collect()
    sizes = {d: len(t.split()) for d, t in rows(docs).items()}
    taken = sum(sizes[r["doc_id"]] * r["copies"] for r in mixed)
    assert all(1 <= r["copies"] <= 2 for r in mixed)
    assert abs(taken - 1.5 * sum(sizes.values())) < 0.05 * sum(sizes.values())


def test_pipeline_of_odd_rows(spark, sf, tmp_path):
    """Nulls in any column, empty texts, repeated rows, extra columns with the operators' names, and no rows."""
    plain = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    odd = plain.limit(4).withColumns({c: F.lit(None).cast(plain.schema[c].dataType) for c in ("lang", "source", "n_chars")})
    none = plain.limit(2).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in plain.schema])
    empty = plain.limit(3).withColumn("text", F.lit(" \n "))
    more = {"row": F.lit("r"), "id": F.lit(1), "t": F.lit(2), "component_id": F.lit("c"), "fp": F.lit(0)}
    table = odd.unionByName(none).unionByName(empty).unionByName(plain).unionByName(plain.limit(5)).withColumns(more)
    for rows, name in ((table, "some"), (table.where("false"), "no")):
        folder = tmp_path / name
        rows.coalesce(2).write.parquet(str(folder / "documents.parquet"))
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"{sf}/{other}.parquet").write.parquet(str(folder / f"{other}.parquet"))
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        for stage, step in corpus_pipeline.STAGES[:-1]:
            docs = store(step(spark, docs, str(folder)), stage)
            assert docs.columns == table.columns
        mixed = corpus_pipeline.run(spark, str(folder))
        assert mixed.columns[: len(table.columns)] == table.columns
        assert (mixed.count() > 0) == (name == "some")
