"""Periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest

from trajmill.llm import queries, runs


def some_words(rng) -> list[int]:
    """Words of few kinds, in part periodic."""
    words = []
    for _ in range(rng.randrange(12)):
        part = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(12))]
        words += part * rng.choice([1, 1, 2, 5, 9]) + part[: rng.randrange(len(part) + 1)]
    return words


@pytest.mark.parametrize("times,least", [(4, 6), (2, 2), (3, 5)])
def test_catchers_in_pieces_of_any_size(times, least):
    rng = random.Random(times)
    for _ in range(150):
        words = some_words(rng)
        catchers = runs.Catchers(times, least)
        at = 0
        while at < len(words):
            step = rng.choice([1, 1, 2, 5, 40])
            catchers.append(np.array(words[at : at + step]))
            at += step
            if rng.random() < 0.2:
                assert catchers.runs().tolist() == brute.runs(words[:at], times, least)
        assert catchers.runs().tolist() == brute.runs(words, times, least)


@pytest.mark.parametrize("piece", [50, 1 << 16])
def test_texts_that_share_a_stream(monkeypatch, piece):
    monkeypatch.setattr(runs, "PIECE", piece)
    rng = random.Random(4)
    texts = [[str(w).encode() for w in some_words(rng)] for _ in range(200)]
    # Texts that are periodic together and not alone.
    texts += [[b"a"] * 3, [b"a"] * 3, [], [b"a", b"b"] * 3, [b"a", b"b"] * 4]
    found = [r.tolist() for _, r in runs.runs_of(texts)]
    assert found == [brute.runs(t) for t in texts]


def test_long_texts_take_near_linear_time():
    for words in ([b"a"] * 200_000, [b"a", b"b", b"a"] * 70_000):
        ((_, found),) = runs.runs_of([words])
        assert found.tolist() == [[0, len(words), 1 if words[1] == b"a" else 3]]


def test_the_highest_run():
    rows = lambda *r: np.array(r, dtype=np.int64).reshape(-1, 3)
    assert runs.highest(rows()) is None
    assert runs.highest(rows((0, 9, 2), (5, 27, 6), (9, 8, 2))) == 0
    assert runs.highest(rows((0, 9, 2), (5, 28, 6))) == 1


def test_query_is_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r.asDict() for r in queries.op12_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    high = 0
    for doc_id, text in docs:
        words = [w.decode() for w in (text or "").encode().split()]
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = brute.runs(words)
        high += bool(found)
        top = max(found, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=[None] * 3)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        text_of = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert got[doc_id] == {
            "doc_id": doc_id,
            "n_runs": len(found),
            "start": top[0],
            "length": top[1],
            "period": top[2],
            "exponent_milli": 1000 * top[1] // top[2] if found else None,
            "runs_sha256": text_of("".join(f"{s},{m},{q}\n" for s, m, q in found)),
            "collapsed_sha256": text_of(" ".join(w for i, w in enumerate(words) if i not in gone)),
        }
    assert high > 5


def test_odd_rows(spark):
    schema = "doc_id long, text string, row int, runs string, top int, n_words long"
    rows = [(None, "x " * 9), (1, None), (1, ""), (2, " \t\n"), (3, "x"), (3, "x"), (4, "é é " * 5), (5, "a b\x0bc\n" * 40000)]
    docs = spark.createDataFrame([(*r, 7, "r", 1, 2) for r in rows], schema)
    found = runs.find_runs(docs).collect()
    assert len(found) == len(rows)
    by_id = {(r["row"]["doc_id"], r["row"]["text"]): r for r in found}
    assert by_id[None, "x " * 9]["collapsed"] == "x" and by_id[None, "x " * 9]["top"] == 0
    for key in ((1, None), (1, ""), (2, " \t\n")):
        assert (by_id[key]["n_words"], by_id[key]["runs"], by_id[key]["top"], by_id[key]["collapsed"]) == (0, [], None, "")
    assert by_id[4, "é é " * 5]["n_words"] == 5 and not by_id[4, "é é " * 5]["runs"]
    (long,) = [r for k, r in by_id.items() if k[0] == 5]
    assert [tuple(x) for x in long["runs"]] == [(0, 120000, 3)] and long["collapsed"] == "a b c"
    assert found[0]["row"]["runs"] == "r"
    assert runs.find_runs(docs.where("false")).count() == 0
