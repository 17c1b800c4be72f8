"""SuperMinHash near-duplicates against brute force."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from trajmill.llm import superminhash as S


def shingles(text, size=4) -> set:
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def expected(docs, size=4, percent=80):
    """(id, set size, component, kept) by comparing all pairs."""
    sets = [shingles(t, size) for _, t in docs]
    links = [
        (i, j)
        for i in range(len(docs))
        for j in range(i)
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    found = {}
    for (own, _), group in zip(docs, brute.groups(len(docs), links)):
        found.setdefault(group, []).append(own)
    low = {g: min((x for x in ids if x is not None), default=None) for g, ids in found.items()}
    groups = brute.groups(len(docs), links)
    return sorted(((d, len(s), low[g], d == low[g]) for (d, _), s, g in zip(docs, sets, groups)), key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def one_by_one(elements, slots):
    """The signature as it is defined: each element's whole order of slots."""
    best = [float("inf")] * slots
    for x in elements:
        order = list(range(slots))
        for place in range(slots):
            bits = S._mixed(np.array([x + place * int(S._ODD) & (1 << 64) - 1], dtype=np.uint64))
            other = place + int(S._mixed(bits ^ S._MIX)[0]) % (slots - place)
            order[place], order[other] = order[other], order[place]
            value = place + (int(bits[0]) >> 12) * 2.0**-52
            best[order[place]] = min(best[order[place]], value)
    return best


@pytest.mark.parametrize("at_once", [7, 1 << 16])
def test_early_stopping_changes_no_signature(monkeypatch, at_once):
    monkeypatch.setattr(S, "AT_ONCE", at_once)
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (0, 1, 2, 9, 0, 40, 200)]
    found = S.signatures(sets, 16)
    assert np.isinf(found[0]).all()
    for own, row in zip(sets, found):
        assert row.tolist() == one_by_one(own.tolist(), 16)


def test_equal_slots_estimate_the_similarity_with_less_variance():
    rng = np.random.default_rng(2)
    shares = []
    for _ in range(300):
        both, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (8, 4, 4))
        x, y = S.signatures([np.concatenate([both, a]), np.concatenate([both, b])], 64)
        shares.append((x == y).mean())
    assert abs(np.mean(shares) - 0.5) < 0.02
    # Independent minima: 0.5 * 0.5 / 64.
    assert np.var(shares) < 0.8 * 0.25 / 64


def near_copies(rng, count):
    texts = []
    while len(texts) < count:
        words = [rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 60))]
        for _ in range(rng.randrange(1, 6)):
            texts.append(" ".join(words))
            words = list(words)
            words[rng.randrange(len(words))] = rng.choice("abc").upper()
    return texts[:count]


@pytest.mark.parametrize("rounds", [1, 3])
def test_links_are_those_of_all_pairs(spark, monkeypatch, rounds):
    monkeypatch.setattr(S, "ROUNDS", rounds)
    rng = random.Random(5)
    docs = list(enumerate(near_copies(rng, 250)))
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(S.near_duplicates(df)) == expected(docs)


def test_pairs_at_the_limit(spark):
    """Four in five of the shingles, exactly and one less."""
    words = [f"w{i}" for i in range(203)]
    docs = []
    for n in range(60):
        own = [f"d{n}-{w}" for w in words]
        docs += [(10 * n, " ".join(own)), (10 * n + 1, " ".join(own[:163])), (10 * n + 2, " ".join(own[:162]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {d: c for d, _, c, _ in rows(S.near_duplicates(df))}
    for n in range(60):
        assert found[10 * n + 1] == 10 * n and found[10 * n + 2] == 10 * n


def test_texts_of_one_template_are_no_near_copies(spark):
    """Texts that share bands by a long common part and are no near copies."""
    rng = random.Random(6)
    shared = " ".join(f"t{i}" for i in range(63))
    tail = lambda: " ".join(f"{rng.randrange(10**9)}" for _ in range(20))
    docs = [(n, f"{shared} {tail()}") for n in range(300)]
    docs += [(1000 + n, f"{docs[n][1]} x") for n in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(S.near_duplicates(df)) == expected(docs)


def test_odd_rows(spark):
    schema = "doc_id long, text string, k long, size int, component_id string, id long"
    data = [
        (1, None), (2, ""), (3, " \t "), (4, "a b"), (5, "A b"), (5, "A b"), (6, "a b c d"), (7, "a b c d e"),
        (None, "a b"), (None, None), (None, "alone"), (8, "x " * 200000), (9, "x x x x"), (10, "é É"), (11, "é é"),
    ]
    df = spark.createDataFrame([(*r, 1, 2, "c", 3) for r in data], schema)
    assert rows(S.near_duplicates(df)) == expected(data)
    assert S.near_duplicates(df.where("false")).count() == 0
    renamed = df.select(F.col("doc_id").alias("page"), F.col("text").alias("body"))
    assert S.near_duplicates(renamed, id_col="page", text="body").columns == ["page", "n_shingles", "component_id", "kept"]


def test_parities_bound_the_difference():
    """Where parities differ, so do the sets: a pair above the limit is never let go."""
    rng = np.random.default_rng(5)
    for size in (0, 1, 40, 700, 3000):
        for apart in (0, 1, size // 9, size // 2):
            both, one, two = (np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (size, apart, apart // 2))
            a, b = np.union1d(both, one), np.union1d(both, two)
            bits = (S.parities(a) ^ S.parities(b)).view(np.uint8)
            assert np.unpackbits(bits).sum() <= len(np.setxor1d(a, b))
    assert not S.parities(np.zeros(0, dtype=np.uint64)).any()


def test_alike_but_unlinked_texts_are_not_compared(spark, monkeypatch):
    """Copies of one text, each with another third of its words changed, share bands; few pairs are read."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(60):
        at = rng.randrange(200)
        words = list(base)
        for n in range(at, at + 60):
            words[n] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    docs += [(100 + i, " ".join(docs[i][1].split()[:-3])) for i in range(6)]
    read = []

    def counted(keyed, near, verify, *rest):
        def count(pairs):
            read.append(pairs.count())
            return verify(pairs)

        return link_keyed(keyed, near, count, *rest)

    link_keyed = S.link_keyed
    monkeypatch.setattr(S, "link_keyed", counted)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(S.near_duplicates(df)) == expected(docs)
    assert sum(read) <= 100
