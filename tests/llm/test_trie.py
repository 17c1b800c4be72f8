"""The prefix trie against one built in memory."""

from __future__ import annotations

import hashlib
import random

import pytest

from trajmill.llm import queries, trie


def expected(sequences: dict) -> list[tuple]:
    """Nodes of {id: [(key, weight), ...]}; None is the largest id."""
    order = lambda i: (i is None, i or 0)
    nodes: dict[tuple, list] = {}
    for own, steps in sequences.items():
        for depth in range(len(steps) + 1):
            nodes.setdefault(tuple(k for k, _ in steps[:depth]), []).append(own)
    found = []
    for path, members in nodes.items():
        low = min(members, key=order)
        below = [p for p in nodes if p[: len(path)] == path]
        weights = [(len(nodes[p]) - 1) * sequences[nodes[p][0]][len(p) - 1][1] if p else 0 for p in below]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes)]
        ends = sorted((m for m in members if len(sequences[m]) == len(path)), key=order)
        text = ",".join("null" if m is None else str(m) for m in ends)
        found.append(
            (
                low,
                len(path),
                min(nodes[path[:-1]], key=order) if path else None,
                len(members),
                sum(len(p) == len(path) + 1 for p in below),
                len(leaves),
                sum(weights),
                hashlib.sha256(text.encode()).hexdigest(),
            )
        )
    return sorted(found, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, sequences, rng=None):
    data = [(own, 10 * i, k, w, "x") for own, steps in sequences.items() for i, (k, w) in enumerate(steps)]
    if rng:
        rng.shuffle(data)
    return spark.createDataFrame(data, "conv_id long, turn long, key string, weight long, p1 string")


def some(rng, count, kinds, longest):
    return {i: [(k := rng.choice(kinds), ord(k[0])) for _ in range(rng.randrange(1, longest))] for i in range(-count // 2, count)}


@pytest.mark.parametrize("bits", [1, 4, 20])
def test_any_sketch_gives_the_same_nodes(spark, monkeypatch, bits):
    monkeypatch.setattr(trie, "LEAST_BITS", bits)
    monkeypatch.setattr(trie, "MOST_BITS", bits)
    monkeypatch.setattr(trie, "IDS", 3)
    rng = random.Random(bits)
    sequences = some(rng, 60, "abc", 7)
    sequences |= {1000 + i: [("a", 97), ("b", 98)] for i in range(20)}
    assert rows(trie.prefix_trie(table(spark, sequences, rng))) == expected(sequences)


def test_long_sequences_are_summed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK_BITS", 2)
    rng = random.Random(3)
    sequences = some(rng, 12, "ab", 40)
    base = [("ab"[i % 2], i % 5) for i in range(90)]
    base = [(k, ord(k)) for k, _ in base]
    sequences |= {500 + i: base[: 90 - 10 * (i % 3)] + [("z", ord("z"))] * (i % 4) for i in range(9)}
    assert rows(trie.prefix_trie(table(spark, sequences, rng))) == expected(sequences)


def test_members_without_elements_and_odd_rows(spark):
    sequences = {7: [("a", 97)], 3: [], None: [("a", 97), ("b", 98)], 9: []}
    members = spark.createDataFrame([(7, 1), (3, 1), (9, 1), (9, 1)], "conv_id long, size int")
    got = trie.prefix_trie(table(spark, sequences), members)
    assert rows(got) == expected(sequences)
    data = [(1, None, None, None), (1, 5, None, None), (1, 5, "k", 3), (2, None, None, 4), (2, 1, "", 1)]
    odd = spark.createDataFrame([(*r, 0) for r in data], "conv_id long, turn int, key string, weight int, depth int")
    found = {(r["conv_id"], r["depth"]): r for r in trie.prefix_trie(odd).collect()}
    assert sorted(found) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 2)]
    assert found[1, 1]["n_convs"] == 2 and found[1, 1]["saved"] in (0, 4)
    assert trie.prefix_trie(odd.where("false")).count() == 0
    only = trie.prefix_trie(odd.where("false"), members)
    assert rows(only) == expected({3: [], 7: [], 9: []})


def rebuilt(turns) -> dict:
    """The conversations of op13 from (conv_id, turn, role, text) rows."""
    import zlib

    own: dict = {}
    for c, _, role, text in sorted(turns, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    found = {}
    for c, steps in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        found[c] = own.get(c - c % 5, [])[:h] + steps[h:]
    return found


def test_query_is_brute_force_on_the_table(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    sequences = {c: [(s, len(s[1].encode())) for s in steps] for c, steps in rebuilt(turns).items()}
    assert rows(queries.op13_trie(spark, sf)) == expected(sequences)
