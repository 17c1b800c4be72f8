"""What the operators must find, against the definition itself rather than against their own keys."""

from __future__ import annotations

import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trajmill.llm import decontaminate, language, lines, toxicity


@pytest.mark.parametrize("length", [200, 400])
@pytest.mark.parametrize("kind", ["deleted", "inserted"])
def test_decontamination_finds_drifting_occurrences(length, kind):
    """Evenly spaced edits of one kind, as many as the budget has, move the hits over the border of
    a band; wherever the occurrence starts it is found."""
    rng = np.random.default_rng(12)
    item = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), size=length))
    index = decontaminate.build([0], [item])
    budget = int(index.edits[0])
    places = set(((np.arange(budget) + 0.5) * length / budget).astype(int).tolist())
    edited = {"deleted": lambda c: "", "inserted": lambda c: c + "é"}[kind]
    text = "".join(edited(c) if i in places else c for i, c in enumerate(item))
    for start in range(2 * budget + 3):
        hits = decontaminate.search(index, ["z" * start + text + "y" * 50])
        assert [h[1] for h in hits] == [0] and hits[0][4] <= budget, start


def test_near_dedup_stage_is_simhash_at_three_bits(spark):
    """One copy of each document with scattered words replaced: what stays is the smallest id of each
    group of all pairs within three bits, by the stage's contract, whatever the word similarity."""
    rng = np.random.default_rng(21)
    words = np.array(["".join(rng.choice(list("abcdefghijklmno"), size=6)) for _ in range(2000)])
    table = []
    for i in range(120):
        text = rng.choice(words, size=400)
        copy = text.copy()
        for at in rng.choice(400, size=1 + i % 5, replace=False):
            copy[at] = "new" + copy[at]
        table += [(i, " ".join(text)), (1000 + i, " ".join(copy))]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    table.sort()
    group = brute.groups(len(table), brute.near([brute.simhash(t, 3) for _, t in table], 3))
    assert kept == {table[g][0] for g in group}
    assert 10 < sum(d >= 1000 for d, _ in table) - sum(d >= 1000 for d in kept) < 120


def test_lines_of_the_wanted_edit_similarity_are_linked(spark):
    """With the query's own defaults, against edit similarity alone: one copy of each line with
    changed words or scattered letters."""
    rng = np.random.default_rng(31)
    words = ["".join(rng.choice(list("abcdefghijklmno"), size=int(n))) for n in rng.integers(2, 9, size=600)]
    table, alike = [], set()
    for i in range(400):
        line = list(" ".join(rng.choice(words, size=4 + i % 37)))
        copy = list(line)
        for at in rng.choice(len(copy), size=1 + i % 4, replace=False):
            if copy[at] != " ":
                copy[at] = "xyz"[i % 3] * (i % 3)
        if i % 2:
            copy = " ".join([*"".join(line).split()[:-1], "other"])
        line, copy = "".join(line), "".join(copy)
        table += [(i, line), (1000 + i, copy)]
        if brute.edits(line, copy) <= int(0.1 * max(len(line), len(copy)) + 1e-9):
            alike.add(1000 + i)
    docs = spark.createDataFrame(table, "doc_id long, text string")
    gone = {r["id"] for r in lines.repeated_lines(docs).collect()}
    assert len(alike) > 200 and gone <= alike
    assert len(gone) >= 0.99 * len(alike)


def test_short_lines_are_compared_too(spark):
    """Lines of one or two words, lines of a script without spaces and lines of marks."""
    some = ["wh the", "les", "これは繰り返される文です", "-----", "=====", " "]
    docs = spark.createDataFrame([(1, "\n".join(some)), (2, "\n".join(["Wh, the!", *some[1:], "ok"]))], "doc_id long, text string")
    got = {r["row"]["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()}
    assert got == {1: "\n".join(some), 2: " \nok"}


def test_lines_with_letters_changed_throughout_are_linked(spark):
    """One letter changed in every fourth word: no run of four words and no half is left as it was."""
    rng = np.random.default_rng(41)
    words = ["".join(rng.choice(list("abcdefghijklmno"), size=int(n))) for n in rng.integers(2, 9, size=600)]
    table = []
    for i in range(40):
        line = list(rng.choice(words, size=20))
        copy = list(line)
        for at in range(int(rng.integers(4)), 20, 4):
            place = int(rng.integers(len(copy[at])))
            copy[at] = copy[at][:place] + "z" + copy[at][place + 1 :]
        table += [(i, " ".join(line)), (1000 + i, " ".join(copy))]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    gone = {r["id"] for r in lines.repeated_lines(docs).collect()}
    want = {i for i, _, _ in brute.dropped_lines(table)}
    assert len(want) >= 35 and gone == want


def test_edits_within_a_budget_are_those_of_the_whole_texts(spark):
    rng = np.random.default_rng(42)
    table = []
    for i in range(400):
        x = list(rng.choice(list("abé"), size=i % 60))
        y = list(x)
        for at in rng.integers(len(y), size=i % 5) if y else []:
            y[at] = ["", "q", y[at] + "z"][int(rng.integers(3))]
        table.append((i, "".join(x), "".join(y), int(rng.integers(6))))
    pairs = spark.createDataFrame(table, "id int, x string, y string, budget int")
    got = {r["id"] for r in pairs.where(lines._within(F.col("x"), F.col("y"), F.col("budget"))).collect()}
    assert got == {i for i, x, y, budget in table if brute.edits(x, y) <= budget}


def test_lines_full_of_one_word_are_not_all_compared(spark, monkeypatch):
    """More than half of the words of each line are a sign: its hash would be the SimHash of all of them."""
    rng = np.random.default_rng(44)
    words = ["".join(rng.choice(list("abcdefghijklmno"), size=6)) for _ in range(3000)]
    table = [(i, "| " + " | ".join(rng.choice(words, size=12, replace=False)) + " |") for i in range(300)]
    for i in range(0, 300, 10):
        line = table[i][1].split(" ")
        line[1] = line[1][:-1] + "z"
        line[11] = line[11][:-1] + "z"
        line[-2] = "z" + line[-2][1:]
        table.append((1000 + i, " ".join(line)))
    compared, similar = [], lines._similar

    def counted(*args):
        verify = similar(*args)
        return lambda pairs: compared.append(pairs.count()) or verify(pairs)

    monkeypatch.setattr(lines, "_similar", counted)
    docs = spark.createDataFrame(table, "doc_id long, text string")
    gone = {r["id"] for r in lines.repeated_lines(docs).collect()}
    assert gone == {i for i, _, _ in brute.dropped_lines(table)} and len(gone) == 30
    assert sum(compared) < 2 * len(table)


def test_runs_shared_at_other_places_are_not_compared(spark, monkeypatch):
    """A run near the start of one line and near the end of the other leaves too much to be edited."""
    rng = np.random.default_rng(45)
    words = ["".join(rng.choice(list("abcdefghijklmno"), size=6)) for _ in range(3000)]
    shared, table = "aaaaaa bbbbbb cccccc dddddd eeeeee", []
    for i in range(200):
        rest = list(rng.choice(words, size=9, replace=False))
        at = 9 * (i % 2)
        table.append((i, " ".join([*rest[:at], shared, *rest[at:]])))
    compared, similar = set(), lines._similar

    def noted(*args):
        verify = similar(*args)
        return lambda pairs: compared.update((r["a"], r["b"]) for r in pairs.collect()) or verify(pairs)

    monkeypatch.setattr(lines, "_similar", noted)
    docs = spark.createDataFrame(table, "doc_id long, text string")
    first = {r["h"] for r in lines._lines(docs.where("doc_id % 2 = 0"), "doc_id", "text", 1).collect()}
    assert lines.repeated_lines(docs).count() == 0
    assert compared and all((a in first) == (b in first) for a, b in compared)


def test_an_edit_changes_two_counts_of_letters_at_most(spark):
    rng = np.random.default_rng(46)
    table = []
    for i in range(300):
        x = list(rng.choice(list("abez é"), size=1 + i))
        y = list(x)
        for at in rng.integers(len(y), size=i % 7):
            y[at] = ["", "t", y[at] + "z"][int(rng.integers(3))]
        table.append((i, "".join(x), "".join(y)))
    pairs = spark.createDataFrame(table, "id int, x string, y string")
    sides = [pairs.select("id", *lines._letters(F.col(c))) for c in "xy"]
    both = sides[0].join(sides[1].withColumnsRenamed({n: n + "_2" for n in lines.LETTERS}), "id")
    apart = lines._letters_apart({n: F.col(n) for n in lines.LETTERS}, {n: F.col(n + "_2") for n in lines.LETTERS})
    got = dict(both.select("id", apart).collect())
    for i, x, y in table:
        counts = [(min(x.count(c), 255), min(y.count(c), 255)) for c in "".join(lines.COUNTED)]
        assert got[i] == sum(abs(a - b) for a, b in counts) <= 2 * brute.edits(x, y)


def test_an_edit_changes_two_counts_of_the_halves_at_most(spark):
    """And one for the middles; lines whose halves are exchanged have the same letters, but not in their halves."""
    rng = np.random.default_rng(47)
    table = [(-1, "the one " * 40 + "up my bulk " * 30, "up my bulk " * 30 + "the one " * 40)]
    for i in range(400):
        x = list(rng.choice(list("abez é"), size=1 + i))
        y = list(x)
        for at in rng.integers(1 + len(y) // (1 + i % 3), size=i % 9):
            y[min(at, len(y) - 1)] = ["", "t", "ze"][int(rng.integers(3))]
        table.append((i, "".join(x), "".join(y)))
    pairs = spark.createDataFrame(table, "id int, x string, y string")
    sides = [pairs.select("id", *lines._halves(F.col(c))) for c in "xy"]
    both = sides[0].join(sides[1].withColumnsRenamed({n: n + "_2" for n in lines.HALVES}), "id")
    apart = lines._halves_apart({n: F.col(n) for n in lines.HALVES}, {n: F.col(n + "_2") for n in lines.HALVES})
    got = dict(both.select("id", apart).collect())
    assert all(got[i] <= 2 * brute.edits(x, y) + 1 for i, x, y in table)
    assert got[-1] > 2 * (len(table[0][1]) // 10) + 1


def test_unlike_lines_of_like_letters_are_not_compared(spark, monkeypatch):
    """Long lines that share a run of words, and all their letters, but in other halves: none becomes a pair."""
    a, b = "the one not seen there " * 12, "up my bulk may pull up " * 12
    run = "these four words stay "
    docs = spark.createDataFrame([(0, a + run + b), (1, b + run + a)], "doc_id long, text string")
    compared = []
    similar = lines._similar

    def counted(*args):
        verify = similar(*args)
        return lambda pairs: compared.append(pairs.count()) or verify(pairs)

    monkeypatch.setattr(lines, "_similar", counted)
    assert lines.dedup_lines(docs).agg(F.sum("n_dropped")).first()[0] == 0
    assert sum(compared) == 0


@pytest.mark.parametrize("part", [150, 400, 1000])
def test_part_size_changes_no_toxicity_score(monkeypatch, part):
    """Windows of a long text are the same wherever it is cut, if none is longer than a part."""
    rng = np.random.default_rng(43)
    shape = toxicity.Shape(buckets=512)
    model = toxicity.Model(shape, rng.normal(size=512).astype(np.float32), -0.5)
    words = ["a", "of", "Müll", "don't", "--", "x9", "語"]
    texts = [" ".join(rng.choice(words, size=int(n))) + tail for n in rng.integers(1, 400, size=60) for tail in ("", " ... ")]
    texts += ["", "?!" * 700]
    whole = model.scores(texts)
    monkeypatch.setattr(toxicity, "PART", part)
    assert np.allclose(model.scores(texts), whole, rtol=1e-5, atol=1e-6)


def test_language_of_few_ids_repeated_often_is_learnt(spark):
    for first in range(3, 30, 9):
        own = [i for i in range(first, first + 60) if zlib.crc32(str(i).encode()) % 3 != 1][:3]
        rows = [(own[i % 3], "der die das und nicht", "de") for i in range(6000)]
        rows += [(1000 + i, "the and of with not", "en") for i in range(200)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        assert language.fit(docs, steps=1).languages == ["de", "en"]
