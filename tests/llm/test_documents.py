"""Operators on documents: against brute force, and on the odd cases."""

from __future__ import annotations

import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajmill.llm import decontaminate, language, licences, lines, mixing, queries, simhash, toxicity

LONG = "this long text says one thing again and again " * 12000
SCHEMA = "doc_id long, text string, lang string, source string, row string, id long, fp long, copies int, k int, component_id int"
SAME = "alpha beta gamma delta epsilon zeta eta theta"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names."""
    extra = ("r", 7, 8, 9, 10, 11)
    rows = [
        (1, SAME, "en", "a", *extra),
        (2, SAME, "en", "a", *extra),
        (2, SAME, "en", "a", *extra),
        (3, None, None, None, None, None, None, None, None, None),
        (4, "", "en", "b", *extra),
        (None, "one without an id is here among others", "en", "b", *extra),
        (5, LONG, "de", None, *extra),
        (6, " \n\n ", "en", "a", *extra),
    ]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    return [(r["doc_id"], r["text"]) for r in rows]


def test_simhash_query_is_brute_force(spark, sf, texts):
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in queries.op3_simhash(spark, sf).collect()}
    prints = [brute.simhash(t, 3) for _, t in texts]
    group = brute.groups(len(texts), brute.near(prints, 3))
    smallest = {}
    for (doc_id, _), g in zip(texts, group):
        smallest[g] = min(doc_id, smallest.get(g, doc_id))
    assert got == {d: (p, smallest[g]) for (d, _), p, g in zip(texts, prints, group)}


def test_simhash_odd_cases(odd, none):
    found = [(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()]
    assert len(found) == 8
    assert sorted(c for d, _, c in found if d in (1, 2)) == [1, 1, 1]
    assert {(f, c) for d, f, c in found if d in (3, 4, 6)} == {(0, 3)}
    assert [c for d, _, c in found if d is None] == [None]
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 3, 5, None]
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(none).count() == 0


def test_keep_one_of_rows_with_one_id(spark):
    rows = [(1, SAME, "x"), (1, SAME, "y"), (1, "something else entirely for the other row", "z"), (2, SAME, "w")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, extra string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(1, SAME), (1, rows[2][1])])


def test_large_group_of_near_copies_is_linked_in_few_rows(spark):
    from trajmill.llm.linking import distance, link

    rng = np.random.default_rng(3)
    center = int(rng.integers(0, 2**62))
    prints = {center}
    for _ in range(400):
        value = center
        for b in rng.integers(0, 64, size=2):
            value ^= 1 << int(b)
        prints.add(value)
    prints |= {int(x) for x in rng.integers(0, 2**62, size=400)}
    nodes = spark.createDataFrame([(brute.signed(p), brute.signed(p)) for p in prints], "id long, fp long")
    got = {r["id"]: r["component"] for r in link(nodes, 3, 6).collect()}
    order = sorted(brute.signed(p) for p in prints)
    group = brute.groups(len(order), brute.near([p & brute.MASK for p in order], 3))
    want = {p: order[g] for p, g in zip(order, group) if group.count(g) > 1}
    assert got == want
    assert nodes.select(distance(F.lit(5), F.lit(6)).alias("d")).first()["d"] == 2


def test_lines_query_is_brute_force(spark, sf, texts):
    gone = brute.dropped_lines(texts)
    got = {r["doc_id"]: r["text"] for r in queries.op1_lines(spark, sf).collect()}
    assert got == {d: brute.kept_text(d, t, gone) for d, t in texts}
    assert gone


def test_lines_run_no_python(odd):
    plan = lines.dedup_lines(odd)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


def test_lines_odd_cases(spark, odd, none):
    rows = {}
    for r in lines.dedup_lines(odd).collect():
        rows.setdefault(r["row"]["doc_id"], []).append((r["text"], r["n_lines"], r["n_dropped"]))
    assert rows[1] == [(SAME, 1, 0)]
    assert rows[2] == [("", 1, 1)] * 2
    assert rows[3] == [(None, 0, 0)] and rows[4] == [("", 1, 0)] and rows[6] == [(" \n\n ", 3, 0)]
    assert rows[5] == [(LONG, 1, 0)]
    kept = lines.keep_first_lines(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 3, 4, 5, 6, None]
    assert lines.dedup_lines(none).count() == 0


def test_lines_that_differ_in_marks_or_signs_are_not_equal(spark):
    """Vowel signs and the signs of names and numbers are characters like others."""
    lines_ = ["कि", "की", "C++ or C", "C# or C", "+5 %", "-5 %", "-- --", "== =="]
    table = spark.createDataFrame(list(enumerate(lines_)), "doc_id long, text string")
    got = {r["row"]["doc_id"]: r["n_dropped"] for r in lines.dedup_lines(table).collect()}
    assert got == {i: 0 for i in range(len(lines_))} and not brute.dropped_lines(list(enumerate(lines_)))


def test_lines_link_small_edits(spark):
    line = " ".join(f"word{i} of the line" for i in range(30))
    other = line.replace("word17", "word1x7")
    table = spark.createDataFrame([(2, f"First. Line!\n{other}\nend of it all"), (1, line.upper())], "doc_id long, text string")
    got = {r["row"]["doc_id"]: r["n_dropped"] for r in lines.dedup_lines(table, max_bits=4, blocks=7).collect()}
    want = brute.dropped_lines([(2, table.first()["text"]), (1, line.upper())])
    assert sum(got.values()) == len(want) and got[1] == 0


def test_mixing_odd_cases(odd, none):
    found = mixing.allocate(odd, mixing.count_words(F.col("text"))).collect()
    assert len(found) == 8
    by_source = {}
    for r in found:
        by_source.setdefault(r["row"]["source"], []).append(r)
        assert 0 <= r["copies"] <= 2 and r["size"] == len((r["row"]["text"] or "").split())
    total = sum(r["size"] for r in found)
    assert sum(own[0]["target"] for own in by_source.values()) == pytest.approx(1.5 * total)
    for own in by_source.values():
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert own[0]["target"] <= 2 * own[0]["source_size"]
        taken = sum(r["size"] * r["copies"] for r in own)
        assert abs(taken - own[0]["target"]) <= max(r["size"] for r in own) / 2
    assert mixing.allocate(none, F.length("text")).count() == 0
    mixed = mixing.mix(odd, mixing.count_words(F.col("text")))
    assert mixed.columns == [*odd.columns, "mix_copies"]


def test_mixing_prefers_what_is_liked(spark):
    rows = [(i, f"s{i % 3}", 10 + i % 7, float(1 + i % 2 * 3)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long, w double")
    plan = mixing.allocate(docs, F.col("size"), weights=(1,), share=0.8, liking=F.col("w"))
    own = plan.groupBy("row.source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("taken"),
        F.first("target").alias("target"),
        F.avg(F.when(F.col("row.w") > 1, F.col("copies"))).alias("liked"),
        F.avg(F.when(F.col("row.w") == 1, F.col("copies"))).alias("other"),
        F.max("copies").alias("most"),
    )
    for r in own.collect():
        assert abs(r["taken"] - r["target"]) <= 8
        assert 3.4 < r["liked"] / r["other"] < 4.7 and r["most"] <= 2
    again = mixing.allocate(docs, F.col("size"), weights=(1,), share=0.8, liking=F.col("w"))
    pick = lambda df: sorted((r["row"]["doc_id"], r["copies"]) for r in df.collect())
    assert pick(plan) == pick(again)


def test_toxicity_learns_misspellings(spark):
    rng = np.random.default_rng(5)
    common = ["".join(rng.choice(list("aeioutnrsl"), size=5)) for _ in range(300)]
    bad = ["blurgh", "snorfle", "quibzat"]
    def doc(toxic, twist=""):
        words = list(rng.choice(common, size=60))
        if toxic:
            words[int(rng.integers(60))] = str(rng.choice(bad)) + twist
        return " ".join(words)
    texts = [doc(i % 2 == 1) for i in range(400)]
    model = toxicity.train(texts, np.array([i % 2 for i in range(400)]), toxicity.Shape(buckets=1 << 14), epochs=30)
    unseen = model.scores([doc(True, "ix") for _ in range(40)])
    clean = model.scores([doc(False) for _ in range(40)])
    assert np.mean(unseen >= 0.7) > 0.9 and np.mean(clean >= 0.7) < 0.1
    whole = model.scores([doc(False) + " " + LONG + " " + doc(True), None, ""])
    assert whole[0] > 0.7 and whole[1] == whole[2] and 0 <= whole[1] <= 1


def test_toxicity_query_holds_out(spark, sf):
    found = queries.op7_toxicity(spark, sf).collect()
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_toxicity_odd_cases(spark, odd, none):
    labels = spark.createDataFrame(
        [(1, 1), (2, 1), (2, 0), (3, None), (4, 0), (5, 0), (9, 1), (None, 1)], "doc_id long, toxic int"
    )
    assert toxicity.fit(odd, labels.where("toxic = 0")) is None
    assert {r["score"] for r in toxicity.scored(odd, None).collect()} == {0.0}
    model = toxicity.Model(toxicity.Shape(buckets=64), np.ones(64, dtype=np.float32), 0.0)
    assert toxicity.scored(odd, model).count() == 8
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    assert toxicity.scored(none, model).count() == 0
    assert toxicity.fit(none, labels) is None


def test_toxicity_never_learns_held_out_labels(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1]
    docs = spark.createDataFrame([(i, f"bad word {i}") for i in held], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in held], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels) is None


def test_decontamination_is_brute_force(spark, sf, texts):
    items = {r["item_id"]: brute.plain(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op8_decontaminate(spark, sf).collect()}
    plain = {d: brute.plain(t) for d, t in texts}
    exact = {(d, i) for d, t in plain.items() for i, item in items.items() if item in t}
    assert exact <= got
    for d, i in got - exact:
        assert brute.nearest(items[i], plain[d]) <= 0.12 * len(items[i])


def test_decontamination_finds_edits():
    rng = np.random.default_rng(11)
    letters = list("abcdefghij ")
    items = ["".join(rng.choice(letters, size=int(n))).strip() for n in rng.integers(40, 300, size=30)]
    index = decontaminate.build(list(range(30)), items)
    for n, item in enumerate(items):
        budget = int(index.edits[n])
        chars = list(brute.plain(item))
        for _ in range(budget):
            at, kind = int(rng.integers(len(chars))), int(rng.integers(3))
            if kind == 0:
                chars[at] = "k"
            elif kind == 1:
                del chars[at]
            else:
                chars.insert(at, "m")
        text = "".join(rng.choice(letters, size=200)) + ". " + "".join(chars).upper() + "! " + "".join(rng.choice(letters, size=99))
        hits = [h for h in decontaminate.search(index, [None, text, ""]) if h[1] == n]
        # Where an edit makes two spaces meet, one more is needed.
        least = brute.nearest(brute.plain(item), brute.plain(text))
        assert [(h[0], h[4]) for h in hits[:1]] == ([(1, least)] if least <= budget else []), n


def test_decontamination_odd_cases(spark, odd, none):
    items = spark.createDataFrame(
        [(1, SAME), (2, None), (3, ""), (4, "..."), (None, "without an id"), (6, SAME)], "item_id long, text string"
    )
    found = sorted((r["doc_id"] or 0, r["item_id"] or 0, r["start"], r["end"]) for r in decontaminate.find(odd, items).collect())
    whole = [(d, i, 0, len(SAME)) for d in (1, 2, 2) for i in (1, 6)]
    assert found == sorted([(0, 0, 4, 17), *whole])
    blocks = decontaminate.find(odd, items, block_chars=20)
    assert sorted((r["doc_id"] or 0, r["item_id"] or 0, r["start"], r["end"]) for r in blocks.collect()) == found
    clean = decontaminate.keep_clean(odd, items)
    assert clean.columns == odd.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [3, 4, 5, 6]
    assert decontaminate.find(none, items).count() == 0
    assert decontaminate.find(odd, items.where("false")).count() == 0


def test_decontamination_of_cut_passages():
    """A passage that the text cuts off within the edit budget is found up to the text's edge."""
    item = "a passage of the benchmark that nobody should learn by heart before the test " * 3
    index = decontaminate.build([1], [item])
    for cut in (1, 5, 20):
        for text in ("filler words " * 20 + item.strip()[:-cut], item[cut:] + "filler words " * 20, item.strip()[cut:-cut]):
            least = brute.nearest(brute.plain(item), brute.plain(text))
            hits = decontaminate.search(index, [text])
            assert [h[4] for h in hits] == ([least] if least <= index.edits[0] else [])
            assert all(0 <= h[2] < h[3] <= len(text) for h in hits)


def test_decontamination_in_long_texts():
    item = "a passage of the benchmark that nobody should learn by heart before the test"
    index = decontaminate.build([1], [item])
    text = ("filler of another kind " * 60000)[: decontaminate.BUFFER - 30] + item + " and so on"
    (hit,) = decontaminate.search(index, [text])
    assert text[hit[2] : hit[3]] == item and hit[4] == 0


def test_licences_query_is_brute_force(spark, sf, texts):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op9_licences(spark, sf).collect()}
    for doc_id, text in texts:
        want = licences.scan_text(text)
        assert got[doc_id][:6] == want[:6]
        assert got[doc_id][6] == pytest.approx(want[6])


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Released under the MIT License.", "mit"),
        ("under the  MIT-license and the Apache\nLicense", "apache,mit"),
        ("THE GNU GENERAL PUBLIC LICENSE, VERSION 3", "gpl,gpl-3.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("licensed under CC BY-NC 4.0", "cc-by-nc-4.0"),
        ("admit licenses", ""),
        ("Émit license", ""),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
         "documentation files (the Software), to deal in the Software without restriction, including without limitation "
         "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "mit"),
    ],
)
def test_licence_labels(spark, text, labels):
    table = spark.createDataFrame([(1, text), (2, "x " * 500 + text + " y" * 500)], "doc_id long, text string")
    found = licences.scan(table)
    assert [r["labels"] for r in found.collect()] == [labels] * 2
    assert licences.scan_text(text)[5] == labels


def test_licences_odd_cases(odd, none):
    found = licences.scan(odd)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
    rows = found.collect()
    assert len(rows) == 8 and all(r["labels"] == "" and r["n_base"] == 0 and r["first_word"] is None for r in rows)
    assert sorted(r["n_words"] for r in rows) == [0, 0, 0, 8, 8, 8, 8, len(LONG.split())]
    assert licences.scan(none).count() == 0


def test_recurrent_network_gradients():
    rng = np.random.default_rng(2)
    layer = language.Direction.fresh(3, rng)
    layer.inputs, layer.inner = layer.inputs.astype(np.float64), layer.inner.astype(np.float64)
    words = rng.integers(97, 101, size=(4, 5)).astype(np.uint8)
    weight = rng.normal(size=(5, 4, 3))
    run = layer.learn(words, None)
    next(run)
    d_inputs, d_inner = run.send(weight)
    def loss():
        return float((next(layer.learn(words, None)) * weight).sum())
    for table, gradient, cells in ((layer.inputs, d_inputs, [(97, 0), (98, 4), (99, 8)]), (layer.inner, d_inner, [(0, 0), (1, 4), (2, 8)])):
        for cell in cells:
            table[cell] += 1e-4
            up = loss()
            table[cell] -= 2e-4
            down = loss()
            table[cell] += 1e-4
            assert (up - down) / 2e-4 == pytest.approx(gradient[cell], rel=1e-2, abs=1e-4)


def test_language_query_on_held_out(spark, sf):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op10_language(spark, sf).collect()
    assert len(found) == len(docs)
    known = {d["lang"] for d in docs.values()}
    right = total = 0
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["lang_pred"] in known | {"und"} and 0 <= r["score"] <= 1
        if r["held_out"] and docs[r["doc_id"]]["lang"]:
            total += 1
            right += r["lang_pred"] == docs[r["doc_id"]]["lang"]
    assert right / total > 0.9


def test_language_odd_cases(odd, none):
    net = language.train(["alpha beta gamma delta"] * 5, ["en"] * 5, steps=5)
    found = {}
    for r in language.predict(odd, net).collect():
        found.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert found[3] == found[4] == found[6] == [("und", 0.0)]
    assert {p for p, _ in found[5] + found[1] + found[None]} == {"en"} and len(found[2]) == 2
    digits = language.Reader(net).predict(["123 456", "§§ !", None, "ø"])
    assert digits["lang_pred"].tolist() == ["und", "und", "und", "en"]
    assert language.predict(none, net).count() == 0
    empty = language.fit(none)
    assert {r["lang_pred"] for r in language.predict(odd, empty).collect()} == {"und"}


def test_language_memory_changes_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["ab ba aab " * 20, "cd dc ccd " * 20]
    net = language.train(texts, ["x", "y"], steps=30)
    many = [" ".join("".join(rng.choice(list("abcd"), size=int(n))) for n in rng.integers(1, 50, size=40)) for _ in range(20)]
    whole = language.Reader(net).predict(many)
    monkeypatch.setattr(language, "MEMORY", 10)
    monkeypatch.setattr(language, "GROUP", 64)
    # A cut inside a word makes two of it, so only texts below the group size compare exactly.
    short = [t[:60] for t in many]
    few = language.Reader(net).predict(short)
    monkeypatch.undo()
    assert few["lang_pred"].tolist() == language.Reader(net).predict(short)["lang_pred"].tolist()
    assert set(whole["lang_pred"]) <= {"x", "y"}


def test_columns_keep_their_types(odd):
    for kept in (simhash.keep_one(odd), lines.keep_first_lines(odd)):
        assert [f.dataType for f in kept.schema] == [f.dataType for f in odd.schema]
        assert isinstance(kept.schema["doc_id"].dataType, T.LongType)


def test_lines_of_every_length(spark):
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdefgh"), size=4)) for _ in range(3000)]
    texts = [" ".join(rng.choice(words, size=n)) for n in (120, 127, 128, 300, 40_000)]
    table = spark.createDataFrame([(i, t + "\n" + t + " more") for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r["id"], r["pos"]): r["fp"] for r in lines._lines(table, "doc_id", "text", 3).collect()}
    for i, t in enumerate(texts):
        hashes = [brute.xxhash.xxh64_intdigest(w, 42) for w in t.encode().split()]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        want = int(np.packbits(2 * bits.sum(axis=0) > len(hashes), bitorder="little").view("<u8")[0])
        assert got[(i, 0)] == brute.signed(want)
