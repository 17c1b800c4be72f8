"""Licence scans with a positional index of rare words, on built-in functions alone.

The index holds the rarest words of each licence template with their positions. A file's
words are looked up there; postings of one template that agree on where the template would start
are added up, and where they hold enough of the template's weight its mandatory key phrases are
looked for in that stretch of the file.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajmill.llm.shared import store

# Licence notices (label, text, mandatory key phrases).
TEMPLATES = [
    (
        "mit",
        "released under the mit license",
        ["mit license"],
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software "
        "and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software",
        ["permission is hereby granted free of charge", "without restriction"],
    ),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0",
        ["apache license version 2 0"],
    ),
    (
        "gpl-3.0",
        "licensed under the gnu general public license version 3",
        ["general public license version 3"],
    ),
    (
        "gpl-2.0",
        "licensed under the gnu general public license version 2",
        ["general public license version 2"],
    ),
    (
        "gpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the "
        "gnu general public license as published by the free software foundation either version 3 of the license",
        ["gnu general public license", "either version 3"],
    ),
    (
        "lgpl-3.0",
        "licensed under the gnu lesser general public license version 3",
        ["lesser general public license"],
    ),
    (
        "agpl-3.0",
        "licensed under the gnu affero general public license version 3",
        ["affero general public license"],
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ["mozilla public license"],
    ),
    (
        "bsd-3-clause",
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met neither the name of the copyright holder nor the "
        "names of its contributors may be used to endorse or promote products",
        ["redistribution and use in source and binary forms", "endorse or promote products"],
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee "
        "is hereby granted",
        ["for any purpose with or without fee is hereby granted"],
    ),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", ["cc0 1 0"]),
]
#: Words that are rare outside licences.
RARE = ["license", "hereby", "redistribution"]
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

#: A word after A-Z are lower-cased, and before.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Positions are compared in overlapping stretches of twice this many words.
STRETCH = 8


def rarity(templates: list) -> dict[str, float]:
    """IDF of every word over the templates."""
    known = Counter(w for _, text, _ in templates for w in set(text.split()))
    return {w: math.log(1 + len(templates) / n) for w, n in known.items()}


def postings(templates: list, rare: int) -> list[tuple[str, int, int, float]]:
    """(word, template, position, weight): the ``rare`` rarest words of each template, at every
    place; a word's weight is dealt over its places."""
    weight, out = rarity(templates), []
    for number, (_, text, _) in enumerate(templates):
        words = text.split()
        chosen = sorted(set(words), key=lambda w: (-weight[w], w))[:rare]
        out += [
            (w, number, at, weight[w] / words.count(w)) for at, w in enumerate(words) if w in chosen
        ]
    return out


def _maybe(text: Column, templates: list) -> Column:
    """Whether a text can hold the first key phrase of any template, or a base phrase: a word that
    is rare outside licences, or, for a phrase without one, the whole phrase."""
    # lower() maps some letters outside ASCII to ASCII too: it finds too much, never too little.
    loose = F.lower(text)
    phrases = {phrase for _, phrase in BASE} | {keys[0] for _, _, keys in templates}
    found = [F.contains(loose, F.lit(w)) for w in RARE if any(w in p.split() for p in phrases)]
    for phrase in sorted(p for p in phrases if not any(w in p.split() for w in RARE)):
        longest = max(phrase.split(), key=lambda w: (len(w), w))
        whole = f"{_NOT_WORD}+".join(re.escape(w) for w in phrase.split())
        found.append(F.contains(loose, F.lit(longest)) & loose.rlike(whole))
    return reduce(lambda a, b: a | b, found)


def _base_places(words: Column) -> tuple[Column, Column]:
    """The starts of the base phrases, and the labels in the same order."""

    def found(i: Column) -> Column:
        hits = []
        for label, phrase in BASE:
            parts = phrase.split()
            same = [F.get(words, i + k) == p for k, p in enumerate(parts)]
            hits.append(F.when(reduce(lambda a, b: a & b, same), F.struct(i.alias("at"), F.lit(label).alias("label"))))
        return F.coalesce(*hits)

    places = F.filter(F.transform(words, lambda _, i: found(i)), lambda x: x.isNotNull())
    return places["at"], places["label"]


def scan(
    docs: DataFrame,
    templates: list | None = None,
    rare: int = 12,
    share: float = 0.6,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: id column, n_words, n_base, first_word, last_word, base_labels, labels,
    score, and ``matches``: (label, first_word, share) of each template found.

    A template is found where postings that agree on its place hold ``share`` of the weight of its
    ``rare`` rarest words, and all its key phrases stand in that stretch. Score is the largest
    such share (at most 1); a base phrase counts 1, no label 0. Null and empty texts have no words
    and empty labels; repeated rows and null ids stay; other columns are not read; an empty table
    gives an empty result.
    """
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    exact = F.regexp_extract_all(F.translate(body, _UPPER, _LOWER), F.lit(WORD), F.lit(0))
    rows = store(
        docs.select(docs[id_col].alias("id"), docs[text].alias("text")).select(
            F.monotonically_increasing_id().alias("row"),
            "id",
            F.regexp_count(body, F.lit(_RAW_WORD)).cast("long").alias("n_words"),
            F.when(_maybe(body, templates), exact).alias("words"),
        ),
        "licence-words",
    )
    starts, labels = _base_places(F.col("words"))
    base = rows.where("words IS NOT NULL").select("row", "words", starts.alias("starts"), labels.alias("base"))

    index = spark.createDataFrame(postings(templates, rare), "word string, template int, place int, weight double")
    facts = spark.createDataFrame(
        [
            (n, label, keys, len(words.split()), sum(w for _, t, _, w in postings(templates, rare) if t == n))
            for n, (label, words, keys) in enumerate(templates)
        ],
        "template int, label string, keys array<string>, length int, total double",
    )
    # The index is a fixed list: its size does not depend on the documents.
    hits = (
        base.select("row", F.posexplode("words").alias("at", "word"))
        .join(F.broadcast(index), "word")
        .withColumn("cell", F.floor((F.col("at") - F.col("place")) / STRETCH))
        .withColumn("cell", F.explode(F.array(F.col("cell"), F.col("cell") - 1)))
        .groupBy("row", "template", "cell", "place")
        .agg(F.first("weight").alias("weight"), F.min("at").alias("at"))
        .groupBy("row", "template", "cell")
        .agg(F.sum("weight").alias("weight"), F.min("at").alias("at"))
        .join(F.broadcast(facts), "template")
        .where(F.col("weight") >= share * F.col("total") - 1e-9)
    )
    begin = F.greatest(F.col("cell") * STRETCH, F.lit(0)).cast("int")
    length = (F.col("length") + 4 * STRETCH).cast("int")
    stretch = F.concat(F.lit(" "), F.array_join(F.slice("words", begin + 1, length), " "), F.lit(" "))
    near = F.forall("keys", lambda k: F.contains(F.col("stretch"), F.concat(F.lit(" "), k, F.lit(" "))))
    found = (
        store(hits.select("row", "label", "keys", "length", "cell", "at", (F.col("weight") / F.col("total")).alias("share")), "licence-hits")
        .join(base.select("row", "words"), "row")
        .withColumn("stretch", stretch)
        .where(near)
        .groupBy("row")
        .agg(
            F.array_sort(
                F.collect_set(F.struct("label", F.col("at").alias("first_word"), F.col("share")))
            ).alias("matches")
        )
    )
    merged = rows.select("row", "id", "n_words").join(
        base.select("row", "starts", "base"), "row", "left"
    ).join(store(found, "licence-matches"), "row", "left")
    none = F.array().cast("array<string>")
    own = F.array_sort(F.array_distinct(F.coalesce("base", none)))
    added = F.coalesce(F.col("matches")["label"], none)
    best = F.least(F.lit(1.0), F.coalesce(F.array_max(F.col("matches")["share"]), F.lit(0.0)))
    return merged.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce(F.size("starts"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(own, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(own, added))), ",").alias("labels"),
        F.when(F.size(own) > 0, 1.0).otherwise(best).alias("score"),
        F.coalesce("matches", F.array().cast("array<struct<label:string,first_word:int,share:double>>")).alias("matches"),
    )


def scan_text(text: str | None, templates: list | None = None, rare: int = 12, share: float = 0.6) -> tuple:
    """The same for one text, word by word; what the tests compare with."""
    templates = TEMPLATES if templates is None else templates
    lowered = (text or "").translate(str.maketrans(_UPPER, _LOWER))
    words = re.findall(WORD, lowered)
    base = []
    for label, phrase in BASE:
        parts = phrase.split()
        base += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    index, labels, best = postings(templates, rare), set(), 0.0
    for n, (label, body, keys) in enumerate(templates):
        own = [(w, at, weight) for w, t, at, weight in index if t == n]
        total, length = sum(w for _, _, w in own), len(body.split())
        for cell in range(-length // STRETCH - 2, len(words) // STRETCH + 1):
            places = {
                at: weight
                for word, at, weight in own
                for i in range(max(0, cell * STRETCH + at), min(len(words), (cell + 2) * STRETCH + at))
                if words[i] == word
            }
            begin = max(cell * STRETCH, 0)
            stretch = f" {' '.join(words[begin : begin + length + 4 * STRETCH])} "
            if sum(places.values()) >= share * total - 1e-9 and all(f" {k} " in stretch for k in keys):
                labels.add(label)
                best = max(best, min(1.0, sum(places.values()) / total))
    own_labels = {label for _, label in base}
    return (
        len(words),
        len(base),
        min((i for i, _ in base), default=None),
        max((i for i, _ in base), default=None),
        ",".join(sorted(own_labels)),
        ",".join(sorted(own_labels | labels)),
        1.0 if base else best,
    )
