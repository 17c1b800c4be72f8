"""Near-duplicates by SuperMinHash signatures, bands, a check of the whole sets, and union-find.

SuperMinHash gives every element of a set one random order of the slots; the element's value in
the j-th slot of that order is j plus a fraction, and a slot keeps the smallest value of all
elements. The slots of one element are negatively correlated, so the share of equal slots of two
signatures varies less than that of independent minima. Elements are handled order by order,
all at once: as soon as no slot holds more than j, places beyond j can change nothing and are never
drawn. A set of some hundred elements needs one or two of the 128 places.

Bands of slots make candidates. Each set also has the parities of its elements in PARITIES places: two
sets differ in at least as many elements as their parities do in places, so pairs that differ in more than
their similarity allows go before a text is read. Of the others the sets of shingles are compared whole. Links are
reduced to a forest by union-find within each task and then merged across tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajmill.llm.components import components
from trajmill.llm.linking import link_keyed
from trajmill.llm.shared import small, store

#: A pair with a similarity of 0.8 shares none of the bands once in twenty million times.
BANDS, ROWS = 32, 4
#: Elements whose orders are drawn together.
AT_ONCE = 1 << 15
#: How often rows are compared with one row of their key before pairs are made.
ROUNDS = 3
#: Places of the parities of a set, in longs of 64.
PARITIES = 512
#: Texts that one task compares with a text at a time.
SHARE = 32

_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _ODD
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct word shingles of a text as sorted 64-bit hashes.

    A-Z are lower-cased and words split at ASCII white space. Fewer words than a shingle needs make
    one shingle; no word at all, or a null text, gives an empty set.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), dtype=np.uint64, count=len(tokens))
    size = min(words, len(hashes))
    found = np.full(len(hashes) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        found = _mixed(found * _ODD + hashes[i : len(hashes) - size + 1 + i])
    return np.unique(found)


def _groups(sets: Iterable[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Sets of AT_ONCE elements together, larger ones alone."""
    group: list[np.ndarray] = []
    size = 0
    for own in sets:
        if group and size + len(own) > AT_ONCE:
            yield group
            group, size = [], 0
        group.append(own)
        size += len(own)
    yield group


def signatures(sets: list[np.ndarray], slots: int = BANDS * ROWS) -> np.ndarray:
    """The SuperMinHash of each set, one row of doubles; of an empty set, infinities."""
    best = np.full((len(sets), slots), np.inf)
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)])
    for at in range(0, len(elements), AT_ONCE):
        _lower(elements[at : at + AT_ONCE], owners[at : at + AT_ONCE], best)
    return best


def _lower(elements: np.ndarray, owners: np.ndarray, best: np.ndarray) -> None:
    """Lower the slots by some elements, place by place of their orders of slots."""
    slots, flat = best.shape[1], best.reshape(-1)
    orders = moved = None
    for place in range(slots):
        # Values at this place are at least its number.
        some = (best.max(axis=1) > place)[owners]
        if not some.all():
            elements, owners = elements[some], owners[some]
            orders = None if orders is None else orders[some]
            moved = None if moved is None else moved[some]
        if not len(elements):
            return
        bits = _mixed(elements + np.uint64(place * int(_ODD) % (1 << 64)))
        fraction = (bits >> np.uint64(12)) * 2.0**-52
        other = place + (_mixed(bits ^ _MIX) % np.uint64(slots - place)).astype(np.int64)
        rows = np.arange(len(elements))
        if place == 0:
            # The order is that of the numbers so far; most elements need no more of it.
            slot = moved = other
        else:
            if orders is None:
                orders = np.tile(np.arange(slots, dtype=np.min_scalar_type(slots)), (len(elements), 1))
                orders[rows, moved] = 0
            slot = orders[rows, other].astype(np.int64)
            orders[rows, other] = orders[:, place]
        np.minimum.at(flat, owners * slots + slot, place + fraction)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band for each signature."""
    bits = signature.view(np.uint64).reshape(len(signature), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _MIX, bits.shape[:2])
    for i in range(rows):
        keys = _mixed((keys ^ bits[:, :, i]) * _ODD)
    return keys


def _set_id(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) if len(own) else 0


def parities(own: np.ndarray) -> np.ndarray:
    """In which of the places an odd number of a set's elements falls, as longs. Where two sets differ
    here, at least one element is in one of them alone."""
    odd = np.bincount((own % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sketches(words: int, bands: int, rows: int):
    @F.pandas_udf("k long, size long, bands array<long>, odd array<long>")
    def sketches(texts: pd.Series) -> pd.DataFrame:
        found = []
        for sets in _groups(shingle_set(t, words) for t in texts):
            keys = band_keys(signatures(sets, bands * rows), bands, rows).view(np.int64)
            for own, row in zip(sets, keys):
                k = np.uint64(_set_id(own)).astype(np.int64)
                found.append((k, len(own), row if len(own) else row[:0], parities(own)))
        return pd.DataFrame(found, columns=["k", "size", "bands", "odd"])

    return sketches


def _comparer(words: int, percent: int) -> Callable:
    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        firsts = dict(zip(left["a1"], left["text1"]))
        found, known, first = [], None, None
        for a, b, text in right.sort_values("a")[["a", "b", "text2"]].itertuples(index=False):
            if a != known:
                known, first = a, shingle_set(firsts[a], words)
            second = shingle_set(text, words)
            both = len(np.intersect1d(first, second, assume_unique=True))
            if 100 * both >= percent * (len(first) + len(second) - both):
                found.append((a, b))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return compare


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the links of a task: one link from each id to the root it has here."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    found = [(x, find(x)) for x in root]
    yield pd.DataFrame([x for x in found if x[0] != x[1]], columns=["a", "b"], dtype="int64")


def near_duplicates(
    docs: DataFrame,
    words: int = 4,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(id column, n_shingles, component_id, kept) of every document.

    Documents are linked if their sets of distinct shingles of ``words`` words have
    100 * intersection >= ``percent`` * union; component_id is the smallest id that can be
    reached, the own one included, and ``kept`` is set where it is the own one. Documents without words,
    null texts included, have an empty set and are linked with nothing. Pairs that share a
    band are compared by their whole sets. Documents with one set are one node.

    Repeated rows stay and are linked like any others; null ids are never the smallest, and kept
    only where their group has no other. Other columns are not read. An empty table gives an
    empty result.
    """
    texts = docs.select(docs[id_col].alias("id"), docs[text].cast("string").alias("text"))
    found = texts.select("id", F.xxhash64("text").alias("t"), _sketches(words, bands, rows)("text").alias("s"))
    sketches = store(found.select("id", "t", "s.*"), "sketches")
    nodes = store(
        sketches.where("size > 0")
        .groupBy("k")
        .agg(
            F.min("id").alias("smallest"),
            F.min("size").alias("size"),
            F.min(F.struct("t", "id")).alias("pick"),
            F.min("bands").alias("bands"),
            F.min("odd").alias("odd"),
        ),
        "nodes",
    )
    odds = [f"odd{i}" for i in range(PARITIES // 64)]
    odd = [F.get("odd", F.lit(i)).alias(c) for i, c in enumerate(odds)]
    keyed = nodes.select(F.col("k").alias("id"), "size", *odd, F.explode("bands").alias("key"))

    def near(x: dict[str, Column], y: dict[str, Column]) -> Column:
        # With D elements in one set alone, 100 * (sizes - D) >= percent * (sizes + D).
        apart = reduce(lambda a, b: a + b, [F.bit_count(x[c].bitwiseXOR(y[c])) for c in odds])
        fits = (100 + percent) * apart <= (100 - percent) * (x["size"] + y["size"])
        return fits & (100 * F.least(x["size"], y["size"]) >= percent * F.greatest(x["size"], y["size"]))

    def texts_of(ids: DataFrame) -> DataFrame:
        """(k, text) of nodes: the text of one document each, found by its hash and id."""
        picks = nodes.select("k", F.col("pick.t").alias("t"), F.col("pick.id").alias("id2"))
        wanted = store(ids.join(picks, "k"), "wanted")
        same = texts.withColumn("t", F.xxhash64("text")).join(small(wanted), "t").where(F.col("id").eqNullSafe(F.col("id2")))
        return store(same.groupBy("k").agg(F.min("text").alias("text")), "texts")

    def verify(pairs: DataFrame) -> DataFrame:
        # Each text of a pair is sent once; the one that many are compared with, once per SHARE of them.
        # The shares are put together to calls of about as many pairs.
        calls = F.lit(max(pairs.count() // SHARE, 1))
        counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        shares = store(counts.select("a", F.ceil(F.col("n") / SHARE).cast("int").alias("shares")), "shares")
        ends = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
        body = texts_of(ends)
        left = (
            shares.join(body.withColumnRenamed("k", "a"), "a")
            .withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
            .select(F.pmod(F.xxhash64("a", "share"), calls).alias("call1"), F.col("a").alias("a1"), F.col("text").alias("text1"))
        )
        share = F.pmod(F.xxhash64("b"), F.col("shares")).cast("int")
        right = (
            pairs.join(small(shares), "a")
            .join(body.withColumnRenamed("k", "b"), "b")
            .select(F.pmod(F.xxhash64("a", share), calls).alias("call"), "a", F.col("b").alias("b"), F.col("text").alias("text2"))
        )
        same = left.groupBy("call1").cogroup(right.groupBy("call"))
        return same.applyInPandas(_comparer(words, percent), "a long, b long")

    def join_up(links: DataFrame) -> DataFrame:
        return components(links.mapInPandas(_forest, "a long, b long"))

    linked = store(link_keyed(keyed, near, verify, ROUNDS, join_up), "linked").withColumnRenamed("id", "k")
    tagged = store(
        nodes.select("k", "smallest")
        .join(small(linked), "k", "left")
        .select("k", "smallest", F.coalesce("component", "k").alias("component")),
        "tagged",
    )
    lowest = store(tagged.groupBy("component").agg(F.min("smallest").alias("component_id")), "lowest")
    groups = store(tagged.join(lowest, "component").select("k", "component_id"), "groups")
    whole = sketches.where("size > 0").select("id", "k", "size").join(groups, "k")
    empty = sketches.where("size = 0").select("id", "size", F.col("id").alias("component_id"))
    return (
        whole.select("id", "size", "component_id")
        .unionByName(empty)
        .select(
            F.col("id").alias(id_col),
            F.col("size").alias("n_shingles"),
            "component_id",
            F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
        )
    )
