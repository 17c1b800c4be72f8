"""Groups of 64-bit fingerprints that differ in few bits, natively and without all pairs.

The bits are cut into ``blocks`` parts. Two fingerprints with at most ``max_bits``
differing bits agree on at least ``blocks - max_bits`` parts, so they share one of the keys
made of that many parts. Rows meet by key:

1. every row is compared with one row of its key (linear, whatever the key's size);
2. the links found so far are contracted to components, and keys whose rows are all in one
   component are done: this is where large groups of near copies end;
3. in the other keys, rows of different components are compared.

The outcome is exactly the components of the links; only the links inside a component
that is connected already are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajmill.llm.components import components
from trajmill.llm.shared import remove, small, store

BITS = 64
#: Orders of the ids by which the rows of a group of keys are compared with one of them.
ORDERS = 8


def masks(max_bits: int, blocks: int) -> list[int]:
    """Signed 64-bit masks of all choices of ``blocks - max_bits`` parts."""
    if not 0 <= max_bits < blocks <= BITS:
        raise ValueError("need 0 <= max_bits < blocks <= 64")
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:])]
    chosen = [sum(some) for some in combinations(parts, blocks - max_bits)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in chosen]


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _keys(fp: Column, max_bits: int, blocks: int) -> Column:
    """One hash per choice of parts; equal hashes by chance are sorted out by distance()."""
    return F.array(
        *[
            F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(m)))
            for i, m in enumerate(masks(max_bits, blocks))
        ]
    )


def link(
    nodes: DataFrame,
    max_bits: int,
    blocks: int,
    verify: Callable[[DataFrame], DataFrame] = lambda pairs: pairs,
) -> DataFrame:
    """(id, fp), ids distinct longs -> (id, component) of all ids that have a link.

    A link is a pair within ``max_bits`` bits that ``verify`` keeps of the stored (a, b) pairs it
    is given; component is the smallest id that can be reached.
    """
    keyed = nodes.select("id", "fp", pigeonholes("fp", max_bits, blocks))
    return link_keyed(keyed, lambda x, y: distance(x["fp"], y["fp"]) <= max_bits, verify)


def pigeonholes(fp: str, max_bits: int, blocks: int) -> Column:
    """One row for each key of a fingerprint."""
    return F.explode(_keys(F.col(fp), max_bits, blocks)).alias("key")


def link_keyed(
    keyed: DataFrame,
    near: Callable[[dict[str, Column], dict[str, Column]], Column],
    verify: Callable[[DataFrame], DataFrame] = lambda pairs: pairs,
    rounds: int = 1,
    join_up: Callable[[DataFrame], DataFrame] = components,
    parts: int = 1,
) -> DataFrame:
    """The same for rows (id, key, others): a link is a pair that shares a key, of which ``near``
    holds, given the other columns of both by name, and which ``verify`` keeps.

    ``rounds`` says how often rows are compared with one row of their key before pairs are made;
    ``join_up`` makes components of links. The rows of shared keys are looked for in ``parts`` of the
    keys, one after the other: no more than a part's shuffle is on disk at a time."""
    others = [c for c in keyed.columns if c not in ("id", "key")]
    here, there = {c: F.col(c) for c in others}, {c: F.col(f"{c}_2") for c in others}
    renamed = {c: f"{c}_2" for c in others}
    # Most keys have one row: they go before anything but the key is shuffled.
    members = []
    for part in range(parts):
        own = keyed.where(F.pmod("key", F.lit(parts)) == part) if parts > 1 else keyed
        shared = store(own.groupBy("key").count().where("count > 1").select("key"), "keys")
        members.append(store(own.join(small(shared), "key"), "members"))
        remove(shared)
    tagged, first = reduce(DataFrame.unionByName, members).withColumn("component", F.col("id")), None
    done = members
    for turn in range(rounds):
        # One round compares with the smallest id; of several, the first with rows by one of a few
        # orders of the ids, so that a group meets some of its rows and not one of them, and the others
        # with rows that were linked to the most of those: the middle of a group.
        order = F.lit(0).cast("long") if rounds == 1 else F.xxhash64("id", F.pmod("key", F.lit(ORDERS)))
        ranked = tagged.withColumn("links", F.lit(0).cast("long"))
        if turn:
            links = found if turn == 1 else links.unionByName(found)
            counts = links.groupBy(F.col("b").alias("id")).agg((-F.count(F.lit(1))).alias("links"))
            counts = counts.join(links.select(F.col("a").alias("id")).distinct(), "id", "left_anti")
            ranked = tagged.join(small(store(counts, "link-counts")), "id", "left")
        reps = store(
            ranked.groupBy("key")
            .agg(F.min(F.struct(F.coalesce("links", F.lit(0).cast("long")), order, "id", "component", *others)).alias("rep"))
            .select("key", "rep.*"),
            "reps",
        ).select("key", F.col("id").alias("rep"), F.col("component").alias("rep_component"), *[F.col(c).alias(n) for c, n in renamed.items()])
        pairs = store(
            tagged.join(small(reps), "key")
            .where(near(here, there) & (F.col("component") != F.col("rep_component")))
            .select(F.col("rep").alias("a"), F.col("id").alias("b"))
            .distinct(),
            "first-pairs",
        )
        remove(reps)
        found = store(verify(pairs), "first-links")
        remove(pairs)
        first = found if first is None else first.unionByName(found)
        so_far = store(join_up(first), "components")
        tagged = store(
            tagged.drop("component")
            .join(small(so_far), "id", "left")
            .select("key", "id", *others, F.coalesce("component", "id").alias("component")),
            "tagged",
        )
        for old in done:
            remove(old)
        done = [tagged]
        mixed = store(
            tagged.groupBy("key")
            .agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
            .where("lo < hi")
            .select("key"),
            "mixed",
        )
        if turn + 1 < rounds:
            tagged = store(tagged.join(small(mixed), "key"), "tagged")
            remove(done[0])
            done = [tagged]
    rest = store(tagged.join(small(mixed), "key"), "rest")
    remove(tagged)
    other = rest.withColumnsRenamed({"id": "id2", "component": "component2", **renamed})
    second = store(
        rest.join(other, "key")
        .where("component < component2")
        .where(near(here, there))
        .select(F.col("id").alias("a"), F.col("id2").alias("b"))
        .distinct(),
        "second-pairs",
    )
    remove(rest)
    if second.isEmpty():
        return so_far
    return join_up(first.unionByName(verify(second)))
