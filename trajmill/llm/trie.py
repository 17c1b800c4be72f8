"""The trie of the prefixes of sequences, such as conversations, without building it in one place.

A prefix is known by its digest, the exclusive or of its elements' hashes with their places (128
bits), so all prefixes come from running sums. A count-min sketch of the digests screens them: a
counter of one proves that no other sequence has that prefix, nor any longer one of this sequence,
and such tails are written by the sequence alone. Only prefixes that may be shared are shuffled
and grouped exactly.

A node belongs to the smallest of its members. Along a sequence its owners only grow, so what a
sequence owns is a tail of its path, and what a node's subtree holds is a sum over its members
of what each owns: one more grouping, whatever the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajmill.llm.shared import store

#: Places of a sequence that one running sum takes.
BLOCK_BITS = 10
#: Counters of each of the two rows of the sketch, as powers of two: four to a prefix within these
#: bounds. The broadcast bits are 2^26 / 64 longs a row at most.
LEAST_BITS, MOST_BITS = 12, 26
#: Ids that are put in one row on the way to an ordered hash.
IDS = 4096
#: Stands for a null id: it counts as the largest.
NO_ID = (1 << 63) - 1

NODE = ["depth", "p1", "p2"]


def running(
    df: DataFrame, key: str, place: str, add: Callable[[Column], Column], **sums: Column
) -> DataFrame:
    """Add running sums along ``place``, the current row included. Long sequences are summed block
    by block: no task sorts one of them whole."""
    cut = df.withColumn("_block", F.shiftright(place, BLOCK_BITS)).withColumns({f"_{n}": c for n, c in sums.items()})
    within = Window.partitionBy(key, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut.groupBy(key, "_block").agg(*[add(F.col(f"_{n}")).alias(f"_of_{n}") for n in sums])
    shifts = blocks.select(
        F.col(key).alias("_key"), F.col("_block").alias("_at"), *[add(F.col(f"_of_{n}")).over(earlier).alias(f"_to_{n}") for n in sums]
    ).where(F.coalesce(*[F.col(f"_to_{n}") for n in sums]).isNotNull())
    here = cut.withColumns({n: add(F.col(f"_{n}")).over(within) for n in sums})
    joined = here.join(shifts, (F.col(key) == F.col("_key")) & (F.col("_block") == F.col("_at")), "left")
    return joined.select(*df.columns, *[F.struct(n, F.col(f"_to_{n}").alias("before")).alias(n) for n in sums])


def number(rows: DataFrame, key: str, order: str, *ties: str) -> DataFrame:
    """Add ``pos``, from 0, along a long column (null first) and the ties' columns."""
    block = F.coalesce(F.shiftright(order, BLOCK_BITS), F.lit(-(1 << 62)))
    cut = rows.withColumn("_block", block)
    within = Window.partitionBy(key, "_block").orderBy(F.col(order).asc_nulls_first(), *ties)
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    shifts = sizes.select(
        F.col(key).alias("_key"), F.col("_block").alias("_at"), F.sum("_n").over(earlier).alias("_before")
    ).where("_before > 0")
    here = cut.withColumn("_no", F.row_number().over(within) - 1)
    joined = here.join(shifts, (F.col(key) == F.col("_key")) & (F.col("_block") == F.col("_at")), "left")
    return joined.select(*rows.columns, (F.col("_no") + F.coalesce("_before", F.lit(0))).cast("long").alias("pos"))


def _paths(rows: DataFrame) -> DataFrame:
    """(id, depth, key, weight), depth from 1 -> (id, depth, weight, p1, p2)."""
    hashes = {f"p{i}": F.xxhash64(F.lit(i), F.col("depth"), F.col("key")) for i in (1, 2)}
    summed = running(rows, "id", "depth", F.bit_xor, **hashes)
    whole = {p: F.col(p)[p].bitwiseXOR(F.coalesce(F.col(p)["before"], F.lit(0).cast("long"))) for p in hashes}
    return summed.select("id", "depth", "weight", *[c.alias(p) for p, c in whole.items()])


def _tails(paths: DataFrame, bits: int) -> DataFrame:
    """(id, tail): the least depth at which the sketch proves that no other sequence is there."""
    slots = [F.col(p).bitwiseAND(F.lit((1 << bits) - 1)) for p in ("p1", "p2")]
    cells = F.array(*[F.struct(F.lit(i).alias("line"), s.alias("slot")) for i, s in enumerate(slots)])
    counts = paths.select(F.inline(cells)).groupBy("line", "slot").agg(F.count(F.lit(1)).alias("n"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))
    ones = store(
        counts.where("n = 1").groupBy("line", F.shiftright("slot", 6).alias("word")).agg(F.bit_or(one).alias("ones")),
        "sketch",
    )
    found = paths
    for i, slot in enumerate(slots):
        # At most 2^MOST_BITS / 64 rows.
        words = F.broadcast(ones.where(F.col("line") == i).select(F.col("word").alias(f"w{i}"), F.col("ones").alias(f"ones{i}")))
        found = found.join(words, F.shiftright(slot, 6) == F.col(f"w{i}"), "left")
    single = [
        F.call_function("shiftrightunsigned", F.coalesce(f"ones{i}", F.lit(0).cast("long")), slot.bitwiseAND(F.lit(63)).cast("int"))
        .bitwiseAND(F.lit(1)) == 1
        for i, slot in enumerate(slots)
    ]
    return found.where(single[0] | single[1]).groupBy("id").agg(F.min("depth").alias("tail"))


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (node, id) rows -> one row for up to IDS ids of a node."""
    node, ids, done = None, [], []

    def flush() -> None:
        if ids:
            done.append((*node, ids[0], ",".join("null" if i == NO_ID else str(i) for i in ids)))
            ids.clear()

    for batch in batches:
        for row in zip(*[batch[c].tolist() for c in (*NODE, "id")]):
            if row[:3] != node or len(ids) == IDS:
                flush()
                node = row[:3]
            ids.append(row[3])
        yield pd.DataFrame(done, columns=[*NODE, "first", "ids"])
        done = []
    flush()
    yield pd.DataFrame(done, columns=[*NODE, "first", "ids"])


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of _chunks in order -> the SHA-256 of each node's ids, as they pass."""
    node, state, done = None, None, []
    for batch in batches:
        for row in zip(*[batch[c].tolist() for c in (*NODE, "ids")]):
            if row[:3] == node:
                state.update(b",")
            else:
                if state:
                    done.append((*node, state.hexdigest()))
                node, state = row[:3], hashlib.sha256()
            state.update(row[3].encode())
        yield pd.DataFrame(done, columns=[*NODE, "ends_sha256"])
        done = []
    if state:
        done.append((*node, state.hexdigest()))
    yield pd.DataFrame(done, columns=[*NODE, "ends_sha256"])


def _ends(ends: DataFrame) -> DataFrame:
    """(node, id) -> (node, ends_sha256). The order across tasks comes from ranges, so a node that many
    sequences end at is sorted in many tasks; one task hashes its rows of IDS ids as they pass."""
    kinds = "depth long, p1 long, p2 long"
    sorted_ids = ends.repartitionByRange(*NODE, "id").sortWithinPartitions(*NODE, "id")
    chunks = store(sorted_ids.mapInPandas(_chunks, f"{kinds}, first long, ids string"), "ids")
    ordered = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return ordered.mapInPandas(_hashes, f"{kinds}, ends_sha256 string")


def prefix_trie(
    rows: DataFrame,
    members: DataFrame | None = None,
    id_col: str = "conv_id",
    order: str = "turn",
    key: str = "key",
    weight: str = "weight",
) -> DataFrame:
    """The nodes of the trie of all sequences of elements.

    ``rows`` hold one element each: the sequence's id, its place (a whole number, null first), its
    ``key``, equal where elements are equal, and its ``weight`` (null: 0); elements at one place are
    ordered by key, and a null key is a key of its own. ``members`` may name further ids, whose
    sequences are empty; rows without an id are one sequence, which counts as the largest id and is
    written as null. Repeated rows are elements like any others. Other columns are not read.

    A depth-d node is a distinct sequence of d elements with which some sequence starts; the root
    is the empty one. Per node: ``conv_id`` the smallest member; ``depth``; ``parent_conv_id`` of the
    parent (root: null); ``n_convs`` members; ``n_children``; ``n_leaves``, nodes without children in its
    subtree, itself included; ``saved``, the sum over the subtree of (members - 1) times the weight of a
    node's last element; ``ends_sha256``, the hash of the ids, ascending and comma-joined, of the members that
    end there. Without any sequence there is no node.
    """
    own = rows.select(
        F.coalesce(rows[id_col].cast("long"), F.lit(NO_ID)).alias("id"),
        rows[order].cast("long").alias("place"),
        F.coalesce(F.concat(F.lit("k"), rows[key].cast("string")), F.lit("")).alias("key"),
        F.coalesce(rows[weight].cast("long"), F.lit(0).cast("long")).alias("weight"),
    )
    numbered = number(own, "id", "place", "key", "weight").select("id", (F.col("pos") + 1).alias("depth"), "key", "weight")
    paths = store(_paths(numbered), "paths")
    lengths = paths.groupBy("id").agg(F.max("depth").alias("size"))
    if members is not None:
        more = members.select(F.coalesce(members[id_col].cast("long"), F.lit(NO_ID)).alias("id"))
        lengths = lengths.unionByName(more.select("id", F.lit(0).cast("long").alias("size")))
        lengths = lengths.groupBy("id").agg(F.max("size").alias("size"))
    bits = min(max((4 * paths.count()).bit_length(), LEAST_BITS), MOST_BITS)
    sizes = store(
        lengths.join(_tails(paths, bits), "id", "left").select(
            "id", "size", F.coalesce("tail", F.col("size") + 1).alias("tail")
        ),
        "sequences",
    )
    # Prefixes that may be shared, grouped exactly.
    shared = store(paths.join(sizes, "id").where("depth < tail").drop("tail"), "shared")
    nodes = store(
        shared.groupBy(*NODE).agg(
            F.count(F.lit(1)).alias("n_convs"),
            F.min("id").alias("owner"),
            F.max("size").alias("deepest"),
            F.min("weight").alias("weight"),
        ),
        "nodes",
    ).withColumn("own_saved", (F.col("n_convs") - 1) * F.col("weight"))
    owned = nodes.groupBy(F.col("owner").alias("id")).agg(
        F.min("depth").alias("own"),
        F.sum("own_saved").alias("saved"),
        F.max((F.col("deepest") == F.col("depth")).cast("long")).alias("leaf"),
    )
    # ``own``: from which depth on a sequence owns its path; null for a copy of a smaller one.
    has_tail = F.col("tail") <= F.col("size")
    sequences = store(
        sizes.join(owned, "id", "left").select(
            "id",
            "size",
            "tail",
            F.coalesce("own", F.when(has_tail, F.col("tail"))).alias("own"),
            F.coalesce("saved", F.lit(0)).alias("saved"),
            F.when(has_tail, 1).otherwise(F.coalesce("leaf", F.lit(0))).alias("leaf"),
        ),
        "owners",
    )
    facts = sequences.select("id", "own", "saved", "leaf")
    tagged = store(shared.select("id", *NODE).join(facts, "id"), "tagged")
    sums = tagged.groupBy(*NODE).agg(
        F.sum("saved").alias("all_saved"),
        F.sum("leaf").alias("n_leaves"),
        F.count_if(F.col("own") == F.col("depth") + 1).alias("new_children"),
    )
    low = sequences.agg(F.min("id")).scalar()
    branches = tagged.where(F.col("own") == F.col("depth") + 1).select("id", *NODE)
    parents = store(
        branches.join(nodes.select(*NODE, F.col("owner").alias("parent")), NODE).select("id", "parent"), "parents"
    )
    hashes = _ends(shared.where("depth = size").select(*NODE, "id"))
    before = running(nodes.select(*NODE, "owner", "own_saved"), "owner", "depth", F.sum, so_far=F.col("own_saved"))
    # What the owner owns above the node is not in the node's subtree.
    above = F.col("so_far.so_far") + F.coalesce("so_far.before", F.lit(0)) - F.col("own_saved")
    before = before.select(*NODE, above.alias("above"))
    owner = sequences.select(F.col("id").alias("owner"), F.col("size").alias("owner_size"), "own").join(
        parents.withColumnRenamed("id", "owner"), "owner", "left"
    )
    none = F.sha2(F.lit(""), 256)
    inner = (
        nodes.join(sums, NODE)
        .join(before, NODE)
        .join(hashes, NODE, "left")
        .join(owner, "owner")
        .select(
            F.col("owner").alias("conv_id"),
            "depth",
            _parent(F.col("owner"), low).alias("parent_conv_id"),
            "n_convs",
            (F.col("new_children") + (F.col("owner_size") > F.col("depth")).cast("long")).alias("n_children"),
            "n_leaves",
            (F.col("all_saved") - F.col("above")).alias("saved"),
            F.coalesce("ends_sha256", none).alias("ends_sha256"),
        )
    )
    tails = sequences.where("tail <= size").join(parents, "id", "left")
    block = F.explode(F.sequence(F.shiftright("tail", BLOCK_BITS), F.shiftright("size", BLOCK_BITS)))
    first, last = F.shiftleft("_block", BLOCK_BITS), F.shiftleft(F.col("_block") + 1, BLOCK_BITS) - 1
    depths = F.explode(F.sequence(F.greatest("tail", first), F.least("size", last)))
    outer = (
        tails.withColumn("_block", block)
        .withColumn("depth", depths)
        .select(
            F.col("id").alias("conv_id"),
            "depth",
            _parent(F.col("id"), low).alias("parent_conv_id"),
            F.lit(1).cast("long").alias("n_convs"),
            (F.col("depth") < F.col("size")).cast("long").alias("n_children"),
            F.lit(1).cast("long").alias("n_leaves"),
            F.lit(0).cast("long").alias("saved"),
            F.when(F.col("depth") == F.col("size"), F.sha2(_written(F.col("id")), 256)).otherwise(none).alias("ends_sha256"),
        )
    )
    empty = sequences.where("size = 0").select(*[F.lit(0).cast("long").alias(c) for c in NODE], "id")
    root = (
        sequences.agg(
            F.min("id").alias("conv_id"),
            F.count(F.lit(1)).alias("n_convs"),
            F.count_if(F.col("own") == 1).alias("n_children"),
            F.greatest(F.sum("leaf"), F.lit(1)).alias("n_leaves"),
            F.sum("saved").alias("saved"),
        )
        .where("n_convs > 0")
        .withColumn("depth", F.lit(0).cast("long"))
        .join(_ends(empty).select("depth", "ends_sha256"), "depth", "left")
        .select(
            "conv_id",
            "depth",
            F.lit(None).cast("long").alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            "saved",
            F.coalesce("ends_sha256", none).alias("ends_sha256"),
        )
    )
    found = inner.unionByName(outer).unionByName(root)
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return found.select(known("conv_id"), "depth", known("parent_conv_id"), *found.columns[3:])


def _parent(own_id: Column, low: Column) -> Column:
    """The owner of the node above: the sequence itself below the first node that it owns."""
    above = F.when(F.col("depth") == 1, low).otherwise(F.col("parent"))
    return F.when(F.col("depth") > F.col("own"), own_id).otherwise(above)


def _written(own_id: Column) -> Column:
    return F.when(own_id == NO_ID, "null").otherwise(own_id.cast("string"))
