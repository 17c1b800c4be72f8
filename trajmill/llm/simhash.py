"""Near-duplicates: SimHash fingerprints of shingles, pigeonhole blocks, Hamming check."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajmill.llm.linking import link
from trajmill.llm.shared import small, store

SEED = 42
_AT_ONCE = 1 << 18


def fingerprint(text: str | None, words: int) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text, repeats included.

    A-Z are lower-cased; words are split at ASCII white space and joined by one space; a
    bit is 1 if set in over half of the shingles' XXH64. Fewer words than a shingle
    needs make one shingle; no word at all, or a null text, gives 0.
    """
    tokens = (text or "").encode("utf-8").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    size = min(words, len(tokens))
    starts, ends = starts[: len(tokens) - size + 1], ends[size - 1 :]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), _AT_ONCE):
        spans = zip(starts[at : at + _AT_ONCE].tolist(), ends[at : at + _AT_ONCE].tolist())
        hashes = np.array(
            [xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in spans], dtype="<u8"
        )
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def _prints(words: int):
    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        found = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64)
        return pd.Series(found.view(np.int64))

    return prints


def _groups(prints: DataFrame, max_bits: int, blocks: int) -> DataFrame:
    """(id, fp) -> (fp, component, component_id), one row per distinct fingerprint."""
    nodes = store(prints.groupBy("fp").agg(F.min("id").alias("smallest")), "nodes")
    linked = small(store(link(nodes.select(F.col("fp").alias("id"), "fp"), max_bits, blocks), "linked"))
    tagged = store(
        nodes.join(linked, nodes["fp"] == linked["id"], "left").select(
            "fp", "smallest", F.coalesce("component", "fp").alias("component")
        ),
        "tagged",
    )
    lowest = store(
        tagged.groupBy("component").agg(F.min("smallest").alias("component_id")), "lowest"
    )
    return store(tagged.join(lowest, "component").drop("smallest"), "groups")


def near_duplicates(
    docs: DataFrame,
    words: int = 3,
    max_bits: int = 3,
    blocks: int = 6,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(id column, fp, component_id) of every document; fp is the fingerprint as a signed long.

    Documents whose fingerprints differ in at most ``max_bits`` bits are linked;
    component_id is the smallest id that can be reached, the own one included. Copies are
    first reduced to one fingerprint, so a large group of them is one node. Null and empty
    texts have fingerprint 0 and are linked by it; repeated rows stay; null ids are never
    the smallest (null where a group has no other). Other columns are not read. An empty
    table gives an empty result.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    prints = store(texts.select("id", _prints(words)("text").alias("fp")), "fingerprints")
    found = prints.join(_groups(prints, max_bits, blocks), "fp")
    return found.select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(
    docs: DataFrame,
    words: int = 3,
    max_bits: int = 3,
    blocks: int = 6,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The documents, all columns, without near-duplicates: of each group of near_duplicates() the row
    with the smallest id stays.

    Null ids come last; of rows with one id that with the smallest hash of its text, and of rows that
    repeat both, one, chosen by a hash of the row. Null and empty texts form a group like any other.
    Any other columns pass, whatever their names. An empty table gives an empty result.
    """
    columns = docs.columns
    body = docs.select(
        F.struct(*[docs[c] for c in columns]).alias("row"),
        docs[id_col].alias("id"),
        docs[text].cast("string").alias("text"),
    ).withColumn("t", F.xxhash64("text"))
    # The ids that the groups' smallest are taken from tell rows of one id apart.
    key = F.struct(F.col("id").isNull().alias("none"), "id", "t").alias("key")
    found = near_duplicates(body.select(key, "text"), words, max_bits, blocks, "key", "text")
    chosen = found.where(F.col("key").eqNullSafe(F.col("component_id"))).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    chosen = store(chosen.select(F.col("key.id").alias("id2"), F.col("key.t").alias("t2"), "n"), "chosen")
    kept = body.join(chosen, F.col("id").eqNullSafe(F.col("id2")) & (F.col("t") == F.col("t2")))
    alone = kept.where("n = 1").select("row")
    order = F.xxhash64(F.to_json("row"))
    tied = kept.where("n > 1").groupBy("id2", "t2").agg(F.min_by("row", order).alias("row"))
    return alone.unionByName(tied.select("row")).select("row.*")
