"""Exact top-k inner products in norm order.

Vectors are sorted by length, longest first, and cut into blocks; queries are cut into
blocks too. The longest block gives every query a first k-th best score; later blocks are
visited only as far as the Cauchy-Schwarz bound ``|q| |x|`` reaches it. Inside a pair of
blocks all vectors are rotated by the SVD of the whole table, so that a product of the
leading components plus the product of the residual lengths is a tight upper bound; only
pairs whose bound reaches the current k-th score are multiplied out, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajmill.llm.shared import store

CHUNK = 1024
_SAFE = float(1 << 53)


def integers(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component; null where the vector or a component is null or
    not finite."""
    wide = vector.cast("array<double>")
    finite = F.forall(
        wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.when(finite, F.transform(wide, lambda x: F.floor(x * scale)))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of the whole table, largest first, from the sum of the outer
    products: width * width numbers come to the driver, whatever the number of rows."""

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch["v"], width).astype(np.float64)
            total += m.T @ m
        yield pd.DataFrame({"cell": np.arange(width * width), "part": total.ravel()})

    cells = vectors.select("v").mapInPandas(grams, "cell long, part double")
    summed = {r["cell"]: r["s"] for r in cells.groupBy("cell").agg(F.sum("part").alias("s")).collect()}
    gram = np.array([summed.get(i, 0.0) for i in range(width * width)]).reshape(width, width)
    return np.ascontiguousarray(np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1])


def search_block(
    q_ids: np.ndarray,
    queries: np.ndarray,
    floors: np.ndarray,
    x_ids: np.ndarray,
    vectors: np.ndarray,
    turn: np.ndarray,
    k: int,
) -> list[tuple[int, int, int]]:
    """(query id, vector id, score): the k best of the vectors for each query, without those
    below the query's floor. Score ties go to the smaller id."""
    lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    order = np.lexsort((x_ids, -lengths))
    x_ids, vectors, lengths = x_ids[order], vectors[order], lengths[order]
    q_lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    width = queries.shape[1]
    lead = max(1, width // 4)
    q_turned, x_turned = queries @ turn, vectors @ turn
    q_rest = np.sqrt((q_turned[:, lead:] ** 2).sum(axis=1))
    x_rest = np.sqrt((x_turned[:, lead:] ** 2).sum(axis=1))
    exact_floats = q_lengths.max(initial=0) * lengths.max(initial=0) * 4 < _SAFE
    kind = np.float64 if exact_floats else np.int64
    whole_q, whole_x = queries.astype(kind), vectors.astype(kind)
    best: list[list[tuple[int, int]]] = [[] for _ in q_ids]
    floors = floors.astype(np.float64).copy()
    for at in range(0, len(x_ids), CHUNK):
        part = slice(at, at + CHUNK)
        longest = lengths[at]
        slack = 1e-9 * q_lengths * longest + 1e-3
        alive = np.flatnonzero(q_lengths * longest + slack >= floors)
        if not len(alive):
            break
        bound = q_turned[alive, :lead] @ x_turned[part, :lead].T
        bound += np.outer(q_rest[alive], x_rest[part])
        reach = bound >= (floors - slack)[alive, None]
        for row in np.flatnonzero(reach.any(axis=1)):
            i = alive[row]
            hits = np.flatnonzero(reach[row]) + at
            scores = (whole_x[hits] @ whole_q[i]).astype(np.int64)
            keep = (scores >= floors[i]) & (x_ids[hits] != q_ids[i])
            found = zip((-scores[keep]).tolist(), x_ids[hits[keep]].tolist())
            best[i] = sorted([*best[i], *found])[:k]
            if len(best[i]) == k:
                floors[i] = max(floors[i], -best[i][-1][0])
    return [(int(q), x, -s) for q, found in zip(q_ids, best) for s, x in found]


def top_k(
    vectors: DataFrame,
    queries: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector: str = "embedding",
    scale: int = 1024,
    block_rows: int = 4096,
    query_rows: int = 512,
    max_blocks: int = 10_000,
) -> DataFrame:
    """(query_id, rank, id column, score): each query's k highest integer inner products.

    ``queries`` says which rows are queries; candidates are all rows with another id.
    Components become floor(scale * x). Rows with a null id, a null vector or null or
    non-finite components take no part; shorter vectors count as padded by zeros.
    Repeated rows are candidates each; as a query an id counts once, with its smallest
    vector. Score ties go to the smaller id. Fewer candidates than k give fewer
    rows, an empty table none. Blocks have ``block_rows`` rows, or more if there were over
    ``max_blocks`` blocks otherwise: one length per block comes to the driver.
    """
    spark = vectors.sparkSession
    out = vectors.select(F.col(id_col).cast("bigint").alias("id"), integers(F.col(vector), scale).alias("v"), queries.alias("q"))
    base = store(out.where("id IS NOT NULL AND v IS NOT NULL"), "vectors")
    n, width = base.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = max(width or 0, 1)
    turn = rotation(base, width)
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    count = max(1, -(-n // max(block_rows, -(-n // max_blocks))))
    blocks = store(
        base.withColumn("length", F.sqrt(square))
        .repartitionByRange(count, F.desc("length"), "id", F.hash("v"))
        .withColumn("block", F.spark_partition_id()),
        "blocks",
    )
    longest = {r["block"]: r["m"] for r in blocks.groupBy("block").agg(F.max("length").alias("m")).collect()}
    q_count = blocks.where("q").agg(F.count_distinct("id")).first()[0]
    q_blocks = max(1, -(-q_count // query_rows))
    asked = store(
        blocks.where("q")
        .groupBy("id")
        .agg(F.min(F.struct("v", "length")).alias("row"))
        .select(
            F.col("id"),
            F.col("row.v").alias("v"),
            F.col("row.length").alias("length"),
            F.pmod(F.xxhash64("id"), F.lit(q_blocks)).alias("q_block"),
        ),
        "queries",
    )

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = search_block(
            left["id"].to_numpy(),
            _matrix(left["v"], width),
            left["floor"].to_numpy(dtype=np.float64),
            right["id"].to_numpy(),
            _matrix(right["v"], width),
            turn,
            k,
        )
        return pd.DataFrame(found, columns=["query_id", "id", "score"])

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        keys = ["q_block", "block"]
        return (
            left.groupBy(*keys)
            .cogroup(right.groupBy(*keys))
            .applyInPandas(pair, "query_id long, id long, score long")
        )

    first_block = min(longest, default=0)
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(q_blocks - 1).cast("bigint")))
    candidates = blocks.select("block", "id", "v", "length")
    opened = asked.withColumn("floor", F.lit(float("-inf"))).withColumn("block", F.lit(first_block))
    first = store(
        meet(opened, candidates.where(F.col("block") == first_block).withColumn("q_block", every)),
        "first-scores",
    )
    floors = first.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor")
    )
    asked = store(
        asked.join(floors.withColumnRenamed("query_id", "id"), "id", "left").withColumn(
            "floor", F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf")))
        ),
        "floors",
    )
    # How long a vector must be to matter to any query of a block.
    need = F.when(F.col("floor") <= 0, 0.0).otherwise(F.col("floor") / F.col("length"))
    lengths = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(m).alias("m")) for b, m in longest.items() if b != first_block])
    visits = (
        asked.groupBy("q_block").agg((F.min(need) * (1 - 1e-9)).alias("need"))
    )
    if len(longest) > 1:
        visits = store(
            visits.select("q_block", F.explode(F.filter(lengths, lambda x: x["m"] >= F.col("need"))).alias("x"))
            .select("q_block", F.col("x.b").alias("block")),
            "visits",
        )
        later = meet(asked.join(visits, "q_block"), candidates.join(visits, "block"))
        first = first.unionByName(later)
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        first.withColumn("rank", F.row_number().over(ranks))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )
