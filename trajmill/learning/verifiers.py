"""Linear verifiers: the pairwise and the binary objective over hashed text features.

The scorer is linear in hashed words, so it stands in for a neural verifier's role in the
table jobs and makes no claim to its quality. The L2 penalty is on the weights.
"""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajmill.functions.feedback import positive
from trajmill.functions.messages import joined
from trajmill.learning.newton import LinearModel, fit
from trajmill.operators.tokens import word_tokens
from trajmill.session import new_folder

DIMENSIONS = 512


def verifier_text(prompt: Column, completion: Column) -> Column:
    """The model sees the first message and the completion, not the whole history."""
    return joined(F.concat(F.slice(prompt, 1, 1), completion))


def _hashed(df: DataFrame, text: Column, name: str, dimensions: int) -> DataFrame:
    """Counts of the lower-case words' hashes, which any SQL engine can repeat."""
    ids = F.transform(word_tokens(F.lower(text), dimensions), lambda i: i.cast("string"))
    numbers = [str(i) for i in range(dimensions)]
    counts = CountVectorizerModel.from_vocabulary(numbers, inputCol="_words", outputCol=name)
    return counts.transform(df.withColumn("_words", ids)).drop("_words")


def verifier_features(
    df: DataFrame, completion: str = "completion", name: str = "features",
    dimensions: int = DIMENSIONS,
) -> DataFrame:
    text = verifier_text(F.col("prompt"), F.col(completion))
    return _hashed(df, text, name, dimensions)


def word_ids(df: DataFrame, completion: str = "completion", dimensions: int = DIMENSIONS) -> Column:
    """The numbers of the words that verifier_features counts."""
    return word_tokens(F.lower(verifier_text(F.col("prompt"), F.col(completion))), dimensions)


def pair_rows(pairs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(ids, signs, label) of each pair: chosen - rejected with label 1.

    The loss has no intercept, so one sign of the difference is enough: this is exactly the
    pairwise logistic objective.
    """
    chosen, rejected = word_ids(pairs, "chosen", dimensions), word_ids(pairs, "rejected", dimensions)
    both = pairs.select(chosen.alias("c"), rejected.alias("r"))
    signs = F.concat(F.transform("c", lambda _: F.lit(1.0)), F.transform("r", lambda _: F.lit(-1.0)))
    return both.select(F.concat("c", "r").alias("ids"), signs.alias("signs"), F.lit(1.0).alias("label"))


def binary_rows(rollouts: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(ids, label) of each rollout."""
    label = positive(F.col("label")).cast("double").alias("label")
    return rollouts.select(word_ids(rollouts, dimensions=dimensions).alias("ids"), label)


def _stored(rows: DataFrame) -> DataFrame:
    """Hashed words, hashed once for all passes."""
    path = new_folder(rows.sparkSession, "words")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def train_pair_verifier(
    pairs: DataFrame, l2: float = 0.01, passes: int = 30, dimensions: int = DIMENSIONS
) -> LinearModel:
    """Minimise the mean of -log sigmoid(r_chosen - r_rejected) plus an L2 term."""
    return fit(_stored(pair_rows(pairs, dimensions)), dimensions, l2, False, most_passes=passes)


def train_binary_verifier(
    rollouts: DataFrame, l2: float = 0.01, passes: int = 30, dimensions: int = DIMENSIONS
) -> LinearModel:
    """Minimise logistic loss on the label."""
    return fit(_stored(binary_rows(rollouts, dimensions)), dimensions, l2, True, most_passes=passes)


def score_linear(
    rollouts: DataFrame, weights: list[float], intercept: float = 0.0, name: str = "reward"
) -> DataFrame:
    """Add the margin of a linear scorer: the weights of the words' hashes, summed."""
    text = verifier_text(F.col("prompt"), F.col("completion"))
    table = F.array(*[F.lit(float(w)) for w in weights])
    ids = word_tokens(F.lower(text), len(weights))
    margin = F.aggregate(ids, F.lit(float(intercept)), lambda acc, i: acc + F.get(table, i))
    return rollouts.withColumn(name, margin)


def score_rollouts(
    model: LinearModel, rollouts: DataFrame, name: str = "reward"
) -> DataFrame:
    """Add the model's margin as the reward of every rollout."""
    return score_linear(rollouts, model.coefficients.tolist(), model.intercept, name)


def gradient(model: LinearModel, rows: DataFrame, l2: float) -> DataFrame:
    """(index, slope): the objective's derivative by the weight of each word in pair_rows or
    binary_rows; all are zero at the minimum. Only the words that a row has are visited."""
    weights = F.array(*[F.lit(float(w)) for w in model.coefficients])
    signs = F.col("signs") if "signs" in rows.columns else F.transform("ids", lambda _: F.lit(1.0))
    terms = F.zip_with("ids", signs, lambda i, s: F.get(weights, i) * s)
    margin = F.aggregate(terms, F.lit(float(model.intercept)), lambda a, x: a + x)
    error = 1 / (1 + F.exp(-margin)) - F.col("label")
    parts = rows.select(error.alias("error"), F.inline(F.arrays_zip(F.col("ids").alias("index"), signs.alias("sign"))))
    total = rows.agg(F.count(F.lit(1))).scalar()
    sums = parts.groupBy("index").agg((F.sum(F.col("error") * F.col("sign")) / total).alias("mean"))
    return sums.select("index", (F.col("mean") + l2 * F.get(weights, F.col("index"))).alias("slope"))
