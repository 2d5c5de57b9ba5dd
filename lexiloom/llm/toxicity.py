"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts and a sample of all texts train a linear classifier on words. The unlabelled
sample holds toxic texts as well; the risk estimator takes their expected share, the class prior, out
of it: ``prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive))``. When the second part
falls below zero the classifier fits noise, and its gradient is reversed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .words import bag_of_words

BITS = 18
#: Classifiers, each from the confirmed rows and unlabelled ones of its own; their mean decides.
MEMBERS = 3
#: Rows that train one classifier: confirmed toxic, and unlabelled. Both are drawn by hash.
POSITIVES, UNLABELLED = 2000, 4000
ROUNDS = 150
_RATE = 0.05
_SPARSE, _DECAY = 3e-4, 1e-4
_CHOSEN = 0.5
#: Words in fewer texts of a classifier's rows than three, or one in so many, are not learned.
_LEAST_TEXTS, _TEXTS_PER_WORD = 3, 400
_DRAWS = 1 << 30


@dataclass
class Classifier:
    """One weight per word bucket, the mean of the members, and their bias."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        """Chance of label 1, from the presence of words, so that length alone changes nothing."""
        logit = self.bias + float(self.weights[bag_of_words(text, BITS)].sum())
        return float(1 / (1 + np.exp(-np.clip(logit, -500, 500))))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _descend(column: np.ndarray, row: np.ndarray, n_columns: int, positive: np.ndarray, prior: float,
             rounds: int, l1: float, l2: float) -> np.ndarray:
    """Full-batch Adam on the non-negative risk with the logistic loss; the bias comes last."""
    w = np.zeros(n_columns + 1)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    n_pos, n_un = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    for step in range(1, rounds + 1):
        p = _sigmoid(w[-1] + np.bincount(row, w[column], len(positive)))
        # The slope of log(1+e^-x) is p - 1 and that of log(1+e^x) is p.
        up = np.where(positive, prior * (p - 1) / n_pos, 0.0)
        down = np.where(positive, -prior * p / n_pos, p / n_un)
        loss = -np.log(np.maximum(1 - p, 1e-12))
        negative_risk = loss[~positive].sum() / n_un - prior * loss[positive].sum() / n_pos
        slope = up + down if negative_risk >= 0 else -down
        g = np.append(np.bincount(column, slope[row], n_columns), slope.sum())
        g[:-1] += l1 * np.sign(w[:-1]) + l2 * w[:-1]
        mean = 0.9 * mean + 0.1 * g
        square = 0.999 * square + 0.001 * g * g
        w -= _RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    return w


def fit_nnpu(bags: list[np.ndarray], positive: np.ndarray, prior: float, bits: int = BITS
             ) -> tuple[np.ndarray, float]:
    """Weights and bias. A sparse first fit chooses the words, a second one weighs these freely."""
    flat = np.concatenate(bags) if bags else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    least = max(_LEAST_TEXTS, len(bags) // _TEXTS_PER_WORD)
    chosen = np.bincount(flat, minlength=1 << bits) >= least
    weights = np.zeros(1 << bits, np.float32)
    bias = 0.0
    for l1, l2 in ((_SPARSE, 0.0), (0.0, _DECAY)):
        keep = chosen[flat]
        used, column = np.unique(flat[keep], return_inverse=True)
        w = _descend(column, row[keep], len(used), positive, prior, ROUNDS, l1, l2)
        weights[:] = 0
        weights[used] = w[:-1]
        bias = float(w[-1])
        chosen = np.abs(weights) > _CHOSEN
    return weights, bias


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          toxic: str = "toxic") -> Classifier:
    """Learn from the given rows; ``labels`` says which ids are confirmed, in any repetition.

    The samples are bounded by ``POSITIVES + MEMBERS * UNLABELLED`` rows, as near as a hash draws them,
    at any size of the input; the class prior is the share of confirmed ids among all labelled
    ones. Without a confirmed text every score is 0.
    """
    one = labels.where(F.col(key).isNotNull() & F.col(toxic).isNotNull()).groupBy(
        F.col(key).alias("_key")).agg(F.max(toxic).alias("_toxic"))
    known = one.agg(F.count("*").alias("n"), F.sum("_toxic").alias("k")).first()
    n_pos, total = int(known["k"] or 0), docs.count()
    if not n_pos:
        return Classifier(np.zeros(1 << BITS, np.float32), -30.0)
    prior = min(0.9, n_pos / known["n"])

    def drawn(column: str, wanted: int, of: int):
        draw = F.pmod(F.xxhash64(F.lit("draw"), F.col(column)), F.lit(_DRAWS))
        return draw < int(_DRAWS * min(1.0, wanted / max(1, of)))

    sample = one.where((F.col("_toxic") == 1) & drawn("_key", POSITIVES, n_pos)).select("_key")
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(
        F.broadcast(sample), F.col("_id") == F.col("_key"), "left")
    chosen = rows.withColumn("_u", F.coalesce(drawn("_id", MEMBERS * UNLABELLED, total), F.lit(False))).where(
        F.col("_u") | F.col("_key").isNotNull())
    member = F.pmod(F.xxhash64(F.lit("member"), F.col("_id")), F.lit(MEMBERS)).cast("int")
    members = F.sequence(F.lit(0), F.lit(MEMBERS - 1))
    nobody = F.array().cast("array<int>")
    # A row may be drawn both ways: a confirmed text is then unlabelled text as well.
    kinds = chosen.select("_text", F.explode(F.concat(
        F.transform(F.when(F.col("_key").isNotNull(), members).otherwise(nobody),
                    lambda m: F.struct(m.alias("member"), F.lit(True).alias("positive"))),
        F.transform(F.when(F.col("_u"), F.array(member)).otherwise(nobody),
                    lambda m: F.struct(m.alias("member"), F.lit(False).alias("positive"))),
    )).alias("k")).select("k.member", "k.positive", "_text")

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"member": batch["member"], "positive": batch["positive"],
                                "bag": [bag_of_words(t, BITS) for t in batch["_text"]]})

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        order = group["bag"].map(lambda b: (len(b), b.tobytes() if len(b) else b"")).sort_values().index
        group = group.loc[order]
        weights, bias = fit_nnpu([np.asarray(b, np.int64) for b in group["bag"]],
                                 group["positive"].to_numpy(bool), prior)
        return pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias]})

    bagged = kinds.mapInPandas(bags, "member int, positive boolean, bag array<bigint>")
    fitted = bagged.groupBy("member").applyInPandas(fit, "weights binary, bias double").collect()
    if not fitted:
        return Classifier(np.zeros(1 << BITS, np.float32), -30.0)
    weights = np.mean([np.frombuffer(r["weights"], np.float32) for r in fitted], axis=0)
    return Classifier(weights.astype(np.float32), float(np.mean([r["bias"] for r in fitted])))


def score_toxicity(docs: DataFrame, model: Classifier, text: str = "text", output: str = "score"
                   ) -> DataFrame:
    """``docs`` with the score of every whole text; a column named ``output`` is replaced.

    Null and empty texts get the score of a text without words. Rows are scored one by one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return docs.withColumn(output, score.asNondeterministic()(F.col(text)))
