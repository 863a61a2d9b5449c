"""Accuracy, logloss and perplexity of scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: probabilities are clipped to [EPS, 1 - EPS].
EPS = 1e-15


def argmax_class(p: Column) -> Column:
    """The most likely class of an ``array<double>``, the lowest on ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def normalise(p: Column) -> Column:
    """Divide by the sum; uniform when the sum is not positive."""
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    size = F.size(p).cast("double")
    return F.when(total > 0, F.transform(p, lambda x: x / total)).otherwise(F.transform(p, lambda x: F.lit(1.0) / size))


def accuracy(predictions: DataFrame, y: str = "y", predicted: str = "y_pred", by: list[str] | None = None) -> DataFrame:
    hit = (F.col(y) == F.col(predicted)).cast("double")
    return predictions.groupBy(*(by or [])).agg(F.avg(hit).alias("accuracy"))


def row_logloss(y: Column, p: Column, eps: float = EPS) -> Column:
    """-ln of the clipped, renormalised probability of the true class."""
    clipped = F.transform(p, lambda x: F.least(F.greatest(x, F.lit(eps)), F.lit(1.0 - eps)))
    total = F.aggregate(clipped, F.lit(0.0), lambda a, x: a + x)
    true = F.least(F.greatest(F.element_at(p, y + 1), F.lit(eps)), F.lit(1.0 - eps))
    # A label outside the classes is an error, as element_at would only say so for y > C.
    checked = F.when((y >= 0) & (y < F.size(p)), true / total).otherwise(
        F.raise_error(F.concat(F.lit("invalid class label "), y.cast("string")))
    )
    return -F.log(checked)


def multi_logloss(
    predictions: DataFrame, y: str = "y", p: str = "p", eps: float = EPS, by: list[str] | None = None
) -> DataFrame:
    return predictions.groupBy(*(by or [])).agg(F.avg(row_logloss(F.col(y), F.col(p), eps)).alias("logloss"))


def perplexity(
    predictions: DataFrame, y: str = "y", p: str = "p", eps: float = EPS, by: list[str] | None = None
) -> DataFrame:
    loss = multi_logloss(predictions, y, p, eps, by)
    return loss.select(*(by or []), F.exp("logloss").alias("perplexity"))


def metrics_report(predictions: DataFrame, by: str = "split", y: str = "y", p: str = "p", **settings) -> DataFrame:
    """One row per split: size, accuracy, logloss, perplexity and the given settings."""
    loss = row_logloss(F.col(y), F.col(p))
    hit = (F.col(y) == argmax_class(F.col(p))).cast("double")
    report = predictions.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(hit).alias("accuracy"),
        F.avg(loss).alias("logloss"),
        F.exp(F.avg(loss)).alias("perplexity"),
    )
    return report.select("*", *[F.lit(v).alias(k) for k, v in settings.items()])
