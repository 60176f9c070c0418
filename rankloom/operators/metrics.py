"""Regression errors and per-fold reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import mean_ndcg, ndcg


def mse(y: str, p: str) -> Column:
    gap = F.col(y) - F.col(p)
    return F.avg(gap * gap)


def mae(y: str, p: str) -> Column:
    return F.avg(F.abs(F.col(y) - F.col(p)))


def errors(preds: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    return preds.groupBy(*by).agg(F.count("*").alias("n"), mse(y, p).alias("mse"), mae(y, p).alias("mae"))


def fold_report(
    preds: DataFrame, y: str, p: str, context: str, candidate: str, gain: str | None = None, k: int | str = "distinct"
) -> DataFrame:
    """One row per fold from ``(fold, role, …)`` predictions: NDCG and errors on valid rows, errors on train rows."""
    sums = preds.groupBy("fold").agg(
        *[
            F.avg(F.when(F.col("role") == role, err)).alias(name + suffix)
            for role, suffix in (("valid", ""), ("train", "_train"))
            for name, err in (
                ("mse", (F.col(y) - F.col(p)) * (F.col(y) - F.col(p))),
                ("mae", F.abs(F.col(y) - F.col(p))),
            )
        ]
    )
    valid = preds.where(F.col("role") == "valid")
    ranked = mean_ndcg(ndcg(valid, ["fold", context], gain or candidate, p, candidate, k), ["fold"])
    scores = ranked.select("fold", F.col("mean_ndcg").alias("ndcg"), F.col("mean_ndcg").cast("long").alias("ndcg_int"))
    return scores.join(sums, "fold")


def cv_mean(report: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Plain mean over folds, whatever their sizes."""
    return report.agg(*[F.avg(c).alias(f"cv_{c}") for c in cols])


def shape(df: DataFrame, vector: str) -> DataFrame:
    """Rows and columns of a matrix held as an array column."""
    return df.agg(F.count("*").alias("n_rows"), F.max(F.size(vector)).cast("long").alias("n_cols"))


def average_scores(preds: DataFrame, keys: Sequence[str], p: str, out: str = "rank") -> DataFrame:
    """Negated mean of the fold models' scores per row, from long predictions."""
    return preds.groupBy(*keys).agg((-F.avg(p)).alias(out))


def average_columns(preds: DataFrame, cols: Sequence[str], out: str = "rank") -> DataFrame:
    """The same from one column per fold model: no shuffle."""
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    return preds.withColumn(out, -(total / F.lit(float(len(cols)))))
