"""Ranking within a context and NDCG."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import discounted
from ..settings import NDCG_SCALE
from .numbering import HOT_ROWS, number_within


def best_first(score: str, tie: str) -> list[Column]:
    return [F.col(score).desc_nulls_last(), F.col(tie).asc()]


def rank_candidates(
    df: DataFrame, context: Sequence[str], score: str, tie: str, out: str = "position", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Position of each candidate in its context, best score first."""
    return number_within(df, context, {out: best_first(score, tie)}, hot_rows)


def top_k(df: DataFrame, context: Sequence[str], order: Sequence[Column], k: int, out: str = "position") -> DataFrame:
    """The first ``k`` rows of each context.

    The limit on the row number is applied in every map task before the
    shuffle (window group limit), so a huge context sends ``k`` rows per task.
    """
    place = F.row_number().over(W.partitionBy(*context).orderBy(*order))
    return df.withColumn(out, place.cast("long")).where(F.col(out) <= k)


def submission(df: DataFrame, context: str, candidate: str, pred: str) -> DataFrame:
    """``context_id, reply_id, rank`` with the negated score, so ascending order is best first."""
    return df.select(
        F.col(context).alias("context_id"), F.col(candidate).alias("reply_id"), (-F.col(pred)).alias("rank")
    )


def ranked_gains(df: DataFrame, context: Sequence[str], gain: str, score: str, tie: str) -> DataFrame:
    """The gain list of every context, as rows ``(context, position, gain)``."""
    ranked = rank_candidates(df, context, score, tie)
    return ranked.select(*context, "position", F.col(gain).cast("double").alias("gain"))


def distinct_candidates(df: DataFrame, context: Sequence[str], candidate: str) -> DataFrame:
    """Cut-off of a context: the number of its distinct candidates."""
    return df.groupBy(*context).agg(F.count_distinct(candidate).alias("cutoff"))


def _dcg(df: DataFrame, context: Sequence[str], place: str, method: int, out: str) -> DataFrame:
    return df.groupBy(*context).agg(F.sum(discounted(F.col("__gain"), F.col(place), method)).alias(out))


def ndcg(
    df: DataFrame,
    context: Sequence[str],
    gain: str,
    score: str,
    tie: str,
    k: int | str = 3,
    method: int = 0,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``dcg``, ``ideal`` and ``ndcg`` per context; 0 where the ideal is 0.

    ``gain`` may be any column, the candidate id included. ``k`` is a number
    or ``'distinct'``: then each context is cut at its number of distinct ``tie`` values.
    """
    context = list(context)
    rows = df.select(*context, F.col(gain).cast("double").alias("__gain"), F.col(score).alias("__score"), F.col(tie).alias("__tie"))
    by_score = best_first("__score", "__tie")
    by_gain = best_first("__gain", "__tie")
    if k == "distinct":
        placed = number_within(rows, context, {"__place": by_score, "__best": by_gain}, hot_rows)
        cut = distinct_candidates(rows, context, "__tie").withColumnRenamed("cutoff", "__cut")
        placed = placed.join(cut, context)

        def kept(place: str) -> Column:
            return F.when(F.col(place) <= F.col("__cut"), discounted(F.col("__gain"), F.col(place), method))

        sums = placed.groupBy(*context).agg(
            F.coalesce(F.sum(kept("__place")), F.lit(0.0)).alias("dcg"),
            F.coalesce(F.sum(kept("__best")), F.lit(0.0)).alias("ideal"),
        )
    else:
        got = _dcg(top_k(rows, context, by_score, int(k), "__place"), context, "__place", method, "dcg")
        best = _dcg(top_k(rows, context, by_gain, int(k), "__place"), context, "__place", method, "ideal")
        sums = got.join(best, context)
    ratio = F.when(F.col("ideal") != 0, F.col("dcg") / F.when(F.col("ideal") != 0, F.col("ideal")))
    return sums.withColumn("ndcg", ratio.otherwise(F.lit(0.0)))


def mean_ndcg(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Plain mean of the contexts' NDCG, times 100,000."""
    return scores.groupBy(*by).agg(
        F.count("*").alias("contexts"), (F.avg("ndcg") * F.lit(float(NDCG_SCALE))).alias("mean_ndcg")
    )


def rank_and_evaluate(
    preds: DataFrame, context: str, candidate: str, pred: str, gain: str | None = None, loss: bool = False, k: int | str = 3
) -> DataFrame:
    """Ranked ``(context_id, reply_id)`` rows, or their mean NDCG when ``loss`` is set.

    With no ``gain`` column the candidate id itself is the gain.
    """
    if loss:
        return mean_ndcg(ndcg(preds, [context], gain or candidate, pred, candidate, k))
    ranked = submission(preds, context, candidate, pred)
    return ranked.orderBy("context_id", "rank", "reply_id").select("context_id", "reply_id")
