"""Ranking and NDCG queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as R
from .registry import query
from .tables import CANDIDATES, ORDER_CANDIDATES, candidates, order_candidates, table


def _rounded(df):
    return df.select(
        "context_id", F.round("dcg", 6).alias("dcg"), F.round("ideal", 6).alias("ideal"), F.round("ndcg", 6).alias("ndcg")
    )


def _ndcg_sql(ctes: str, source: str, k: str, method: int, gain: str = "gain") -> str:
    if method == 0:
        discount = "CASE WHEN {p} = 1 THEN CAST(1 AS DOUBLE) ELSE log2({p}) END"
    else:
        discount = "log2({p} + 1)"
    by_score, by_gain = discount.format(p="p"), discount.format(p="q")
    return f"""{ctes}, graded AS (SELECT context_id, reply_id, score, CAST({gain} AS DOUBLE) AS g FROM {source}),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY score DESC, reply_id) AS p,
         row_number() OVER (PARTITION BY context_id ORDER BY g DESC, reply_id) AS q FROM graded),
cuts AS (SELECT context_id, {k} AS k FROM graded GROUP BY context_id),
sums AS (
  SELECT placed.context_id, sum(CASE WHEN p <= k THEN g / ({by_score}) ELSE 0 END) AS dcg,
         sum(CASE WHEN q <= k THEN g / ({by_gain}) ELSE 0 END) AS ideal
  FROM placed JOIN cuts ON placed.context_id = cuts.context_id GROUP BY placed.context_id),
scored AS (SELECT context_id, dcg, ideal, CASE WHEN ideal <> 0 THEN dcg / ideal ELSE CAST(0 AS DOUBLE) END AS ndcg FROM sums)"""


_SELECT = "SELECT context_id, round(dcg, 6) AS dcg, round(ideal, 6) AS ideal, round(ndcg, 6) AS ndcg FROM scored"
_EVENTS, _ORDERS = f"WITH {CANDIDATES}", f"WITH {ORDER_CANDIDATES}"


@query("rank_ndcg", f"{_ndcg_sql(_EVENTS, 'candidates', '3', 0)} {_SELECT}")
def rank_ndcg(spark, sf):
    return _rounded(R.ndcg(candidates(spark, sf), ["context_id"], "gain", "score", "reply_id", 3))


@query("ndcg_method1", f"{_ndcg_sql(_ORDERS, 'order_candidates', '5', 1)} {_SELECT}")
def ndcg_method1(spark, sf):
    return _rounded(R.ndcg(order_candidates(spark, sf), ["context_id"], "gain", "score", "reply_id", 5, method=1))


@query("ndcg_distinct_k", f"{_ndcg_sql(_EVENTS, 'candidates', 'count(DISTINCT reply_id)', 0)} {_SELECT}")
def ndcg_distinct_k(spark, sf):
    return _rounded(R.ndcg(candidates(spark, sf), ["context_id"], "gain", "score", "reply_id", "distinct"))


@query(
    "ndcg_id_gain",
    f"{_ndcg_sql(_EVENTS, 'candidates', 'count(DISTINCT reply_id)', 0, 'reply_id')}"
    " SELECT context_id, round(dcg, 2) AS dcg, round(ideal, 2) AS ideal, round(ndcg, 6) AS ndcg FROM scored",
)
def ndcg_id_gain(spark, sf):
    """The candidate id as gain, as the job's own reports compute it."""
    scored = R.ndcg(candidates(spark, sf), ["context_id"], "reply_id", "score", "reply_id", "distinct")
    return scored.select(
        "context_id", F.round("dcg", 2).alias("dcg"), F.round("ideal", 2).alias("ideal"), F.round("ndcg", 6).alias("ndcg")
    )


@query(
    "mean_ndcg",
    f"{_ndcg_sql(_ORDERS, 'order_candidates', '3', 0)}"
    " SELECT count(*) AS contexts, round(avg(ndcg) * 100000, 4) AS mean_ndcg FROM scored",
)
def mean_ndcg(spark, sf):
    scored = R.ndcg(order_candidates(spark, sf), ["context_id"], "gain", "score", "reply_id", 3)
    return R.mean_ndcg(scored).select("contexts", F.round("mean_ndcg", 4).alias("mean_ndcg"))


@query(
    "ranked_list",
    f"""{_EVENTS} SELECT context_id, reply_id, score,
      row_number() OVER (PARTITION BY context_id ORDER BY score DESC, reply_id) AS position FROM candidates""",
)
def ranked_list(spark, sf):
    ranked = R.rank_candidates(candidates(spark, sf).drop("gain"), ["context_id"], "score", "reply_id")
    return ranked.select("context_id", "reply_id", "score", "position")


@query(
    "topk_per_context",
    f"""{_ORDERS} SELECT context_id, reply_id, score, position FROM (SELECT *,
      row_number() OVER (PARTITION BY context_id ORDER BY score DESC, reply_id) AS position FROM order_candidates)
      WHERE position <= 3""",
)
def topk_per_context(spark, sf):
    best = R.top_k(order_candidates(spark, sf).drop("gain"), ["context_id"], R.best_first("score", "reply_id"), 3)
    return best.select("context_id", "reply_id", "score", "position")


@query(
    "submission_order",
    f"{_ORDERS} SELECT context_id, reply_id, -score AS rank FROM order_candidates ORDER BY context_id, rank, reply_id",
)
def submission_order(spark, sf):
    rows = R.submission(order_candidates(spark, sf), "context_id", "reply_id", "score")
    return rows.orderBy("context_id", "rank", "reply_id")


@query(
    "ranked_gains",
    f"""{_ORDERS} SELECT context_id,
      row_number() OVER (PARTITION BY context_id ORDER BY score DESC, reply_id) AS position, gain FROM order_candidates""",
)
def ranked_gains(spark, sf):
    return R.ranked_gains(order_candidates(spark, sf), ["context_id"], "gain", "score", "reply_id")


@query(
    "distinct_cutoff",
    "SELECT l_suppkey AS context_id, count(DISTINCT l_partkey) AS cutoff FROM lineitem GROUP BY l_suppkey",
)
def distinct_cutoff(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("context_id"), "l_partkey")
    return R.distinct_candidates(lines, ["context_id"], "l_partkey")


@query("distinct_contexts", "SELECT DISTINCT o_custkey AS context_id FROM orders")
def distinct_contexts(spark, sf):
    return order_candidates(spark, sf).select("context_id").distinct()


@query(
    "mean_ndcg_of_ids",
    f"""{_ndcg_sql(_ORDERS, 'order_candidates', '3', 0, 'reply_id')}
      SELECT count(*) AS contexts, round(avg(ndcg) * 100000, 4) AS mean_ndcg FROM scored""",
)
def mean_ndcg_of_ids(spark, sf):
    """Rank and evaluate in one call, with the candidate id as gain."""
    score = R.rank_and_evaluate(order_candidates(spark, sf), "context_id", "reply_id", "score", loss=True)
    return score.select("contexts", F.round("mean_ndcg", 4).alias("mean_ndcg"))
