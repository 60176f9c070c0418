"""Fold and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds as D
from ..operators import metrics as M
from .registry import query
from .tables import CANDIDATES, MODEL_SCORES, candidates, fold_sql, model_scores, table


@query("kfold_exact", f"WITH {fold_sql('documents', 'doc_id', 10)} SELECT doc_id, fold FROM folded")
def kfold_exact(spark, sf):
    return D.assign_folds(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 10)


@query(
    "kfold_sizes",
    f"WITH {fold_sql('(SELECT event_id FROM events)', 'event_id', 7)} SELECT fold, count(*) AS n FROM folded GROUP BY fold",
)
def kfold_sizes(spark, sf):
    folded = D.assign_folds(table(spark, sf, "events").select("event_id"), ["event_id"], 7)
    return folded.groupBy("fold").agg(F.count("*").alias("n"))


@query(
    "fold_complement",
    f"""WITH {fold_sql('orders', 'o_orderkey', 5)}, folds AS (SELECT CAST(range AS INTEGER) AS f FROM range(5))
      SELECT f AS fold, CASE WHEN fold = f THEN 'valid' ELSE 'train' END AS role, count(*) AS n,
        round(avg(o_totalprice), 4) AS mean_price FROM folded CROSS JOIN folds GROUP BY 1, 2""",
)
def fold_complement(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    roles = D.fold_roles(D.assign_folds(orders, ["o_orderkey"], 5), 5)
    sums = roles.groupBy("fold", "role").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("p"))
    return sums.select("fold", "role", "n", F.round("p", 4).alias("mean_price"))


@query("rest_of_rows", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def rest_of_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return D.rest_of(docs, table(spark, sf, "labels"), ["doc_id"])


@query(
    "group_folds",
    """SELECT user_id, event_id,
      CAST(CAST('0x' || substr(md5(concat_ws('|', user_id, '42')), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM events""",
)
def group_folds(spark, sf):
    return D.assign_group_folds(table(spark, sf, "events").select("user_id", "event_id"), "user_id", 5)


@query(
    "fold_count",
    """SELECT d AS n_train, l AS n_test, CAST(round_even(d / l, 0) AS BIGINT) AS folds
      FROM (SELECT count(*) AS d FROM lineitem), (SELECT count(*) AS l FROM orders)""",
)
def fold_count(spark, sf):
    return D.fold_count(table(spark, sf, "lineitem"), table(spark, sf, "orders"))


# A score that depends on the fold, as that of the fold's own model would.
_FOLD_SCORES = f"""WITH {CANDIDATES}, {fold_sql('candidates', 'reply_id', 5)},
folds AS (SELECT CAST(range AS INTEGER) AS f FROM range(5)),
scored AS (
  SELECT context_id, reply_id, gain AS target, f AS fold, CASE WHEN fold = f THEN 'valid' ELSE 'train' END AS role,
         score * CAST(0.1 AS DOUBLE) + f * CAST(0.25 AS DOUBLE) AS pred FROM folded CROSS JOIN folds)"""


def fold_scores(spark, sf):
    rows = D.fold_roles(D.assign_folds(candidates(spark, sf), ["reply_id"], 5), 5)
    pred = F.col("score") * 0.1 + F.col("fold") * 0.25
    return rows.select("context_id", "reply_id", F.col("gain").alias("target"), "fold", "role", pred.alias("pred"))


@query(
    "mse_mae_by_fold",
    f"""{_FOLD_SCORES} SELECT fold, role, count(*) AS n, round(avg((target - pred) * (target - pred)), 6) AS mse,
      round(avg(abs(target - pred)), 6) AS mae FROM scored GROUP BY fold, role""",
)
def mse_mae_by_fold(spark, sf):
    sums = M.errors(fold_scores(spark, sf), "target", "pred", ["fold", "role"])
    return sums.select("fold", "role", "n", F.round("mse", 6).alias("mse"), F.round("mae", 6).alias("mae"))


_REPORT = f"""{_FOLD_SCORES}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY fold, context_id ORDER BY pred DESC, reply_id) AS p,
         row_number() OVER (PARTITION BY fold, context_id ORDER BY target DESC, reply_id) AS q,
         count(*) OVER (PARTITION BY fold, context_id) AS k
  FROM scored WHERE role = 'valid'),
per_context AS (
  SELECT fold, context_id, sum(target / CASE WHEN p = 1 THEN CAST(1 AS DOUBLE) ELSE log2(p) END) AS dcg,
         sum(target / CASE WHEN q = 1 THEN CAST(1 AS DOUBLE) ELSE log2(q) END) AS ideal FROM placed GROUP BY ALL),
ranked AS (SELECT fold, avg(CASE WHEN ideal <> 0 THEN dcg / ideal ELSE 0 END) * 100000 AS ndcg FROM per_context GROUP BY fold),
errors AS (
  SELECT fold, avg(CASE WHEN role = 'valid' THEN (target - pred) * (target - pred) END) AS mse,
         avg(CASE WHEN role = 'valid' THEN abs(target - pred) END) AS mae,
         avg(CASE WHEN role = 'train' THEN (target - pred) * (target - pred) END) AS mse_train,
         avg(CASE WHEN role = 'train' THEN abs(target - pred) END) AS mae_train FROM scored GROUP BY fold)"""


@query(
    "fold_report",
    f"""{_REPORT} SELECT ranked.fold, round(ndcg, 3) AS ndcg, CAST(floor(ndcg) AS BIGINT) AS ndcg_int, round(mse, 6) AS mse,
      round(mae, 6) AS mae, round(mse_train, 6) AS mse_train, round(mae_train, 6) AS mae_train
      FROM ranked JOIN errors ON ranked.fold = errors.fold""",
)
def fold_report(spark, sf):
    report = M.fold_report(fold_scores(spark, sf), "target", "pred", "context_id", "reply_id", gain="target")
    errors = [F.round(c, 6).alias(c) for c in ("mse", "mae", "mse_train", "mae_train")]
    return report.select("fold", F.round("ndcg", 3).alias("ndcg"), "ndcg_int", *errors)


@query(
    "cv_mean",
    f"""{_REPORT} SELECT round(avg(ndcg), 3) AS cv_ndcg, round(avg(mse), 6) AS cv_mse, round(avg(mae), 6) AS cv_mae
      FROM ranked JOIN errors ON ranked.fold = errors.fold""",
)
def cv_mean(spark, sf):
    report = M.fold_report(fold_scores(spark, sf), "target", "pred", "context_id", "reply_id", gain="target")
    mean = M.cv_mean(report, ["ndcg", "mse", "mae"])
    return mean.select(F.round("cv_ndcg", 3).alias("cv_ndcg"), F.round("cv_mse", 6).alias("cv_mse"), F.round("cv_mae", 6).alias("cv_mae"))


@query(
    "holdout_average",
    f"""{_FOLD_SCORES} SELECT context_id, reply_id, round(-avg(pred), 6) AS rank FROM scored GROUP BY context_id, reply_id""",
)
def holdout_average(spark, sf):
    mean = M.average_scores(fold_scores(spark, sf), ["context_id", "reply_id"], "pred")
    return mean.select("context_id", "reply_id", F.round("rank", 6).alias("rank"))


@query(
    "average_columns",
    f"WITH {MODEL_SCORES} SELECT context_id, reply_id, round(-((lr + xgb + cat + lgbm) / 4), 6) AS rank FROM model_scores",
)
def average_columns(spark, sf):
    mean = M.average_columns(model_scores(spark, sf), ["lr", "xgb", "cat", "lgbm"])
    return mean.select("context_id", "reply_id", F.round("rank", 6).alias("rank"))


@query("matrix_shape", "SELECT count(*) AS n_rows, max(len(embedding)) AS n_cols FROM embeddings")
def matrix_shape(spark, sf):
    return M.shape(table(spark, sf, "embeddings"), "embedding")
