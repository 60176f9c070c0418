"""Blend queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import WAYS
from ..operators import blend as B
from ..operators import folds as D
from .registry import query
from .tables import MODEL_SCORES, MODELS, fold_sql, model_scores, table


def _way_sql(members, way: str) -> str:
    n = len(members)
    if way == "mean":
        return f"({' + '.join(members)}) / CAST({n} AS DOUBLE)"
    if way == "geom":
        return f"power(abs({' * '.join(members)}), CAST(1 AS DOUBLE) / {n})"
    zero = " OR ".join(f"{m} = 0" for m in members)
    parts = " + ".join(f"CAST(1 AS DOUBLE) / nullif({m}, 0)" for m in members)
    return f"CASE WHEN {zero} THEN CAST(0 AS DOUBLE) ELSE {n} / ({parts}) END"


_COMBOS = B.model_combinations(MODELS)


def _scores_sql(way: str) -> str:
    parts = [
        f"SELECT reply_id, '{B.combo_name(c)}' AS combo, round({_way_sql(c, way)}, 6) AS score FROM model_scores"
        for c in _COMBOS
    ]
    return f"WITH {MODEL_SCORES} " + " UNION ALL ".join(parts)


def _blend_query(way: str):
    @query(f"blend_{way}", _scores_sql(way))
    def run(spark, sf):
        rows = B.blend_scores(model_scores(spark, sf), ["reply_id"], MODELS)
        return rows.select("reply_id", "combo", F.round(way, 6).alias("score"))


for _way in WAYS:
    _blend_query(_way)


_COMBO_ROWS = " UNION ALL ".join(
    f"SELECT '{B.combo_name(c)}' AS combo, {_way_sql(c, 'mean')} AS score FROM model_scores" for c in _COMBOS
)


@query(
    "blend_combos",
    f"""WITH {MODEL_SCORES} SELECT combo, count(*) AS n, round(avg(score), 6) AS mean_score, round(max(score), 6) AS best
      FROM ({_COMBO_ROWS}) GROUP BY combo""",
)
def blend_combos(spark, sf):
    """Every combination that is tried, with the spread of its mean blend over all rows."""
    rows = B.blend_scores(model_scores(spark, sf), [], MODELS)
    found = rows.groupBy("combo").agg(F.count("*").alias("n"), F.avg("mean").alias("m"), F.max("mean").alias("b"))
    return found.select("combo", "n", F.round("m", 6).alias("mean_score"), F.round("b", 6).alias("best"))


def _loss_parts(by: str) -> str:
    group = f"GROUP BY {by}" if by else ""
    pre = f"{by}, " if by else ""
    rows = [
        f"SELECT {pre}'{B.combo_name(c)}' AS combo, '{way}' AS way, {len(WAYS) * i + j} AS ordinal,"
        f" avg(power(target - {_way_sql(c, way)}, 2)) AS loss FROM folded {group}"
        for i, c in enumerate(_COMBOS)
        for j, way in enumerate(WAYS)
    ]
    return " UNION ALL ".join(rows)


_FOLDED = f"WITH {MODEL_SCORES}, {fold_sql('model_scores', 'reply_id', 5)}"
_LOSSES = f"{_FOLDED}, losses AS ({_loss_parts('fold')})"
_SINGLE = " UNION ALL ".join(
    f"SELECT fold, '{m}' AS model, {i} AS ordinal, avg(power(target - {m}, 2)) AS loss FROM folded GROUP BY fold"
    for i, m in enumerate(MODELS)
)
_BEST = f"""{_LOSSES}, blended AS (
  SELECT fold, combo, way, loss FROM losses QUALIFY row_number() OVER (PARTITION BY fold ORDER BY loss, ordinal) = 1),
single AS ({_SINGLE}),
choices AS (
  SELECT fold, best, way, members, loss FROM (
    SELECT fold, model AS best, CAST(NULL AS VARCHAR) AS way, model AS members, loss, ordinal FROM single
    UNION ALL SELECT fold, 'averaged', way, combo, loss, 4 FROM blended)
  QUALIFY row_number() OVER (PARTITION BY fold ORDER BY loss, ordinal) = 1)"""


def folded_scores(spark, sf):
    return D.assign_folds(model_scores(spark, sf), ["reply_id"], 5)


@query(
    "blend_loss", f"WITH {MODEL_SCORES}, folded AS (SELECT * FROM model_scores), losses AS ({_loss_parts('')})"
    " SELECT combo, way, round(loss, 6) AS loss FROM losses",
)
def blend_loss(spark, sf):
    rows = B.blend_losses(model_scores(spark, sf), "target", MODELS)
    return rows.select("combo", "way", F.round("loss", 6).alias("loss"))


@query("blend_best", f"{_BEST} SELECT fold, combo, way, round(loss, 6) AS loss FROM blended")
def blend_best(spark, sf):
    best = B.best_blend(B.blend_losses(folded_scores(spark, sf), "target", MODELS, ["fold"]), ["fold"])
    return best.select("fold", "combo", "way", F.round("loss", 6).alias("loss"))


@query("best_choice", f"{_BEST} SELECT fold, best, way, members, round(loss, 6) AS loss FROM choices")
def best_choice(spark, sf):
    best = B.best_choice(folded_scores(spark, sf), "target", MODELS, ["fold"])
    return best.select("fold", "best", "way", F.concat_ws("_", "members").alias("members"), F.round("loss", 6).alias("loss"))


_CHOSEN = "CASE " + " ".join(
    [f"WHEN way IS NULL AND members = '{m}' THEN h.{m}" for m in MODELS]
    + [
        f"WHEN way = '{way}' AND members = '{B.combo_name(c)}' THEN {_way_sql([f'h.{m}' for m in c], way)}"
        for c in _COMBOS
        for way in WAYS
    ]
) + " END"
_HOLDOUT = """holdout AS (
  SELECT o_custkey AS context_id, o_orderkey AS reply_id, o_totalprice / 100000 AS lr, o_totalprice / 50000 + 1 AS xgb,
         CAST(1 + o_orderkey % 3 AS DOUBLE) AS cat, sqrt(o_totalprice / 100000) AS lgbm FROM orders)"""


@query(
    "blended_holdout",
    f"""{_BEST}, {_HOLDOUT} SELECT context_id, reply_id, round(-avg({_CHOSEN}), 6) AS rank
      FROM holdout h CROSS JOIN choices GROUP BY context_id, reply_id""",
)
def blended_holdout(spark, sf):
    """Rows outside the folds scored by each fold's choice."""
    choices = B.best_choice(folded_scores(spark, sf), "target", MODELS, ["fold"])
    price = F.col("o_totalprice")
    rows = table(spark, sf, "orders").select(
        F.explode(F.array(*[F.lit(f) for f in range(5)])).alias("fold"),
        F.col("o_custkey").alias("context_id"),
        F.col("o_orderkey").alias("reply_id"),
        (price / 100000).alias("lr"),
        (price / 50000 + 1).alias("xgb"),
        (F.lit(1.0) + F.col("o_orderkey") % 3).alias("cat"),
        F.sqrt(price / 100000).alias("lgbm"),
    )
    ranked = B.blended_holdout(rows, choices, ["context_id", "reply_id"], MODELS)
    return ranked.select("context_id", "reply_id", F.round("rank", 6).alias("rank"))


@query(
    "wide_predictions",
    f"WITH {MODEL_SCORES} SELECT reply_id, lr, xgb, cat, lgbm FROM model_scores",
)
def wide_predictions(spark, sf):
    """Long predictions, one row per model, brought back to one row per candidate."""
    long = model_scores(spark, sf).unpivot(["reply_id"], list(MODELS), "model", "pred")
    return B.wide_predictions(long, ["reply_id"], MODELS)
