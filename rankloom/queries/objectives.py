"""Queries of the ranking objective, the forest and the search for settings (2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learners as M
from ..operators.forest import BootstrapForest, poisson_steps
from ..operators.lambdas import RankBoost, RankTask, rank_gradients
from ..plans import search as H
from ..plans import training as T
from .models import HELD_SQL, TREES, embedded, folded_features, submitted
from .registry import query
from .tables import CANDIDATES, candidates, fold_sql

_PLACES = 20


@query(
    "rank_gradients",
    f"""WITH {CANDIDATES}, scaled AS (SELECT context_id, reply_id, gain, score / CAST(100 AS DOUBLE) AS s FROM candidates),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY s DESC, reply_id) AS place,
    row_number() OVER (PARTITION BY context_id ORDER BY gain DESC, reply_id) AS best FROM scaled),
ideals AS (SELECT context_id, sum(gain / log2(best + 1)) AS ideal FROM placed WHERE best <= {_PLACES} GROUP BY context_id),
worths AS (SELECT *, CASE WHEN place <= {_PLACES} THEN 1 / log2(place + 1) ELSE 0 END AS worth FROM placed),
pairs AS (
  SELECT a.context_id, a.reply_id, sign(a.gain - b.gain) AS side, abs(a.gain - b.gain) * abs(a.worth - b.worth) / ideal AS change,
    1 / (1 + exp(sign(a.gain - b.gain) * (a.s - b.s))) AS chance
  FROM worths a JOIN worths b USING (context_id) JOIN ideals USING (context_id) WHERE a.gain <> b.gain AND ideal > 0),
sums AS (
  SELECT context_id, reply_id, sum(side * chance * change) AS gradient, sum(chance * (1 - chance) * change) AS curvature
  FROM pairs GROUP BY context_id, reply_id)
SELECT context_id, reply_id, round(coalesce(gradient, 0), 6) + 0 AS gradient, round(coalesce(curvature, 0), 6) + 0 AS curvature
FROM candidates LEFT JOIN sums USING (context_id, reply_id)""",
)
def gradients(spark, sf):
    """How far each candidate's score should move to raise NDCG at 20 of its context."""
    rows = candidates(spark, sf).withColumn("score", F.col("score") / 100.0)
    found = rank_gradients(rows, RankTask(gain="gain", k=_PLACES), "score")
    return found.select("context_id", "reply_id", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("gradient", "curvature")])


@query("ndcg_ranker", HELD_SQL)
def ndcg_ranker(spark, sf):
    """Boosted trees that raise NDCG, on sentence vectors, up to the submission."""
    rows, holdout, folds = embedded(spark, sf)
    learner = RankBoost(M.boosted("embedding", trees=TREES))
    return submitted(spark, T.train_and_rank(rows, learner, folds, holdout, parallelism=folds).ranked)


# Trees of the forest queries; the preset has 1,000.
FOREST = 20


def _draws_sql(keys: str) -> str:
    """CTE ``draws`` of how often each tree draws a row, by the Poisson steps of its hash."""
    digest = f"md5(concat({', '.join(f"{k}, '|'" for k in keys.split(', '))}, '42|', tree))"
    drawn = " + ".join(f"CASE WHEN draw >= CAST({s!r} AS DOUBLE) THEN 1 ELSE 0 END" for s in poisson_steps())
    return f"""hashed AS (
  SELECT {keys}, CAST(('0x' || substr({digest}, 1, 13)) AS BIGINT) / CAST({1 << 52} AS DOUBLE) AS draw
  FROM candidates, (SELECT unnest(range({FOREST})) AS tree)),
draws AS (SELECT {keys}, {drawn} AS n FROM hashed)"""


@query(
    "forest_out_of_bag",
    f"""WITH {CANDIDATES}, {_draws_sql('context_id, reply_id')}
SELECT context_id, reply_id, CAST(count(*) FILTER (n = 0) AS INTEGER) AS trees_out, count(*) FILTER (n = 0) > 0 AS scored, true AS in_range
FROM draws GROUP BY context_id, reply_id""",
)
def forest_out_of_bag(spark, sf):
    """Each row's trees that never drew it; those alone score it, within the range of the targets."""
    rows = folded_features(spark, sf)
    found = BootstrapForest(FOREST, depth=5).fit_trees(rows).out_of_bag(rows)
    fine = F.coalesce(F.col("pred").between(0, 3), F.col("trees_out") == 0)
    return found.select("context_id", "reply_id", "trees_out", F.col("pred").isNotNull().alias("scored"), fine.alias("in_range"))


@query("forest_ranker", HELD_SQL)
def forest_ranker(spark, sf):
    """A forest on sentence vectors, up to the submission."""
    rows, holdout, folds = embedded(spark, sf)
    return submitted(spark, T.train_and_rank(rows, BootstrapForest(FOREST), folds, holdout, parallelism=folds).ranked)


_RIDGES = (0.0, 0.05, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0)
_GRID_FOLDS = 5
# The ridge acts on standardised columns, so it divides the plain slope by one number.
_TRIALS = f"""WITH {CANDIDATES}, {fold_sql('candidates', 'reply_id', _GRID_FOLDS)},
fits AS (
  SELECT f, regr_slope(gain, score) AS slope, avg(score) AS mx, avg(gain) AS my, stddev_pop(gain) AS sy
  FROM folded JOIN (SELECT CAST(range AS INTEGER) AS f FROM range({_GRID_FOLDS})) ON fold <> f GROUP BY f),
trials AS MATERIALIZED (
  SELECT ridge, f, avg(pow(gain - my - slope / (1 + ridge / sy) * (score - mx), 2)) AS loss
  FROM fits JOIN folded ON fold = f, (SELECT CAST(unnest({list(_RIDGES)}) AS DOUBLE) AS ridge) GROUP BY ridge, f)"""


def _halved_sql() -> str:
    """One table per rung: the better part of the rung before, by the mean loss over the folds seen so far."""
    rungs, before = [], "(SELECT DISTINCT ridge FROM trials)"
    for i, (count, upto) in enumerate(H.rung_folds(_GRID_FOLDS, len(_RIDGES))):
        rungs.append(f"""rung{i} AS MATERIALIZED (SELECT ridge, {upto} AS folds, {i} AS rung, avg(loss) AS loss, row_number() OVER (ORDER BY avg(loss), ridge) AS place
  FROM trials JOIN {before} USING (ridge) WHERE f < {upto} GROUP BY ridge)""")
        if i + 1 < len(H.rung_folds(_GRID_FOLDS, len(_RIDGES))):
            before = f"(SELECT ridge FROM rung{i} WHERE place <= {H.rung_folds(_GRID_FOLDS, len(_RIDGES))[i + 1][0]})"
    every = " UNION ALL ".join(f"SELECT * FROM rung{i}" for i in range(len(rungs)))
    return f"""{_TRIALS}, {', '.join(rungs)}
SELECT ridge, CAST(max(folds) AS INTEGER) AS folds, CAST(max(rung) AS INTEGER) AS rung, round(max_by(loss, rung), 9) AS loss FROM ({every}) GROUP BY ridge"""


def _tried(spark, sf, halving):
    found = H.search(folded_features(spark, sf), M.linear, H.grid({"ridge": _RIDGES}), _GRID_FOLDS, halving=halving, parallelism=8)
    rows = [(t.setting["ridge"], t.folds, t.rung, t.loss) for t in found]
    out = spark.createDataFrame(rows, "ridge double, folds int, rung int, loss double")
    return out.withColumn("loss", F.round("loss", 9))


@query("setting_grid", f"""{_TRIALS} SELECT ridge, CAST(count(*) AS INTEGER) AS folds, CAST(0 AS INTEGER) AS rung, round(avg(loss), 9) AS loss FROM trials GROUP BY ridge""")
def setting_grid(spark, sf):
    """Mean loss of every ridge of a grid over all folds."""
    return _tried(spark, sf, halving=False)


@query("setting_halving", _halved_sql())
def setting_halving(spark, sf):
    """The same grid, where only the better half of a rung goes on to more folds."""
    return _tried(spark, sf, halving=True)
