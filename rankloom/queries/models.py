"""Learner and end-to-end ranking queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.labels import target
from ..operators import folds as D
from ..operators import learners as M
from ..operators import lexical as G
from ..operators.embed import keyed_join
from ..operators.numbering import number_within
from ..operators.reduce import TruncatedSvd
from ..plans import features as P
from ..plans import training as T
from ..session import packed, scratch_path, settle
from ..settings import STOP_CHUNK, STOP_ROUNDS, TEXT_COLUMNS, LexicalSettings
from ..sources import delimited as S
from ..sources.vectors import placed_lines
from .embedding import WIDTH, word_vectors
from .lexical import KEYS, TURNS, counts_sql, turns, vocab_sql
from .registry import query
from .tables import CANDIDATES, DIALOGUES, candidates, dialogues, fold_sql, order_candidates, table

# Trees of the learners of these queries; all other settings are those of the presets and the job. `embedding_ranker`,
# `gbt_early_stop` and `word_vector_ranker` run their presets as they stand.
TREES = 10
# Components that `truncated_svd` asks for, as its SQL states them; the rankers use the job's.
COMPONENTS = 8


def _one_feature(rows):
    return VectorAssembler(inputCols=["score"], outputCol="features").transform(rows).withColumnRenamed("gain", "target")


@query(
    "linear_fit_one_feature",
    f"""WITH {CANDIDATES} SELECT round(regr_slope(gain, score), 6) AS slope, round(regr_intercept(gain, score), 6) AS intercept
      FROM candidates""",
)
def linear_fit_one_feature(spark, sf):
    model = M.linear().fit(_one_feature(candidates(spark, sf)))
    row = (round(float(model.coefficients[0]), 6), round(float(model.intercept), 6))
    return spark.createDataFrame([row], "slope double, intercept double")


_FOLDS = 5
_FITS = f"""WITH {CANDIDATES}, {fold_sql('candidates', 'reply_id', _FOLDS)},
fits AS (
  SELECT f, regr_slope(gain, score) AS slope, regr_intercept(gain, score) AS intercept
  FROM folded JOIN (SELECT CAST(range AS INTEGER) AS f FROM range({_FOLDS})) ON fold <> f GROUP BY f)"""
_OOF = f"""{_FITS} SELECT context_id, reply_id, fold, round(slope * score + intercept, 6) AS pred
      FROM folded JOIN fits ON fold = f"""


def folded_features(spark, sf):
    return _one_feature(settle(D.assign_folds(candidates(spark, sf), ["reply_id"], _FOLDS)))


@query("linear_oof", _OOF)
def linear_oof(spark, sf):
    """Every row scored by the model fitted without its fold."""
    rows = folded_features(spark, sf)
    scored = M.score_folds(rows, M.fit_folds(rows, M.linear(), _FOLDS, parallelism=_FOLDS))
    return scored.select("context_id", "reply_id", "fold", F.round("pred", 6).alias("pred"))


@query(
    "linear_holdout",
    f"""{_FITS}, orders_in AS (SELECT o_custkey AS context_id, o_orderkey AS reply_id, o_totalprice / 1000 AS score FROM orders)
      SELECT context_id, reply_id, round(-avg(slope * score + intercept), 6) AS rank FROM orders_in CROSS JOIN fits
      GROUP BY context_id, reply_id""",
)
def linear_holdout(spark, sf):
    """Rows outside the folds, scored by all fold models."""
    models = M.fit_folds(folded_features(spark, sf), M.linear(), _FOLDS, parallelism=_FOLDS)
    rows = order_candidates(spark, sf).withColumn("score", F.col("score") / 1000)
    ranked = M.score_holdout(_one_feature(rows), models)
    return ranked.select("context_id", "reply_id", F.round("rank", 6).alias("rank"))


@query(
    "truncated_svd",
    f"""WITH {TURNS}, {counts_sql('turns', 'conv_id, turn', G.WORDS)}, {vocab_sql('counts', 'turns', 200_000)}
      SELECT conv_id, turn, CAST({COMPONENTS} AS INTEGER) AS components, true AS bounded,
        NOT EXISTS (SELECT 1 FROM counts c JOIN vocab USING (term) WHERE c.conv_id = t.conv_id AND c.turn = t.turn) AS no_terms,
        true AS zero_without_terms FROM turns t""",
)
def truncated_svd(spark, sf):
    """Scores of the conversations on the leading components of their word weights, by what must hold for them:
    as many as asked for, no longer than the unit length of the weights, and zero exactly for texts without a term."""
    docs = turns(spark, sf)
    counts = G.term_counts(docs, KEYS, G.WORDS)
    weights = settle(G.tfidf(counts, G.vocabulary(counts, docs), KEYS))
    svd = TruncatedSvd.fit(weights, KEYS, COMPONENTS)
    scores = svd.project(weights, docs, KEYS)
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    known = weights.select(*KEYS).distinct().withColumn("known", F.lit(True))
    return scores.join(known, KEYS, "left").select(
        *KEYS,
        F.size("vector").alias("components"),
        (length <= 1 + 1e-9).alias("bounded"),
        F.col("known").isNull().alias("no_terms"),
        (F.col("known").isNotNull() | (length == 0)).alias("zero_without_terms"),
    )


_STUMP = f"""{CANDIDATES}, cells AS (SELECT context_id % 4 AS x, gain FROM candidates),
cuts AS (
  SELECT c, avg(gain) FILTER (x <= c) AS low, avg(gain) FILTER (x > c) AS high,
    sum(gain) FILTER (x <= c) * avg(gain) FILTER (x <= c) + sum(gain) FILTER (x > c) * avg(gain) FILTER (x > c) AS fit
  FROM cells, (SELECT unnest([0, 1, 2]) AS c) GROUP BY c),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (ORDER BY fit DESC, c) = 1),
one AS (SELECT x, gain, CASE WHEN x <= c THEN low ELSE high END AS first FROM cells, best),
again AS (
  SELECT k, avg(gain - first) FILTER (x <= k) AS low, avg(gain - first) FILTER (x > k) AS high,
    sum(gain - first) FILTER (x <= k) * avg(gain - first) FILTER (x <= k) + sum(gain - first) FILTER (x > k) * avg(gain - first) FILTER (x > k) AS fit
  FROM one, (SELECT unnest([0, 1, 2]) AS k) GROUP BY k),
second AS (SELECT * FROM again QUALIFY row_number() OVER (ORDER BY fit DESC, k) = 1)"""


def _stump_rows(spark, sf):
    rows = candidates(spark, sf).select((F.col("context_id") % 4).cast("double").alias("score"), "gain")
    return settle(packed(_one_feature(rows)))


@query("gbt_stump", f"WITH {_STUMP} SELECT DISTINCT CAST(x AS BIGINT) AS x, round(first, 6) AS pred FROM one")
def gbt_stump(spark, sf):
    """One tree of depth one on a column of four values: the best split of the squared error."""
    rows = _stump_rows(spark, sf)
    model = M.boosted("embedding", trees=1, leaves=2, min_rows=1).fit(rows)
    values = rows.select("score", "features").distinct()
    return M.predict(model, values).select(F.col("score").cast("long").alias("x"), F.round("pred", 6).alias("pred"))


@query(
    "gbt_second_tree",
    f"""WITH {_STUMP} SELECT DISTINCT CAST(x AS BIGINT) AS x,
      round(first + CAST(0.1 AS DOUBLE) * CASE WHEN x <= k THEN second.low ELSE second.high END, 6) AS pred FROM one, second""",
)
def gbt_second_tree(spark, sf):
    """The second tree fits what the first leaves over, and counts by the learning rate. The residual has weight two in
    the gradient of the squared loss, which the rate of one half of the preset's undoes."""
    rows = _stump_rows(spark, sf)
    model = M.boosted("embedding", trees=2, leaves=2, min_rows=1, rate=0.05).fit(rows)
    values = rows.select("score", "features").distinct()
    return M.predict(model, values).select(F.col("score").cast("long").alias("x"), F.round("pred", 6).alias("pred"))


def dialogue_rows(spark, sf):
    """Cleaned dialogues, labelled ones with their target and fold, unlabelled ones as the hold-out.

    A reply's label is that of the document numbered ten times its dialogue plus its turn, where there is one.
    """
    rows = dialogues(spark, sf).withColumn("doc_id", F.col("context_id") * 10 + F.col("reply_id"))
    rows = rows.join(table(spark, sf, "labels"), "doc_id", "left").drop("doc_id")
    label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "good").when(F.col("quality") == 1, "neutral").otherwise("bad")
    size = F.length("reply")
    rows = rows.withColumns({"known": F.col("quality").isNotNull(), "label": label, "confidence": size / (size + 1000.0)})
    rows = settle(packed(X.clean_columns(rows.drop("quality", "toxic"), TEXT_COLUMNS)))
    train = rows.where("known").withColumn("target", target(F.col("label"), F.col("confidence"), 0))
    holdout = rows.where("not known")
    folds = T.fold_number(train, holdout)
    return settle(D.assign_folds(train, ["context_id", "reply_id"], folds)), holdout, folds


_KNOWN = f"""{DIALOGUES}, known AS (
  SELECT d.*, l.doc_id IS NOT NULL AS known,
    CASE WHEN quality = 1 AND toxic = 0 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END * (length(reply) / (length(reply) + CAST(1000 AS DOUBLE))) AS target
  FROM dialogues d LEFT JOIN labels l ON l.doc_id = context_id * 10 + reply_id)"""
_SIZES = f"""{_KNOWN}, sizes AS (
  SELECT CAST(greatest(2, round_even(count(*) FILTER (known) / CAST(nullif(count(*) FILTER (NOT known), 0) AS DOUBLE), 0)) AS INTEGER) AS k FROM known)"""
_PLACED = f"""{_SIZES}, numbered AS (
  SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', context_id, reply_id, '42')), context_id, reply_id) - 1 AS i, count(*) OVER () AS n
  FROM known WHERE known),
folded AS (
  SELECT *, CAST(CASE WHEN i < (n % k) * (n // k + 1) THEN i // (n // k + 1) ELSE (i - n % k) // greatest(n // k, 1) END AS INTEGER) AS fold
  FROM numbered, sizes)"""


def embedded(spark, sf):
    """Labelled and hold-out dialogues with the sentence vectors of their four texts."""
    train, holdout, folds = dialogue_rows(spark, sf)
    vectors, keys = word_vectors(spark, sf), ["context_id", "reply_id"]
    found = P.embedding_features(train, vectors, WIDTH)
    found = settle(packed(keyed_join(found, train.select(*keys, "fold", "target"), keys)))
    return found, settle(packed(P.embedding_features(holdout, vectors, WIDTH))), folds


@query(
    "gbt_oof",
    f"WITH {_PLACED} SELECT context_id, reply_id, fold, round(target, 6) AS target, true AS scored FROM folded",
)
def gbt_oof(spark, sf):
    """Every labelled row scored once, by the model of its fold, with a number near the range of the targets."""
    rows, _, folds = embedded(spark, sf)
    models = M.fit_folds(rows, M.boosted("embedding", trees=TREES), folds, parallelism=folds)
    scored = M.score_folds(rows, models)
    return scored.select("context_id", "reply_id", "fold", F.round("target", 6).alias("target"), F.col("pred").between(-2, 4).alias("scored"))


@query(
    "gbt_early_stop",
    f"""WITH {_SIZES} SELECT CAST(f AS INTEGER) AS fold, true AS by_rule, true AS ended_by_rule, true AS few_enough, true AS same_score
      FROM sizes, unnest(range(k)) AS a(f)""",
)
def gbt_early_stop(spark, sf):
    """The preset of 500 trees with early stopping, per fold: the kept round is the one the rule reads off the losses, training
    ended by the rule or at the last tree, no more than a chunk was fitted beyond that, and the kept trees score as they did."""
    rows, _, folds = embedded(spark, sf)
    estimator = M.boosted("word_vectors")

    def fit(f):
        valid = D.valid_rows(rows, f)
        model, losses = M.fit_early_stopped(estimator, D.train_rows(rows, f), valid)
        # The first tree after which none of the next STOP_ROUNDS is better.
        best = next(i for i, x in enumerate(losses) if x == min(losses[: i + 1]) and all(y >= x for y in losses[i + 1 : i + 1 + STOP_ROUNDS]))
        ended = best + STOP_ROUNDS < len(losses) or len(losses) == estimator.getMaxIter()
        error = M.predict(model, valid).agg(F.avg(F.pow(F.col("pred") - F.col("target"), 2))).first()[0]
        few = model.fitted == len(losses) <= model.kept + STOP_ROUNDS + STOP_CHUNK
        return f, model.kept == best + 1, ended, few, error is None or abs(error - losses[model.kept - 1]) < 1e-9

    out = M.side_by_side(fit, range(folds), folds)
    return spark.createDataFrame(out, "fold int, by_rule boolean, ended_by_rule boolean, few_enough boolean, same_score boolean")


HELD_SQL = f"WITH {_KNOWN} SELECT context_id, reply_id, true AS in_order FROM known WHERE NOT known"


def submitted(spark, ranked):
    """The lines of a submission read back, and whether each stands where its rank puts it."""
    path = scratch_path(spark, "submission")
    ranked = settle(ranked.select("context_id", "reply_id", "rank"))
    S.write_submission(ranked, path)
    lines = placed_lines(spark, path).select(F.split("value", " ").alias("c"), F.struct("file", "block", "line").alias("place"))
    lines = settle(lines.select(F.col("c")[0].cast("long").alias("context_id"), F.col("c")[1].cast("long").alias("reply_id"), "place"))
    lines = number_within(lines, [], {"at": [F.col("place")]})
    wanted = number_within(ranked, [], {"want": [F.col("context_id"), F.col("rank"), F.col("reply_id")]})
    joined = lines.join(wanted.select("context_id", "reply_id", "want"), ["context_id", "reply_id"])
    return joined.select("context_id", "reply_id", (F.col("at") == F.col("want")).alias("in_order"))


@query("holdout_score", f"WITH {_KNOWN} SELECT context_id, reply_id, true AS scored FROM known WHERE NOT known")
def holdout_score(spark, sf):
    """The unlabelled replies scored by all fold models; a rank is the negated mean."""
    rows, holdout, folds = embedded(spark, sf)
    models = M.fit_folds(rows, M.boosted("embedding", trees=TREES), folds, parallelism=folds)
    return T.holdout_scores(models, holdout).select("context_id", "reply_id", F.col("rank").between(-4, 2).alias("scored"))


@query("embedding_ranker", HELD_SQL)
def embedding_ranker(spark, sf):
    """Boosted trees of the preset on sentence vectors, up to the submission."""
    rows, holdout, folds = embedded(spark, sf)
    return submitted(spark, T.train_and_rank(rows, M.boosted("embedding"), folds, holdout, parallelism=folds).ranked)


def _ranked_by_fold(spark, name, train, holdout, folds, fit, estimator, scale=False, **options):
    path = scratch_path(spark, name)
    P.write_fold_features(spark, path, train, holdout, folds, fit, scale=scale)
    done = T.train_and_rank(P.stored_fold(spark, path), estimator, folds, P.stored_holdout(spark, path), parallelism=folds, **options)
    return submitted(spark, done.ranked)


LEXICAL = LexicalSettings()


@query("lexical_ranker", HELD_SQL)
def lexical_ranker(spark, sf):
    """Boosted trees on SVD scores fitted fold by fold, up to the submission."""
    train, holdout, folds = dialogue_rows(spark, sf)
    fit = P.LexicalFeatures.fit_folds(train, folds, LEXICAL)
    return _ranked_by_fold(spark, "lexical", train, holdout, folds, fit, M.boosted("lexical", trees=TREES))


@query("raw_lexical_ranker", HELD_SQL)
def raw_lexical_ranker(spark, sf):
    """Sparse TF-IDF weights of the whole vocabularies into the linear learner, whose work grows with the non-zeros."""
    train, holdout, folds = dialogue_rows(spark, sf)
    fit = P.LexicalFeatures.fit_folds(train, folds, replace(LEXICAL, components=None))
    return _ranked_by_fold(spark, "raw", train, holdout, folds, fit, M.linear(ridge=0.1))


@query("word_vector_ranker", HELD_SQL)
def word_vector_ranker(spark, sf):
    """Early-stopped trees on weighted word vectors, up to the submission."""
    train, holdout, folds = dialogue_rows(spark, sf)
    fit = P.fit_word_vector_features(train, folds, word_vectors(spark, sf), WIDTH, LEXICAL)
    return _ranked_by_fold(spark, "word-vectors", train, holdout, folds, fit, M.boosted("word_vectors"), early_stopping=True)


@query("mixed_ranker", HELD_SQL)
def mixed_ranker(spark, sf):
    """SVD scores beside sentence vectors, scaled to unit variance, up to the submission."""
    train, holdout, folds = dialogue_rows(spark, sf)
    fit = P.fit_mixed_features(train, folds, word_vectors(spark, sf), WIDTH, LEXICAL)
    return _ranked_by_fold(spark, "mixed", train, holdout, folds, fit, M.boosted("mixed", trees=TREES), scale=True)


@query("sparse_mixed_ranker", HELD_SQL)
def sparse_mixed_ranker(spark, sf):
    """Sparse TF-IDF weights beside sentence vectors into the linear learner."""
    train, holdout, folds = dialogue_rows(spark, sf)
    fit = P.fit_mixed_features(train, folds, word_vectors(spark, sf), WIDTH, replace(LEXICAL, components=None))
    return _ranked_by_fold(spark, "sparse-mixed", train, holdout, folds, fit, M.linear(ridge=0.1))


def _blended(spark, sf):
    rows, holdout, folds = embedded(spark, sf)
    learners = {"lr": M.linear(ridge=0.01)} | {n: M.boosted(n, trees=TREES) for n in ("xgb", "cat", "lgbm")}
    return T.blend_and_rank(lambda f: (D.train_rows(rows, f), D.valid_rows(rows, f)), learners, folds, lambda f: holdout, parallelism=8)


@query("blend_models", HELD_SQL)
def blend_models(spark, sf):
    """Four learners per fold, the best of them or of their blends, up to the submission."""
    return submitted(spark, _blended(spark, sf).ranked)


@query(
    "blend_report",
    f"""WITH {_SIZES} SELECT CAST(f AS INTEGER) AS fold, m AS model, true AS scored, true AS not_below_choice
      FROM sizes, unnest(range(k)) AS a(f), unnest(['lr', 'xgb', 'cat', 'lgbm']) AS b(m)""",
)
def blend_report(spark, sf):
    """NDCG at three and loss of every learner in every fold; none has a lower loss than the fold's choice."""
    done = _blended(spark, sf)
    best = done.choices.select("fold", F.col("loss").alias("chosen"))
    rows = done.report.join(best, "fold")
    return rows.select("fold", "model", F.col("ndcg").between(0, 100_000).alias("scored"), (F.col("mse") >= F.col("chosen") - 1e-9).alias("not_below_choice"))
