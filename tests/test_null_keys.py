"""Rows with a null key go through feature tables and ranking up to the submission."""

import pytest
from pyspark.sql import functions as F

from rankloom.operators import learners as M
from rankloom.plans import features as P
from rankloom.plans import training as T
from rankloom.settings import LexicalSettings
from rankloom.sources import delimited as S

SCHEMA = "context_id int, reply_id int, context_2 string, context_1 string, context_0 string, reply string"
TEXTS = ["yes sure", "of course", "blue stone", "seven rivers", "fine thanks"]


def frames(spark):
    rows = [(i // 4, i % 4, "hello", "well now", "how are you", TEXTS[i % 5]) for i in range(24)] + [(None, 1, "hello", "well now", "how are you", "blue stone")]
    train = spark.createDataFrame(rows, SCHEMA).withColumns({"fold": F.coalesce("context_id", F.lit(0)) % 2, "target": F.length("reply").cast("double")})
    return train, spark.createDataFrame(rows[:6] + rows[-1:], SCHEMA)


@pytest.mark.parametrize("kind", ["lexical", "raw", "mixed"])
def test_null_keys_reach_the_submission(spark, tmp_path, kind):
    train, test = frames(spark)
    vectors = spark.createDataFrame([(w, [float(i), 1.0]) for i, w in enumerate("yes of blue seven fine stone".split())], "word string, vector array<double>")
    settings = LexicalSettings(char_range=(2, 3), word_range=(1, 2), max_features=60, components=3 if kind == "lexical" else None, iterations=2)
    fit = P.fit_mixed_features(train, 2, vectors, 2, settings) if kind == "mixed" else P.LexicalFeatures.fit_folds(train, 2, settings)
    path = str(tmp_path / "f")
    P.write_fold_features(spark, path, train, test, 2, fit)
    for f in range(2):
        parts = P.stored_fold(spark, path)(f)
        assert sum(p.count() for p in parts) == 25 and sum(p.where("context_id is null").count() for p in parts) == 1
    # The row with a null key has the vector of the row with its texts.
    held = P.stored_holdout(spark, path)(0).collect()
    same = [r.features.toArray() for r in held if r.context_id is None or (r.context_id, r.reply_id) == (0, 2)]
    assert len(held) == 7 and len(same) == 2 and same[0].any() and abs(same[0] - same[1]).max() < 1e-6
    done = T.train_and_rank(P.stored_fold(spark, path), M.linear(ridge=0.1), 2, P.stored_holdout(spark, path))
    S.write_submission(done.ranked, str(tmp_path / "sub"))
    assert spark.read.text(str(tmp_path / "sub")).count() == 7
