"""Features as wide as whole vocabularies (F11, F14): no note for each place, no call for each term, no wide fits side by side."""

import pytest
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.linalg import DenseVector, SparseVector, Vectors

from rankloom.operators import learners as M
from rankloom.operators import lexical as G
from rankloom.plans import features as P

KEYS = ("context_id", "reply_id")


@pytest.fixture(scope="module")
def blocks(spark):
    rows = [
        (1, 1, Vectors.sparse(5, [0, 3], [1.0, 0.0]), Vectors.dense([0.0, 2.0])),
        (2, 1, Vectors.dense([1.0, 0.0, 0.0, 0.0, 2.0]), Vectors.dense([3.0, 0.0])),
        (None, 2, Vectors.sparse(5, [], []), Vectors.sparse(2, [1], [7.0])),
        (None, 2, Vectors.sparse(5, [4], [9.0]), Vectors.dense([0.0, 0.0])),
    ]
    return spark.createDataFrame(rows, [*KEYS, "a", "b"])


def test_blocks_side_by_side_are_those_of_the_assembler(blocks):
    got = P.side_by_side(blocks, ["a", "b"], KEYS)
    want = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(blocks)
    assert got.schema["features"].metadata == {} and got.schema["features"].dataType == want.schema["features"].dataType
    found, asked = ([(r.context_id, r.reply_id, r.features.toArray().tolist()) for r in df.collect()] for df in (got, want))
    assert found == asked
    kinds = [type(r.features) for r in got.collect()]
    assert kinds == [SparseVector, DenseVector, SparseVector, SparseVector]


def test_bound_blocks_carry_no_note_for_each_place(blocks):
    parts = [blocks.select(*KEYS, c).where("context_id is not null").withColumnRenamed(c, "features") for c in ("a", "b")]
    bound = P.bind_vectors(parts)
    assert bound.schema["features"].metadata == {}
    assert {r.context_id: r.features.toArray().tolist() for r in bound.collect()} == {1: [1, 0, 0, 0, 0, 0, 2], 2: [1, 0, 0, 0, 2, 3, 0]}


def test_a_vocabulary_goes_to_the_jvm_once(spark, monkeypatch):
    """Not term by term, and not for each column and table anew."""
    sent, plain = [], CountVectorizerModel.from_vocabulary
    monkeypatch.setattr(CountVectorizerModel, "from_vocabulary", lambda terms, *a, **k: sent.append(len(terms)) or plain(terms, *a, **k))
    terms = [f"t{i}" for i in range(500)] + ["x\x01y", "ä\U0001f600"]
    vectorizer = G.Vectorizer(G.Analyzer("word", 1, 1), terms, None)
    rows = spark.createDataFrame([("t1 t499 t1", "t7"), ("", "none")], "a string, b string")
    out = vectorizer.transform(vectorizer.transform(rows, "a", "va"), "b", "vb")
    assert max(sent, default=0) < 10
    assert out.schema["va"].metadata.get("ml_attr", {}).get("attrs") is None
    assert [(r.va, r.vb) for r in out.collect()] == [
        (SparseVector(502, {1: 2.0, 499: 1.0}), SparseVector(502, {7: 1.0})), (SparseVector(502, {}), SparseVector(502, {})),
    ]
    assert list(G.java_strings(terms)) == terms and list(G.java_strings(["", "a", ""])) == ["", "a", ""]


def test_wide_linear_fits_go_one_after_the_other(blocks, monkeypatch):
    rows = blocks.withColumnRenamed("a", "features")
    monkeypatch.setattr(M, "DRIVER_BYTES", 8 * M.HELD * 5 * 2)
    assert M.fits_together(M.linear(), rows, 8) == 2
    assert M.fits_together(M.linear(), rows.limit(0), 8) == 8
    assert M.fits_together(M.boosted("embedding"), rows, 8) == 8
    monkeypatch.undo()
    assert M.fits_together(M.linear(), rows, 8) == 8


def test_columns_and_tables_share_one_vocabulary_on_the_jvm(spark, monkeypatch):
    """A copy of the model would send its vocabulary to the executors again."""
    models, plain = [], CountVectorizerModel.transform
    monkeypatch.setattr(CountVectorizerModel, "transform", lambda self, df: models.append(self._java_obj) or plain(self, df))
    vectorizer = G.Vectorizer(G.Analyzer("word", 1, 1), ["aa", "bb"], [1.0, 2.0])
    rows = spark.createDataFrame([("aa bb", "bb")], "a string, b string")
    out = vectorizer.transform(vectorizer.transform(rows, "a", "va"), "b", "vb").first()
    assert len(models) == 2 and models[0].equals(models[1])
    assert (out.va.indices.tolist(), out.vb.toArray().tolist()) == ([0, 1], [0.0, 1.0])
