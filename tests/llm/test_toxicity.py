import tracemalloc

import numpy as np

from rankloom.llm import toxicity
from rankloom.llm.toxicity import LIMIT, fit_ordinal, train, with_severity

SCHEMA = "doc_id long, text string, severity string, __toxic int"


def corpus(n=1500):
    draw = np.random.default_rng(2)
    words = ["wort%d" % i for i in range(500)]
    bad, rows, labels = ["vileone", "viletwo", "grumb", "Snark!"], [], []
    for i in range(n):
        toxic = i % 8 == 0
        text = [words[j] for j in draw.integers(0, 500, int(draw.integers(10, 120)))]
        if toxic:
            for _ in range(int(draw.integers(1, 9))):
                text.insert(int(draw.integers(0, len(text))), bad[int(draw.integers(0, 4))] + ["", "en", "ung"][int(draw.integers(0, 3))])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_order_of_grades(spark):
    rows, labels = corpus()
    df = spark.createDataFrame([(*r, "s", 0) for r in rows], SCHEMA)
    known = spark.createDataFrame([x for x in labels if x[0] % 3] + [(None, 1), (7, None), (99999, 1)], "doc_id long, toxic int")
    model = train(df, known)
    assert np.all(np.diff(model.cuts) > 0)
    found = {r.doc_id: r.found for r in with_severity(df, model, name="found", keep=["doc_id"]).collect()}
    held = [(found[i] >= LIMIT, bool(t)) for i, t in labels if i % 3 == 0]
    assert np.mean([a for a, t in held if t]) >= 0.95 and np.mean([a for a, t in held if not t]) <= 0.01
    few = [found[i] for i, t in labels if t and sum(w.startswith(("vile", "grumb", "Snark")) for w in rows[i][1].split()) <= 2]
    many = [found[i] for i, t in labels if t and sum(w.startswith(("vile", "grumb", "Snark")) for w in rows[i][1].split()) >= 7]
    assert np.mean(few) + 0.2 < np.mean(many) and all(0 <= x <= 2 for x in found.values())


def test_odd_texts_stay_clean_and_columns_pass(spark):
    rows, labels = corpus(600)
    df = spark.createDataFrame([(*r, "s", 0) for r in rows] + [(9000, None, "s", 0), (9001, "", "s", 0), (None, " \n", "s", 0), (9002, "fine " * 100_000, "s", 0)], SCHEMA)
    model = train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = with_severity(df, model, name="found")
    assert got.columns == [*df.columns, "found"] and got.count() == 604
    assert all(r.found < LIMIT for r in got.where("doc_id >= 9000 or doc_id is null").collect())


def test_no_toxic_labels_and_empty_tables(spark):
    rows, _ = corpus(20)
    df = spark.createDataFrame([(*r, "s", 0) for r in rows], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = train(df, none)
    assert all(r.found < 1e-9 for r in with_severity(df, model, name="found").collect())
    assert with_severity(df.limit(0), model, name="found").count() == 0
    assert train(df.limit(0), none).weight.sum() == 0


def test_fit_recovers_weights_and_grades():
    draw = np.random.default_rng(0)
    rows = [np.flatnonzero(draw.random(12) < 0.4) for _ in range(300)]
    true = draw.normal(size=12) * 2
    score = np.array([true[r].sum() for r in rows])
    grades = (score > 0.5).astype(int) + (score > 2)
    model = fit_ordinal(rows, grades, np.ones(12), rounds=800)
    got = np.array([model.raw(r) for r in rows])
    assert np.corrcoef(got, score)[0, 1] > 0.97
    assert np.mean((got[:, None] > model.cuts).sum(axis=1) == grades) > 0.93


def test_sample_far_smaller_than_the_labels(spark):
    draw = np.random.default_rng(5)
    words, bad = ["wort%d" % i for i in range(300)], ["%sfoul" % c * 2 for c in "abcdefghij"]
    rows, toxic = [], set(range(0, 3000, 50))
    for i in range(3000):
        text = [words[j] for j in draw.integers(0, 300, 30)]
        rows.append((i, " ".join(text + [bad[j] for j in draw.permutation(10)[:3]] if i in toxic else text), "s", 0))
    df = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([(i, int(i in toxic)) for i in range(3000)], "doc_id long, toxic int")
    for sample in (4, 20):
        model = train(df, known, sample=sample)
        assert (model.weight[model.ratio != 0] != 0).all()
        found = {r.doc_id: r.found for r in with_severity(df, model, name="found", keep=["doc_id"]).collect()}
        assert np.mean([found[i] >= LIMIT for i in toxic]) >= 0.95
        assert np.mean([x >= LIMIT for i, x in found.items() if i not in toxic]) <= 0.01


def test_labels_without_documents_have_no_part_in_the_sample(spark):
    rows, labels = corpus(600)
    df = spark.createDataFrame([(*r, "s", 0) for r in rows], SCHEMA)
    far = [(i, 1) for i in range(10_000, 20_000)]
    one, two = (train(df, spark.createDataFrame(x, "doc_id long, toxic int"), sample=100) for x in (labels, labels + far))
    assert one.weight.any() and np.allclose(one.weight, two.weight) and np.allclose(one.cuts, two.cuts)


def test_rows_that_share_a_doc_id_do_not_widen_the_sample(spark, monkeypatch):
    """A doc_id that holds a third of all rows reaches the fit once."""
    rows, labels = corpus(600)
    rows += [(8, "vileone and number %d" % i) for i in range(300)]
    df = spark.createDataFrame([(*r, "s", 0) for r in rows], SCHEMA)
    seen = []
    monkeypatch.setattr(toxicity, "fit_ordinal", lambda sets, *a: seen.append(len(sets)) or fit_ordinal(sets, *a))
    for sample in (100, 20_000):
        train(df, spark.createDataFrame(labels, "doc_id long, toxic int"), sample=sample)
    assert seen == [100, 600]


def test_the_fit_holds_little_beside_the_sample():
    """Twelve bytes for each feature of the sample and a bounded block; the same weights as sums over all rows at once."""
    draw, ratio = np.random.default_rng(4), np.random.default_rng(5).normal(size=5000)
    rows = [np.unique(draw.integers(0, 5000, int(n))).astype(np.int32) for n in draw.integers(0, 2000, 1000)] + [np.empty(0, np.int32)]
    grades = np.arange(len(rows)) % 3
    tracemalloc.start()
    found = fit_ordinal(rows, grades, ratio, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * sum(map(len, rows)) + (6 << 20)
    # Two equal halves of the rows have the slopes of one.
    twice = fit_ordinal(rows + rows, np.concatenate([grades, grades]), ratio, rounds=2)
    assert np.allclose(found.weight, twice.weight, atol=1e-6) and np.allclose(found.cuts, twice.cuts, atol=1e-6)
