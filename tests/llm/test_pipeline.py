import re
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from rankloom.llm import common, exact, minhash, mixing, pieces, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def norm(t):
    return re.sub("[\x20\x09-\x0d]", "", t or "")


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_stages_on_the_small_table(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
        after = docs.collect()
        if name in ("exact dedup", "near dedup"):
            assert Counter(r.doc_id for r in after) == Counter({r.doc_id for r in after}) and {r.doc_id for r in after} <= {r.doc_id for r in before}
        if name == "exact dedup":
            assert sorted(norm(r.text) for r in after) == sorted({norm(r.text) for r in before})
        if name == "near dedup":
            sets = [shingles(r.text) for r in after]
            for a in range(len(sets)):
                for b in range(a):
                    assert 100 * len(sets[a] & sets[b]) < 80 * len(sets[a] | sets[b]) or not sets[a]
            assert len(after) > 0.6 * len(before)
        if name == "mix":
            assert max(Counter(r.doc_id for r in after).values()) <= 2
        if name == "pieces":
            assert Counter((r.doc_id, r.text) for r in after) == Counter((r.doc_id, r.text) for r in before)
            assert all(r.n_tokens == len(r.ids) > 0 for r in after)


def test_stages_take_empty_and_odd_rows(spark):
    odd = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "text", "en", "s", 4), (2, "text", "en", "s", 4), (3, "more text of a few words", None, None, 9)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, SCHEMA)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
            docs.collect()


def test_operators_are_those_of_the_package():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mix", "pieces"]
    assert exact and minhash and mixing and toxicity


def test_pieces_stage_takes_one_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "some text", "en", "s", 9)], SCHEMA)
    plan = corpus_pipeline.encode_pieces(spark, docs, "")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


RUNS = {
    "counted": lambda: toxicity._counted,
    "features": lambda: toxicity._features(np.ones(toxicity.BUCKETS)),
    "scored": lambda: toxicity._scored(toxicity.Severity(np.ones(toxicity.BUCKETS), np.ones(toxicity.BUCKETS), np.ones(2))),
    "signatures": lambda: minhash._signatures(5, *minhash.bands_for(80)),
    "sets": lambda: minhash._sets(5),
    "coded": lambda: pieces._coded(pieces.Pieces.load(public_tokenizers.path("piece_bpe_32k.model")), 1, "text"),
}
COLUMNS = {"counted": "tn", "features": "tnn", "scored": "nt", "signatures": "ntn", "sets": "nt", "coded": "nt"}


@pytest.mark.parametrize("name", RUNS)
def test_workers_of_the_stages_give_memory_back(name, monkeypatch):
    """Once, when a task has given all its rows."""
    calls, made = [], {"t": pa.array(["some words", None]), "n": pa.array([0, 1])}
    pool = type("Pool", (), {"release_unused": lambda self: calls.append(1)})
    batch = pa.RecordBatch.from_arrays([made[c] for c in COLUMNS[name]], names=[f"c{i}" for i in range(len(COLUMNS[name]))])
    run = RUNS[name]()
    monkeypatch.setattr(common.pa, "default_memory_pool", pool)
    found = run(iter([batch]))
    assert next(found).num_rows and not calls
    assert list(found) == [] and calls == [1]
