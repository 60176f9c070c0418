import re
from collections import defaultdict

import numpy as np

from rankloom.llm.mixing import apply_mix, mix

SCHEMA = "doc_id long, text string, source string, size string, target int"


def n_words(t):
    return len(re.findall("[^\x20\x09-\x0d]+", t or ""))


def corpus():
    draw = np.random.default_rng(7)
    rows = [(i, "w " * int(draw.integers(0, 60)), ["a", "b", "hot", "hot", "hot", "Z", "é"][i % 7]) for i in range(700)]
    rows += [(2000, "long " * 900, "b"), (2001, None, "a"), (2002, "\x1c x\x0by", None), (2003, "one two", None), (None, "no id here", "a"), (5, "again", "b"), (5, "again", "b"), (2004, "", "empty")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA)


def plain_targets(sizes, share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, budget = {}, set(order), share * sum(sizes.values())
    while open_:
        level = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if most * sizes[s] < level * weight[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            budget -= target[s]
        open_ -= full
    return target


def test_targets_sizes_and_words_taken(spark):
    rows = corpus()
    got = mix(frame(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += n_words(t)
    want, taken = plain_targets(sizes), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sum(want.values()) == np.float64(1.5 * sum(sizes.values())) or abs(sum(want.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert sorted(map(repr, got)) == sorted(map(repr, mix(frame(spark, rows).repartition(5)).collect()))


def test_better_documents_come_first(spark):
    rows = [(i, "a b c d", "s") for i in range(4000)]
    quality = spark.createDataFrame([(i, 4.0 if i % 2 else 0.25) for i in range(4000)] + [(1, 0.1), (None, 9.0), (4001, None)], "doc_id long, weight double")
    got = mix(frame(spark, rows), quality, weights=(1,), share=0.3).collect()
    good = sum(r.taken for r in got if r.doc_id % 2)
    assert abs(sum(r.taken for r in got) - 0.3 * 16000) <= 1 and good > 0.8 * 0.3 * 16000


def test_copies_follow_the_words_taken(spark):
    rows = corpus()
    df = frame(spark, rows)
    taken = mix(df)
    out = apply_mix(df, taken).collect()
    want = sum(-(-r.taken // r["size"]) for r in taken.collect() if r.taken)
    assert len(out) == want and all(len(r) == 5 for r in out)
    assert mix(df.limit(0)).count() == 0 and apply_mix(df.limit(0), taken).count() == 0


def test_no_words_at_all(spark):
    got = mix(frame(spark, [(1, "", "a"), (2, None, None)])).collect()
    assert [(r["size"], r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_documents_without_words_go_and_the_stage_says_so(spark):
    from corpus_pipeline import mix_sources

    df = frame(spark, [(1, "two words", "a"), (2, "", "a"), (3, None, "a"), (4, " \n", "a")])
    out = apply_mix(df, mix(df, share=2)).collect()
    assert [r.doc_id for r in out] == [1, 1]
    assert "documents without words" in " ".join(mix_sources.__doc__.split())


def test_texts_under_one_key_draw_apart(spark):
    rows = [(None, f"word {i}", "hot") for i in range(300)] + [(i, "one two", "b") for i in range(300)]
    df = frame(spark, rows)
    got = mix(df, share=1.2).where("source = 'hot'").groupBy("taken").count().collect()
    assert {r.taken: r["count"] for r in got} == {2: 180, 0: 120}


def test_clashing_columns_of_the_documents_stay(spark):
    rows = [(i, "one two three", "a", i, "x", i) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __size int, __copy string, __n int")
    out = apply_mix(df, mix(df))
    assert out.columns == df.columns
    assert {(r.doc_id, r["__size"], r["__copy"], r["__n"]) for r in out.collect()} == {(i, i, "x", i) for i in range(20)}
