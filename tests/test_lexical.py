import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankloom.operators import folds as D
from rankloom.operators import lexical as G

TEXTS = [
    "the cat sat on the mat",
    "the dog sat on a log",
    "a cat and a dog",
    "",
    "x",
    "the  cat\n\tsat ё й",
    "cat cat cat dog 😀 emoji😀end",
]


def word_grams(text, lo, hi):
    tokens = re.findall(r"\b\w\w+\b", text)
    return [" ".join(tokens[i : i + n]) for n in range(lo, hi + 1) for i in range(len(tokens) - n + 1)]


def char_grams(text, lo, hi):
    text = re.sub(r"\s\s+", " ", text)
    return [text[i : i + n] for n in range(lo, hi + 1) for i in range(len(text) - n + 1)]


def grams(analyzer):
    fn = word_grams if analyzer.kind == "word" else char_grams
    return lambda text: fn(text, analyzer.lo, analyzer.hi)


def corpus(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def plain_vocab(texts, cut, min_df=2, max_df=0.9, cap=None):
    counts = [Counter(cut(t)) for t in texts]
    df, total = Counter(), Counter()
    for c in counts:
        df.update(c.keys())
        total.update(c)
    kept = [t for t in df if min_df <= df[t] <= max_df * len(texts)]
    kept = sorted(kept, key=lambda t: (-total[t], t.encode()))[:cap]
    return {t: (df[t], total[t], i, math.log((1 + len(texts)) / (1 + df[t])) + 1) for i, t in enumerate(kept)}


def plain_tfidf(texts, cut, vocab):
    out = {}
    for i, text in enumerate(texts):
        w = {t: n * vocab[t][3] for t, n in Counter(cut(text)).items() if t in vocab}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.update({(i, t): x / norm for t, x in w.items()})
    return out


ANALYZERS = [G.WORDS, G.CHARS, G.CHARS_SHORT, G.Analyzer("word", 2, 2), G.Analyzer("char", 1, 1)]


@pytest.mark.parametrize("analyzer", ANALYZERS)
def test_counts(spark, analyzer):
    cut = grams(analyzer)
    got = {(r.id, r.term): r.tf for r in G.term_counts(corpus(spark), ["id"], analyzer).collect()}
    assert got == {(i, t): n for i, text in enumerate(TEXTS) for t, n in Counter(cut(text)).items()}


def test_long_text_is_cut_without_loss(spark):
    rng = random.Random(0)
    text = "".join(rng.choice("abcде 😀") for _ in range(3 * G._PIECE + 17))
    text = re.sub(r"\s+", " ", text)
    got = {r.term: r.tf for r in G.term_counts(corpus(spark, [text]), ["id"], G.CHARS).collect()}
    assert got == Counter(char_grams(text, 2, 5))
    exact = text[: 2 * G._PIECE]
    got = {r.term: r.tf for r in G.term_counts(corpus(spark, [exact]), ["id"], G.CHARS).collect()}
    assert got == Counter(char_grams(exact, 2, 5))


@pytest.mark.parametrize("analyzer", [G.WORDS, G.CHARS])
@pytest.mark.parametrize("cap", [None, 5])
def test_vocabulary_and_tfidf(spark, analyzer, cap):
    docs, cut = corpus(spark), grams(analyzer)
    counts = G.term_counts(docs, ["id"], analyzer)
    want = plain_vocab(TEXTS, cut, cap=cap)
    for hot_rows in (3, 1000):
        vocab = G.vocabulary(counts, docs, max_features=cap, hot_rows=hot_rows)
        got = {r.term: (r.df, r.total, r.idx, r.idf) for r in vocab.collect()}
        assert got.keys() == want.keys()
        for term in want:
            assert got[term] == pytest.approx(want[term])
    weights = {(r.id, r.term): r.weight for r in G.tfidf(counts, vocab, ["id"]).collect()}
    assert weights == pytest.approx(plain_tfidf(TEXTS, cut, want))


def test_idf_fixture(spark):
    got = spark.range(1).select(G.idf(F.lit(2), F.lit(3)).alias("x")).first().x
    assert got == pytest.approx(1.287682, abs=1e-6)


def test_limits(spark):
    docs = corpus(spark, ["aa bb", "aa cc", "aa bb", "aa dd"])
    totals = G.term_totals(G.term_counts(docs, ["id"], G.Analyzer("word", 1, 1)))
    kept = lambda lo, hi: {r.term for r in G.within_limits(totals, G.document_count(docs), lo, hi).collect()}
    assert kept(2, 0.9) == {"bb"}
    assert kept(1, 0.5) == {"bb", "cc", "dd"}
    assert kept(2, 1.0) == {"aa", "bb"}


@pytest.mark.parametrize("analyzer", [G.WORDS, G.CHARS_SHORT])
def test_vectors_equal_long_weights(spark, analyzer):
    docs = corpus(spark)
    counts = G.term_counts(docs, ["id"], analyzer)
    vocab = G.vocabulary(counts, docs, max_features=40)
    long = {(r.id, r.idx): r.weight for r in G.tfidf(counts, vocab, ["id"]).collect()}
    fitted = G.Vectorizer.fit(docs, ["id"], analyzer, max_features=40)
    rows = fitted.transform(docs, "text", "v").select("id", "v").collect()
    got = {(r.id, int(j)): x for r in rows for j, x in zip(r.v.indices, r.v.values)}
    assert got == pytest.approx(long)
    raw = G.Vectorizer.from_vocabulary(analyzer, vocab, use_idf=False).transform(docs, "text", "v").collect()
    plain = {(r.id, r.idx): r.weight for r in G.count_weights(counts, vocab, ["id"]).collect()}
    assert {(r.id, int(j)): x for r in raw for j, x in zip(r.v.indices, r.v.values)} == plain


def test_fold_vocabularies_equal_one_fit_per_fold(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff"]) for _ in range(rng.randrange(9))) for _ in range(40)]
    docs = D.assign_folds(corpus(spark, texts), ["id"], 4)
    counts = G.term_counts(docs, ["id"], G.WORDS, also=["fold"])
    for hot_rows in (20, 10_000):
        got = {}
        for r in G.fold_vocabularies(counts, docs, 4, max_features=25, hot_rows=hot_rows).collect():
            got.setdefault(r.fold, {})[r.term] = (r.df, r.total, r.idx, r.idf)
        folds = {r.id: r.fold for r in docs.collect()}
        for f in range(4):
            rest = [t for i, t in enumerate(texts) if folds[i] != f]
            want = plain_vocab(rest, grams(G.WORDS), cap=25)
            assert got[f].keys() == want.keys()
            for term in want:
                assert got[f][term] == pytest.approx(want[term])


def test_stack_and_union(spark, rows):
    df = spark.createDataFrame([(1, "a", "b")], "id int, x string, y string")
    assert rows(G.stack_columns(df, ["id"], ["x", "y"])) == [(1, "x", "a"), (1, "y", "b")]
    part = spark.createDataFrame([(1, "t", 0, 1.0)], "id int, term string, idx int, weight double")
    assert rows(G.feature_union({"char": part, "word": part}), "id", "block") == [(1, "char"), (1, "word")]


def test_texts_are_shuffled_once(spark):
    docs = corpus(spark)
    counts = G.term_counts(docs, ["id"], G.WORDS)
    plan = G.tfidf(counts, G.vocabulary(counts, docs), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "BroadcastHashJoin" in plan


def test_bad_analyzer():
    with pytest.raises(ValueError):
        G.Analyzer("word", 3, 1)


@pytest.mark.parametrize("lo,hi", [(1, 3), (2, 2), (1, 1)])
def test_word_ngrams_of_long_texts_cross_the_cuts(spark, lo, hi):
    """Pieces carry the words ahead: texts around a cut, one very long word, single letters, and marks in the text."""
    rng = random.Random(lo * 10 + hi)
    words = ["w%d" % i for i in range(40)] + ["q", "é", "été", "_x", "😀ab", "日本"]
    mixed = "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "\x01", "\x02", "  "]) for _ in range(6 * G._PIECE))
    texts = [mixed, "ab " * 3000, "z" * (3 * G._PIECE) + " tail end", "a b " * G._PIECE + "last two", "x" * (G._PIECE - 3) + " yy zz", "one", "a", " ", "", None]
    df = spark.createDataFrame([*enumerate(texts)], "id int, text string")
    analyzer = G.Analyzer("word", lo, hi)
    got = {(r.id, r.term): r.tf for r in G.term_counts(df, ["id"], analyzer).collect()}
    want = Counter()
    for i, t in enumerate(texts):
        kept = [w for w in re.findall(r"\w+", t or "") if len(w) > 1]
        want.update((i, " ".join(kept[j : j + n])) for n in range(lo, hi + 1) for j in range(len(kept) - n + 1))
    assert got == want


def test_a_million_words(spark):
    text = "alpha beta " * 500_000
    got = {r.term: r.tf for r in G.term_counts(spark.createDataFrame([(1, text)], "id int, text string"), ["id"], G.WORDS).collect()}
    n = 500_000
    assert got == {"alpha": n, "beta": n, "alpha beta": n, "beta alpha": n - 1, "alpha beta alpha": n - 1, "beta alpha beta": n - 1}
