import re
from collections import Counter

import numpy as np
import pytest

from rankloom.llm import phrases
from rankloom.llm.phrases import collocations, parsed

SCHEMA = "doc_id long, text string, lang string, phrase string, n int, a int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, l, "p", 1, 2) for i, (t, l) in enumerate(rows)], SCHEMA)


def word_lists(rows):
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            yield lang or "und", re.findall("[^\x20\x09]+", piece)


def plain(rows, least, top):
    f, n = Counter(), Counter()
    for lang, w in word_lists(rows):
        n[lang] += len(w)
        for m in range(1, 6):
            for i in range(len(w) - m + 1):
                f[lang, tuple(w[i : i + m])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        inside = any(
            l2 == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (l2, q), b in found.items()
        )
        if not inside:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in n:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(lang, i, *r[1:]) for i, r in enumerate(mine, start=1)]
    return sorted(ranked)


def corpus():
    draw = np.random.default_rng(11)
    words = ["a", "b", "The", "é", "new", "york", "city", "x-1", "zz", "\x1cq"]
    rows = [(" ".join(draw.choice(words, int(draw.integers(0, 60)))) + draw.choice([".", " ", "\n", "!? "]) + "new  york\tcity hall", "en") for _ in range(300)]
    rows += [("new york city hall, again and AGAIN and again", "de")] * 40 + [("a a a a a a a a a", None)] * 5 + [("a a a", "und")] * 5
    rows += [(None, "en"), ("", "en"), (" \t .,;", "fr"), ("one", "fr")]
    # The same passage, often and in other company, and texts of one word and without any break.
    passage = " ".join(draw.choice(words, 400))
    rows += [(f"w{i} {passage} v{i}", "es") for i in range(30)] + [("t " * 3000, "it"), (" ".join(draw.choice(words, 5000)), "it")]
    return rows


@pytest.mark.parametrize("least,top,size", [(20, 2000, phrases.SLICE), (3, 25, 700)])
def test_equals_a_plain_count(spark, monkeypatch, least, top, size):
    monkeypatch.setattr(phrases, "SLICE", size)
    monkeypatch.setattr(phrases, "TOGETHER", 500)
    rows = corpus()
    got = collocations(frame(spark, rows).repartition(5), least=least, top=top)
    assert sorted(map(tuple, got.collect())) == plain(rows, least, top)


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SMALL_BYTES", -1)
    rows = corpus()
    assert sorted(map(tuple, collocations(frame(spark, rows), least=15).collect())) == plain(rows, 15, 2000)


def test_chunks_own_every_word_once_and_copies_fall_together(spark):
    rows = corpus()
    entries = parsed(frame(spark, rows)).collect()
    words = sum(len(w) for _, w in word_lists(rows))
    assert sum(r.own * r.weight for r in entries) == words
    assert all(r.own <= len(r.chunk.split()) <= r.own + 4 and r.own <= phrases.MOST for r in entries)
    # 30 copies of a passage of 400 words are cut alike inside, though their beginnings differ.
    assert sum(r.own for r in entries if r.lang == "es") < 30 * 400 / 5


def test_long_texts_and_exact_large_scores(spark):
    rows = [("u v " * 200_000 + "end", "en"), ("y" * 300_000 + " z", "en")]
    got = {r.phrase: r for r in collocations(frame(spark, rows)).collect()}
    n = 400_003
    # Alternating words: both phrases of five words are as frequent as their parts but for the ends.
    assert got["v u v u v"].a == 199_998 and got["u v u v u"].a == 199_998 and got["u v"].a == 200_000
    assert got["u v"].score == 1000 * 200_000 * n // (200_000 * 200_000) and all(r.n == n for r in got.values())


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = (3 * 10**12 + 1, 7 * 10**13 + 3, 5 * 10**12 + 7)
    row = spark.createDataFrame([(big[0], big[1], [big[2], big[0]], [big[2] + 1, big[0]])], "f long, n long, pre array<long>, suf array<long>")
    assert row.select(F.expr(phrases._CUT).alias("c")).first().c.score == 1000 * big[0] * big[1] // (big[2] * (big[2] + 1))


def test_without_words(spark):
    for rows in ([], [(None, None)], [("once only", "en")]):
        got = collocations(frame(spark, rows))
        assert got.count() == 0 and got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
