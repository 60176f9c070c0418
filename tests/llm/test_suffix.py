from collections import Counter
from hashlib import sha256
from itertools import groupby

import numpy as np
import pytest

from rankloom.llm.suffix import segments, window_minima, without_repeats

SCHEMA = "doc_id long, text string, digest string, spans string"


def plain(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (d, _), r in zip(rows, raws):
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(1 for g, _ in groupby(gone) if g)
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((d, len(r), sum(gone), spans, sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    draw = np.random.default_rng(seed)
    words = ["".join(draw.choice(list("abcdeäö"), 4)) for _ in range(400)]

    def text(n):
        return " ".join(words[i] for i in draw.integers(0, 400, n))

    shared = [text(60) for _ in range(4)]
    rows = [(i, text(int(draw.integers(0, 200)))) for i in range(40)]
    rows += [(100 + i, text(int(draw.integers(5, 30))) + shared[i % 4][int(draw.integers(0, 40)) :] + text(20)) for i in range(40)]
    rows += [(200 + i, shared[0][: 199 + i] + f"#{i}" + shared[1][-200:]) for i in range(4)]
    rows += [(300, "x" * 1000), (301, "x" * 250), (302, "ab cd " * 300), (303, "y" * 199), (304, None), (305, ""), (None, "z" * 230), (306, shared[2]), (307, shared[2])]
    rows += [(308, text(150))] * 3 + [(309, text(80) * 2)]
    return rows


@pytest.mark.parametrize("group,together", [(100_000, 50_000), (3, 10)])
def test_against_plain_search(spark, group, together):
    rows = corpus(group)
    df = spark.createDataFrame([(*r, "d", "s") for r in rows], SCHEMA).repartition(4)
    got = sorted(map(tuple, without_repeats(df, group=group, together=together).collect()), key=repr)
    assert got == plain(rows, 200)


def test_segments_cover_all_windows():
    raw = bytes(np.random.default_rng(3).integers(0, 4, 5000, dtype=np.uint8))
    keys, places = segments(raw, 200)
    first, many, offset = places >> 16, (places >> 8 & 255) + 1, places & 255
    assert (first[1:] == first[:-1] + many[:-1]).all() and first[0] == 0 and first[-1] + many[-1] == 5000 - 199
    assert (offset <= 168).all() and len(keys) < 5000 / 50
    x = np.random.default_rng(4).integers(0, 50, 1000).astype(np.uint64)
    assert (window_minima(x, 7) == [x[i : i + 7].min() for i in range(994)]).all()


def test_every_window_of_a_cut_text_is_in_one_piece():
    raw = bytes(np.random.default_rng(5).integers(0, 256, 3000, dtype=np.uint8))
    for size in (699, 700, 701, 1401, 3000):
        for piece in (200, 201, 450, 700):
            _, places = segments(raw[:size], 200, piece)
            first, many = places >> 16, (places >> 8 & 255) + 1
            assert [w for a, n in zip(first, many) for w in range(a, a + n)] == list(range(size - 199))


@pytest.mark.parametrize("group", [100_000, 1])
def test_texts_of_several_pieces_against_plain_search(spark, group):
    draw = np.random.default_rng(6)
    plainly = ["".join(draw.choice(list("abcdefgh"), n)) for n in (2500, 1201, 700)]
    rows = list(enumerate(plainly)) + [(9, plainly[0][300:1100] + plainly[1][:100])]
    for part in (rows[:3], rows):
        df = spark.createDataFrame([(*r, "d", "s") for r in part], SCHEMA)
        got = sorted(map(tuple, without_repeats(df, group=group, piece=700).collect()), key=repr)
        assert got == plain(part, 200)
    assert not any(r[2] for r in plain(rows[:3], 200))


def test_empty_table(spark):
    assert without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
