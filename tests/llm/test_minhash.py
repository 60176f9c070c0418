from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm.minhash import bands_for, drop_near_copies, near_groups, packed_bits

SCHEMA = "doc_id long, text string, digest string, kept string"


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def plain(rows, width, percent):
    """Smallest doc_id reachable, per row, by comparing all pairs of different sets."""
    sets = {r: shingles(r[1], width) for r in rows}
    inside = defaultdict(list)
    for r, s in sets.items():
        for x in s:
            inside[x].append(r)
    parent = {r: r for r in sets}

    def root(r):
        while parent[r] != r:
            r = parent[r]
        return r

    for r, s in sets.items():
        for other, n in Counter(o for x in s for o in inside[x]).items():
            if 100 * n >= percent * (len(s) + len(sets[other]) - n):
                parent[root(r)] = root(other)
    least = {}
    for r in sets:
        if r[0] is not None:
            least[root(r)] = min(least.get(root(r), r[0]), r[0])
    return {r: (len(sets[r]), least.get(root(r)) if sets[r] else r[0]) for r in sets}


def corpus(seed, copies):
    draw = np.random.default_rng(seed)
    word = lambda: "w%d" % draw.integers(0, 3000)
    base = [word() for _ in range(150)]
    rows, next_id = [], 0

    def add(words):
        nonlocal next_id
        rows.append((next_id * 7 % 10007, " ".join(words)))
        next_id += 1

    for _ in range(copies):
        words = list(base)
        for i in draw.integers(0, 150, draw.integers(0, 14)):
            words[i] = word()
        add(words)
    for _ in range(60):
        words = [word() for _ in range(int(draw.integers(1, 200)))]
        add(words)
        for _ in range(int(draw.integers(0, 4))):
            near = list(words)
            near[int(draw.integers(0, len(near)))] = word()
            add(near)
        add(base[:60] + words)
    return rows


@pytest.mark.parametrize("width,percent,copies", [(3, 85, 300), (5, 80, 80)])
def test_components_equal_all_pairs(spark, width, percent, copies):
    rows = corpus(width, copies)
    rows += [(20001, ""), (20002, None), (20003, " \t\n"), (20004, "one"), (20005, "ONE"), (20006, "one two"), (20007, "One\x0btwo"), (None, rows[0][1]), (None, "alone null id here")]
    rows += [(20008, "again and again the same row"), (20008, "again and again the same row"), (20009, "É é \x1c x y z"), (20010, "é é \x1c x y z")]
    df = spark.createDataFrame([(*r, "d", "k") for r in rows], SCHEMA).repartition(5)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_groups(df, width, percent).collect())
    want = plain(set(rows), width, percent)
    assert got == Counter((r[0], *want[r], r[0] == want[r][1]) for r in rows)


def test_one_row_of_each_group_stays(spark):
    rows = corpus(9, 40) + [(30000, "")] * 2 + [(30001, "some text " * 9)] * 3 + [(30002, "b c d e f g")] + [(30002, "x y z u v w")]
    df = spark.createDataFrame([(*r, "d", "k") for r in rows], SCHEMA)
    got = [tuple(r) for r in drop_near_copies(df, 5, 80).collect()]
    want = plain(set(rows), 5, 80)
    groups = {want[r][1] for r in want if want[r][0]}
    assert sorted(r[0] for r in got if r[1]) == sorted([*groups, 30002])
    assert Counter(r[0] for r in got if not r[1]) == {30000: 2}
    assert drop_near_copies(df.limit(0)).count() == 0


def test_bits_and_bands():
    low = np.array([0, 1, 2, 3] * 20, np.uint64)
    bits = packed_bits(low).view(np.uint64)
    assert len(bits) == 4 and bits[0] & 1 == 0 and bits[0] >> 1 & 1 == 1 and bits[2] >> 2 & 1 == 1
    for percent in (80, 85, 95):
        bands, rows = bands_for(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1e-6
