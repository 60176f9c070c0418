import re
from collections import Counter, defaultdict
from hashlib import sha256

import pytest

from rankloom.llm.exact import drop_copies, exact_groups, identities

SCHEMA = "doc_id long, text string, sha string, name string, pos int"


def norm(t):
    return re.sub("[\x20\x09-\x0d]", "", t or "")


def plain(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[norm(t)].append((-len(t or ""), d is None, d if d is not None else 0, d))
    out = []
    for d, t in rows:
        best = min(groups[norm(t)])
        out.append((d, best[3], len(groups[norm(t)]), sha256(norm(t).encode()).hexdigest()))
    return Counter(out)


LONG = "abc déf 🎉 " * 700
ROWS = [
    (5, "same text"), (3, "same  text"), (9, "same\ttext\n"), (1, "sametext"), (4, "other"), (6, None), (7, ""), (8, " \n\x0b\x0c\r\t"),
    (None, "same  text "), (None, "only null"), (None, "only null"), (10, "same\x85text"), (11, "same\xa0text"), (11, "twice"), (11, "twice"), (12, "twice"),
    (20, LONG), (21, LONG + "x"), (22, " " + LONG), (23, LONG[:-2]), (24, "z" * 10), (25, "z" * 11), (26, "z" * 20), (27, "z" * 30), (28, "y" * 10 + "z" * 10),
]


@pytest.mark.parametrize("block", [2048, 5])
def test_groups_against_plain_rule(spark, block):
    rows = ROWS + [(1000 + i, "hot copy") for i in range(300)]
    df = spark.createDataFrame([(*r, "s", "n", 1) for r in rows], SCHEMA).repartition(4)
    got = exact_groups(df, block=block).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == plain(rows)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({sha256(norm(t).encode()).hexdigest() for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_names_stand_for_contents(spark):
    df = spark.createDataFrame([(*r, "s", "n", 1) for r in ROWS], SCHEMA)
    names = {}
    for r in identities(df, block=5).collect():
        names.setdefault(r.sha, set()).add((r.rounds, r.name))
    assert all(len(v) == 1 for v in names.values())
    assert len({next(iter(v)) for v in names.values()}) == len(names) == len({norm(t) for _, t in ROWS})


def test_one_row_of_each_group_stays_with_its_columns(spark):
    df = spark.createDataFrame([(*r, "s", "n", 1) for r in ROWS], SCHEMA)
    got = drop_copies(df).collect()
    assert Counter(norm(r.text) for r in got) == Counter({norm(t) for _, t in ROWS})
    assert {r.doc_id for r in got if norm(r.text) == "sametext"} == {9} or {r.doc_id for r in got if norm(r.text) == "sametext"} == {None}
    assert all(r.sha == "s" and r.pos == 1 for r in got)
    assert drop_copies(df.limit(0)).count() == 0 and exact_groups(df.limit(0)).count() == 0
