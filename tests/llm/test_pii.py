import hashlib
import re

import numpy as np
import pytest

from rankloom.llm import pii

SCHEMA = "doc_id long, text string, kind string, row int, spans string"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, "s") for i, t in rows], SCHEMA)


def luhn(digits):
    twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in twice) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def card(draw, n=16):
    body = "4" + "".join(str(d) for d in draw.integers(0, 10, n - 2))
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def corpus():
    draw = np.random.default_rng(5)
    words = ["alpha", "βeta", "see", "v1.2,", "😀", "call", "token=12ab98cd7654ef", "ref=1234567,", "rev=10.0.0,", "no=555-1234,", "or (12) 345-6789;", "<a@b>,"]
    phone = lambda: f"+1 ({draw.integers(200, 999)}) 555-{draw.integers(1000, 9999)}"
    ip = lambda: ".".join(str(x) for x in draw.integers(1, 256, 4))
    rows = []
    for i in range(900):
        parts = [str(w) for w in draw.choice(words, int(draw.integers(0, 30)))]
        for make in (phone, ip, lambda: card(draw), lambda: f"u{i}.x@mail{i % 7}.example.com"):
            if draw.random() < 0.4:
                parts.insert(int(draw.integers(0, len(parts) + 1)), make() + str(draw.choice(["", ".", ","])))
        rows.append((i, " ".join(parts)))
    return rows, phone(), card(draw)


@pytest.fixture(scope="module")
def found(spark):
    rows, phone, number = corpus()
    rows += [
        (2000, f"one {phone} {number} two"),
        (2001, "clean words, nothing to see 7 here"),
        (2002, None),
        (2003, ""),
        (None, "x@y.z"),
        (2004, "a@b.c_d@e.f x@y@z.w a..b@c.d.e-@f.g 1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.01 +1+12345678901 + 1"),
        (2005, "4111 1111-1111 1111 4111111111111111x 1 2 3 +49 (0)30 1234567-89. ٣@x.y é@x.y"),
        (5, rows[5][1]),
    ]
    return rows, pii.find(frame(spark, rows).repartition(4)).collect()


def test_base_spans_equal_the_plain_search(found):
    rows, got = found
    want = sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest(), base_spans(t)) for i, t in rows)
    assert sorted((str(r.doc_id), r.text_sha256, [tuple(s)[:3] for s in r.spans if s.base]) for r in got) == want
    assert all(r.spans == sorted(r.spans) for r in got)


def test_spans_are_added_where_a_strict_match_ran_into_its_neighbour(found):
    rows, got = found
    text = dict(rows)[2000]
    spans = next(r.spans for r in got if r.doc_id == 2000)
    assert base_spans(text) == []
    assert {(pii.KINDS[s.kind], text[s.start : s.end]) for s in spans} == {("phone", text.split(" two")[0][4:21]), ("card", text.split()[-2])}
    assert next(r.spans for r in got if r.doc_id == 2001) == []
    extra = [s for r in got if r.doc_id is not None and r.doc_id < 2000 for s in r.spans if not s.base]
    assert len(extra) <= 30


def test_digest_and_redaction(spark, found):
    rows, _ = found
    docs = frame(spark, rows[:40] + rows[-8:])
    out = pii.find(docs)
    for r in pii.digest(out).collect():
        text = next(t for i, t in rows if i == r.doc_id)
        base = base_spans(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
    clean = {r.doc_id: r.text for r in pii.redact(docs, out).collect()}
    assert pii.redact(docs, out).columns == docs.columns and docs.count() == 48
    assert clean[None] == "[email]" and clean[2002] is None and clean[2003] == "" and clean[2001] == dict(rows)[2001]
    assert "@" not in clean[2004].replace("@y@", "").replace("a..b@", "") or "[email]" in clean[2004]


def test_bounded_sample_and_held_out_accuracy(spark):
    rows, _, _ = corpus()
    some = pii.with_features(pii.candidates(pii._matches(frame(spark, rows), "text", "doc_id"))).cache()
    model = pii.fit(some, sample=300)
    judged = pii.scored(some, model).where("labelled").where(pii._kept_out()).toPandas()
    assert ((judged.score >= 0.5) == judged.base).mean() > 0.97
    assert {r.kind for r in pii.thresholds(pii.scored(some, model)).collect()} >= {0, 1, 2}


def test_long_texts_in_linear_time(spark):
    rows = [(1, "a" * 400_000), (2, "7" * 400_000), (3, "1 " * 200_000), (4, "0." * 200_000 + "1"), (5, "+1" * 150_000), (6, "x " * 300_000 + "me@here.org"), (7, "+1" + "(" * 300_000)]
    got = {r.doc_id: [tuple(s)[:3] for s in r.spans if s.base] for r in pii.find(frame(spark, rows)).collect()}
    assert got[6] == [(600_000, 0, 600_011)] and got[1] == got[2] == got[3] == got[5] == got[7] == []
    assert len(got[4]) == 50_000 and got[4][1] == (8, 1, 15)


def test_nothing_to_learn_from(spark):
    none = pii.find(frame(spark, []))
    assert none.count() == 0
    one = pii.digest(pii.find(frame(spark, [(1, "only me@x.org"), (2, None)]))).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_email, r.spans) for r in one] == [(1, 1, "email:5:13"), (2, 0, "")]
