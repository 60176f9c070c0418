import gc
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece

from rankloom.llm.pieces import LONG, Lattice, Pieces, _coded, decode, encode, long_path, words_of
from rankloom.llm.words import WordIds

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, unit string"


def _varint(raw, at):
    value = shift = 0
    while True:
        value |= (raw[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if raw[at - 1] < 128:
            return value, at


def _fields(raw):
    at = 0
    while at < len(raw):
        begin = at
        key, at = _varint(raw, at)
        if key & 7 == 0:
            _, at = _varint(raw, at)
        elif key & 7 == 2:
            size, at = _varint(raw, at)
            body, at = at, at + size
            yield key >> 3, raw[body:at], raw[begin:at]
            continue
        else:
            at += 8 if key & 7 == 1 else 4
        yield key >> 3, None, raw[begin:at]


def unigram_of(path):
    """The library's segmenter by scores on the pieces of a model file: its trainer's model type becomes unigram."""
    raw, out = open(path, "rb").read(), b""
    for number, body, whole in _fields(raw):
        if number == 2:
            spec = b"".join(b"\x18\x01" if n == 3 else w for n, _, w in _fields(body))
            size, head = len(spec), b"\x12"
            while size > 127:
                head, size = head + bytes([size & 127 | 128]), size >> 7
            whole = head + bytes([size]) + spec
        out += whole
    model = sentencepiece.SentencePieceProcessor()
    model.LoadFromSerializedProto(out)
    return model


TEXTS = [
    "Hello  world, this is   a test.\n\tTabs\r\nand lines", "", None, " leading and trailing ", "Ünïcödé 北京 🎉🎉 ▁ x́", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "1234567890 3.14 <s> </s> <0x41> <unk>", "supercalifragilisticexpialidocious " * 5, "\x00\x01\x7f", "ﬁ ﬂ ① ｆｕｌｌ", "    " * 9, "Thntatwh&&& ndreea$$$ an%%%",
]


def test_ids_equal_the_library_on_the_same_pieces(spark):
    library = unigram_of(PATH)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (3, "again"), (3, "again"), (99, "x" * 3000), (98, "ab" * 2000 + " " + "é" * 700)]
    pieces = Pieces.load(PATH)
    df = spark.createDataFrame([(*r, "i", "u") for r in rows], SCHEMA).repartition(3)
    got = decode(encode(df, pieces, keep=["doc_id", "unit"]), pieces).collect()
    want = sorted(((d, library.encode(t or ""), library.decode(library.encode(t or ""))) for d, t in rows), key=repr)
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=repr) == want
    assert all(r.unit == "u" for r in got)
    assert {r.decoded for r in got} == {(t or "").replace("▁", " ") for _, t in rows}


def test_empty_table(spark):
    pieces = Pieces.load(PATH)
    assert decode(encode(spark.createDataFrame([], SCHEMA), pieces), pieces).count() == 0


def test_very_long_units(spark):
    """A unit above LONG characters gives what the library gives, as one just below does."""
    library, draw = unigram_of(PATH), np.random.default_rng(3)
    rows = [(1, "a" * 300_000), (2, "".join(draw.choice(list("abcdefghij北"), 100_000))), (3, "b" * (LONG - 1)), (4, "b" * (LONG + 1)), (5, "word " * 60_000)]
    pieces = Pieces.load(PATH)
    df = spark.createDataFrame([(*r, "i", "u") for r in rows], SCHEMA)
    got = {r.doc_id: (r.ids, r.decoded) for r in decode(encode(df, pieces), pieces).collect()}
    assert got == {i: (library.encode(t), t) for i, t in rows}


def test_words_side_by_side_give_the_lattice_of_the_whole_text():
    """Known words, new ones, words cut into units, long units and a worker that begins anew: one lattice per text says the same."""
    draw, pieces = np.random.default_rng(5), Pieces.load(PATH)
    lattice = Lattice(pieces)
    chars = list("etaoinshrdlu") * 4 + list(" .,\n▁é北🎉") + ["  ", "▁▁", "the", "ing"]
    texts = ["".join(draw.choice(chars, n)) for n in draw.integers(0, 400, 300)] + TEXTS + ["n" * 500, "ab" * (LONG // 2), "x" * (LONG - 2), " "]
    for most in (10**6, 50):
        known, got = WordIds(lattice.words, most), []
        for i in range(0, len(texts), 7):
            ids, size = known.ids([words_of(t, True) for t in texts[i : i + 7]])
            got += [a.tolist() for a in np.split(ids, np.cumsum(size)[:-1])]
        for text, ids in zip(texts, got, strict=True):
            whole = long_path("▁" + text.replace(" ", "▁"), lattice.scores, lattice.longest, lattice.unknown) if text else []
            assert ids == [b for i in whole for b in ([i] if i >= 0 else [pieces.byte_ids[x] for x in chr(-1 - i).encode()])]


def test_words_stay_in_their_task(spark):
    """No word or text is sent to another task or written on the way."""
    pieces = Pieces.load(PATH)
    found = decode(encode(spark.createDataFrame([(1, "some text", "i", "u")], SCHEMA).repartition(2), pieces), pieces)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and not re.search("Join|Aggregate|parquet|hashpartitioning|RepartitionByExpression", plan)


def test_ids_and_their_texts_from_one_pass(spark):
    """One worker a task gives what encoding and then decoding give."""
    pieces = Pieces.load(PATH)
    df = spark.createDataFrame([(i, t, "i", "u") for i, t in enumerate(TEXTS)], SCHEMA).repartition(3)
    one, two = encode(df, pieces, keep=["doc_id", "unit"], decoded="text"), decode(encode(df, pieces, keep=["doc_id", "unit"]), pieces)
    assert one.columns == ["doc_id", "unit", "ids", "text"] and one._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, one.collect())) == sorted(tuple(r) for r in two.select(*two.columns).collect())


def test_an_idle_worker_knows_no_words():
    """After a task nothing of its words is left in the worker."""
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words here", "and there"])], names=["doc_id", "__text"])
    gc.collect()
    before = sum(isinstance(x, WordIds) for x in gc.get_objects())
    run = _coded(Pieces.load(PATH), 1)
    assert [b.num_rows for b in run(iter([batch]))] == [2]
    assert sum(isinstance(x, WordIds) for x in gc.get_objects()) == before
