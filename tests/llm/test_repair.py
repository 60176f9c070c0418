from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rankloom.llm.repair import FACTOR, LEAST, STOP, Shard, WordEncoder, compressed, packed, round_trip, write_shards

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids array<long>, start string"


@pytest.mark.parametrize("seed", range(4))
def test_shard_gives_back_its_ids(seed):
    draw = np.random.default_rng(seed)
    words = [draw.integers(0, 300, draw.integers(1, 6)) for _ in range(50)]
    docs = [np.concatenate([words[i] for i in draw.integers(0, 50, n)] + [[2]]) for n in (0, 1, 400, 0, 3000, 20)]
    docs.append(np.full(997, 7))
    shard = Shard(packed([3, None, 5, 6, 7, 8, 9], np.array([len(d) for d in docs]), np.concatenate(docs), 300))
    assert shard.doc_ids == [3, None, 5, 6, 7, 8, 9]
    assert all((a == b).all() for a, b in zip(docs, shard.documents()))
    assert len(shard.symbols) < sum(map(len, docs)) * 0.6
    for i, d in enumerate(docs):
        for a, b in ((0, len(d)), (len(d) // 3, len(d) // 2), (len(d) - 1, len(d)), (0, 0)):
            assert (shard.read_range(i, a, b) == d[a:b]).all()


def test_damage_is_noticed():
    raw = bytearray(packed([1], np.array([3]), np.array([1, 2, 3]), 10))
    raw[50] ^= 1
    with pytest.raises(ValueError):
        Shard(bytes(raw))


TEXTS = ["Hello, WORLD!! it's  <|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y", "", None, "ÉCOLE é é İ ß ﬁ    a\x1cb\x85c", "a." * 50, "don't 12,3 ... .,! 北京。 x́.", "\t\n ", "🎉🎉ok"]


def test_words_give_the_ids_of_whole_texts():
    encoder, tokenizer = WordEncoder(open(PATH).read()), Tokenizer.from_file(PATH)
    ids, sizes = encoder.encode(TEXTS, 2)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in TEXTS]
    assert ids.tolist() == sum(want, []) and sizes.tolist() == [len(w) for w in want]


def test_round_trip_of_a_table(spark, tmp_path):
    rows = [(i * 3 % 101, TEXTS[i % 8] and TEXTS[i % 8] * (1 + i % 5)) for i in range(101)] + [(None, "null id"), (4, "again"), (4, "again")]
    df = spark.createDataFrame([(*r, [1], "s") for r in rows], SCHEMA)
    got = sorted(map(tuple, round_trip(df, PATH).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    tokenizer, want, at = Tokenizer.from_file(PATH), [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((at, d, len(ids), crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert round_trip(df.limit(0), PATH).count() == 0
    # Small shards: a long document makes one of its own.
    write_shards(df, str(tmp_path / "s"), open(PATH).read(), 49408, 2, shard_ids=10)
    assert spark.read.parquet(str(tmp_path / "s")).count() >= 2


PLAIN = ["ÿþßæœ ﬁn naïve straße", "it's'' don't%%% a'b'' é''s x_y__ 3.1.. ÿ- µ+ ªº ς", "aé" * 40 + "&&&", "x<|endoftext|>% <|y|>", "Ünder ünder ÜNDER", "\x1c \x85\u00a0word\u00a0"]


def test_plain_words_and_endings_give_the_ids_of_whole_texts():
    """Each different plain word is asked of the library's model once, without the symbols at its end, and never through normaliser and splitter."""
    encoder, tokenizer = WordEncoder(open(PATH).read()), Tokenizer.from_file(PATH)
    for _ in range(2):
        ids, sizes = encoder.encode(PLAIN + TEXTS, 2)
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in PLAIN + TEXTS]
        assert ids.tolist() == sum(want, []) and sizes.tolist() == [len(w) for w in want]
    asked = []

    class Library:
        def encode_batch_fast(self, words, **options):
            asked.extend(words)
            return tokenizer.encode_batch_fast(words, **options)

    encoder.tokenizer = Library()
    encoder.encode(["gänzlich neue wörter, wörter! wörter### (8)", "neue wörter%% 8 8###"], 2)
    assert not {"gänzlich", "neue", "wörter"} & set(asked) and len(asked) == len(set(asked))


def test_rules_are_those_of_pairs_sorted_one_by_one():
    """Rounds of `compressed` against plain counts: the same rules in the same order, for narrow and wide symbols."""
    draw = np.random.default_rng(8)
    for terminals, top in ((300, 12), (70_000, 40), (10, 3)):
        sizes = np.array([1, 700, 1, 4000, 2300])
        ids = draw.integers(0, top, sizes.sum())
        sym = [s for part in np.split(ids, np.cumsum(sizes)[:-1]) for s in [*part.tolist(), -1]]
        rules, following = [], terminals
        while True:
            count = Counter((a, b) for a, b in zip(sym, sym[1:]) if a >= 0 and b >= 0)
            most = max(count.values(), default=0)
            chosen = sorted((p for p, n in count.items() if n >= max(LEAST, most // FACTOR)), key=lambda p: (-count[p], p))
            place = {p: i for i, p in enumerate(chosen)}
            rank = [len(chosen), *[place.get(p, len(chosen)) for p in zip(sym, sym[1:])], len(chosen)]
            taken, run = [], 0
            for i in range(1, len(sym)):
                run = run + 1 if rank[i] == rank[i - 1] and i > 1 else 0
                if rank[i] < len(chosen) and run % 2 == 0 and (run or rank[i] < rank[i - 1]) and rank[i] <= rank[i + 1]:
                    taken.append(i - 1)
            if not taken or len(taken) * STOP < len(sym):
                break
            used = sorted({rank[i + 1] for i in taken})
            rules += [chosen[u] for u in used]
            for i in taken:
                sym[i] = following + used.index(rank[i + 1])
            gone = {i + 1 for i in taken}
            sym, following = [s for i, s in enumerate(sym) if i not in gone], following + len(used)
        rule, _, left, _ = compressed(ids, sizes, terminals)
        assert [tuple(r) for r in rule.tolist()] == rules and left.tolist() == [s for s in sym if s >= 0]
