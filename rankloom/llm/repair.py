"""Token ids in grammar-compressed shards (Re-Pair).

Documents are range-partitioned and sorted by doc_id, encoded, and gathered into shards of a bounded number of ids. In
each shard the most frequent pairs of neighbouring ids become nonterminals, again and again, until a round shortens the
shard by less than one part in STOP; pairs never reach over the end of a document. A shard is one binary value of its own format:

    b"RPR2", documents, rules, symbols, terminals      (4 + 4 * 8 bytes, little-endian)
    doc_id, whether it is null, ids, first symbol      (per document: 8, 1, 8, 8 bytes)
    left, right                                        (per rule: 4 + 4 bytes)
    expansion length                                   (per rule: 8 bytes)
    symbols                                            (4 bytes each; 2 where all symbols fit)
    crc32 of all before                                (4 bytes)

Expansion lengths let a reader find the symbol that covers an id without expanding the ones before (`read_range`).

The tokenizer's normaliser turns white space into a blank that its splitter drops, so a text's ids are those of its
words one after the other; each different word is encoded by the library once per worker, and so is each word without
the ASCII symbols at its end. Words of lower-case letters that normaliser and splitter leave as they are go straight to the library's model.

Defined cases: null and empty texts are documents that hold the end id alone; a null doc_id comes first; rows that share
a doc_id are neighbours, ordered by text; a document longer than a shard is a shard of its own; an empty table gives no
shards; other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import sys
from collections.abc import Iterator
from itertools import chain
from types import ModuleType
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from ..session import scratch_path
from .common import running_before
from .words import WordIds, gathered

SHARD_IDS = 1 << 20
# A pair becomes a rule if it occurs so often in a shard, and at least a FACTOR-th as often as the most frequent one.
LEAST, FACTOR, STOP = 8, 256, 64
# Words, and words without the symbols at their ends, that a worker knows; rows that it encodes at once.
KNOWN, KNOWN_BARE, ROWS = 1_000_000, 600_000, 1024
_HEAD, _MAGIC, _HASH_BITS = "<4s4q", b"RPR2", 20
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_LETTERS_DIGITS = frozenset(range(33, 127)) - frozenset(_SYMBOLS)
# Lower-case letters that no normal form and no lower case changes, and the signs that stand for bytes in the vocabulary.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_SIGNS = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class WordEncoder:
    """Ids of whole texts, each different word encoded by the library once."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        # The model of words alone takes a word as it stands; other normalisers and splitters are asked every time.
        self.straight = self.tokenizer.model.tokenize if _leaves_plain_words(self.tokenizer) else None
        self.bare, self.words = WordIds(self._library, KNOWN_BARE), WordIds(self._ends_apart, KNOWN)

    def _library(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found: list[list[int] | None] = []
        for w in words:
            plain = self.straight and _PLAIN.fullmatch(w.decode("utf-8"))
            found.append([t.id for t in self.straight(w.decode("latin-1").translate(_SIGNS))] if plain else None)
        rest = [i for i, f in enumerate(found) if f is None]
        for i in range(0, len(rest), 4096):
            some = rest[i : i + 4096]
            for at, e in zip(some, self.tokenizer.encode_batch_fast([words[j].decode("utf-8") for j in some], add_special_tokens=False)):
                found[at] = e.ids
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(size.sum())), size

    def _ends_apart(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # ASCII symbols after a letter or digit are a pre-token of their own, so a word and its ending are encoded apart.
        parts, begin = [], []
        for w in words:
            begin.append(len(parts))
            b = w.rstrip(_SYMBOLS)
            if len(b) < len(w) and b and b[-1] in _LETTERS_DIGITS and b"<|" not in w:
                parts.append(b)
                parts.append(w[len(b) :])
            else:
                parts.append(w)
        ids, size = self.bare.each(parts)
        return ids, np.add.reduceat(size, begin, dtype=np.int64)

    def encode(self, texts: pa.Array | list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end``, and how many each has."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        # The normaliser lowers anyway; a text that may spell a special token is left to the library as it is.
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().cast(pa.binary()).dictionary_encode()
        # White space at the ends of a text leaves empty words, which have no ids.
        flat, size = self.words.each(words.dictionary.to_pylist())
        at = words.indices.to_numpy(zero_copy_only=False)
        ids, size = gathered(flat, (np.cumsum(size) - size)[at], size[at]), size[at]
        upto = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        ends = upto[np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)]
        return np.insert(ids, ends, end), np.diff(ends, prepend=0) + 1


def _leaves_plain_words(tokenizer) -> bool:
    """Whether whole encoding gives a word of lower-case letters what the model alone gives it: asked of every letter, alone,
    doubled, and between others."""
    letters = [c for c in map(chr, range(256)) if _PLAIN.fullmatch(c)]
    words = [*letters, *[c + c for c in letters], *[f"{a}{c}{b}" for c in letters for a, b in ("st", "él", "re")]]
    whole = tokenizer.encode_batch_fast(words, add_special_tokens=False)
    return all(e.ids == [t.id for t in tokenizer.model.tokenize(w.encode().decode("latin-1").translate(_SIGNS))] for w, e in zip(words, whole))


def _encoder(model: str) -> WordEncoder:
    """The worker's encoder: words stay known from task to task."""
    kept = sys.modules.setdefault("_rankloom_worker", ModuleType("_rankloom_worker"))
    if getattr(kept, "model", None) != model:
        kept.model, kept.encoder = model, WordEncoder(model)
    return kept.encoder


def _ranks(key: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The place of each key among the ``chosen`` ones, or their number."""
    multiplier, shift = (0x9E3779B1, 32) if key.dtype == np.uint32 else (0x9E3779B97F4A7C15, 64)

    def spot(keys: np.ndarray) -> np.ndarray:
        return (keys * key.dtype.type(multiplier)) >> key.dtype.type(shift - _HASH_BITS)

    slot = np.full(1 << _HASH_BITS, len(chosen), np.int32)
    slot[spot(chosen)] = np.arange(len(chosen))
    rank = slot[spot(key)]
    # Chosen keys that share a slot, and others that fall on one, are looked up in order.
    other = np.flatnonzero((rank < len(chosen)) & (chosen[np.minimum(rank, len(chosen) - 1)] != key))
    order = np.argsort(chosen)
    at = order[np.minimum(np.searchsorted(chosen, key[other], sorter=order), len(chosen) - 1)]
    rank[other] = np.where(chosen[at] == key[other], at, len(chosen))
    return rank


def compressed(ids: np.ndarray, sizes: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rules (left, right), their expansion lengths, the symbols left, and the first symbol of each document."""
    # Each document is closed by a mark that pairs with nothing.
    ends = np.cumsum(sizes)
    following, most = terminals, (1 << 16 if terminals < 1 << 16 else 1 << 31)
    # A pair of symbols is one number; few numbers of half the width sort and compare faster.
    bits, signed, plain = (16, np.int32, np.uint32) if most == 1 << 16 else (32, np.int64, np.uint64)
    sym = np.insert(ids.astype(signed), ends, -1)
    rules: list[np.ndarray] = []
    while len(sym) > 1 and following < most:
        key = sym.astype(plain)
        key = (key[:-1] << plain(bits)) | (key[1:] & plain((1 << bits) - 1))
        marks = np.flatnonzero(sym < 0)
        marked = np.concatenate([marks[marks < len(key)], marks[marks > 0] - 1])
        apart = np.ones(len(key), bool)
        apart[marked] = False
        ordered = np.sort(key[apart])
        begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)
        counts = np.diff(np.append(begin, len(ordered)))
        often = counts >= LEAST
        if not often.any():
            break
        pairs, counts = ordered[begin[often]], counts[often]
        chosen = np.flatnonzero(counts >= max(LEAST, counts.max() // FACTOR))
        chosen = chosen[np.lexsort((pairs[chosen], -counts[chosen]))][: most - following]
        rank = np.full(len(sym) + 1, len(chosen), np.int32)
        rank[1:-1] = _ranks(key, pairs[chosen])
        rank[marked + 1] = len(chosen)
        # Of overlapping occurrences the one of the more frequent pair goes first, the rest wait for the next round;
        # a run of one id gives every second of its pairs.
        before, here, after = rank[:-2], rank[1:-1], rank[2:]
        ready = (here < before) & (here <= after)
        again = np.flatnonzero((here == before) & (here < len(chosen)))
        if len(again):
            fresh = np.concatenate([[True], np.diff(again) != 1])
            run = again - again[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] + 1
            ready[again] = (run % 2 == 0) & (here[again] <= after[again])
        taken = np.flatnonzero(ready)
        if len(taken) * STOP < len(sym):
            break
        won = here[taken]
        seen = np.bincount(won, minlength=len(chosen)) > 0
        used = np.flatnonzero(seen)
        rule = pairs[chosen[used]].astype(np.int64)
        rules.append((rule >> bits) << 32 | (rule & ((1 << bits) - 1)))
        sym[taken] = following + (np.cumsum(seen) - 1)[won]
        stay = np.ones(len(sym), bool)
        stay[taken + 1] = False
        sym = sym[stay]
        following += len(used)
    pairs = np.concatenate(rules) if rules else np.empty(0, np.int64)
    rule = np.stack([pairs >> 32, pairs & 0xFFFFFFFF], axis=1)
    length = np.ones(terminals + len(rule), np.int64)
    at = terminals
    for part in rules:
        sides = np.stack([part >> 32, part & 0xFFFFFFFF])
        length[at : at + len(part)] = length[sides].sum(axis=0)
        at += len(part)
    marks = np.flatnonzero(sym < 0)
    first = np.concatenate([[0], marks[:-1] + 1]) - np.arange(len(marks))
    return rule, length[terminals:], np.delete(sym, marks), first


def packed(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, terminals: int) -> bytes:
    rule, length, sym, first = compressed(ids, sizes, terminals)
    kind = "<u2" if terminals + len(rule) <= 1 << 16 else "<u4"
    body = b"".join([
        struct.pack(_HEAD, _MAGIC, len(doc_ids), len(rule), len(sym), terminals),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        sizes.astype("<i8").tobytes(), first.astype("<i8").tobytes(),
        rule.astype("<u4").tobytes(), length.astype("<i8").tobytes(), sym.astype(kind).tobytes(),
    ])
    return body + struct.pack("<I", crc32(body))


class Shard:
    """A shard read back from its bytes."""

    def __init__(self, raw: bytes):
        if crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("damaged shard")
        magic, docs, rules, symbols, self.terminals = struct.unpack_from(_HEAD, raw)
        if magic != _MAGIC:
            raise ValueError("not a shard")
        at = struct.calcsize(_HEAD)

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(raw, kind, count, at)
            at += got.nbytes
            return got

        ids, none = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if n else int(i) for i, n in zip(ids, none)]
        self.sizes, self.first = take("<i8", docs), take("<i8", docs)
        self.rule, self.length = take("<u4", 2 * rules).reshape(-1, 2), take("<i8", rules)
        self.symbols = take("<u2" if self.terminals + rules <= 1 << 16 else "<u4", symbols)
        self._expansions()

    def _expansions(self) -> None:
        """Every symbol's ids one after the other; a rule only uses symbols before it."""
        parts: list[np.ndarray] = []
        for left, right in self.rule.tolist():
            sides = [np.array([s], np.uint32) if s < self.terminals else parts[s - self.terminals] for s in (left, right)]
            parts.append(np.concatenate(sides))
        self.flat = np.concatenate([np.arange(self.terminals, dtype=np.uint32), *parts])
        self.sizes_of = np.concatenate([np.ones(self.terminals, np.int64), self.length])
        self.begin = np.cumsum(self.sizes_of) - self.sizes_of

    def _expanded(self, symbols: np.ndarray) -> np.ndarray:
        size = self.sizes_of[symbols]
        shift = np.repeat(self.begin[symbols] - (np.cumsum(size) - size), size)
        return self.flat[shift + np.arange(int(size.sum()))]

    def ids(self) -> np.ndarray:
        """The ids of all documents, one after the other."""
        return self._expanded(self.symbols)

    def documents(self) -> list[np.ndarray]:
        ids, ends = self.ids(), np.cumsum(self.sizes)
        return [ids[e - s : e] for s, e in zip(self.sizes, ends)]

    def read_range(self, doc: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of a document, by its place in the shard; only the symbols that cover them are expanded."""
        last = self.first[doc + 1] if doc + 1 < len(self.first) else len(self.symbols)
        sym = self.symbols[self.first[doc] : last]
        upto = np.cumsum(self.sizes_of[sym])
        a, b = np.searchsorted(upto, start, "right"), np.searchsorted(upto, stop, "left")
        got = self._expanded(sym[a : b + 1])
        skip = start - (int(upto[a - 1]) if a else 0)
        return got[skip : skip + stop - start]


def _written(model: str, terminals: int, end: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(model), TaskContext.get().partitionId()
        docs, sizes, ids, held, number = [], [], [], 0, 0

        def shard() -> pa.RecordBatch:
            nonlocal docs, sizes, ids, held, number
            raw = packed(docs, np.concatenate(sizes), np.concatenate(ids), terminals)
            out = [pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([held], pa.int64()), pa.array([raw], pa.binary())]
            docs, sizes, ids, held, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_arrays(out, names=["part", "number", "n_ids", "shard"])

        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                piece = batch.slice(i, ROWS)
                got, count = encoder.encode(piece.column(1), end)
                named, ends = piece.column(0).to_pylist(), np.concatenate([[0], np.cumsum(count)])
                for lo in range(0, piece.num_rows, 64):
                    hi = min(lo + 64, piece.num_rows)
                    docs += named[lo:hi]
                    sizes.append(count[lo:hi]), ids.append(got[ends[lo] : ends[hi]])
                    held += int(ends[hi] - ends[lo])
                    if held >= shard_ids:
                        yield shard()
        if docs:
            yield shard()

    return run


def write_shards(docs: DataFrame, path: str, model: str, terminals: int, end: int, text: str = "text", doc_id: str = "doc_id", shard_ids: int = SHARD_IDS) -> None:
    """Encode and write ``docs``; ``model`` is the tokenizer's JSON, ``terminals`` one more than its largest id."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_written(model, terminals, end, shard_ids), "part int, number long, n_ids long, shard binary").write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw, start in zip(batch.column(0), batch.column(1).to_pylist()):
            shard = Shard(raw.as_py())
            ids, ends = shard.ids().astype("<u4"), np.cumsum(shard.sizes)
            before = start + ends - shard.sizes
            crc = [crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), shard.sizes.tolist())]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.doc_ids, pa.int64()), pa.array(before), pa.array(shard.sizes), pa.array(crc, pa.int64()), lists],
                names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
            )


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the shards: doc_id, start among all ids, n_tokens, ids_crc32 and ids."""
    rows = spark.read.schema("part int, number long, n_ids long, shard binary").parquet(path)
    sizes = rows.select("part", "number", "n_ids")
    outer = running_before(sizes, [], "part", {"outer": F.col("n_ids")}).withColumnRenamed("part", "p")
    inner = running_before(sizes, ["part"], "number", {"inner": F.col("n_ids")})
    start = inner.join(outer, F.col("part") == F.col("p")).select(F.col("part").alias("p"), F.col("number").alias("n"), (F.col("outer") + F.col("inner")).alias("start"))
    placed = rows.join(start, (F.col("part") == F.col("p")) & (F.col("number") == F.col("n"))).select("shard", "start")
    return placed.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")


def round_trip(docs: DataFrame, tokenizer: str, end: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write the shards of ``docs`` to the shared folder and read them back; ``tokenizer`` names a file of the driver."""
    from tokenizers import Tokenizer

    with open(tokenizer, encoding="utf-8") as file:
        model = file.read()
    terminals = max(Tokenizer.from_str(model).get_vocab(with_added_tokens=True).values()) + 1
    path = scratch_path(docs.sparkSession, "shards")
    write_shards(docs, path, model, max(terminals, end + 1), end, text, doc_id)
    return read_shards(docs.sparkSession, path)
