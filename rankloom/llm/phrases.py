"""Collocations: contiguous phrases scored by their weakest cut, counted over a prefix-free parsing of the corpus.

1. Texts are cut into pieces at punctuation, and a piece into chunks where four words in a row have a hash that is divisible
   by EVERY: cuts depend on the words around them alone, so equal passages are cut alike wherever they stand. A chunk runs on
   for the four words behind its end, and owns the phrases that begin before that: every phrase of up to five words lies whole
   in exactly one chunk that owns its beginning.
2. Equal chunks are one entry of the dictionary with the number of times it is in the parse. Everything below works on the
   dictionary; an entry counts as often as it occurs.
3. Words are counted. A phrase cannot be frequent unless both of its parts without the last and without the first word are,
   so phrases grow by one word a round: an entry holds, place by place, the numbers of its frequent phrases of n words; two
   at neighbouring places are a candidate of n + 1 words, equal pairs of numbers are added up in the tasks first, and the
   frequent pairs get numbers of their own. Numbers stand for phrases and not for hashes of them, so counts are exact.
4. Each phrase carries the counts of its beginnings and endings, which the two halves of every cut are among. Scores are exact
   integer quotients of 38 digits. A phrase of which one with a word more has the same count is dropped.

Defined cases: null text has no words; null lang is `und`, together with documents that say so; texts of any length are cut
into pieces and chunks, none longer than MOST words and their tail; equal rows count each; an empty table, or one without
frequent phrases, gives no rows; ties are in byte order of the phrase; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import table_bytes
from .common import SMALL_BYTES, send, stored

LONGEST, LEAST, TOP = 5, 100, 2000
# One place in EVERY begins a chunk; chunks without such a place end after MOST words.
EVERY, MOST = 16, 256
# Bytes of text that a task works on at a time, and candidate pairs that it adds up together.
SLICE, TOGETHER = 1 << 20, 1 << 20
BREAK = r"[.,;:!?\x0A-\x0D]+"

_TAIL = LONGEST - 1
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLANK = np.isin(np.arange(256), [0x20, 0x09])

Batches = Iterator[pa.RecordBatch]


def _after(data: np.ndarray, start: int, end: int, words: int) -> int:
    """Place after ``words`` more words from a blank on."""
    reach = 1 << 12
    while True:
        stop = min(start + reach, end)
        blank = _BLANK[data[start:stop]]
        begins = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
        if len(begins) > words:
            return start + int(begins[words])
        if stop == end:
            return end
        reach *= 4


def _slices(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of whole pieces: (row, start, end of what it owns, end). A piece longer than SLICE is cut at a blank, with a tail."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1
        if j > i:
            yield np.arange(i, j), offsets[i:j], offsets[i + 1 : j + 1], offsets[i + 1 : j + 1]
            i = j
            continue
        start, end = int(offsets[i]), int(offsets[i + 1])
        while start < end:
            cut, reach = min(start + SLICE, end), 1 << 12
            while cut < end and not (found := np.flatnonzero(_BLANK[data[cut : cut + reach]])).size:
                cut, reach = min(cut + reach, end), reach * 4
            cut = end if cut >= end else cut + int(found[0])
            stop = _after(data, cut, end, _TAIL) if cut < end else end
            yield np.array([i]), np.array([start]), np.array([cut]), np.array([stop])
            start = cut
        i += 1


def _cut(text: np.ndarray, starts: np.ndarray, owned: np.ndarray, ends: np.ndarray):
    """Chunks of the pieces of a stretch: (piece, first byte, end byte, words owned)."""
    blank = _BLANK[text]
    edge = np.zeros(len(text) + 1, bool)
    edge[starts] = True
    edge[-1] = True
    begins = np.flatnonzero(~blank & (np.r_[True, blank[:-1]] | edge[:-1]))
    stops = np.flatnonzero(~blank & (np.r_[blank[1:], True] | edge[1:])) + 1
    n = len(begins)
    if not n:
        return None
    row = np.searchsorted(ends, begins, side="right")
    count = np.bincount(row, minlength=len(ends))
    first = np.cumsum(count) - count
    own_end = first + np.bincount(row[begins < owned[row]], minlength=len(ends))
    cut = np.zeros(n, bool)
    cut[first[count > 0]] = True
    if n > _TAIL:
        sums = np.r_[np.uint64(0), np.cumsum(text, dtype=np.uint64)]
        word = (sums[stops] - sums[begins]) * np.uint64(31) + (stops - begins).astype(np.uint64)
        with np.errstate(over="ignore"):
            h = sum((word[i : n - _TAIL + 1 + i] * _MIX[i] for i in range(_TAIL)), np.zeros(n - _TAIL + 1, np.uint64))
            h = (h ^ (h >> np.uint64(29))) * _MIX[-1]
        whole = row[_TAIL - 1 :] == row[: n - _TAIL + 1]
        cut[: n - _TAIL + 1] |= whole & ((h >> np.uint64(40)) % np.uint64(EVERY) == 0)
    at = np.flatnonzero(cut)
    at = at[at < own_end[row[at]]]
    until = np.minimum(np.r_[at[1:], n], own_end[row[at]])
    parts = -(-(until - at) // MOST)
    inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    at, until = np.repeat(at, parts) + inner * MOST, np.repeat(until, parts)
    own = np.minimum(until - at, MOST)
    last = np.minimum(at + own + _TAIL, (first + count)[row[at]]) - 1
    return row[at], begins[at], stops[last], own


def _chunks(batches: Batches) -> Batches:
    for batch in batches:
        column = batch.column(1)
        _, places, raw = column.buffers()
        if not batch.num_rows or raw is None:
            continue
        offsets = np.frombuffer(places, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(raw, np.uint8)
        for rows, starts, owned, ends in _slices(offsets, data):
            base = starts[0]
            text = _LOWER[data[base : ends[-1]]]
            found = _cut(text, starts - base, owned - base, ends - base)
            if found is None:
                continue
            row, lo, hi, own = found
            size = hi - lo
            close = np.cumsum(size)
            out = text[np.arange(close[-1]) + np.repeat(lo - (close - size), size)]
            chunk = pa.StringArray.from_buffers(len(size), pa.py_buffer(np.r_[0, close].astype(np.int32).tobytes()), pa.py_buffer(out.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[row])), chunk, pa.array(own, pa.int32())], names=["lang", "chunk", "own"])


def parsed(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The dictionary: (cid, lang, chunk, own, weight), one row per different chunk; ``own`` words of it begin phrases."""
    of = F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang")
    pieces = docs.select(of, F.explode(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), BREAK)).alias("piece")).where("piece <> ''")
    chunks = pieces.mapInArrow(_chunks, "lang string, chunk string, own int")
    entries = chunks.groupBy("lang", "chunk", "own").agg(F.count("*").alias("weight"))
    return stored(entries.select(F.monotonically_increasing_id().alias("cid"), "lang", "chunk", "own", "weight"), "chunks")


_ENTRY = "cid long, own int, weight long"


def _gathered(batches: Batches) -> Batches:
    """Rows (entry, pos, id), entry by entry, to one row per entry: its places and numbers. One number alone is of no use."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else pa.concat_batches([held, batch])
        cid = held.column(0).to_numpy()
        # The last entry may go on in the next batch.
        cut = int(np.flatnonzero(cid != cid[-1])[-1]) + 1 if cid[0] != cid[-1] else 0
        if cut:
            yield from _lists_of(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None:
        yield from _lists_of(held)


def _lists_of(rows: pa.RecordBatch) -> Batches:
    cid = rows.column(0).to_numpy()
    first = np.flatnonzero(np.r_[True, cid[1:] != cid[:-1]])
    size = np.diff(np.r_[first, len(cid)])
    keep = size > 1
    if not keep.any():
        return
    inside = np.repeat(keep, size)
    ends = pa.array(np.r_[0, np.cumsum(size[keep])], pa.int32())
    head = rows.take(pa.array(first[keep]))
    lists = [pa.ListArray.from_arrays(ends, rows.column(i).filter(pa.array(inside))) for i in (3, 4)]
    yield pa.RecordBatch.from_arrays([head.column(0), head.column(1), head.column(2), *lists], names=["cid", "own", "weight", "at", "ids"])


def _numbered(rows: DataFrame, names: DataFrame, on: list[str], row_bytes) -> DataFrame:
    """Rows (entry, pos, on ...) whose key has a number, gathered by entry.

    Entries lie row after row. A join with a small table keeps them so; else they are dealt by entry and sorted.
    """
    small = table_bytes(names, row_bytes) <= SMALL_BYTES
    met = rows.join(F.broadcast(names) if small else names, on).select("cid", "own", "weight", "pos", "id")
    if not small:
        met = met.repartition("cid").sortWithinPartitions("cid", "pos")
    return stored(met.mapInArrow(_gathered, f"{_ENTRY}, at array<int>, ids array<long>"), "places")


def _neighbours(batch: pa.RecordBatch):
    """Pairs of numbers at neighbouring places: (row, place, left, right)."""
    size = batch.column(3).value_lengths().to_numpy()
    row = np.repeat(np.arange(batch.num_rows), size)
    at, ids = (batch.column(i).flatten().to_numpy() for i in (3, 4))
    meet = np.flatnonzero((row[1:] == row[:-1]) & (at[1:] == at[:-1] + 1))
    return row[meet], at[meet], ids[meet], ids[meet + 1]


def _added(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(np.add.reduceat(n[order], first))], names=["a", "b", "n"])


def _pair_counts(batches: Batches) -> Batches:
    """Pairs that their entry owns, added up for many entries together."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        row, at, a, b = _neighbours(batch)
        own, weight = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        mine = at < own[row]
        held.append((a[mine], b[mine], weight[row[mine]]))
        size += int(mine.sum())
        if size >= TOGETHER:
            yield _added(*[np.concatenate(x) for x in zip(*held)])
            held, size = [], 0
    if size:
        yield _added(*[np.concatenate(x) for x in zip(*held)])


def _pair_rows(batches: Batches) -> Batches:
    for batch in batches:
        if batch.num_rows:
            row, at, a, b = _neighbours(batch)
            head = batch.select(["cid", "own", "weight"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*head.columns, pa.array(at, pa.int32()), pa.array(a), pa.array(b)], names=["cid", "own", "weight", "pos", "a", "b"])


def _size(*strings: str):
    return sum((F.octet_length(s) for s in strings), F.lit(96))


def frequent(entries: DataFrame, least: int = LEAST, longest: int = LONGEST) -> list[DataFrame]:
    """For n = 1 ... ``longest`` the phrases of n words with at least ``least`` occurrences, as far as there are any.

    Rows (id, lang, phrase, last, f, pre, suf, a, b): the last word, the counts of the beginnings and endings of 1 ... n
    words, and the numbers of the phrases without the last and without the first word.
    """
    words = entries.select("cid", "own", "weight", "lang", F.posexplode(F.split("chunk", r"[\x20\x09]+")).alias("pos", "word"))
    counted = words.where("pos < own").groupBy("lang", "word").agg(F.sum("weight").alias("f")).where(F.col("f") >= least)
    none = F.lit(None).cast("long")
    level = counted.select(
        F.monotonically_increasing_id().alias("id"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f",
        F.array("f").alias("pre"), F.array("f").alias("suf"), none.alias("a"), none.alias("b"),
    )
    levels = [stored(level, "words")]
    places = _numbered(words, levels[0].select("lang", F.col("phrase").alias("word"), "id"), ["lang", "word"], _size("lang", "word"))
    while len(levels) < longest:
        pairs = places.mapInArrow(_pair_counts, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("f"))
        pairs = stored(pairs.where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id()), "pairs")
        before = send(levels[-1], 2 * _size("phrase", "last"))
        left = before.select(F.col("id").alias("a"), "lang", F.col("phrase").alias("head"), "pre")
        right = before.select(F.col("id").alias("b"), F.col("last"), "suf")
        level = pairs.join(left, "a").join(right, "b").select(
            "id", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "f",
            F.concat("pre", F.array("f")).alias("pre"), F.concat("suf", F.array("f")).alias("suf"), "a", "b",
        )
        levels.append(stored(level, "phrases"))
        if len(levels) == longest or levels[-1].isEmpty():
            break
        rows = places.mapInArrow(_pair_rows, f"{_ENTRY}, pos int, a long, b long")
        places = _numbered(rows, pairs.select("a", "b", "id"), ["a", "b"], 64)
    return levels


# The lowest score of all cuts, the first of equals: floor(1000 a n / (l r)) in integers of up to 38 digits.
_CUT = """array_min(transform(sequence(1, size(pre) - 1), k -> struct(
    (cast(1000 as decimal(4, 0)) * cast(f as decimal(19, 0)) * cast(n as decimal(19, 0)))
        div (cast(element_at(pre, k) as decimal(19, 0)) * cast(element_at(suf, size(suf) - k) as decimal(19, 0))) as score,
    k as k, element_at(pre, k) as l, element_at(suf, size(suf) - k) as r)))"""


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    if longest > LONGEST:
        raise ValueError(f"chunks overlap for phrases of up to {LONGEST} words")
    entries = parsed(docs, text, lang)
    levels = frequent(entries, least, longest)
    sizes = entries.groupBy("lang").agg(F.sum(F.col("own") * F.col("weight")).alias("n"))
    kept = None
    for i, level in enumerate(levels[1:], start=1):
        if i + 1 < len(levels):
            # What a longer phrase covers as often is covered by one with a word more, whose count lies between the two.
            longer = levels[i + 1].select("f", F.explode(F.array(F.struct(F.col("a").alias("id"), F.element_at("pre", -2).alias("of")), F.struct(F.col("b").alias("id"), F.element_at("suf", -2).alias("of")))).alias("part"))
            covered = longer.where("f >= part.of").select("part.id").distinct()
            level = level.join(send(covered, 16), "id", "left_anti")
        part = level.select("lang", "phrase", "f", "pre", "suf")
        kept = part if kept is None else kept.unionByName(part)
    scored = kept.join(send(sizes, _size("lang")), "lang").withColumn("cut", F.expr(_CUT))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    scored = scored.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
