"""Removal of repeated byte strings by column-wise sorting of a collection.

A byte goes if some string of ``length`` bytes that covers it also starts anywhere else, same document included. To find
all such strings without sorting every suffix of the corpus at once:

1. The anchor of a window of ``length`` bytes is the smallest hash of its short substrings, the leftmost of equals. It
   depends on the window's bytes alone, so equal windows have equal anchors at equal places. Windows that share an
   anchor occurrence form a segment. Only segments whose anchor hash occurs again can hold a repeat.
2. Segments of one anchor hash form a collection; equal segments are one member with a count. Members are laid side by
   side, anchor under anchor, and built up column by column from the right: each round puts one symbol before the
   suffix of every member. The symbols, taken in the order of the suffixes, are the column that the Burrows-Wheeler
   transform would insert; a stable counting sort by them gives the next order, and the common prefix lengths of
   neighbours follow from the minima between them. After the round of a window's first byte, the window is repeated
   exactly if it shares at least ``length`` bytes with a neighbour. A round needs the last order, the last lengths and one
   column, which are read in sequence; a bounded number of members is in memory at a time.
3. Anchor groups with more than GROUP different members are not put in one task: their windows are compared one by one
   under a digest of all their bytes, which spreads them by content. Same result, more rows.
4. Repeated windows are united per document, and the remaining bytes are digested.

Whole copies are counted first and one of them takes part; a document of at least ``length`` bytes with a copy goes as a whole.

Defined cases: null and empty texts have no bytes and no spans; texts shorter than ``length`` bytes keep everything; rows
with equal text are copies of each other, also with equal or null doc_id; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

LENGTH, GRAM = 200, 32
# Members of one collection that a task may hold, and members that are built up together.
GROUP, TOGETHER = 100_000, 50_000
# Positions share a 64-bit key with 40 bits of hash; longer texts are cut into pieces that overlap by a byte less than a window.
_PLACE_BITS = 24
_PIECE = (1 << _PLACE_BITS) - 1
_MULTIPLIER = 0x9E3779B97F4A7C15


def gram_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """Hash of every substring of ``width`` bytes, a power of two: doubled step by step."""
    h, power, step = raw.astype(np.uint64) + np.uint64(1), _MULTIPLIER, 1
    with np.errstate(over="ignore"):
        while step < width:
            h = h[:-step] * np.uint64(power) + h[step:]
            power, step = power * power % (1 << 64), step * 2
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every window, from running minima of blocks in both directions."""
    n = len(x) - width + 1
    full = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    full[: len(x)] = x
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments(raw: bytes, length: int, piece: int = _PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Anchor hash and packed place of every segment: first window << 16 | windows - 1 << 8 | anchor offset.

    Texts are cut into pieces of at most ``piece`` bytes (``length`` to ``_PIECE``); every window lies in one of them.
    """
    hashes, places = [], []
    for start in range(0, max(1, len(raw) - length + 1), piece - length + 1):
        part = np.frombuffer(raw, np.uint8)[start : start + piece]
        if len(part) < length:
            break
        h = gram_hashes(part, GRAM)
        place = np.arange(len(h), dtype=np.uint64)
        low = window_minima((h >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | place, length - GRAM + 1)
        anchor = (low & np.uint64(_PIECE)).astype(np.int64)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        many = np.diff(np.append(first, len(anchor)))
        at = anchor[first]
        hashes.append(h[at].view(np.int64))
        places.append((first + start) << 16 | (many - 1) << 8 | (at - first))
    if not hashes:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def _signed(length: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long_list = pa.list_(pa.int64())
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                size, digest, keys, places = [], [], [], []
                for text in part.column(1):
                    raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                    k, p = segments(raw, length, piece)
                    size.append(len(raw)), digest.append(sha256(raw).digest()), keys.append(k), places.append(p)
                columns = [part.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, long_list), pa.array(places, long_list)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "digest", "keys", "places"])

    return run


def _cut(length: int):
    """The bytes of the wanted segments of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = (batch.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass")
                places, keys = batch.column(2)[i].values.to_numpy(), batch.column(3)[i].values.to_numpy()
                first, many = places >> 16, (places >> 8 & 255) + 1
                cut = [raw[a : a + n + length - 1] for a, n in zip(first.tolist(), many.tolist())]
                digest = [blake2b(c, digest_size=16).digest() for c in cut]
                uid = pa.array(np.full(len(cut), batch.column(0)[i].as_py()))
                yield pa.RecordBatch.from_arrays([uid, pa.array(places), pa.array(keys), pa.array(digest, pa.binary()), pa.array(cut, pa.binary())], names=["uid", "place", "key", "member", "bytes"])

    return run


def repeated_windows(members: list[bytes], offsets: np.ndarray, groups: np.ndarray, length: int) -> np.ndarray:
    """Which windows of each member start another occurrence in its group; members come sorted by group.

    Row i, column w: the w-th window of member i. ``offsets`` are the places of the anchors inside the members.
    """
    m, left = len(members), length - GRAM
    sizes = np.array([len(x) for x in members])
    windows = sizes - length + 1
    # Column by column, anchors at column ``left``; 0 stands for no symbol.
    width = left + length
    table = np.zeros((m, width + 1), np.uint16)
    for i, x in enumerate(members):
        at = left - offsets[i]
        table[i, at : at + len(x)] = np.frombuffer(x, np.uint8)
        table[i, at : at + len(x)] += 1
    columns = np.ascontiguousarray(table.T)
    rank = np.cumsum(np.diff(groups, prepend=groups[:1]) != 0).astype(np.uint32)
    order, common = np.arange(m), np.zeros(m + 1, np.int16)
    found = np.zeros((left + 1, m), bool)
    for c in range(width - 1, -1, -1):
        symbols = columns[c][order]
        by = np.argsort(symbols, kind="stable")
        owner = rank[order]
        by = by[np.argsort((owner[by] & 0xFFFF).astype(np.uint16), kind="stable")]
        if rank[-1] >> 16:
            by = by[np.argsort((owner[by] >> 16).astype(np.uint16), kind="stable")]
        # Neighbours in the new order with one symbol before suffixes of one group: one more byte than what was
        # common to all suffixes that lay between them.
        a, b = by[:-1], by[1:]
        alike = np.flatnonzero((symbols[a] == symbols[b]) & (symbols[b] > 0) & (owner[a] == owner[b]))
        fresh = np.zeros(m + 1, np.int16)
        p, q = a[alike], b[alike]
        near = common[q]
        far = np.flatnonzero(q - p > 1)
        if len(far):
            bounds = np.stack([p[far] + 1, q[far] + 1], axis=1).reshape(-1)
            near[far] = np.minimum.reduceat(common, bounds)[::2]
        fresh[alike + 1] = near + 1
        order, common = order[by], fresh
        if c <= left:
            again = (common[:-1] >= length) | (common[1:] >= length)
            found[c, order[again]] = True
    out = np.zeros((m, left + 1), bool)
    for i in range(m):
        at = left - offsets[i]
        out[i, : windows[i]] = found[at : at + windows[i], i]
    return out


def _built(length: int, together: int):
    """Runs of repeated windows of each member; rows come by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int] = []
        rows: list[tuple[bytes, bytes, int]] = []

        def solved(n: int) -> pa.RecordBatch:
            part, groups = rows[:n], np.array(keys[:n])
            del rows[:n], keys[:n]
            again = repeated_windows([r[1] for r in part], np.array([r[2] for r in part]), groups, length)
            edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            member, begin = np.nonzero(edge == 1)
            _, end = np.nonzero(edge == -1)
            digests = [part[i][0] for i in member]
            return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], names=["member", "begin", "end"])

        for batch in batches:
            keys += batch.column(0).to_pylist()
            rows += zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())
            while len(rows) > together:
                # The last group may go on in the next batch.
                n = next((i for i in range(len(keys) - 1, 0, -1) if keys[i] != keys[-1]), -1) + 1
                if not n:
                    break
                yield solved(n)
        if rows:
            yield solved(len(rows))

    return run


def _windows(length: int):
    """Every window of a member by a digest of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for member, raw in zip(batch.column(0), batch.column(1)):
                raw = raw.as_py()
                n = len(raw) - length + 1
                digest = [blake2b(raw[i : i + length], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([member.as_py()] * n, pa.binary()), pa.array(range(n), pa.int64()), pa.array(digest, pa.binary())], names=["member", "begin", "window"])

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, removed, runs = [], [], []
        for text, spans in zip(batch.column(1), batch.column(2).to_pylist()):
            raw, at, out, cut, n = (text.as_py() or "").encode("utf-8", "surrogatepass"), 0, [], 0, 0
            # Sorted spans; those that meet or overlap are one run.
            reach = -1
            for s in sorted(spans, key=lambda s: (s["a"], s["b"])):
                if s["a"] > reach:
                    out.append(raw[at : s["a"]])
                    n += 1
                    cut += s["b"] - s["a"]
                elif s["b"] > reach:
                    cut += s["b"] - reach
                reach = max(reach, s["b"])
                at = reach
            out.append(raw[at:])
            digests.append(sha256(b"".join(out)).hexdigest()), removed.append(cut), runs.append(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests)], names=["digest", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id", group: int = GROUP, together: int = TOGETHER, piece: int = _PIECE
) -> tuple[DataFrame, DataFrame]:
    """Facts of every row (doc_id, n_bytes, digest, copies), and the spans (digest, a, b) of texts without a copy."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, n_bytes long, digest binary, keys array<long>, places array<long>"
    signed = stored(rows.mapInArrow(_signed(length, piece), schema).withColumn("uid", F.monotonically_increasing_id()), "signed")
    classes = stored(signed.groupBy("digest").agg(F.count("*").alias("copies"), F.min("uid").alias("first")), "classes")
    facts = signed.select("doc_id", "n_bytes", "digest").join(classes.select("digest", "copies"), "digest")
    # One of each set of copies takes part.
    chosen = signed.join(classes.select(F.col("first").alias("uid")), "uid", "left_semi")
    anchors = chosen.select("uid", F.explode(F.arrays_zip("keys", "places")).alias("z")).select("uid", F.col("z.keys").alias("key"), F.col("z.places").alias("place"))
    again = anchors.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    wanted = anchors.join(again, "key", "left_semi").groupBy("uid").agg(F.collect_list(F.struct("place", "key")).alias("at"))
    wanted = wanted.join(signed.select("uid", F.col("digest").alias("of"), F.col("doc_id").alias("doc")), "uid")
    wanted = stored(wanted.select("uid", "of", "doc", F.col("at.place").alias("places"), F.col("at.key").alias("keys")), "wanted")
    mine = rows.withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    found = mine.join(wanted, (mine["digest"] == wanted["of"]) & mine["doc_id"].eqNullSafe(wanted["doc"])).select("uid", "text", "places", "keys")
    cut = found.mapInArrow(_cut(length), "uid long, place long, key long, member binary, bytes binary")
    # A row may be there several times over with one id and text; its segments are one.
    cut = stored(cut, "segments")
    uses = cut.select("uid", "place", "member").distinct()
    members = cut.groupBy("key", "member").agg(F.min("bytes").alias("bytes"), F.min(F.struct("uid", "place")).alias("one"), F.max(F.struct("uid", "place")).alias("other"))
    members = members.select("key", "member", "bytes", (F.col("one.place").bitwiseAND(F.lit(255))).cast("int").alias("offset"), (F.col("one") != F.col("other")).alias("again"))
    members = stored(members, "members")
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    alone = members.where("again").select("member", F.lit(0).cast("long").alias("begin"), (F.octet_length("bytes") - length + 1).cast("long").alias("end"))
    # A group with one member has nothing to compare.
    several = stored(sizes.where("n > 1"), "groups")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = members.join(several.where(F.col("n") <= group), "key", "left_semi").select("key", "member", "bytes", "offset")
    small = small.repartition(parts, "key").sortWithinPartitions("key")
    runs = small.mapInArrow(_built(length, together), "member binary, begin long, end long").unionByName(alone)
    large = members.join(several.where(F.col("n") > group), "key", "left_semi").select("member", "bytes")
    if not several.where(F.col("n") > group).isEmpty():
        windows = stored(large.mapInArrow(_windows(length), "member binary, begin long, window binary"), "windows")
        twice = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
        runs = runs.unionByName(windows.join(twice, "window", "left_semi").select("member", "begin", (F.col("begin") + 1).alias("end")))
    spans = uses.join(runs, "member").select("uid", (F.shiftright("place", 16) + F.col("begin")).alias("a"), (F.shiftright("place", 16) + F.col("end") + length - 1).alias("b"))
    owners = signed.select("uid", "digest").join(classes.where("copies = 1").select(F.col("first").alias("uid")), "uid", "left_semi")
    return facts, spans.join(owners, "uid").select("digest", "a", "b")


def without_repeats(
    docs: DataFrame, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id", group: int = GROUP, together: int = TOGETHER, piece: int = _PIECE
) -> DataFrame:
    """Per row doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    facts, spans = repeated_spans(docs, length, text, doc_id, group, together, piece)
    spans = stored(spans.groupBy("digest").agg(F.collect_set(F.struct("a", "b")).alias("spans")).withColumnRenamed("digest", "of"), "spans")
    mine = docs.select(F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"), F.col(text).alias("text"))
    texts = mine.join(spans, F.col("digest") == F.col("of")).select("digest", "text", "spans")
    kept = texts.mapInArrow(_kept, "digest binary, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("digest", "of")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    out = facts.join(kept, F.col("digest") == F.col("of"), "left")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )
