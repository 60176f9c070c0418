"""Near-duplicate documents by b-bit MinHash.

1. Each text gives its set of word shingles (64-bit names), a digest of its word sequence, and one minimum per hash
   function. Groups of `rows` minima are band keys; of every minimum only the two low bits are kept, packed in longs.
2. Copies (equal digests) become one class before anything else, so groups of copies cost one row.
3. Classes that share a band key are candidates. First each class is compared with the smallest class of its buckets,
   which joins most of a group without making its pairs. Then only buckets that still hold several components are
   opened: classes outside a bucket's main component meet the rest of the bucket.
4. A candidate stays if the sizes allow the similarity and if the share of equal low bits, corrected for chance
   collisions, is not far below it. Candidates of the first step are confirmed by the intersection of the full sets.
   In opened buckets each class carries how its full set differs from the set of the bucket's smallest class; two such
   differences give the exact intersection of two sets, so the join itself confirms and only links leave it. Two
   classes meet in the smallest bucket they share.
5. Connected components of the links give each document the smallest doc_id that it reaches.

The number of bands follows from the similarity: at the threshold a link is missed by all bands with probability MISS.
There is no cap on buckets, partners or candidates.

Defined cases: null and empty texts, or texts without words, have no shingle and link with nothing; a text with fewer
words than a shingle is one shingle; rows with the same words are one class, also when doc_id repeats or is null (null
is never the smallest id unless all are null); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, lean, one_of_each, send, stored

MISS = 1e-6
# Standard deviations that the estimate may lie below the threshold before a candidate is given up.
SLACK = 5.0
BITS = 2
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(29)
# Shingles that meet all hash functions at a time; keeps the table of products inside the cache.
_STEP = 2048


def bands_for(percent: int) -> tuple[int, int]:
    """Bands and rows per band for a similarity of ``percent`` in a hundred."""
    rows = 6 if percent >= 85 else 5
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** rows)), rows


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _MIX
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Words to shingle names; words are named once per worker."""

    def __init__(self, width: int):
        self.width, self.names = width, {}

    def words(self, text: str | None) -> list[bytes]:
        # bytes.lower changes A-Z only, and bytes.split cuts at space and 0x09 to 0x0D.
        return text.encode("utf-8", "surrogatepass").lower().split() if text else []

    def named(self, words: list[bytes]) -> np.ndarray:
        names = self.names
        if len(names) > 1_000_000:
            names.clear()
        try:
            got = [names[w] for w in words]
        except KeyError:
            for w in words:
                if w not in names:
                    names[w] = int.from_bytes(blake2b(w, digest_size=8).digest(), "little")
            got = [names[w] for w in words]
        return np.array(got, dtype=np.uint64)

    def shingles(self, words: list[bytes]) -> np.ndarray:
        """Sorted distinct names of the shingles."""
        if not words:
            return np.empty(0, np.uint64)
        ids = self.named(words)
        width = min(self.width, len(ids))
        count = len(ids) - width + 1
        name = np.full(count, width, np.uint64)
        for i in range(width):
            name = _mixed(name * _ODD + ids[i : i + count])
        return np.unique(name)


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(20240131)).integers(0, 1 << 63, (2, count), dtype=np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def signature(names: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over a set of shingles."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(names), _STEP):
            np.minimum(low, (a[:, None] * names[None, i : i + _STEP] + b[:, None]).min(axis=1), out=low)
    return _mixed(low)


def packed_bits(low: np.ndarray) -> np.ndarray:
    """The two low bits of each minimum as bit planes: longs of first bits, then longs of second bits."""
    size = -len(low) % 64
    planes = [np.packbits(np.pad(((low >> np.uint64(i)) & np.uint64(1)).astype(np.uint8), (0, size)), bitorder="little") for i in range(BITS)]
    return np.concatenate(planes).view(np.int64)


def _signatures(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, (a, b) = Shingler(width), _functions(bands * rows)
        salt = np.arange(bands, dtype=np.uint64)
        for batch in batches:
            texts = batch.column(1)
            digest, count, keys, bits = [], [], [], []
            for text in texts:
                words = cut.words(text.as_py())
                names = cut.shingles(words)
                count.append(len(names))
                if not len(names):
                    digest.append(None), keys.append(None), bits.append(None)
                    continue
                digest.append(blake2b(b" ".join(words), digest_size=16).digest())
                low = signature(names, a, b)
                key = salt
                for column in low.reshape(bands, rows).T:
                    key = _mixed(key * _ODD + column)
                keys.append(key.view(np.int64)), bits.append(packed_bits(low))
            long_list = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(digest, pa.binary()), pa.array(count, pa.int64()), pa.array(keys, long_list), pa.array(bits, long_list)],
                names=["doc_id", "mark", "digest", "n", "keys", "bits"],
            )

    return lean(run)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(width)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                found = [cut.shingles(cut.words(t.as_py())).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["cid", "names"])

    return lean(run)


def likely(left: str, right: str, minima: int, percent: int) -> Column:
    """Whether two classes may reach the similarity, by their sizes and by the bits of their minima."""
    n, m = F.col(f"{left}.n"), F.col(f"{right}.n")
    longs = -(-minima // 64)
    unequal = F.lit(0)
    for i in range(longs):
        differ = [F.col(f"{left}.bits")[i + p * longs].bitwiseXOR(F.col(f"{right}.bits")[i + p * longs]) for p in range(BITS)]
        both = differ[0]
        for d in differ[1:]:
            both = both.bitwiseOR(d)
        unequal = unequal + F.bit_count(both)
    # The share of equal minima is the similarity s plus chance collisions: e = s + (1 - s) / 2^BITS.
    chance, s = 1 / 2**BITS, percent / 100
    spread = math.sqrt((s + (1 - s) * chance) * (1 - s) * (1 - chance) / minima) / (1 - chance)
    estimate = (1 - unequal / F.lit(float(minima)) - chance) / (1 - chance)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (estimate >= s - SLACK * spread)


def _full_sets(cids: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(cid, names): the whole shingle sets of some classes, cut again from one text each."""
    one = classes.join(cids.distinct(), "cid", "left_semi").select("cid", F.col("first.doc_id").alias("of"), F.col("first.mark").alias("mark"))
    one = send(stored(one, "needed"), 32)
    texts = docs.join(one, docs["doc_id"].eqNullSafe(one["of"]) & (docs["mark"] == one["mark"])).select("cid", "text")
    return stored(texts.dropDuplicates(["cid"]).mapInArrow(_sets(width), "cid long, names array<long>"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets are similar enough."""
    far = pairs.join(sets.select(F.col("cid").alias("b"), F.col("names").alias("right")), "b")
    both = far.join(sets.select(F.col("cid").alias("a"), F.col("names").alias("left")), "a")
    met = F.size(F.array_intersect("left", "right")).cast("long")
    return both.where(met * 100 >= (F.size("left") + F.size("right") - met) * percent).select("a", "b")


def _edits(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """(hub, cid, base, kept, edits): the hub's set size, what a class shares with the hub, and what only one of both has."""
    sides = open_.select("hub", "cid").distinct()
    both = sides.join(sets, "cid").join(sets.select(F.col("cid").alias("hub"), F.col("names").alias("of")), "hub")
    both = both.withColumn("gained", F.array_except("names", "of"))
    kept = (F.size("names") - F.size("gained")).cast("long")
    edits = F.concat("gained", F.array_except("of", "names"))
    return both.select("hub", "cid", F.size("of").cast("long").alias("base"), kept.alias("kept"), edits.alias("edits"))


def _similar(percent: int) -> Column:
    """Whether two classes of a bucket are similar enough, exactly, by how each differs from the bucket's hub.

    What both share is what both kept of the hub and what both gained; kept by both is all of the hub but what one of them
    lost, so shared = kept + kept - base + equal edits. The most that edits can agree is tried first.
    """
    kept, need = F.col("l.kept") + F.col("r.kept") - F.col("l.base"), (F.col("l.n") + F.col("r.n")) * percent
    most = F.least(*[F.col(f"{s}.base") - F.col(f"{s}.kept") for s in "lr"]) + F.least(*[F.col(f"{s}.n") - F.col(f"{s}.kept") for s in "lr"])
    equal = F.size(F.array_intersect("l.edits", "r.edits"))
    return ((kept + most) * (100 + percent) >= need) & ((kept + equal) * (100 + percent) >= need)


def _with_bits(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        mine = classes.select(F.col("cid").alias(side), F.struct("n", "bits").alias(f"at_{side}"))
        pairs = pairs.join(mine, side)
    return pairs


def links(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between classes that join exactly the classes which similar pairs connect."""
    bands, rows = bands_for(percent)
    flat = classes.select("cid", F.explode("keys").alias("key"))
    shared = flat.groupBy("key").agg(F.min("cid").alias("hub"), F.count("*").alias("members")).where("members > 1")
    members = stored(flat.join(shared, "key").select("key", "cid", "hub"), "members")
    # Each class beside the smallest class of each of its buckets.
    tried = stored(members.where("cid <> hub").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct(), "tried")
    near = stored(_with_bits(tried, classes).where(likely("at_a", "at_b", bands * rows, percent)).select("a", "b"), "near")
    sets = _full_sets(near.select(F.explode(F.array("a", "b")).alias("cid")), docs, classes, width)
    first = stored(_confirmed(near, sets, percent), "links")
    # Buckets that still hold several components: what is outside the main one meets all others.
    roots = components(first)
    state = members.join(roots, members["cid"] == roots["node"], "left").select("key", "cid", "hub", F.coalesce("root", "cid").alias("root"))
    state = stored(state, "state")
    main = state.groupBy("key", "root").agg(F.count("*").alias("size")).groupBy("key")
    main = main.agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
    open_ = stored(state.join(main, "key"), "open")
    edits = _edits(open_, _full_sets(open_.select("cid"), docs, classes, width))
    opened = open_.groupBy("cid").agg(F.collect_list("key").alias("opened"))
    open_ = stored(open_.join(classes.select("cid", "n", "bits"), "cid").join(opened, "cid").join(edits, ["hub", "cid"]), "open")
    l, r = open_.where("root <> main").alias("l"), open_.alias("r")
    apart = (F.col("l.key") == F.col("r.key")) & (F.col("l.root") != F.col("r.root"))
    once = (F.col("r.root") == F.col("r.main")) | (F.col("l.cid") < F.col("r.cid"))
    # Two classes of different components share opened buckets only; they meet in the smallest of these.
    here = F.col("l.key") == F.array_min(F.array_intersect("l.opened", "r.opened"))
    second = l.join(r, apart & once & likely("l", "r", bands * rows, percent) & here & _similar(percent))
    second = second.select(F.least("l.cid", "r.cid").alias("a"), F.greatest("l.cid", "r.cid").alias("b"))
    return first.unionByName(stored(second, "links"))


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    ``stays`` marks one different text per component, also where rows share a doc_id.
    """
    bands, rows = bands_for(percent)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    schema = "doc_id long, mark long, digest binary, n long, keys array<long>, bits array<long>"
    signed = stored(docs.mapInArrow(_signatures(width, bands, rows), schema), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    classes = signed.where(F.col("digest").isNotNull()).groupBy("digest").agg(first, *[F.first(c).alias(c) for c in ("n", "keys", "bits")])
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    linked = components(links(docs, classes, width, percent))
    found = classes.join(linked, classes["cid"] == linked["node"], "left").select("digest", "first", F.coalesce("root", "cid").alias("root"))
    found = stored(found, "found")
    smallest = found.groupBy("root").agg(F.min("first").alias("least"))
    named = found.join(smallest, "root").select("digest", "least")
    out = signed.select("doc_id", "mark", "digest", F.col("n").alias("n_shingles")).join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    stays = F.col("digest").isNull() | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("mark") == F.col("least.mark")))
    kept = F.col("doc_id").eqNullSafe(component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "digest", "mark", stays.alias("stays"))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that stay, with all columns: those without words, and one row of each group of near copies."""
    found = near_groups(docs, width, percent, text, doc_id).where("stays").groupBy("doc_id", "mark")
    found = found.agg(F.count("*").alias("rows"), F.max(F.col("digest").isNull()).alias("bare"))
    found = found.select(F.col("doc_id").alias("__d"), F.col("mark").alias("__m"), ((F.col("rows") > 1) & ~F.col("bare")).alias("__again"))
    mine = docs.withColumn("__mark", F.xxhash64(F.col(f"`{text}`")))
    kept = mine.join(found, mine[doc_id].eqNullSafe(found["__d"]) & (mine["__mark"] == found["__m"]))
    alone, again = kept.where("not __again").select(*docs.columns), kept.where("__again").select(*docs.columns, "__mark")
    return alone.unionByName(one_of_each(again, [doc_id, "__mark"]).select(*docs.columns))
