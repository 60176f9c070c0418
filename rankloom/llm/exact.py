"""Exact deduplication by deterministic block naming, with built-in functions only.

The normalised text of each document is cut into fixed-size blocks. Distinct blocks are sorted and numbered; adjacent
numbers are paired, distinct pairs are numbered again, and so on until one number is left for each document. Two
documents have the same (rounds, number) exactly when their normalised texts are the same, because every number stands
for one content and not for a hash of it. A block travels to the naming step once for each map task; its SHA-256 only
carries the number back, and the step stops if one digest should ever stand for two contents.

Defined cases: null text counts as empty; a row whose doc_id is null is an own document and comes last among ties; rows
with equal doc_id and text are repeats, of which one is kept; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, joined, named_in_order, one_of_each, stored

BLOCK = 2048


def _cut(docs: DataFrame, text: str, doc_id: str, block: int) -> DataFrame:
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), raw.alias("raw"), F.translate(raw, WHITE, "").alias("norm"))
    cut = F.regexp_extract_all("norm", F.lit("(?s).{1,%d}" % block), F.lit(0))
    return rows.withColumn("cut", F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(cut))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def digested(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_points, key, digests) of every row, written: SHA-256 of the normalised text and of its blocks."""
    rows = _cut(docs, text, doc_id, block)
    return stored(rows.select("doc_id", F.char_length("raw").cast("long").alias("n_points"), _digest(F.col("norm")).alias("key"), F.transform("cut", _digest).alias("digests")), "digests")


def identities(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK, rows: DataFrame | None = None) -> DataFrame:
    """One row for each different (doc_id, sha): rounds and name, which are the identity of the normalised text.

    ``rows`` is what `digested` gives for the same documents, where the caller has it.
    """
    rows = digested(docs, text, doc_id, block) if rows is None else rows
    # Numbers for the distinct blocks, in the order of their content.
    names = _cut(docs, text, doc_id, block).select(F.explode("cut").alias("block")).distinct().sortWithinPartitions("block")
    names = stored(names.select(_digest(F.col("block")).alias("digest"), F.monotonically_increasing_id().alias("name")), "names")
    if not names.groupBy("digest").count().where("count > 1").isEmpty():
        raise RuntimeError("one digest stands for two blocks")
    at = rows.select("doc_id", "key", F.size("digests").alias("n"), F.posexplode("digests").alias("pos", "digest"))
    level = at.join(names, "digest").select("doc_id", "key", "n", "pos", "name")
    done, rounds = [], 0
    while True:
        level = stored(level, "level")
        done.append(level.where("n = 1").select("doc_id", "key", F.lit(rounds).alias("rounds"), "name").distinct())
        open_ = level.where("n > 1")
        if open_.isEmpty():
            break
        rounds += 1
        # Repeats of a row have the same names at the same places and fall together here.
        pairs = open_.groupBy("doc_id", "key", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("right"),
        )
        names = named_in_order(pairs.select("left", "right").distinct(), "name", "left", "right")
        level = joined(pairs, names, ["left", "right"]).select("doc_id", "key", "n", "pos", "name")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", F.lower(F.hex("key")).alias("sha"), "rounds", "name")


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """One row per document: keep_id, group_size, kept and the digest of the normalised text.

    Of equal texts the one with the most code points before normalisation stays, then the smallest doc_id. Rows are
    counted per (doc_id, digest, length) before they meet, so a group of any size sends a few rows from each task.
    """
    rows = digested(docs, text, doc_id, block)
    ids = identities(docs, text, doc_id, block, rows)
    rows = rows.groupBy("doc_id", F.lower(F.hex("key")).alias("sha"), "n_points").agg(F.count("*").alias("copies"))
    rows = stored(joined(rows, ids, ["doc_id", "sha"]), "rows")
    best = F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("q"), F.col("doc_id").alias("keep_id"))
    # Written first, so that the join deals both sides anew and a hot identity can be split.
    groups = stored(rows.groupBy("rounds", "name").agg(F.sum("copies").alias("group_size"), F.min(best).alias("best")), "groups")
    held = (F.col("n_points") == -F.col("best.p")) & F.col("doc_id").eqNullSafe(F.col("best.keep_id"))
    each = rows.join(groups, ["rounds", "name"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(
        "doc_id",
        F.col("best.keep_id").alias("keep_id"),
        "group_size",
        (held & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "n_points",
    )


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """The documents that stay, with all their columns; one of each set of equal rows."""
    found = exact_groups(docs, text, doc_id, block)
    found = found.groupBy("doc_id", "text_sha256", "n_points").agg(F.max("kept").alias("kept"), F.count("*").alias("copies")).where("kept")
    found = found.select(F.col("doc_id").alias("__d"), F.col("text_sha256").alias("__s"), F.col("n_points").alias("__n"), F.col("copies").alias("__copies"))
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    mine = docs.withColumns({"__sha": F.sha2(F.translate(raw, WHITE, ""), 256), "__len": F.char_length(raw).cast("long")})
    kept = mine.join(found, mine[doc_id].eqNullSafe(found["__d"]) & (mine["__sha"] == found["__s"]) & (mine["__len"] == found["__n"]))
    alone = kept.where("__copies = 1").select(*docs.columns)
    repeats = one_of_each(kept.where("__copies > 1").select(*docs.columns, "__sha"), [doc_id, "__sha"]).select(*docs.columns)
    return alone.unionByName(repeats)
