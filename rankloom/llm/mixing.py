"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with built-in functions only.

Each source gets a share of the token budget by weight, never more than ``max_epochs`` times its size; what a full source
cannot take is shared again by weight. A source takes its complete epochs first. For the rest every document draws an
exponential key -ln(u) / quality, with u from a hash of the row; the documents with the smallest keys are taken until the
prefix sum of their sizes reaches the budget, and the document at the border gives the words that are still missing.

Prefix sums of a source of any size: keys are mapped to ``BUCKETS`` buckets by a monotone function, summed per bucket in
the map tasks, and only rows of one bucket of one source meet in a window.

Defined cases: null text has size 0 and takes 0 words; a null or not positive quality counts as 1; a null source is a
source of its own and comes last; rows that share doc_id and source draw by their texts; equal rows have equal keys and
are told apart by their number alone, so the set of rows is the same at each run; a very long text is read once, for its size
and digest; a table without words, or an empty one, takes nothing; other columns pass through `mix`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import joined, running_before, stored

BUCKETS = 16384
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words of a text: a null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2) -> DataFrame:
    """(source, source_size) to target, by filling up: sources at their limit leave the excess to the others.

    With sources ordered by limit / weight, the full ones come first: a source is full when its limit lies below what
    its weight would give it of what the earlier ones leave over. One row per source reaches one window.
    """
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(max_epochs))
    ratio = W.orderBy(F.col("limit") / F.col("weight"), "place")
    first, later = ratio.rowsBetween(W.unboundedPreceding, -1), ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.col("budget") - F.col("limits")) / F.col("weights")
    table = sizes.withColumns({"place": place, "weight": weight, "limit": limit})
    table = table.withColumn("budget", F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)))
    table = table.withColumns({"limits": F.coalesce(F.sum("limit").over(first), F.lit(0.0)), "weights": F.sum("weight").over(later)})
    table = table.withColumn("full", F.col("limit") <= level * F.col("weight"))
    # The level at the first source that is not full holds for all that follow.
    rest = F.first(F.when(~F.col("full"), level), ignorenulls=True).over(W.orderBy(F.col("limit") / F.col("weight"), "place").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.least("limit", rest * F.col("weight")))
    return table.select("source", "source_size", target.alias("target"))


def _sized(docs: DataFrame, text: str, source: str, doc_id: str) -> DataFrame:
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), digest.alias("digest"))


def mix(
    docs: DataFrame,
    quality: DataFrame | None = None,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2,
    seed: int = 42,
) -> DataFrame:
    """Per document size, source_size, target and taken (words, repeats counted). No text is shuffled.

    ``quality`` is a table (doc_id, weight); of several weights of one doc_id the largest counts.
    """
    base = _sized(docs, text, source, doc_id)
    if quality is None:
        base = base.withColumn("weight", F.lit(1.0))
    else:
        weight = quality.groupBy(F.col("doc_id").alias("of")).agg(F.max("weight").alias("weight"))
        base = base.join(weight, F.col("doc_id") == F.col("of"), "left").drop("of")
        base = base.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(1.0))
    shown = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("source", F.lit("")), "digest")
    draw = F.conv(F.substring(F.md5(shown), 1, 13), 16, 10).cast("double")
    base = base.withColumn("key", -F.log((draw + 0.5) / float(1 << 52)) / F.col("weight"))
    base = stored(base.select("doc_id", "source", "size", "key"), "sizes")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = source_targets(sizes, weights, share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumns({"epochs": epochs, "part": F.round(F.col("target") - epochs * F.col("source_size")).cast("long")})
    goal = stored(goal, "targets")
    base = base.withColumn("bucket", F.floor(F.col("key") / (F.col("key") + 1) * BUCKETS).cast("int"))
    before = running_before(base, ["source"], "bucket", {"before": F.col("size")})
    order = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = base.withColumn("inner", F.coalesce(F.sum("size").over(order), F.lit(0)))
    placed = joined(placed, before, ["source", "bucket"])
    placed = placed.select("doc_id", "source", "size", (F.col("inner") + F.col("before")).alias("start"))
    left = F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - F.col("start")))
    out = joined(placed, goal, ["source"])
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + left).alias("taken"))


def apply_mix(docs: DataFrame, taken: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The documents that `mix` takes, each as many times as its taken words begin a copy of it.

    Repeats of a row (same doc_id, source and size) cannot be told apart; their copies are summed and dealt evenly.
    """
    copies = taken.where("taken > 0").select("doc_id", "source", "size", F.ceil(F.col("taken") / F.col("size")).alias("n"))
    copies = copies.groupBy("doc_id", "source", "size").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    copies = copies.select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__z"), F.ceil(F.col("n") / F.col("rows")).cast("int").alias("__n"))
    # All columns of a document travel as one, so none of them can clash with the names here.
    mine = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{source}`").alias("__source"), words(F.col(f"`{text}`")).alias("__size"), F.struct("*").alias("__row"))
    on = F.col("__id").eqNullSafe(F.col("__d")) & F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__z"))
    return mine.join(copies, on).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select("__row.*")


def label_quality(labels: DataFrame) -> DataFrame:
    """Weights for `mix` from the labels table: good documents come early, poor ones late, unlabelled ones between."""
    return labels.select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0).alias("weight"))
