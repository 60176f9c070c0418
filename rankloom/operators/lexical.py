"""N-gram counts, vocabularies and TF-IDF weights.

Texts are shuffled once, by row key, before they are cut into n-grams. All that
follows within a text (counting, weighting, the norm) then needs no further
exchange; only sums per term travel. Weights are long ``(keys, term, weight)``
rows; ``vector_features`` gives the same numbers as Spark ML vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark import SparkContext
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import WORD, word_text, word_tokens
from ..session import broadcast_if_small, colocate, settle
from ..settings import MAX_DF, MAX_FEATURES, MIN_DF
from .numbering import HOT_ROWS, number_within

# Characters of a text handled at a time; n-grams that cross a cut are kept whole.
_PIECE = 4096


@dataclass(frozen=True)
class Analyzer:
    """How a text becomes terms: ``word`` or ``char`` n-grams of ``lo`` … ``hi``."""

    kind: str
    lo: int
    hi: int

    def __post_init__(self):
        if self.kind not in ("word", "char") or not 1 <= self.lo <= self.hi:
            raise ValueError(f"bad analyzer {self}")


WORDS = Analyzer("word", 1, 3)
CHARS = Analyzer("char", 2, 5)
CHARS_SHORT = Analyzer("char", 2, 4)


def stack_columns(df: DataFrame, ids: Sequence[str], text_cols: Sequence[str]) -> DataFrame:
    """The text columns as one corpus: ``(ids, column, text)``, one row per cell."""
    return df.unpivot(list(ids), list(text_cols), "column", "text")


def _joined_words(n: int) -> Callable[[Column], Column]:
    return lambda i: F.concat_ws(" ", F.slice("__g1", i, F.lit(n)))


def _word_grams(df: DataFrame, analyzer: Analyzer, text: str) -> tuple[DataFrame, list[str]]:
    """Add one array column per n-gram length, over tokens of two or more characters."""
    df = df.withColumn("__g1", F.filter(word_tokens(F.col(text)), lambda t: F.length(t) > 1))
    for n in range(max(2, analyzer.lo), analyzer.hi + 1):
        starts = F.sequence(F.lit(1), F.size("__g1") - n + 1)
        grams = F.transform(starts, _joined_words(n))
        df = df.withColumn(f"__g{n}", F.when(F.size("__g1") >= n, grams).otherwise(F.array().cast("array<string>")))
    return df, [f"__g{n}" for n in range(analyzer.lo, analyzer.hi + 1)]


def word_terms(df: DataFrame, analyzer: Analyzer, text: str = "text", out: str = "terms") -> DataFrame:
    """Add the array of a text's word n-grams."""
    df, grams = _word_grams(df, analyzer, text)
    return df.withColumn(out, F.concat(*grams)).drop("__g1", *grams)


def _word_rows(df: DataFrame, keep: Sequence[str], analyzer: Analyzer, text: str) -> DataFrame:
    """One row per word n-gram. Long texts are cut between words first; a piece carries the next few words beside
    its own, and each n-gram belongs to the piece of its first word, so no array of words or n-grams grows with the text."""
    letter = WORD.removesuffix("+")
    spaced = word_text(F.regexp_replace(text, f"(?<!{letter}){letter}(?!{letter})", " "))
    # Own words, a mark, the words ahead, a mark; neither mark is a word character.
    marked = F.regexp_replace(spaced, r"(\S.{0,%d}\S*+)(?=((?: \S++){0,%d}))" % (_PIECE - 1, analyzer.hi - 1), "$1\x01$2\x02")
    pieces = df.select(*keep, F.explode(F.filter(F.split(marked, "\x02"), lambda p: p != "")).alias("__p"))
    words = F.split(F.ltrim(F.replace("__p", F.lit("\x01"), F.lit(""))), " ")
    own = F.size(F.split(F.ltrim(F.substring_index("__p", "\x01", 1)), " "))
    pieces = pieces.select(*keep, words.alias("__g1"), own.alias("__own"))
    grams = []
    for n in range(analyzer.lo, analyzer.hi + 1):
        last = F.least("__own", F.size("__g1") - n + 1)
        cut = F.slice("__g1", F.lit(1), F.col("__own")) if n == 1 else F.transform(F.sequence(F.lit(1), last), _joined_words(n))
        grams.append(F.when(last >= 1, cut).otherwise(F.array().cast("array<string>")))
    return pieces.select(*keep, F.explode(F.concat(*grams)).alias("term"))


def _windows(text: Column, n: int) -> Column:
    """All runs of ``n`` code points, by a look-ahead at every position."""
    return F.regexp_extract_all(text, F.lit(r"(?s)(?=(\P{Cs}.{%d}))" % (n - 1)), F.lit(1))


def one_spaced(text: Column) -> Column:
    """Runs of two or more white-space characters become one space."""
    return F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]{2,}", " ")


def char_terms(analyzer: Analyzer, text: Column) -> Column:
    """Array of the character n-grams of a text; spaces count."""
    text = one_spaced(text)
    return F.flatten(F.array(*[_windows(text, n) for n in range(analyzer.lo, analyzer.hi + 1)]))


def _char_rows(df: DataFrame, keep: Sequence[str], analyzer: Analyzer, text: str) -> DataFrame:
    """One row per character n-gram. Long texts are cut into overlapping pieces first,
    so that no array grows with the text and substrings stay short."""
    ahead = analyzer.hi - 1
    cut = r"(?s)(?=(.{1,%d})).{1,%d}" % (_PIECE + ahead, _PIECE)
    pieces = df.select(*keep, F.explode(F.regexp_extract_all(one_spaced(F.col(text)), F.lit(cut), F.lit(1))).alias("__p"))
    grams = [_windows(F.substring("__p", 1, _PIECE + n - 1), n) for n in range(analyzer.lo, analyzer.hi + 1)]
    return pieces.select(*keep, F.explode(F.flatten(F.array(*grams))).alias("term"))


def term_rows(df: DataFrame, keep: Sequence[str], analyzer: Analyzer, text: str = "text") -> DataFrame:
    """One row ``(keep, term)`` per occurrence."""
    keep = list(keep)
    if analyzer.kind == "char":
        return _char_rows(df, keep, analyzer, text)
    return _word_rows(df, keep, analyzer, text)


def term_counts(
    df: DataFrame, keys: Sequence[str], analyzer: Analyzer, text: str = "text", also: Sequence[str] = (), row: Sequence[str] | None = None
) -> DataFrame:
    """``(keys, also, term, tf)``. ``row`` names the keys to shuffle texts by (default: all keys);
    ``also`` are columns that depend on the keys, such as the fold."""
    keep = [*keys, *also]
    spread = colocate(df.select(*keep, text), *(row or keys))
    return term_rows(spread, keep, analyzer, text).groupBy(*keep, "term").agg(F.count("*").alias("tf"))


def term_totals(counts: DataFrame) -> DataFrame:
    """Document frequency and corpus total of each term."""
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


def document_count(docs: DataFrame) -> Column:
    """Number of documents as a scalar subquery."""
    return docs.select(F.count(F.lit(1))).scalar()


def within_limits(totals: DataFrame, n_docs: Column, min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """Keep terms in at least ``min_df`` documents and at most the share ``max_df`` of them."""
    return totals.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n_docs))


def idf(df: Column, n_docs: Column) -> Column:
    return F.log((n_docs + 1).cast("double") / (df + 1)) + 1.0


def _within_reach(totals: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """The terms that can be among the ``n`` most frequent: those with at least the total of the n-th.

    Terms are counted per total first, so a window only sees the different totals.
    """
    sizes = totals.groupBy(*by, "total").agg(F.count("*").alias("__n"))
    above = F.sum("__n").over(W.partitionBy(*by).orderBy(F.desc("total")).rowsBetween(W.unboundedPreceding, -1))
    least = sizes.withColumn("__above", F.coalesce(above, F.lit(0))).where(F.col("__above") < n)
    # One row for each group.
    least = least.groupBy(*by).agg(F.min("total").alias("__least"))
    joined = totals.join(F.broadcast(least), list(by)) if by else totals.crossJoin(F.broadcast(least))
    return joined.where(F.col("total") >= F.col("__least")).drop("__least")


def top_terms(
    totals: DataFrame, max_features: int | None = MAX_FEATURES, by: Sequence[str] = (), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The most frequent terms with a 0-based ``idx``; ties by term. One choice per group of ``by``.

    The totals are settled first, since the size check and the numbering both read
    them, and so is the choice: both are far smaller than the texts they come from.
    """
    order, totals = [F.col("total").desc(), F.col("term").asc()], settle(totals)
    if max_features is not None:
        totals = _within_reach(totals, by, max_features)
    ranked = number_within(totals, by, {"__rank": order}, hot_rows)
    if max_features is not None:
        ranked = ranked.where(F.col("__rank") <= max_features)
    return settle(ranked.withColumn("idx", F.col("__rank") - 1).drop("__rank"))


def _looked_up(counts: DataFrame, vocab: DataFrame, on: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Join counts with the vocabulary, by broadcast if its measured size allows.

    A capped vocabulary always fits, and then the counts keep their partitioning
    by text. Otherwise both are shuffled by term and adaptive execution splits the
    frequent terms.
    """
    known = vocab.select(*on, *cols)
    return counts.join(broadcast_if_small(known, F.octet_length("term") + 64), list(on))


def vocabulary(
    counts: DataFrame,
    docs: DataFrame,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    max_features: int | None = MAX_FEATURES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``(term, df, total, idx, idf)`` fitted on the counted documents ``docs``."""
    n = document_count(docs)
    kept = within_limits(term_totals(counts), n, min_df, max_df)
    return top_terms(kept.withColumn("idf", idf(F.col("df"), n)), max_features, hot_rows=hot_rows)


def fold_vocabularies(
    counts: DataFrame,
    docs: DataFrame,
    k: int,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    max_features: int | None = MAX_FEATURES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``(fold, term, df, total, idx, idf)`` for all folds from one pass over the counts.

    What a fold's train rows hold is the whole corpus less the fold's own rows,
    so each term needs its grand totals and its totals per fold, not ``k`` fits.
    """
    own = [
        F.struct(
            F.lit(f).cast("int").alias("fold"),
            F.count(F.when(F.col("fold") == f, 1)).alias("df"),
            F.coalesce(F.sum(F.when(F.col("fold") == f, F.col("tf"))), F.lit(0)).alias("total"),
        )
        for f in range(k)
    ]
    sums = counts.groupBy("term").agg(F.count("*").alias("__df"), F.sum("tf").alias("__total"), F.array(*own).alias("__own"))
    # A term's train rows are some of its rows: what is too rare in all is too rare in each fold.
    sums = sums.where(F.col("__df") >= min_df)
    rest = sums.select("term", "__df", "__total", F.inline("__own")).select(
        "fold",
        "term",
        (F.col("__df") - F.col("df")).alias("df"),
        (F.col("__total") - F.col("total")).alias("total"),
    )
    # One row per fold, at most k of them.
    sizes = docs.groupBy("fold").agg(F.count("*").alias("__in"))
    sizes = sizes.select("fold", (F.sum("__in").over(W.partitionBy()) - F.col("__in")).alias("__n"))
    fitted = rest.join(F.broadcast(sizes), "fold")
    kept = within_limits(fitted, F.col("__n"), min_df, max_df).withColumn("idf", idf(F.col("df"), F.col("__n")))
    return top_terms(kept.drop("__n"), max_features, ["fold"], hot_rows)


def tfidf(counts: DataFrame, vocab: DataFrame, keys: Sequence[str], on: Sequence[str] = ("term",)) -> DataFrame:
    """``(keys, term, idx, weight)``: tf · idf with unit length per text."""
    keys = list(keys)
    weighted = _looked_up(counts, vocab, on, ["idx", "idf"]).withColumn("__w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("__w") * F.col("__w")).over(W.partitionBy(*keys)))
    return weighted.withColumn("weight", F.col("__w") / norm).select(*keys, "term", "idx", "weight")


def count_weights(counts: DataFrame, vocab: DataFrame, keys: Sequence[str], on: Sequence[str] = ("term",)) -> DataFrame:
    """``(keys, term, idx, weight)`` with the raw count as weight."""
    return _looked_up(counts, vocab, on, ["idx"]).select(*keys, "term", "idx", F.col("tf").cast("double").alias("weight"))


def feature_union(blocks: dict[str, DataFrame]) -> DataFrame:
    """Long weights of several blocks side by side: a ``block`` column tells them apart."""
    out = None
    for name, rows in blocks.items():
        part = rows.withColumn("block", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def java_strings(values: Sequence[str]):
    """An array of strings on the JVM, sent in one call instead of one for each of them."""
    jvm, joined = SparkContext._active_spark_context._jvm, "".join(values)
    mark = next(c for c in map(chr, range(1, 0xD800)) if c not in joined)
    pattern = jvm.java.util.regex.Pattern
    return pattern.compile(mark, pattern.LITERAL).split(mark.join(values), -1)


class Vectorizer:
    """A fitted vocabulary as a Spark ML transformer chain: text column to sparse TF-IDF vector.

    ``fit`` brings the vocabulary to the driver, at most ``max_features`` short
    terms. ``transform`` is a narrow stage: each executor looks terms up in the
    broadcast vocabulary, so no n-gram is ever shuffled.
    """

    def __init__(self, analyzer: Analyzer, terms: list[str], idf_values: list[float] | None):
        self.analyzer, self.terms, self.idf_values = analyzer, terms, idf_values

    @classmethod
    def fit(
        cls,
        corpus: DataFrame,
        keys: Sequence[str],
        analyzer: Analyzer,
        use_idf: bool = True,
        min_df: int = MIN_DF,
        max_df: float = MAX_DF,
        max_features: int = MAX_FEATURES,
    ) -> Vectorizer:
        counts = term_counts(corpus, keys, analyzer)
        vocab = vocabulary(counts, corpus, min_df, max_df, max_features)
        return cls.from_vocabulary(analyzer, vocab, use_idf)

    @classmethod
    def from_vocabulary(cls, analyzer: Analyzer, vocab: DataFrame, use_idf: bool = True) -> Vectorizer:
        rows = vocab.select("idx", "term", "idf").orderBy("idx").collect()
        return cls(analyzer, [r.term for r in rows], [r.idf for r in rows] if use_idf else None)

    @property
    def width(self) -> int:
        return len(self.terms)

    @cached_property
    def counter(self) -> CountVectorizerModel:
        """The vocabulary on the JVM, once for all columns and tables."""
        if not self.terms:
            return CountVectorizerModel.from_vocabulary(self.terms, inputCol="__terms")
        uid = CountVectorizerModel.from_vocabulary(["any"], inputCol="__terms").uid
        java = SparkContext._active_spark_context._jvm.org.apache.spark.ml.feature.CountVectorizerModel(uid, java_strings(self.terms))
        return CountVectorizerModel(java).setInputCol("__terms")

    def transform(self, df: DataFrame, text: str, out: str) -> DataFrame:
        if self.analyzer.kind == "char":
            df = df.withColumn("__terms", char_terms(self.analyzer, F.col(text)))
        else:
            df = word_terms(df, self.analyzer, text, "__terms")
        counted = "__counts" if self.idf_values is not None else out
        # The same model each time: a copy would send the vocabulary to the executors again.
        df = self.counter.setOutputCol(counted).transform(df).drop("__terms")
        # Nothing asks for a note on each term, and a plan that carries them fills the driver.
        df = df.withColumn(counted, F.col(counted).alias(counted, metadata={}))
        if self.idf_values is None:
            return df
        df = ElementwiseProduct(
            scalingVec=Vectors.dense(self.idf_values), inputCol=counted, outputCol="__weighted"
        ).transform(df)
        return Normalizer(p=2.0, inputCol="__weighted", outputCol=out).transform(df).drop(counted, "__weighted")
