"""Word vectors and text vectors made of them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import bare_tokens, drop_tokens, join_tokens, key_prefix, strip_accents
from ..session import BROADCAST_BYTES, broadcast_if_small, colocate, settle, table_bytes
from .matrices import beside, product, row_ranges

# Words of a block of vectors, on average, and places that a block has.
WORDS, PLACES = 2048, 1 << 20


def zeros(width: int) -> Column:
    return F.array_repeat(F.lit(0.0), width)


def last_wins(df: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """One row per key: the value with the highest ordinal."""
    return df.groupBy(key).agg(F.max_by(value, ordinal).alias(value))


def with_lemma(tokens: DataFrame, lemmas: DataFrame, token: str = "token") -> DataFrame:
    """Replace each token by its lemma where the dictionary ``(token, lemma)`` has one.

    Of several lemmas of a token the smallest counts, so tokens never multiply.
    """
    pairs = lemmas.where("token is not null and lemma is not null").groupBy(F.col("token").alias("__t")).agg(F.min("lemma").alias("__l"))
    pairs = broadcast_if_small(pairs, F.octet_length("__t") + F.octet_length("__l") + 64)
    return (
        tokens.join(pairs, F.col(token) == F.col("__t"), "left")
        .withColumn(token, F.coalesce("__l", token))
        .drop("__t", "__l")
    )


def clean_tokens(
    df: DataFrame, keys: Sequence[str], text: str, lemmas: DataFrame | None = None, garbage: Iterable[str] = ()
) -> DataFrame:
    """Token-mode clean: words, lower case, no accents, lemmas, drop rules, one space.

    Returns ``(keys, text)`` with one row per input row. Without a dictionary it is a
    column expression. With one, tokens are joined to it and regrouped by text; a
    group is a single text, and texts were shuffled by key beforehand.
    """
    keys = list(keys)
    if lemmas is None:
        return df.select(*keys, join_tokens(drop_tokens(bare_tokens(F.col(text)), garbage)).alias(text))
    spread = colocate(df.select(*keys, text), *keys)
    tokens = with_lemma(spread.select(*keys, F.posexplode(bare_tokens(F.col(text))).alias("pos", "token")), lemmas)
    kept = tokens.where(F.length("token") > 1)
    garbage = sorted(set(garbage))
    if garbage:
        kept = kept.where(~F.col("token").isin(*garbage))
    joined = kept.groupBy(*keys).agg(
        F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"])).alias("__c")
    )
    return spread.select(*keys).join(joined, keys, "left").select(*keys, F.coalesce("__c", F.lit("")).alias(text))


def clean_token_columns(df: DataFrame, cols: Sequence[str], lemmas: DataFrame, garbage: Iterable[str] = ()) -> DataFrame:
    """Token-mode clean with a dictionary of several text columns at once; every row stays, whatever its keys are.

    Rows are settled under a number of their own, their texts are unpivoted and cut once, and the cleaned columns
    go back by that number.
    """
    cols = list(cols)
    rows = settle(df.withColumn("__row", F.monotonically_increasing_id()))
    cleaned = clean_tokens(rows.unpivot(["__row"], cols, "__column", "__text"), ["__row", "__column"], "__text", lemmas, garbage)
    wide = cleaned.groupBy("__row").agg(*[F.max(F.when(F.col("__column") == c, F.col("__text"))).alias(f"__c{i}") for i, c in enumerate(cols)])
    back = rows.drop(*cols).join(wide.withColumnsRenamed({f"__c{i}": c for i, c in enumerate(cols)}), "__row")
    return back.select(*df.columns)


def prepare_word_vectors(vectors: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """``(word, vector)`` from ``(ordinal, word, vector)``: prefix, no accents, lemma, last one wins."""
    keyed = vectors.withColumn("word", strip_accents(key_prefix(F.col("word"))))
    if lemmas is not None:
        keyed = with_lemma(keyed, lemmas, "word")
    return last_wins(keyed, "word", "vector", "ordinal")


def align_vectors(vocab: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """A vector for every vocabulary term, zero where the table has none."""
    known = vectors.select(F.col("word").alias("term"), "vector")
    return vocab.join(known, "term", "left").withColumn("vector", F.coalesce("vector", zeros(width)))


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """Vectors scaled to length one; zero-length vectors are dropped."""
    squared = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x)
    measured = vectors.withColumn("__len", F.sqrt(squared)).where(F.col("__len") > 0)
    return measured.withColumn("vector", F.transform("vector", lambda x: x / F.col("__len"))).drop("__len")


def _placed(weights: DataFrame, vectors: DataFrame, width: int, limit: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The weights, each word's place ``(term, idx)``, the vectors as dense blocks ``(block, v)``, and their bytes.

    A table above the limit is first cut to the words that the texts hold; the weights are settled for that, so that texts are
    cut into words once. Words are dealt into blocks by a hash. A one behind each vector makes the product count the weights
    that met a vector.
    """
    known = vectors.select(F.col("word").alias("term"), F.concat("vector", F.array(F.lit(1.0))).alias("v")).where("term is not null")
    if table_bytes(known, width * 8 + 64) > limit:
        weights = settle(weights)
        known = known.join(weights.select("term").distinct(), "term", "left_semi")
    known = settle(known)
    count = known.count()
    blocks = max(1, -(-count // WORDS))
    at = F.row_number().over(W.partitionBy("block").orderBy("term")) - 1
    known = known.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("long")).withColumn("at", at.cast("long"))
    in_order = F.sort_array(F.collect_list(F.struct("at", "v")))
    dense = known.groupBy("block").agg(F.flatten(F.transform(in_order, lambda s: s["v"])).alias("v"))
    places = known.select("term", (F.col("block") * PLACES + F.col("at")).alias("idx"))
    return weights, places, dense, count * (width + 1) * 8


def _summed(
    weights: DataFrame, keys: Sequence[str], vectors: DataFrame, width: int, out: str, limit: int, columns: Sequence[str] = (), mean: bool = False
) -> DataFrame:
    """``(keys, out)``: weighted vector sums, or means, of the text columns end to end; zero where no word has a vector.

    ``weights`` is ``(keys, term, weight)``, with ``columns`` also ``column``, partitioned by ``keys`` and one row at least for
    each of them. Words become places in the vector table, and the texts of a range are multiplied with blocks of vectors at
    once: a word's vector is read once for a range and not once for a token.
    """
    weights, places, dense, size = _placed(weights, vectors, width, limit)
    known = broadcast_if_small(places, F.octet_length("term") + 64, limit)
    slots, slot = max(1, len(columns)), []
    if slots > 1:
        slot = [(F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column")) - 1).alias("slot")]
    ranges = row_ranges(weights.join(known, "term", "left").select(*keys, *slot, "idx", "weight"), keys, PLACES, slots)
    found = product(beside(ranges, dense, size, limit), keys, np.eye(width + 1), "__v", slots)
    parts = []
    for i in range(slots):
        part, mass = F.slice("__v", i * (width + 1) + 1, width), F.element_at("__v", (i + 1) * (width + 1))
        parts.append(F.when(mass != 0, F.transform(part, _over(mass))).otherwise(zeros(width)) if mean else part)
    return found.select(*keys, F.concat(*parts).alias(out))


def _over(mass: Column):
    return lambda x: x / mass


def _token_counts(located: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Tokens of a text with their counts; one row without a token for a text that has none."""
    tokens = located.select(*keys, F.explode_outer(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))).alias("term"))
    return tokens.groupBy(*keys, "term").agg(F.count("*").cast("double").alias("weight"))


def _filled(rows: DataFrame, found: DataFrame, keys: Sequence[str], width: int, out: str) -> DataFrame:
    """Rows without a vector get the zero vector. Both sides lie partitioned by ``keys``."""
    return found_for(rows.select(*keys), found, keys).select(*keys, F.coalesce(out, zeros(width)).alias(out))


def sentence_vectors(
    df: DataFrame, keys: Sequence[str], text: str, vectors: DataFrame, width: int, out: str = "vector", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Mean of the unit vectors of a text's known tokens, one row per text.

    Equal tokens of a text are counted before the lookup.
    """
    keys = list(keys)
    located = colocate(df.select(*keys, text), *keys)
    return _summed(_token_counts(located, keys, text), keys, unit_vectors(vectors), width, out, limit, mean=True)


def weighted_vectors(
    weights: DataFrame, rows: DataFrame, keys: Sequence[str], vectors: DataFrame, width: int, out: str = "vector", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Sum of term vectors times term weights, one row per text of ``rows``.

    ``weights`` is ``(keys, term, weight)``; terms without a vector add nothing.
    """
    keys = list(keys)
    found = _summed(weights.select(*keys, "term", "weight"), keys, vectors, width, out, limit)
    return _filled(colocate(rows.select(*keys), *keys), found, keys, width, out)


def spread_columns(
    found: DataFrame, rows: DataFrame, keys: Sequence[str], columns: Sequence[str], width: int, vector: str = "vector", out: str = "features"
) -> DataFrame:
    """Put the vectors of a row's text columns end to end, zero where a column has none.

    ``found`` is ``(keys, column, vector)``, one row per column that has a vector.
    """
    keys = list(keys)
    picked = [
        F.coalesce(F.first(F.when(F.col("column") == c, F.col(vector)), ignorenulls=True), zeros(width)) for c in columns
    ]
    bound = found.groupBy(*keys).agg(F.concat(*picked).alias(out))
    return _filled(rows, bound, keys, width * len(columns), out)


def column_sentence_vectors(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], vectors: DataFrame, width: int, out: str = "features", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Sentence vectors of several text columns, end to end: ``(keys, features)``.

    Rows are shuffled once, by their key; all columns of a row stay together.
    """
    keys, columns = list(keys), list(columns)
    stacked = colocate(df.unpivot(keys, columns, "column", "text"), *keys)
    counts = _token_counts(stacked, [*keys, "column"], "text")
    return _summed(counts, keys, unit_vectors(vectors), width, out, limit, columns, mean=True)


def column_weighted_vectors(
    weights: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    vectors: DataFrame,
    width: int,
    out: str = "features",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Weighted vector sums of several text columns, end to end: ``weights`` is ``(keys, column, term, weight)``."""
    keys, columns = list(keys), list(columns)
    found = _summed(weights.select(*keys, "column", "term", "weight"), keys, vectors, width, out, limit, columns)
    return _filled(colocate(rows.select(*keys), *keys), found, keys, width * len(columns), out)


def keyed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal ``keys``, null beside null; the keys come from ``left``."""
    right = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys])
    return left.join(right, on, how).drop(*[f"__right_{k}" for k in keys])


def found_for(rows: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of ``rows``, which hold their keys alone, with ``found``; null keys meet like any other.

    A null-safe join cannot use that both sides lie by their keys already, so it is taken only where a key is null.
    """
    keys = list(keys)
    if rows.where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])).isEmpty():
        return rows.join(found, keys, "left")
    return keyed_join(rows, found, keys, "left")


def bind_columns(blocks: Sequence[tuple[str, DataFrame]], keys: Sequence[str], out: str = "features") -> DataFrame:
    """Put row-aligned vector blocks end to end, by key; null keys meet like any other.

    A row that some block lacks gets zeros there. All blocks are grouped by the key once. Keys are unique in a block.
    """
    keys = list(keys)
    stacked = None
    for i, (col, block) in enumerate(blocks):
        part = block.select(*keys, F.lit(i).alias("__i"), F.col(col).alias("__v"))
        stacked = part if stacked is None else stacked.unionByName(part)
    # One width for each block.
    widths = {r["__i"]: r["w"] for r in stacked.groupBy("__i").agg(F.max(F.size("__v")).alias("w")).collect()}
    picked = [
        F.coalesce(F.first(F.when(F.col("__i") == i, F.col("__v")), ignorenulls=True), zeros(widths.get(i, 0))) for i in range(len(blocks))
    ]
    return stacked.groupBy(*keys).agg(F.concat(*picked).alias(out))
