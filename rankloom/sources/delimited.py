"""Delimited files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import NA_LITERALS, fill_missing, missing
from ..session import settle, shuffle_width
from .vectors import placed_lines

UNLABELLED = T.StructType(
    [
        T.StructField("context_id", T.LongType()),
        T.StructField("context_2", T.StringType()),
        T.StructField("context_1", T.StringType()),
        T.StructField("context_0", T.StringType()),
        T.StructField("reply_id", T.LongType()),
        T.StructField("reply", T.StringType()),
    ]
)
LABELLED = T.StructType(
    [*UNLABELLED.fields, T.StructField("label", T.StringType()), T.StructField("confidence", T.DoubleType())]
)


def _tsv(spark: SparkSession, path: str, schema: T.StructType, strict: bool, literals: Sequence[str], place: str | None) -> DataFrame:
    width = len(schema)
    cells = F.split("value", "\t", -1)
    lines = placed_lines(spark, path).where(F.col("value") != "")
    rows = lines.select("value", cells.alias("cells"), F.struct("file", "block", "line").alias("place"))
    fits = F.size("cells") <= width
    if strict:
        message = F.concat(F.lit(f"expected at most {width} fields: "), F.col("value"))
        rows = rows.withColumn("cells", F.when(fits, F.col("cells")).otherwise(F.raise_error(message).cast("array<string>")))
    else:
        rows = rows.where(fits)

    def column(i: int, field: T.StructField):
        raw = F.get("cells", F.lit(i))
        value = F.when(~missing(raw, literals), raw)
        if not isinstance(field.dataType, T.StringType):
            value = value.cast(field.dataType) if strict else value.try_cast(field.dataType)
        return value.alias(field.name)

    return rows.select(*[column(i, f) for i, f in enumerate(schema)], *([F.col("place").alias(place)] if place else []))


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = LABELLED, literals: Sequence[str] = NA_LITERALS, place: str | None = None) -> DataFrame:
    """Tab-separated, no header, quotes literal; a row with too many fields or a bad number is an error.

    ``place`` names a column for the place of each line in the input, to order or number rows by.
    """
    return _tsv(spark, path, schema, True, literals, place)


def read_tsv_lenient(
    spark: SparkSession, path: str, schema: T.StructType = UNLABELLED, literals: Sequence[str] = NA_LITERALS, place: str | None = None
) -> DataFrame:
    """As ``read_tsv``, but rows with too many fields are dropped; short rows are padded with null in both."""
    return _tsv(spark, path, schema, False, literals, place)


def text_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema if isinstance(f.dataType, T.StringType)]


def read_prepared(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False) -> DataFrame:
    """Space-delimited with header and a leading row index; missing texts become ``''``.

    Files split at line ends. Set ``multiline`` when quoted cells hold line breaks.
    """
    df = spark.read.csv(
        path, schema=schema, sep=" ", header=True, quote='"', escape='"', multiLine=multiline, enforceSchema=True
    )
    return fill_missing(df, text_columns(schema))


def write_prepared(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Space-delimited with header; the row index is the first column. Quotes are doubled."""
    df.write.mode(mode).csv(path, sep=" ", header=True, quote='"', escape='"', emptyValue="", nullValue="")


def write_text_lines(df: DataFrame, path: str, row_id: str, columns: Sequence[str], mode: str = "errorifexists") -> None:
    """One line per row and one folder per column, in row order, with the row ids kept beside them in Parquet.

    The texts are computed once, into the Parquet copy that the lines are sorted
    from. Part files follow each other in row order. A text that holds a line break
    would shift all later lines, so it is an error.
    """
    df.select(row_id, *columns).write.mode(mode).parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    broken = F.concat(F.lit("line break in text of row "), F.col(row_id).cast("string"))
    # Sorted once and settled; every column is then written from the same partitions, which follow each other.
    placed = settle(rows.repartitionByRange(shuffle_width(rows.sparkSession), row_id).sortWithinPartitions(row_id))
    for c in columns:
        line = F.coalesce(F.col(c), F.lit(""))
        safe = F.when(line.rlike(r"[\r\n]"), F.raise_error(broken).cast("string")).otherwise(line)
        placed.select(safe.alias("value")).write.mode(mode).text(f"{path}/{c}")


def write_submission(ranked: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``context_id reply_id`` lines without header, best candidate first within each context.

    The sort key ends in the candidate id, so even one huge context is range-partitioned.
    """
    ordered = ranked.orderBy("context_id", "rank", "reply_id").select("context_id", "reply_id")
    ordered.write.mode(mode).csv(path, sep=" ", header=False)


def write_ranked(ranked: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The ranked scores with header, in the same order."""
    write_prepared(ranked.orderBy("context_id", "rank", "reply_id"), path, mode)
