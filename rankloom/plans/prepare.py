"""Preparation of raw pair tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as X
from ..operators.embed import clean_token_columns
from ..operators.numbering import number_within
from ..session import settle
from ..settings import TEXT_COLUMNS
from ..sources import delimited as S

def prepare(
    df: DataFrame,
    text_cols: Iterable[str] = TEXT_COLUMNS,
    base: int = 1,
    mode: str = "default",
    lemmas: DataFrame | None = None,
    garbage: Iterable[str] = (),
) -> DataFrame:
    """Missing texts filled, grade and target added to labelled rows, text columns cleaned.

    The default mode is one narrow stage. Mode ``tokens`` cleans token by token
    and joins a lemma dictionary if one is given.
    """
    text_cols = list(text_cols)
    label = [c for c in ("label",) if c in df.columns]
    df = L.fill_missing(df, [*text_cols, *label])
    if label:
        df = df.withColumns(
            {"rank": L.grade(F.col("label"), base), "target": L.target(F.col("label"), F.col("confidence"), base)}
        )
    if mode == "default":
        return X.clean_columns(df, text_cols)
    if mode != "tokens":
        raise ValueError("mode must be 'default' or 'tokens'")
    if lemmas is None:

        def tidy(c):
            return X.join_tokens(X.drop_tokens(X.bare_tokens(c), garbage))

        return X.clean_columns(df, text_cols, tidy)
    return clean_token_columns(df, text_cols, lemmas, garbage)


def numbered(df: DataFrame) -> DataFrame:
    """``row_id`` 0 … n-1 in the order of the input, in place of ``place``."""
    # Settled, so that the numbers of lines inside a split stay as they were when they are read again.
    rows = number_within(settle(df), [], {"row_id": [F.col("place")]})
    return rows.withColumn("row_id", F.col("row_id") - 1).drop("place")


def prepare_files(spark: SparkSession, train: str, test: str, out: str, text_cols: Sequence[str] = TEXT_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """Read both raw files, prepare them, and write Parquet plus the text-line and delimited forms.

    Parquet is what later steps read; it is written once and the other forms come from it.
    """
    tables = {
        "train": prepare(numbered(S.read_tsv(spark, train, S.LABELLED, place="place")), text_cols),
        "test": prepare(numbered(S.read_tsv_lenient(spark, test, S.UNLABELLED, place="place")), text_cols),
    }
    done = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        done[name] = spark.read.parquet(f"{out}/{name}")
        S.write_text_lines(done[name], f"{out}/{name}_text", "row_id", text_cols, mode="overwrite")
        ordered = done[name].select("row_id", *[c for c in done[name].columns if c != "row_id"])
        S.write_prepared(ordered, f"{out}/{name}_modified", mode="overwrite")
    return done["train"], done["test"]
