"""From raw documents to a training mix, in five stages that each apply one operator of `rankloom.llm`.

Every stage takes (spark, docs, sf_dir) and gives the documents that go on; its result is written as Parquet and read
again as the next stage's input. The last stage adds token ids.

Defined cases are those of the operators' modules; what a stage makes of them is told with the stage. Whole texts are read,
however long. An empty table stays empty through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import exact, minhash, mixing, pieces, toxicity
from rankloom.llm.common import stored, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below the limit; the model is fitted on the labelled ones.

    Null and empty texts have no features and are scored as such; equal texts get equal scores, so repeated rows go or stay
    together; a score at the limit goes. All columns stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.with_severity(docs, model, name="__severity")
    return scored.where(F.col("__severity") < toxicity.LIMIT).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, white space aside: the one with the most code points, then the smallest doc_id.

    Null, empty and white texts are one group. All columns stay."""
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more: the one with the smallest doc_id.

    Documents without words are linked with nothing and stay. All columns stay."""
    return minhash.drop_near_copies(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, at most twice; those that a source's target leaves out go,
    and so do documents without words (null, empty, white space), of which no mix can take a word."""
    taken = mixing.mix(docs, mixing.label_quality(table(spark, sf_dir, "labels")))
    return mixing.apply_mix(docs, stored(taken, "taken"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text they decode to; a copy that the mix took twice is encoded twice.

    Null and empty texts have no ids. Of other columns lang, source and n_chars stay, as this is the last stage."""
    vocabulary = pieces.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    tokens = pieces.encode(docs, vocabulary, keep=["doc_id", "lang", "source", "n_chars"], decoded="text")
    return tokens.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mix", mix_sources),
    ("pieces", encode_pieces),
]

# The learned toxicity grades and MinHash candidates have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
