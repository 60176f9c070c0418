"""Source and sink queries: tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.labels import NA_LITERALS
from ..operators import folds as D
from ..operators import learners as M
from ..operators import ranking as R
from ..session import scratch_path
from ..sources import delimited as S
from ..sources import stores, vectors
from .models import _FOLDS, _OOF, folded_features
from .registry import query
from .tables import PAIRS, fold_sql, order_candidates, pairs, table, texts
from .text import clean_sql

_NA = ", ".join(f"'{x}'" for x in NA_LITERALS)
_FLAT = r"regexp_replace({c}, '[\t\r\n]', ' ', 'g')"


def flat(c: str):
    return F.regexp_replace(c, r"[\t\r\n]", " ")


def known(c: str) -> str:
    return f"CASE WHEN {c} IN ({_NA}) THEN NULL ELSE {c} END"


@query(
    "tsv_strict",
    f"""WITH {PAIRS}, flat AS (SELECT *, {_FLAT.format(c='reply')} AS r FROM pairs)
      SELECT context_id, reply_id, {known('r')} AS reply, label, round(confidence, 6) AS confidence FROM flat""",
)
def tsv_strict(spark, sf):
    """Labelled pairs as tab-separated lines."""
    path = scratch_path(spark, "tsv")
    rows = pairs(spark, sf).select("context_id", *[F.lit("").alias(c) for c in ("a", "b", "c")], "reply_id", flat("reply"), "label", "confidence")
    rows.select(F.concat_ws("\t", *rows.columns).alias("value")).write.text(path)
    back = S.read_tsv(spark, path)
    return back.select("context_id", "reply_id", "reply", "label", F.round("confidence", 6).alias("confidence"))


_CELLS = ", ".join(known("cells[{i}]".format(i=i)) + f" AS c{i}" for i in range(1, 6))


@query(
    "tsv_lenient",
    rf"""WITH split AS (SELECT doc_id, string_split(regexp_replace(text, '[\t\r]', ' ', 'g'), chr(10)) AS cells FROM documents)
      SELECT doc_id, {_CELLS} FROM split WHERE len(cells) <= 5""",
)
def tsv_lenient(spark, sf):
    """The lines of a document as fields: documents of more than five lines do not fit and are dropped."""
    path = scratch_path(spark, "lenient")
    text = F.translate(F.regexp_replace("text", r"[\t\r]", " "), "\n", "\t")
    table(spark, sf, "documents").select(F.concat_ws("\t", "doc_id", text).alias("value")).write.text(path)
    names = [f"c{i}" for i in range(1, 6)]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(n, T.StringType()) for n in names]])
    return S.read_tsv_lenient(spark, path, schema)


@query(
    "prepared_roundtrip",
    f"""SELECT doc_id, CASE WHEN t IN ({_NA}) THEN '' ELSE t END AS text, lang, n_chars
      FROM (SELECT *, {_FLAT.format(c='text')} AS t FROM documents)""",
)
def prepared_roundtrip(spark, sf):
    """Texts with quotes and blanks through the space-delimited form."""
    path = scratch_path(spark, "prepared")
    rows = table(spark, sf, "documents").select("doc_id", flat("text").alias("text"), "lang", "n_chars")
    S.write_prepared(rows, path)
    return S.read_prepared(spark, path, rows.schema)


@query("text_lines", f"SELECT {clean_sql('text')} AS text FROM documents")
def text_lines(spark, sf):
    path = scratch_path(spark, "lines")
    rows = X.clean_columns(texts(spark, sf, "documents", "doc_id"), ["text"])
    S.write_text_lines(rows, path, "doc_id", ["text"])
    return spark.read.text(f"{path}/text").withColumnRenamed("value", "text")


def _vector_lines(spark, sf, path, **options):
    cells = F.transform("embedding", lambda x: x.cast("double").cast("string"))
    line = F.concat_ws(" ", F.concat(F.col("vec_id"), F.lit("_"), F.col("label")), cells)
    table(spark, sf, "embeddings").select(line.alias("value")).write.options(**options).text(path)


@query(
    "vector_lines",
    """SELECT pos, count(*) AS n, round(sum(value), 4) AS total FROM (
      SELECT CAST(unnest(range(len(embedding))) AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)
      GROUP BY pos""",
)
def vector_lines(spark, sf):
    path = scratch_path(spark, "vectors")
    _vector_lines(spark, sf, path)
    values = vectors.read_text_vectors(spark, path, 64).select(F.posexplode("vector").alias("pos", "value"))
    return values.groupBy("pos").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "word_vector_file",
    """SELECT vec_id || '_' || label AS word, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos,
      round(CAST(unnest(embedding) AS DOUBLE), 6) AS value FROM embeddings""",
)
def word_vector_file(spark, sf):
    """Gzipped word vectors with their ``count dim`` header."""
    path = scratch_path(spark, "words")
    table(spark, sf, "embeddings").agg(F.concat_ws(" ", F.count("*"), F.max(F.size("embedding"))).alias("value")).write.option(
        "compression", "gzip"
    ).text(f"{path}/head")
    _vector_lines(spark, sf, f"{path}/rows", compression="gzip")
    rows = vectors.read_word_vectors(spark, [f"{path}/head", f"{path}/rows"], 64)
    values = rows.select("word", F.posexplode("vector").alias("pos", "value"))
    return values.select("word", "pos", F.round("value", 6).alias("value"))


@query("submission_file", "SELECT o_custkey || ' ' || o_orderkey AS line FROM orders")
def submission_file(spark, sf):
    path = scratch_path(spark, "submission")
    S.write_submission(R.submission(order_candidates(spark, sf), "context_id", "reply_id", "score"), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(
    "ranked_file",
    "SELECT o_custkey AS context_id, o_orderkey AS reply_id, -o_totalprice AS rank FROM orders",
)
def ranked_file(spark, sf):
    path = scratch_path(spark, "ranked")
    rows = R.submission(order_candidates(spark, sf), "context_id", "reply_id", "score")
    S.write_ranked(rows, path)
    return S.read_prepared(spark, path, rows.schema)


@query(
    "feature_store",
    f"""WITH {fold_sql('embeddings', 'vec_id', 4)} SELECT vec_id, CAST(2 AS INTEGER) AS fold, 'train' AS role,
      CAST(unnest(range(len(embedding))) AS INTEGER) AS pos, round(CAST(unnest(embedding) AS DOUBLE), 6) AS value
      FROM folded WHERE fold <> 2""",
)
def feature_store(spark, sf):
    """One fold's train rows read from a store of all folds and roles."""
    path = scratch_path(spark, "features")
    rows = D.assign_folds(table(spark, sf, "embeddings").select("vec_id", "embedding"), ["vec_id"], 4)
    stores.write_features(D.fold_roles(rows, 4), path)
    back = stores.read_features(spark, path, 2, "train")
    rows = back.select("vec_id", "fold", "role", F.posexplode("embedding").alias("pos", "value"))
    return rows.withColumn("value", F.round(F.col("value").cast("double"), 6))


@query("fold_store", f"WITH {fold_sql('documents', 'doc_id', 10)} SELECT doc_id, fold FROM folded")
def fold_store(spark, sf):
    """Folds made on the first call and loaded on the second."""
    path = scratch_path(spark, "folds")

    def create():
        return D.assign_folds(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 10)

    stores.load_or_create_folds(spark, path, create, 10)
    return stores.load_or_create_folds(spark, path, create, 10)


@query("model_store", _OOF)
def model_store(spark, sf):
    """Out-of-fold scores of models that were saved and loaded."""
    path = scratch_path(spark, "models")
    rows = folded_features(spark, sf)
    stores.save_models(spark, M.fit_folds(rows, M.linear(), _FOLDS, parallelism=_FOLDS), path)
    scored = M.score_folds(rows, stores.load_models(spark, path, _FOLDS))
    return scored.select("context_id", "reply_id", "fold", F.round("pred", 6).alias("pred"))
