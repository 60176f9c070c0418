"""Word-vector and text-vector queries."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import embed as E
from ..operators import lexical as G
from ..operators.reduce import UnitVariance
from ..session import settle
from ..settings import TEXT_COLUMNS
from .lexical import CELLS, KEYS, TURNS, WORD_WEIGHTS, turns, word_weights
from .registry import query
from .tables import dialogues, table

WIDTH = 64


def word_vectors(spark, sf):
    """The i-th most frequent word of the conversations gets vector i."""
    words = turns(spark, sf).select(F.explode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("term"))
    ranked = G.top_terms(words.groupBy("term").agg(F.count("*").alias("total")), max_features=None)
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("idx"), F.transform("embedding", lambda x: x.cast("double")).alias("vector")
    )
    return settle(ranked.join(vectors, "idx").select(F.col("term").alias("word"), "vector", "idx"))


_WORD_VECTORS = """words AS (
  SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) - 1 AS idx
  FROM (SELECT unnest(string_split(text, ' ')) AS word FROM turns) WHERE word <> '' GROUP BY word),
word_vectors AS (
  SELECT word, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vector, idx FROM words JOIN embeddings ON idx = vec_id)"""
_UNIT = """units AS (
  SELECT word, list_transform(vector, lambda x: x / len) AS vector
  FROM (SELECT word, vector, sqrt(list_sum(list_transform(vector, lambda x: x * x))) AS len FROM word_vectors) WHERE len > 0),
long_units AS (SELECT word, unnest(range(64)) AS pos, unnest(vector) AS value FROM units)"""


def _mean_sql(source: str, keys: str) -> str:
    return f"""token_counts AS (
  SELECT {keys}, word, count(*) AS tf FROM (SELECT {keys}, unnest(string_split(text, ' ')) AS word FROM {source}) GROUP BY ALL),
means AS (SELECT {keys}, pos, sum(tf * value) / sum(tf) AS value FROM token_counts JOIN long_units USING (word) GROUP BY ALL),
grid AS (SELECT {keys}, range AS pos FROM {source} CROSS JOIN range(64)),
vectors AS (SELECT {keys}, pos, coalesce(value, 0) AS value FROM grid LEFT JOIN means USING ({keys}, pos))"""


def long_form(df, keys, vector="vector"):
    rows = df.select(*keys, F.posexplode(vector).alias("pos", "value"))
    return rows.select(*keys, "pos", (F.round("value", 6) + 0.0).alias("value"))


_LONG = "CAST(pos AS INTEGER) AS pos, round(value, 6) + 0 AS value"
_K = "conv_id, turn"


@query("sentence_vector", f"WITH {TURNS}, {_WORD_VECTORS}, {_UNIT}, {_mean_sql('turns', _K)} SELECT {_K}, {_LONG} FROM vectors")
def sentence_vector(spark, sf):
    docs = turns(spark, sf)
    return long_form(E.sentence_vectors(docs, KEYS, "text", word_vectors(spark, sf), WIDTH), KEYS)


@query(
    "weighted_vector",
    f"""WITH {WORD_WEIGHTS}, {_WORD_VECTORS}, long_vectors AS (
      SELECT word, unnest(range(64)) AS pos, unnest(vector) AS value FROM word_vectors),
    sums AS (SELECT {_K}, pos, sum(weight * value) AS value FROM weights JOIN long_vectors ON term = word GROUP BY ALL),
    grid AS (SELECT {_K}, range AS pos FROM turns CROSS JOIN range(64))
    SELECT {_K}, {_LONG.replace('value,', 'coalesce(value, 0),')} FROM grid LEFT JOIN sums USING ({_K}, pos)""",
)
def weighted_vector(spark, sf):
    weights = word_weights(spark, sf)
    return long_form(E.weighted_vectors(weights, turns(spark, sf), KEYS, word_vectors(spark, sf), WIDTH), KEYS)


@query(
    "vocab_reindex",
    f"""WITH {WORD_WEIGHTS}, {_WORD_VECTORS}
      SELECT term, vocab.idx, round(coalesce(list_sum(vector), 0), 6) + 0 AS total, coalesce(round(vector[64], 6), 0) AS last
      FROM vocab LEFT JOIN word_vectors ON term = word""",
)
def vocab_reindex(spark, sf):
    docs = turns(spark, sf)
    vocab = G.vocabulary(G.term_counts(docs, KEYS, G.WORDS), docs)
    rows = E.align_vectors(vocab.select("term", "idx"), word_vectors(spark, sf).drop("idx"), WIDTH)
    total = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x)
    last = F.round(F.element_at("vector", -1), 6)
    return rows.select("term", "idx", (F.round(total, 6) + 0.0).alias("total"), last.alias("last"))


@query(
    "last_wins",
    "SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey",
)
def last_wins(spark, sf):
    return E.last_wins(table(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderkey")


_RAW_WORDS = """raw_words AS (
  SELECT vec_id AS ordinal, w.word || '_' || label AS word, embedding
  FROM embeddings JOIN words w ON w.idx = vec_id // 3)"""


@query(
    "prepare_word_vectors",
    f"""WITH {TURNS}, {_WORD_VECTORS}, {_RAW_WORDS}
      SELECT word, CAST(unnest(range(64)) AS INTEGER) AS pos, round(CAST(unnest(e) AS DOUBLE), 6) + 0 AS value
      FROM (SELECT strip_accents(split_part(word, '_', 1)) AS word, arg_max(embedding, ordinal) AS e FROM raw_words GROUP BY 1)""",
)
def prepare_word_vectors(spark, sf):
    """Three tagged spellings of each word: the last one in file order stays."""
    words = word_vectors(spark, sf).select("word", "idx")
    raw = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("ordinal"),
        F.floor(F.col("vec_id") / 3).alias("idx"),
        "label",
        F.transform("embedding", lambda x: x.cast("double")).alias("vector"),
    )
    tagged = raw.join(words, "idx").withColumn("word", F.concat_ws("_", "word", "label"))
    ready = E.prepare_word_vectors(tagged.select("ordinal", "word", "vector"))
    return long_form(ready, ["word"])


def text_feature_rows(spark, sf):
    """Sentence vectors of the four text columns, end to end."""
    rows = X.clean_columns(dialogues(spark, sf), TEXT_COLUMNS)
    return E.column_sentence_vectors(rows, ["context_id", "reply_id"], TEXT_COLUMNS, word_vectors(spark, sf), WIDTH)


_BLOCK = "CASE \"column\" " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(TEXT_COLUMNS)) + " END"


@query(
    "text_features",
    f"""WITH {CELLS}, {TURNS}, {_WORD_VECTORS}, {_UNIT}, {_mean_sql('cells', 'context_id, reply_id, "column"')}
      SELECT context_id, reply_id, CAST({_BLOCK} * 64 + pos AS INTEGER) AS pos, round(value, 6) + 0 AS value FROM vectors""",
)
def text_features(spark, sf):
    return long_form(text_feature_rows(spark, sf), ["context_id", "reply_id"], "features")


@query(
    "column_bind",
    f"""WITH {WORD_WEIGHTS}, {_WORD_VECTORS}, {_UNIT}, {_mean_sql('turns', _K)},
    long_vectors AS (SELECT word, unnest(range(64)) AS pos, unnest(vector) AS value FROM word_vectors),
    sums AS (SELECT {_K}, pos, sum(weight * value) AS value FROM weights JOIN long_vectors ON term = word GROUP BY ALL),
    bound AS (SELECT {_K}, pos, value FROM vectors
      UNION ALL SELECT {_K}, pos + 64, coalesce(sums.value, 0) FROM grid LEFT JOIN sums USING ({_K}, pos))
    SELECT {_K}, {_LONG} FROM bound""",
)
def column_bind(spark, sf):
    """Sentence vectors beside weighted word vectors."""
    docs, vectors = turns(spark, sf), word_vectors(spark, sf)
    means = E.sentence_vectors(docs, KEYS, "text", vectors, WIDTH)
    sums = E.weighted_vectors(word_weights(spark, sf), docs, KEYS, vectors, WIDTH)
    return long_form(E.bind_columns([("vector", means), ("vector", sums)], KEYS), KEYS, "features")


@query(
    "scale_unit_variance",
    """WITH long AS (SELECT vec_id, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings),
    spread AS (SELECT pos, stddev_pop(value) AS sd FROM long GROUP BY pos)
    SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(value / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) + 0 AS value
    FROM long JOIN spread USING (pos)""",
)
def scale_unit_variance(spark, sf):
    values = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf, "embeddings").select("vec_id", array_to_vector(values).alias("v"))
    scaled = UnitVariance.fit(rows, "v").transform(rows, "v", "s")
    return long_form(scaled.select("vec_id", vector_to_array("s").alias("vector")), ["vec_id"])
