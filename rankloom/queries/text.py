"""Label and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as X
from ..operators import embed as E
from ..session import settle
from .registry import query
from .tables import DIALOGUES, PAIRS, dialogues, pairs, table, texts

_REPLACED = "lower(text)"
for _key, _word in {**X.SYMBOL_WORDS, **X.DIGIT_WORDS}.items():
    _REPLACED = f"replace({_REPLACED}, '{_key}', ' {_word} ')"
_WORDS = r"'[\p{L}\p{N}_]+'"


def clean_sql(text: str) -> str:
    inner = _REPLACED.replace("lower(text)", f"lower({text})")
    return f"array_to_string(regexp_extract_all({inner}, {_WORDS}), ' ')"


def _documents(expression):
    def run(spark, sf):
        return texts(spark, sf, "documents", "doc_id").select("doc_id", expression(F.col("text")).alias("text"))

    return run


query(
    "lower_strip",
    r"SELECT doc_id, regexp_replace(lower(text), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS text FROM documents",
)(_documents(X.lower_strip))
query(
    "isolate_punct",
    r"""SELECT doc_id, regexp_replace(text, '([''".()!?\-\\/,])', ' \1 ', 'g') AS text FROM documents""",
)(_documents(X.isolate_punctuation))
query(
    "symbol_words", "SELECT doc_id, replace(replace(text, '&', ' и '), '@', ' в ') AS text FROM documents"
)(_documents(X.symbol_words))


def _digits_sql(text: str) -> str:
    for key, word in X.DIGIT_WORDS.items():
        text = f"replace({text}, '{key}', ' {word} ')"
    return text


query("digit_words", f"SELECT doc_id, {_digits_sql('text')} AS text FROM documents")(_documents(X.digit_words))
query(
    "word_extract", f"SELECT doc_id, array_to_string(regexp_extract_all(text, {_WORDS}), ' ') AS text FROM documents"
)(_documents(X.word_text))
query("clean_default", f"SELECT doc_id, {clean_sql('text')} AS text FROM documents")(_documents(X.clean))
query("strip_accents", "SELECT doc_id, strip_accents(text) AS text FROM documents")(_documents(X.strip_accents))


@query(
    "word_tokens",
    f"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, '|') AS tokens
      FROM (SELECT doc_id, regexp_extract_all(text, {_WORDS}) AS t FROM documents)""",
)
def word_tokens(spark, sf):
    tokens = texts(spark, sf, "documents", "doc_id").select("doc_id", X.word_tokens(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").alias("n_tokens"), F.concat_ws("|", "t").alias("tokens"))


@query(
    "token_filter",
    f"""SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), {_WORDS}),
      lambda t: length(t) > 1 AND t NOT IN ('the', 'and', 'la', 'der')), ' ') AS text FROM documents""",
)
def token_filter(spark, sf):
    tokens = X.word_tokens(F.lower("text"))
    kept = X.drop_tokens(tokens, ["the", "and", "la", "der"])
    return texts(spark, sf, "documents", "doc_id").select("doc_id", X.join_tokens(kept).alias("text"))


_CLEAN_COLUMNS = ", ".join(f"{clean_sql(c)} AS {c}" for c in ("context_2", "context_1", "context_0", "reply"))


@query("clean_dialogue", f"WITH {DIALOGUES} SELECT context_id, reply_id, {_CLEAN_COLUMNS} FROM dialogues")
def clean_dialogue(spark, sf):
    return X.clean_columns(dialogues(spark, sf), ["context_2", "context_1", "context_0", "reply"])


# A lemma dictionary drawn from the corpus: a word that ends in s, with the word without it.
_BARE_TOKENS = f"""tokens AS (
  SELECT doc_id, pos, strip_accents(lower(token)) AS token FROM (
    SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS pos
    FROM (SELECT doc_id, regexp_extract_all(text, {_WORDS}) AS t FROM documents))),
lemmas AS (
  SELECT w.token, v.token AS lemma FROM (SELECT DISTINCT token FROM tokens) w JOIN (SELECT DISTINCT token FROM tokens) v
  ON w.token = v.token || 's' WHERE length(v.token) > 2)"""


def corpus_tokens(spark, sf):
    docs = texts(spark, sf, "documents", "doc_id")
    return docs.select("doc_id", F.posexplode(X.bare_tokens(F.col("text"))).alias("pos", "token"))


def corpus_lemmas(spark, sf):
    words = settle(corpus_tokens(spark, sf).select("token").distinct())
    plural = words.select("token", F.regexp_replace("token", "s$", "").alias("lemma"))
    plural = plural.where((F.col("token") != F.col("lemma")) & (F.length("lemma") > 2))
    found = plural.join(words.withColumnRenamed("token", "lemma"), "lemma", "left_semi")
    return settle(found.select("token", "lemma"))


@query(
    "lemma_lookup",
    f"""WITH {_BARE_TOKENS} SELECT coalesce(lemma, tokens.token) AS token, count(*) AS n
      FROM tokens LEFT JOIN lemmas ON tokens.token = lemmas.token GROUP BY 1""",
)
def lemma_lookup(spark, sf):
    """Tokens by lemma; equal tokens are counted first, so a frequent word is joined once."""
    counted = corpus_tokens(spark, sf).groupBy("token").agg(F.count("*").alias("n"))
    return E.with_lemma(counted, corpus_lemmas(spark, sf)).groupBy("token").agg(F.sum("n").alias("n"))


@query(
    "clean_tokens",
    f"""WITH {_BARE_TOKENS}, kept AS (
      SELECT doc_id, pos, coalesce(lemma, tokens.token) AS token FROM tokens LEFT JOIN lemmas ON tokens.token = lemmas.token)
      SELECT d.doc_id, coalesce(k.text, '') AS text FROM documents d LEFT JOIN (
        SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS text FROM kept
        WHERE length(token) > 1 AND token NOT IN ('the', 'and') GROUP BY doc_id) k ON d.doc_id = k.doc_id""",
)
def clean_tokens(spark, sf):
    docs = texts(spark, sf, "documents", "doc_id")
    return E.clean_tokens(docs, ["doc_id"], "text", corpus_lemmas(spark, sf), ["the", "and"])


@query(
    "key_prefix",
    "SELECT p_partkey, split_part(replace(p_name, ' ', '_'), '_', 1) AS word FROM part",
)
def key_prefix(spark, sf):
    key = F.regexp_replace("p_name", " ", "_")
    return table(spark, sf, "part").select("p_partkey", X.key_prefix(key).alias("word"))


@query(
    "parse_vector",
    """SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos,
      round(unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS value FROM embeddings""",
)
def parse_vector(spark, sf):
    """Vectors written out as text and parsed again."""
    words = F.transform("embedding", lambda x: x.cast("double").cast("string"))
    rows = table(spark, sf, "embeddings").select("vec_id", F.split(F.concat_ws(" ", words), " ").alias("cells"))
    values = rows.select("vec_id", F.posexplode(X.parse_floats(F.col("cells"))).alias("pos", "value"))
    return values.select("vec_id", "pos", F.round("value", 6).alias("value"))


_GRADE = "CASE label WHEN 'good' THEN 3 WHEN 'neutral' THEN 2 ELSE 1 END"


@query("label_grade", f"WITH {PAIRS} SELECT context_id, reply_id, label, {_GRADE} AS grade FROM pairs")
def label_grade(spark, sf):
    rows = pairs(spark, sf)
    return rows.select("context_id", "reply_id", "label", L.grade(F.col("label")).alias("grade"))


@query("target_base1", f"WITH {PAIRS} SELECT context_id, reply_id, round({_GRADE} * confidence, 6) AS target FROM pairs")
def target_base1(spark, sf):
    goal = L.target(F.col("label"), F.col("confidence"), 1)
    return pairs(spark, sf).select("context_id", "reply_id", F.round(goal, 6).alias("target"))


@query(
    "target_base0", f"WITH {PAIRS} SELECT context_id, reply_id, round(({_GRADE} - 1) * confidence, 6) AS target FROM pairs"
)
def target_base0(spark, sf):
    goal = L.target(F.col("label"), F.col("confidence"), 0)
    return pairs(spark, sf).select("context_id", "reply_id", F.round(goal, 6).alias("target"))


@query(
    "fill_missing",
    """SELECT event_id, CASE WHEN event_type = 'error' OR event_type IS NULL THEN '' ELSE event_type END AS event_type,
      value FROM events""",
)
def fill_missing(spark, sf):
    """The missing-value rule with one more literal."""
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    return L.fill_missing(events, ["event_type"], [*L.NA_LITERALS, "error"])
