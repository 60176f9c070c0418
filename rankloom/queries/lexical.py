"""N-gram, vocabulary and TF-IDF queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import folds as D
from ..operators import lexical as G
from ..settings import TEXT_COLUMNS
from .registry import query
from .tables import DIALOGUES, dialogues, table, texts
from .text import clean_sql

KEYS = ["conv_id", "turn"]
CELL = ["context_id", "reply_id", "column"]


def turns(spark, sf):
    """Conversation turns with cleaned text."""
    return X.clean_columns(texts(spark, sf, "conversations", *KEYS), ["text"])


TURNS = f"turns AS (SELECT conv_id, turn, {clean_sql('text')} AS text FROM conversations)"


def documents(spark, sf):
    return X.clean_columns(texts(spark, sf, "documents", "doc_id"), ["text"])


def cells(spark, sf):
    """The stacked corpus of cleaned dialogues."""
    rows = X.clean_columns(dialogues(spark, sf), TEXT_COLUMNS)
    return G.stack_columns(rows, ["context_id", "reply_id"], TEXT_COLUMNS)


CELLS = f"{DIALOGUES}, cells AS (" + " UNION ALL ".join(
    f"""SELECT context_id, reply_id, '{c}' AS "column", {clean_sql(c)} AS text FROM dialogues""" for c in TEXT_COLUMNS
) + ")"


def counts_sql(source: str, keys: str, analyzer: G.Analyzer, name: str = "counts") -> str:
    """CTE ``(keys, term, tf)`` over ``source(keys, text)``."""
    if analyzer.kind == "word":
        lists = []
        for n in range(analyzer.lo, analyzer.hi + 1):
            gram = " || ' ' || ".join(f"t[i + {j}]" for j in range(n))
            lists.append(f"list_transform(range(1, len(t) - {n} + 2), lambda i: {gram})")
        lists = " || ".join(lists)
        return f"""{name} AS (SELECT {keys}, term, count(*) AS tf FROM (SELECT {keys}, unnest({lists}) AS term FROM (
          SELECT {keys}, list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1) AS t
          FROM {source})) GROUP BY ALL)"""
    parts = " UNION ALL ".join(
        f"SELECT {keys}, unnest(list_transform(range(1, length(s) - {n} + 2), lambda i: substr(s, i, {n}))) AS term FROM spaced"
        for n in range(analyzer.lo, analyzer.hi + 1)
    )
    spaced = rf"SELECT {keys}, regexp_replace(text, '[\s\p{{Z}}\x1c-\x1f]{{2,}}', ' ', 'g') AS s FROM {source}"
    return f"{name} AS (WITH spaced AS ({spaced}) SELECT {keys}, term, count(*) AS tf FROM ({parts}) GROUP BY ALL)"


def vocab_sql(counts: str, source: str, cap: int, name: str = "vocab", min_df: int = 2, max_df: float = 0.9) -> str:
    return f"""{name} AS (
      SELECT term, df, total, row_number() OVER (ORDER BY total DESC, term) - 1 AS idx, ln((1 + n) / (1 + df)) + 1 AS idf
      FROM (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM {counts} GROUP BY term),
        (SELECT CAST(count(*) AS DOUBLE) AS n FROM {source})
      WHERE df >= {min_df} AND df <= CAST({max_df} AS DOUBLE) * n QUALIFY idx < {cap})"""


def tfidf_sql(counts: str, vocab: str, keys: str, name: str = "weights") -> str:
    return f"""{name} AS (
      SELECT {keys}, term, idx, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY {keys})) AS weight
      FROM {counts} JOIN {vocab} USING (term))"""


_K = "conv_id, turn"


@query("stack_text_columns", f'WITH {CELLS} SELECT context_id, reply_id, "column", text FROM cells')
def stack_text_columns(spark, sf):
    return cells(spark, sf)


@query("word_ngrams", f"WITH {TURNS}, {counts_sql('turns', _K, G.WORDS)} SELECT * FROM counts")
def word_ngrams(spark, sf):
    return G.term_counts(turns(spark, sf), KEYS, G.WORDS)


_UNIGRAMS = G.Analyzer("word", 1, 1)


@query(
    "term_counts",
    f"""WITH docs AS (SELECT doc_id, {clean_sql('text')} AS text FROM documents), {counts_sql('docs', 'doc_id', _UNIGRAMS)}
      SELECT * FROM counts""",
)
def term_counts(spark, sf):
    return G.term_counts(documents(spark, sf), ["doc_id"], _UNIGRAMS)


@query(
    "char_ngrams",
    f"""WITH {counts_sql('conversations', _K, G.CHARS)}
      SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM counts GROUP BY term""",
)
def char_ngrams(spark, sf):
    """On raw texts, whose line breaks and runs of blanks matter here."""
    return G.term_totals(G.term_counts(table(spark, sf, "conversations"), KEYS, G.CHARS))


@query(
    "doc_freq",
    f"""WITH {TURNS}, {counts_sql('turns', _K, G.WORDS)}
      SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM counts GROUP BY term""",
)
def doc_freq(spark, sf):
    return G.term_totals(G.term_counts(turns(spark, sf), KEYS, G.WORDS))


_DOCS = f"docs AS (SELECT doc_id, {clean_sql('text')} AS text FROM documents)"


@query(
    "vocab_limits",
    f"""WITH {_DOCS}, {counts_sql('docs', 'doc_id', G.WORDS)}, {vocab_sql('counts', 'docs', 10**12)}
      SELECT term, df, total, round(idf, 6) AS idf FROM vocab""",
)
def vocab_limits(spark, sf):
    docs = documents(spark, sf)
    n = G.document_count(docs)
    kept = G.within_limits(G.term_totals(G.term_counts(docs, ["doc_id"], G.WORDS)), n)
    return kept.select("term", "df", "total", F.round(G.idf(F.col("df"), n), 6).alias("idf"))


@query(
    "vocab_top_n",
    f"""WITH {TURNS}, {counts_sql('turns', _K, G.CHARS_SHORT)}, {vocab_sql('counts', 'turns', 5000)}
      SELECT term, df, total, idx FROM vocab""",
)
def vocab_top_n(spark, sf):
    docs = turns(spark, sf)
    vocab = G.vocabulary(G.term_counts(docs, KEYS, G.CHARS_SHORT), docs, max_features=5000)
    return vocab.select("term", "df", "total", "idx")


def word_weights(spark, sf, cap=200_000):
    docs = turns(spark, sf)
    counts = G.term_counts(docs, KEYS, G.WORDS)
    return G.tfidf(counts, G.vocabulary(counts, docs, max_features=cap), KEYS)


WORD_WEIGHTS = (
    f"{TURNS}, {counts_sql('turns', _K, G.WORDS)}, {vocab_sql('counts', 'turns', 200_000)}, {tfidf_sql('counts', 'vocab', _K)}"
)


@query("tfidf_word", f"WITH {WORD_WEIGHTS} SELECT conv_id, turn, term, round(weight, 6) AS weight FROM weights")
def tfidf_word(spark, sf):
    return word_weights(spark, sf).select(*KEYS, "term", F.round("weight", 6).alias("weight"))


_CHAR_WEIGHTS = f"""{TURNS}, {counts_sql('turns', _K, G.CHARS)}, {vocab_sql('counts', 'turns', 200_000)},
{tfidf_sql('counts', 'vocab', _K)}"""


@query("tfidf_char", f"WITH {_CHAR_WEIGHTS} SELECT conv_id, turn, term, round(weight, 6) AS weight FROM weights")
def tfidf_char(spark, sf):
    docs = turns(spark, sf)
    counts = G.term_counts(docs, KEYS, G.CHARS)
    weights = G.tfidf(counts, G.vocabulary(counts, docs), KEYS)
    return weights.select(*KEYS, "term", F.round("weight", 6).alias("weight"))


@query(
    "count_char",
    f"""WITH {TURNS}, {counts_sql('turns', _K, G.CHARS_SHORT)}, {vocab_sql('counts', 'turns', 200_000)}
      SELECT conv_id, turn, idx, CAST(tf AS DOUBLE) AS weight FROM counts JOIN vocab USING (term)""",
)
def count_char(spark, sf):
    docs = turns(spark, sf)
    counts = G.term_counts(docs, KEYS, G.CHARS_SHORT)
    vocab = G.vocabulary(counts, docs)
    return G.count_weights(counts, vocab, KEYS).select(*KEYS, "idx", "weight")


@query(
    "feature_union",
    f"""WITH {TURNS}, {counts_sql('turns', _K, G.CHARS_SHORT, 'char_counts')}, {vocab_sql('char_counts', 'turns', 200_000, 'char_vocab')},
      {counts_sql('turns', _K, G.WORDS, 'word_counts')}, {vocab_sql('word_counts', 'turns', 200_000, 'word_vocab')},
      {tfidf_sql('word_counts', 'word_vocab', _K, 'word_weights')}
      SELECT conv_id, turn, 'char' AS block, idx, CAST(tf AS DOUBLE) AS weight FROM char_counts JOIN char_vocab USING (term)
      UNION ALL SELECT conv_id, turn, 'word', idx, round(weight, 6) FROM word_weights""",
)
def feature_union(spark, sf):
    """Character counts beside word TF-IDF, the blocks of the blended job."""
    docs = turns(spark, sf)
    chars = G.term_counts(docs, KEYS, G.CHARS_SHORT)
    words = G.term_counts(docs, KEYS, G.WORDS)
    both = G.feature_union(
        {
            "char": G.count_weights(chars, G.vocabulary(chars, docs), KEYS),
            "word": G.tfidf(words, G.vocabulary(words, docs), KEYS),
        }
    )
    return both.select(*KEYS, "block", "idx", F.round("weight", 6).alias("weight"))


FOLDS = 5


def folded_cells(spark, sf):
    """Stacked cells; the fold belongs to the row, not to the cell."""
    rows = D.assign_folds(dialogues(spark, sf), ["context_id", "reply_id"], FOLDS)
    rows = X.clean_columns(rows, TEXT_COLUMNS)
    return G.stack_columns(rows, ["context_id", "reply_id", "fold"], TEXT_COLUMNS)


_ROW = "concat_ws('|', context_id, reply_id, '42')"
_FOLD_COUNTS = f"""{CELLS}, row_folds AS (
  SELECT context_id, reply_id, CAST(ntile({FOLDS}) OVER (ORDER BY md5({_ROW}), context_id, reply_id) - 1 AS INTEGER) AS fold
  FROM dialogues),
folded AS (SELECT * FROM cells JOIN row_folds USING (context_id, reply_id)),
{counts_sql('folded', 'context_id, reply_id, "column", fold', G.WORDS)},
fits AS (SELECT CAST(range AS INTEGER) AS fit FROM range({FOLDS})),
fold_vocab AS (
  SELECT fit AS fold, term, df, total, row_number() OVER (PARTITION BY fit ORDER BY total DESC, term) - 1 AS idx,
         ln((1 + n) / (1 + df)) + 1 AS idf
  FROM (SELECT fit, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM counts JOIN fits ON fold <> fit GROUP BY fit, term)
  JOIN (SELECT fit, CAST(count(*) AS DOUBLE) AS n FROM folded JOIN fits ON fold <> fit GROUP BY fit) USING (fit)
  WHERE df >= 2 AND df <= CAST(0.9 AS DOUBLE) * n QUALIFY idx < 200000)"""


def fold_counts(spark, sf):
    docs = folded_cells(spark, sf)
    return docs, G.term_counts(docs, CELL, G.WORDS, also=["fold"], row=["context_id", "reply_id"])


@query("fold_vocabularies", f"WITH {_FOLD_COUNTS} SELECT fold, term, df, total, idx, round(idf, 6) AS idf FROM fold_vocab")
def fold_vocabularies(spark, sf):
    docs, counts = fold_counts(spark, sf)
    vocab = G.fold_vocabularies(counts, docs, FOLDS)
    return vocab.select("fold", "term", "df", "total", "idx", F.round("idf", 6).alias("idf"))


@query(
    "tfidf_fold_fit",
    f"""WITH {_FOLD_COUNTS} SELECT context_id, reply_id, "column", fold, term,
      round(tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY context_id, reply_id, "column")), 6) AS weight
      FROM counts JOIN fold_vocab USING (fold, term)""",
)
def tfidf_fold_fit(spark, sf):
    """Valid rows weighted by the vocabulary of their fold's train rows."""
    docs, counts = fold_counts(spark, sf)
    vocab = G.fold_vocabularies(counts, docs, FOLDS)
    weights = G.tfidf(counts, vocab, [*CELL, "fold"], on=["fold", "term"])
    return weights.select(*CELL, "fold", "term", F.round("weight", 6).alias("weight"))
