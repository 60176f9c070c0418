"""Text normalisation.

Every function but ``recompose_accents`` is a built-in column expression, so a
cleaning job is a narrow stage without a Python worker.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Mapping
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Russian words for two symbols and the ten ASCII digits.
SYMBOL_WORDS = {"&": "и", "@": "в"}
DIGIT_WORDS = {
    "0": "ноль", "1": "один", "2": "два", "3": "три", "4": "четыре",
    "5": "пять", "6": "шесть", "7": "семь", "8": "восемь", "9": "девять",
}

# A word character is a letter, a number or an underscore, in any script.
WORD = r"[\p{L}\p{N}_]+"
NON_WORD = r"[^\p{L}\p{N}_]+"
SPACE = r"(?U)[\s\x1c-\x1f]"
# The punctuation that is set apart.
PUNCTUATION = r"(['\".()!?\-\\/,])"


def lower_strip(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, rf"{SPACE}+\z|\A{SPACE}+", ""))


def isolate_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, PUNCTUATION, " $1 ")


def spell_out(c: Column, words: Mapping[str, str]) -> Column:
    """Replace each key by its word, with a space on both sides."""
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(f" {kv[1]} ")), words.items(), c)


def symbol_words(c: Column) -> Column:
    return spell_out(c, SYMBOL_WORDS)


def digit_words(c: Column) -> Column:
    return spell_out(c, DIGIT_WORDS)


def word_text(c: Column) -> Column:
    """The runs of word characters, joined by one space."""
    return F.trim(F.regexp_replace(c, NON_WORD, " "))


def word_tokens(c: Column) -> Column:
    """The runs of word characters as an array."""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def clean(c: Column, symbols: Mapping[str, str] = SYMBOL_WORDS, digits: Mapping[str, str] = DIGIT_WORDS) -> Column:
    """Default clean: lower-case, spell out symbols and digits, keep the words.

    Stripping and isolating punctuation cannot change the result, since only
    word runs are kept, so neither is computed here.
    """
    return word_text(spell_out(F.lower(c), {**symbols, **digits}))


def clean_columns(df: DataFrame, cols: Iterable[str], fn=clean) -> DataFrame:
    """Apply one text function to each of the listed columns."""
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def _without_marks(text: str) -> str:
    kept = (ch for ch in unicodedata.normalize("NFD", text) if unicodedata.category(ch) != "Mn")
    return unicodedata.normalize("NFC", "".join(kept))


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str, dict[str, str]]:
    """Characters that lose an accent and their replacements, from the Unicode database.

    Combining marks come last, without a replacement, so ``translate`` drops them.
    The few characters that leave two others behind are listed apart.
    """
    plain, marks, wide = [], [], {}
    for ch in map(chr, range(0x80, sys.maxunicode + 1)):
        if unicodedata.category(ch) == "Mn":
            marks.append(ch)
        elif unicodedata.decomposition(ch):
            bare = _without_marks(ch)
            if bare != ch and len(bare) == 1:
                plain.append((ch, bare))
            elif bare != ch and len(bare) > 1:
                wide[ch] = bare
    return "".join(a for a, _ in plain) + "".join(marks), "".join(b for _, b in plain), wide


def strip_accents(c: Column) -> Column:
    """Drop accents (decompose, remove marks, recompose) with one character table.

    Exact for composed and for decomposed letters. Sequences in which two *base*
    characters combine once a mark between them has gone (conjoining Hangul
    jamo, a few Indic vowel pairs) stay apart; ``recompose_accents`` joins those too.
    """
    source, repl, wide = accent_table()
    split = reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), wide.items(), c)
    return F.translate(F.when(c.rlike(f"[{''.join(wide)}]"), split).otherwise(c), source, repl)


@F.pandas_udf(T.StringType())
def recompose_accents(texts: pd.Series) -> pd.Series:
    """As ``strip_accents``, by the full decompose / recompose rule, in Arrow batches."""
    return texts.map(_without_marks, na_action="ignore")


def bare_tokens(c: Column) -> Column:
    """Word tokens in lower case without accents. Words are cut first, then the joined words are
    treated in one go: neither step adds or removes a space."""
    words = strip_accents(F.lower(word_text(c)))
    return F.filter(F.split(words, " "), lambda t: t != "")


def drop_tokens(tokens: Column, garbage: Iterable[str] = ()) -> Column:
    """Drop one-character tokens and the tokens of a stop list."""
    garbage = sorted(set(garbage))
    if not garbage:
        return F.filter(tokens, lambda t: F.length(t) > 1)
    return F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(*garbage))


def join_tokens(tokens: Column) -> Column:
    return F.concat_ws(" ", tokens)


def key_prefix(c: Column) -> Column:
    """The part before the first ``_``: drops a part-of-speech suffix."""
    return F.split_part(c, F.lit("_"), F.lit(1))


def parse_floats(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: x.cast("double"))
