import unicodedata

import pytest
from pyspark.sql import functions as F

from rankloom.functions import labels as L
from rankloom.functions import text as X

SAMPLES = [
    "A&B@c 2018!",
    "  Tabs\tand\nlines  ",
    "5² ½ über_x x‿y",
    "don't (stop) a/b-c\\d, \"q\". ok?",
    "Ёлка йод 😀 25 & @",
    "",
    "Straße ÇA İs",
    "नमस्ते दुनिया 你好 مرحبا",
]
WORDS = X.SYMBOL_WORDS | X.DIGIT_WORDS


def one(spark, fn, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.o for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()]


def words(text):
    """Runs of letters, numbers and underscores, which is what a word character is."""
    keep = "".join(c if c == "_" or unicodedata.category(c)[0] in "LN" else " " for c in text)
    return keep.split()


def plain_clean(text):
    text = text.lower()
    for key, word in WORDS.items():
        text = text.replace(key, f" {word} ")
    return " ".join(words(text))


def test_clean_fixture(spark):
    assert one(spark, X.clean, ["A&B@c 2018!"]) == ["a и b в c два ноль один восемь"]


def test_clean_equals_the_rules_step_by_step(spark):
    texts = [t for t in SAMPLES if "İ" not in t]
    assert one(spark, X.clean, texts) == [plain_clean(t) for t in texts]


def test_clean_equals_its_parts(spark):
    def steps(c):
        return X.word_text(X.digit_words(X.symbol_words(X.isolate_punctuation(X.lower_strip(c)))))

    assert one(spark, steps, SAMPLES) == one(spark, X.clean, SAMPLES)


def test_single_steps(spark):
    assert one(spark, X.lower_strip, ["  Ab C\t\n"]) == ["ab c"]
    assert one(spark, X.isolate_punctuation, ["a.b-c\\d/e,f(g)!?'\""]) == [
        "a . b - c \\ d / e , f ( g )  !  ?  '  \" "
    ]
    assert one(spark, X.digit_words, ["25"]) == [" два  пять "]
    assert one(spark, X.symbol_words, ["a&b"]) == ["a и b"]
    assert one(spark, X.word_text, ["5² ½ über_x x‿y"]) == ["5² ½ über_x x y"]
    assert one(spark, X.key_prefix, ["слово_NOUN", "a_b_c", "plain"]) == ["слово", "a", "plain"]
    assert one(spark, lambda c: X.parse_floats(F.split(c, " ")), ["1 -2.5 3e-2"]) == [[1.0, -2.5, 0.03]]


def test_word_tokens(spark):
    assert one(spark, X.word_tokens, SAMPLES) == [words(t) for t in SAMPLES]


def test_token_filter(spark):
    fn = lambda c: X.join_tokens(X.drop_tokens(F.split(c, " "), ["ok"]))
    assert one(spark, fn, ["a b b ok", "ok bb cc bb"]) == ["", "bb cc bb"]


ACCENTED = ["Ёлка йод ø ł ß", "é é ñ Å Ω", "ệ ǖ ΐ", "שָׁלוֹם", "مُحَمَّد", "กำ เก่", "한국어", "x̣́y"]


def test_strip_accents(spark):
    assert one(spark, X.strip_accents, ["Ёлка йод ø ł ß"]) == ["Елка иод ø ł ß"]
    full = one(spark, X.recompose_accents, ACCENTED)
    assert one(spark, X.strip_accents, ACCENTED) == full


def test_strip_accents_on_every_letter(spark):
    letters = [chr(c) for c in range(0x80, 0x2FFF) if unicodedata.category(chr(c))[0] in "LM"]
    assert one(spark, X.strip_accents, letters) == one(spark, X.recompose_accents, letters)


def test_recompose_joins_what_the_table_leaves_apart(spark):
    apart = "ᄀ́ᅡ"
    assert one(spark, X.recompose_accents, [apart]) == ["가"]
    assert one(spark, X.strip_accents, [apart]) == ["가"]


def test_grades_and_targets(spark):
    df = spark.createDataFrame([("good", 0.5), ("neutral", 1.0), ("odd", 0.25), (None, 1.0)], "label string, c double")
    got = df.select(
        L.grade(F.col("label")).alias("g"),
        L.target(F.col("label"), F.col("c")).alias("t1"),
        L.target(F.col("label"), F.col("c"), 0).alias("t0"),
    ).collect()
    assert [tuple(r) for r in got] == [(3, 1.5, 1.0), (2, 2.0, 1.0), (1, 0.25, 0.0), (1, 1.0, 0.0)]
    with pytest.raises(ValueError):
        L.grade(F.col("label"), 2)


def test_fill_missing_leaves_numbers_alone(spark):
    df = spark.createDataFrame([("NA", None), (None, 1.0), ("nan", 2.0), ("text", 3.0)], "t string, x double")
    assert [tuple(r) for r in L.fill_missing(df, ["t"]).collect()] == [("", None), ("", 1.0), ("", 2.0), ("text", 3.0)]
