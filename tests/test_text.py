"""Text measures on edge cases; the oracles cover whole documents."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from redressa.functions import batches, text
from redressa.operators.vectors import narrative_words

# Text -> the measures that are not zero. Recorded from this code, after it had
# agreed with Python's re and str.count on the same texts.
EDGES = [
    (None, {}),
    ("", {}),
    ("   ", dict(n_chars=3, n_sentences=1)),
    # a word with an apostrophe is no plain word: pay, or
    (
        "don't pay 3.50 or 7.",
        dict(n_chars=20, n_words=5, n_sentences=2, avg_word_len=2.5, avg_sentence_len=2.5,
             lexical_diversity=1, digit_count=4),
    ),
    (
        "A.B!! C?? really?!",
        dict(n_chars=18, n_words=4, n_sentences=4, avg_word_len=2.25, avg_sentence_len=1,
             lexical_diversity=1, uppercase_ratio=1 / 3, question_count=3, exclamation_count=3),
    ),
    # characters are code points
    (
        "smile 😀 twice 😀😀",
        dict(n_chars=16, n_words=2, n_sentences=1, avg_word_len=5, avg_sentence_len=2,
             lexical_diversity=1),
    ),
    # digits of any script count
    (
        "٣٤ and 12",
        dict(n_chars=9, n_words=3, n_sentences=1, avg_word_len=3, avg_sentence_len=3,
             lexical_diversity=1, digit_count=4),
    ),
    # a dotted capital I becomes i and a combining dot
    (
        "İstanbul İ",
        dict(n_chars=10, n_words=3, n_sentences=1, avg_word_len=3, avg_sentence_len=3,
             lexical_diversity=2 / 3),
    ),
    # accented letters, digits and underscores are parts of a word: no redaction
    (
        "éXX a",
        dict(n_chars=5, n_words=2, n_sentences=1, avg_word_len=1.5, avg_sentence_len=2,
             lexical_diversity=1, uppercase_ratio=2 / 3),
    ),
    (
        "XX_ b",
        dict(n_chars=5, n_words=2, n_sentences=1, avg_word_len=1.5, avg_sentence_len=2,
             lexical_diversity=1, uppercase_ratio=2 / 3),
    ),
    (
        "XXXX/XX and XX",
        dict(n_chars=14, n_words=4, n_sentences=1, avg_word_len=2.75, avg_sentence_len=4,
             lexical_diversity=0.75, uppercase_ratio=8 / 11, redaction_count=3),
    ),
    (
        "XX1 XX",
        dict(n_chars=6, n_words=3, n_sentences=1, avg_word_len=2, avg_sentence_len=3,
             lexical_diversity=2 / 3, uppercase_ratio=1, digit_count=1, redaction_count=1),
    ),
    # terms are substrings: "rent" three times
    (
        "current parents pay rent",
        dict(n_chars=24, n_words=4, n_sentences=1, avg_word_len=5.25, avg_sentence_len=4,
             lexical_diversity=1, hardship_term_count=3),
    ),
    # terms of one list may overlap: pursuant twice, section, 15 usc
    (
        "pursuant to section 15 usc 1681, pursuant",
        dict(n_chars=41, n_words=7, n_sentences=1, avg_word_len=5.6, avg_sentence_len=7,
             lexical_diversity=6 / 7, digit_count=6, legal_term_count=4, template_phrase_count=2),
    ),
    # hits of one term do not overlap
    (
        "aasapasap",
        dict(n_chars=9, n_words=1, n_sentences=1, avg_word_len=9, avg_sentence_len=1,
             lexical_diversity=1, urgency_term_count=2),
    ),
    (
        "deniedenied evidencevidence",
        dict(n_chars=27, n_words=2, n_sentences=1, avg_word_len=13, avg_sentence_len=2,
             lexical_diversity=1, evidence_term_count=1, anger_term_count=1),
    ),
    (
        "{$1,200.50} and $30 and {$5} and $,",
        dict(n_chars=35, n_words=7, n_sentences=1, avg_word_len=3, avg_sentence_len=7,
             lexical_diversity=5 / 7, digit_count=9, money_amount_count=4),
    ),
    (
        "UPPER lower MiXed",
        dict(n_chars=17, n_words=3, n_sentences=1, avg_word_len=5, avg_sentence_len=3,
             lexical_diversity=1, uppercase_ratio=7 / 15),
    ),
    (
        "o'clock rock'n'roll",
        dict(n_chars=19, n_words=3, n_sentences=1, avg_word_len=4, avg_sentence_len=3,
             lexical_diversity=1),
    ),
]


@pytest.mark.parametrize("value, wanted", EDGES)
def test_edges(spark, value, wanted):
    df = spark.createDataFrame([(value,)], "consumer_narrative string")
    row = text.with_text_measures(df).first()
    got = {n: row[n] for n in text.TEXT_MEASURES if row[n]}
    assert got == pytest.approx(wanted)


@pytest.mark.parametrize(
    "value, connectives, paragraphs",
    [
        (None, 0, 0),
        (" \t\n\r\n ", 0, 0),
        ("First I called.\n\n \tThen, however, nobody came\r\nso", 4, 3),
        ("also alsoran\rbecause", 2, 2),
        (" " * 200_000 + "\n" * 200_000 + "x", 0, 1),
    ],
)
def test_structure(spark, value, connectives, paragraphs):
    df = spark.createDataFrame([(value,)], "consumer_narrative string")
    row = text.with_text_measures(df).first()
    assert (row["connective_count"], row["n_paragraphs"]) == (connectives, paragraphs)


def test_own_lexicon(spark):
    df = spark.createDataFrame([("one two Two twos é é",)], "consumer_narrative string")
    row = text.with_text_measures(df, lexicons={"twos": ["two"], "accents": ["é"]}).first()
    assert (row["twos"], row["accents"]) == (3, 2)


def test_blanks_are_what_strip_removes(spark):
    df = spark.createDataFrame([(text.BLANKS + "x y" + text.BLANKS,)], "t string")
    assert df.select(text.strip_blanks(F.col("t"))).first()[0] == "x y"


def test_normalize(spark):
    df = spark.createDataFrame(
        [("On  XX/XX/2022 I paid {$1,200.50}\n and $30.25 on 2021-01-02. ",), (None,)], "t string"
    )
    got = [r[0] for r in df.select(text.normalize_text(F.col("t"))).collect()]
    assert got == ["on <date> i paid <amount> and <amount> on <date>.", ""]


def test_topic_words(spark):
    df = spark.createDataFrame([("The éabc abc1 foo_bar big don't x-ray ok",)], "t string")
    got = df.select(text.topic_words(F.lower("t"))).first()[0]
    assert got == ["the", "big", "don", "ray"]


def test_a_term_is_replaced_only_where_it_is(spark):
    counted = text.count_terms(F.col("t"), ["aa", "b"])
    df = spark.createDataFrame([("aaab",), ("xyz",), ("",), (None,)], "t string").select("t", counted.alias("n"))
    assert [r["n"] for r in df.collect()][:3] == [2, 0, 0]
    assert "contains" in df._jdf.queryExecution().analyzed().toString().lower()


def test_batched_measures_and_words_equal_the_expressions(spark):
    texts = [t for t, _ in EDGES] + [
        "a'b'c'd e''f 'g h'", "1.2.3.4 5..6 .7 8.", "٣.٤.5", "Kelvin K K'k", "İİ'x K", "ab²c abc² xabc_ abc_d",
        "\n\n a\r\n \t b\n", "evidencevidence asapasap", "rent\nrent renT", "$1,2.3 {$5} {$5.} {$5.55} $ $,", "XX́ x XXx XX",
        "a\0b\0\0", "𝟘𝟙 𝐚bc", "ßabc abcß the account is late", "ΣΑΣ abc", " \t \n \r x", "was " * 3000 + "🙂", "word" * 700,
    ]
    df = spark.createDataFrame(list(enumerate(texts * 2)), "id int, consumer_narrative string").repartition(2)
    names = ["id", *text.TEXT_MEASURES, *text.STRUCTURE_MEASURES, "kept_words"]
    plain = narrative_words(text.with_text_measures(df)).select(names).sort("id")
    batched = narrative_words(text.with_text_measures(df, batched=True), batched=True).select(names).sort("id")
    assert [f.dataType.typeName() for f in batched.schema] == [f.dataType.typeName() for f in plain.schema]
    assert batched.collect() == plain.collect()


def test_batched_texts_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(batches, "CHUNK", 50)
    monkeypatch.setattr(batches, "CHUNK_TEXTS", 3)
    monkeypatch.setattr(batches, "TABLE", 4)
    kinds = {"n_words": pa.int32(), "lexical_diversity": pa.float64(), "late": pa.int32()}
    texts = ["one two one", None, "a b c d e " * 20, "", "x", "late Late latelate", "two two"]
    found = batches.measures(kinds, {"late": ["late", "te l"]}, ["one"])(pa.array(texts, pa.string())).to_pylist()
    assert [r["n_words"] for r in found] == [3, 0, 100, 0, 1, 3, 2]
    assert [r["late"] for r in found] == [0, 0, 0, 0, 0, 6, 0]
    assert [r["lexical_diversity"] for r in found] == [2 / 3, 0, 0.05, 0, 1, 2 / 3, 0.5]
    words = batches.topic_words(["two"])(pa.array(["two one oneé", None, "Abc two"], pa.string()))
    assert words.to_pylist() == [["one"], [], ["abc"]]
    assert len(batches.topic_words([])(pa.array([], pa.string()))) == len(batches.measures(kinds, {"late": []}, [])(pa.array([], pa.string()))) == 0
