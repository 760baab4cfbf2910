import math
import random

import pytest
from pyspark.sql import functions as F

from speechlytics.functions import wording as W
from speechlytics.operators.judging import align_words, score_judgments

COUNTS = [
    ("the quick brown fox jumps", 5),
    ("Well... “no” — really, stop!", 4),
    ("I'm sure they'll say it's what we've done", 12),
    ("He said that's fine, I can't go", 9),
    ("it’s here", 3),
    ("the dog's bone and my brother's old red car", 9),
    ("state-of-the-art at 7:30 for 2,000 people now", 7),
    ("ᱚᱞ ᱪᱤᱠᱤ", 2),
    ("", 0),
    (None, 0),
    ("  spaced   out\tand\nbroken ", 4),
]
WEIGHTS = [
    ("substitution", "one", "two", 1),
    ("substitution", "one", "two three", 1),
    ("substitution", "one two", "three", 1),
    ("substitution", "one two three", "four five", 3),
    ("deletion", "a b c d e", None, 5),
    ("deletion", None, None, 1),
    ("insertion", None, "two words", 2),
    ("insertion", None, None, 1),
]


def test_word_counts(spark):
    df = spark.createDataFrame(COUNTS, "text string, expected int").withColumn("got", W.count_words(F.col("text")))
    assert [(r.text, r.got) for r in df.collect()] == COUNTS


def slow_count(text):
    """Words by the definition, token by token."""
    total = 0
    for token in text.lower().replace("’", "'").split():
        core = token.strip(W.EDGE_MARKS)
        if any(c.isalpha() or c.isnumeric() for c in core):
            total += 1 + (core.endswith(W.CONTRACTION_ENDINGS) or (core[-2:] == "'s" and core[:-2] in W.IS_STEMS))
    return total


def test_word_counts_against_the_definition(spark):
    rng = random.Random(8)
    parts = ["it", "'s", "n't", "can", "'d", "let's", "that's", "(it's)", "'m", ".", ",", "…", " ", "  ", "\n", "x", "42", "-", "’s", "dog", '"', "'", "we'll!", "[he's]"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", W.count_words(F.col("t")).alias("n"))
    wrong = [(r.t, r.n, slow_count(r.t)) for r in df.collect() if r.n != slow_count(r.t)]
    assert not wrong, wrong[:5]
    words = spark.createDataFrame([("(Hi), it's 7:30 — ok…",)], "t string").select(W.plain_words(F.col("t"))).first()[0]
    assert words == ["hi", "it's", "7:30", "ok"]


def test_error_weights(spark):
    df = spark.createDataFrame(WEIGHTS, "type string, r string, h string, expected int")
    got = df.select("expected", W.error_weight(F.col("type"), F.col("r"), F.col("h")).alias("got")).collect()
    assert all(r.expected == r.got for r in got)


ERRORS = "array<struct<type:string,reference:string,hypothesis:string,position:int>>"


def insertions(*words):
    return [("insertion", None, w, 0) for w in words]


@pytest.mark.parametrize(
    ("errors", "hypothesis", "expected"),
    [
        (insertions("red", "green", "blue", "pink", "grey", "teal"), "nothing of it", True),
        (insertions("it", "is", "not", "12", "345"), "it's isn't", False),
        (insertions("is", "not"), "it isn't so", False),
        (insertions("red", "green"), "nothing", False),
        (insertions("red", "green", "blue", "a", "b", "c"), "a b c", False),
        (insertions("red green blue", "a"), "a", True),
        ([], "anything", False),
        (None, "anything", False),
    ],
)
def test_invented_insertions(spark, errors, hypothesis, expected):
    df = spark.createDataFrame([(errors, hypothesis)], f"errors {ERRORS}, h string")
    assert df.select(W.invented_insertions(F.col("errors"), F.col("h"))).first()[0] is expected


def test_rate_and_blank_cases(spark):
    df = spark.createDataFrame([(0, 0, 0, 0), (0, 0, 2, 0), (1, 1, 1, 6)], "s int, d int, i int, n int")
    rates = [r[0] for r in df.select(W.word_error_rate(*(F.col(c) for c in "sdin"))).collect()]
    assert rates == [0.0, math.inf, 0.5]
    blank = spark.createDataFrame([("", " "), (None, "two words"), ("three words here", ""), ("a", "b")], "r string, h string")
    got = [r[0] for r in blank.select(W.blank_case(F.col("r"), F.col("h"))).collect()]
    assert (got[0].wer, got[1].wer, got[1].insertions, got[2].wer, got[2].deletions) == (0.0, math.inf, 2, 1.0, 3)
    assert got[3] is None


def test_judgments_are_scored_or_quarantined(spark):
    rows = [
        ("k1", "a b c d", "a x c", [("substitution", "b", "x", 1), ("deletion", "d", None, 3)]),
        ("k2", "a", "a", [("typo", "a", "b", 0)]),
        ("k3", "a", "a", None),
        ("k4", "a", "b", insertions("red", "green", "blue")),
        ("k5", "", "x", []),
    ]
    df = spark.createDataFrame(rows, f"key string, reference string, hypothesis string, errors {ERRORS}")
    scored, bad = score_judgments(df)
    assert {r.key: r.wer for r in scored.collect()} == {"k1": 0.5, "k5": 0.0}
    assert {r.key: r.reason for r in bad.collect()} == {
        "k2": "invalid error list", "k3": "invalid error list", "k4": "invented insertions",
    }


def test_error_texts(spark):
    df = spark.createDataFrame([([("substitution", "a", "b", 1), ("deletion", "c", None, 2)],), ([],)], f"e {ERRORS}")
    text = W.errors_text(F.col("e"), ["type", "reference", "hypothesis"])
    assert [r[0] for r in df.select(text).collect()] == ["substitution: a → b; deletion: c → ∅", "none"]


def test_alignment_is_shortest():
    assert align_words("a b c".split(), "a c".split()) == [
        {"type": "deletion", "reference": "b", "hypothesis": None, "position": 1}
    ]
    assert [e["type"] for e in align_words([], ["x", "y"])] == ["insertion"] * 2
    assert align_words(["a"], ["a"]) == []
