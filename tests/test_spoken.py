import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from speechlytics.functions import identity as I
from speechlytics.functions import spoken as S


def values(spark, make, *columns):
    """The results of a Column function for lists of arguments."""
    names = [f"c{k}" for k in range(len(columns))]
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(zip(*columns, strict=True))], "k int, " + ", ".join(f"{n} string" for n in names))
    return [r.x for r in df.select("k", make(*(F.col(n) for n in names)).alias("x")).orderBy("k").collect()]


NUMBERS = {
    "four seven one nine": "4719", "oh six two oh": "0620", "triple four": "444", "thirty-one": "31",
    "three hundred and six": "306", "one thousand and ten": "1010", "oh well": "oh well", "nine oh": "90",
    "sixty oh": "60 0", "unit eight, four": "unit 8 4", "double 5 two": "552", "": "",
}


def test_numbers(spark):
    assert dict(zip(NUMBERS, values(spark, I.digits, list(NUMBERS)), strict=True)) == NUMBERS


SPELLINGS = {
    "It's H, A, L, V, O, R.": "halvor", "K for kilo, E, I, R": "keir", "em ell oh": "ml", "double t, o, m": "ttom",
    "That's PQ for queen, u. I": "pqui", "b as in bravo, o, a, z": "boaz", "are they there": "", "see you at the sea": "cu",
}


def test_spelling(spark):
    got = [x.replace(" ", "") for x in values(spark, I.letter_runs, list(SPELLINGS))]
    assert got == [v.replace(" ", "") for v in SPELLINGS.values()]
    checks = values(spark, I.check_spelled, ["H-A-L-V-O-R", "halvor, H A L V O R", "no H A L V E R"], ["Halvor"] * 3)
    assert [(c.strict, c.lenient) for c in checks] == [(True, True), (True, True), (False, False)]


def test_names(spark):
    texts = ["this is Orla D'Arcy", "this is Darsy", "", "d a r c y", None]
    got = values(spark, I.check_name, texts, ["D'Arcy"] * 5)
    assert [(c.strict, c.lenient) for c in got] == [(True, True), (False, False), (False, False), (False, True), (None, None)]
    assert got[1].near_miss == 0.8 and got[2].near_miss == 0.0
    assert values(spark, I.name_candidates, ["van der, berg"])[0] == ["van", "der", "berg", "vander", "derberg"]


def test_email(spark):
    said = ["m dot falk nineteen at post dot example", "m.falk19@post.example", "M.Falk 19 @post.example", "m dot falk ninety at post dot example"]
    got = values(spark, I.check_email, said, ["m.falk19@post.example"] * 4)
    assert [(c.strict, c.lenient) for c in got] == [(False, True), (True, True), (True, True), (False, False)]
    assert values(spark, I.normalise_email, ["jay underscore bee full stop two at x dot org"]) == ["j_b.2@x.org"]


DATES = {
    "the ninth of June, nineteen seventy-two": (9, 6, 1972), "9th June 1972": (9, 6, 1972), "09/06/1972": (9, 6, 1972),
    "oh nine, oh six, seventy two": (9, 6, 1972), "two one one two fifty eight": (21, 12, 1958), "9-6-72": (9, 6, 1972),
    "twelfth August two thousand and five": (12, 8, 2005), "August thirty first, nineteen ninety nine": (31, 8, 1999),
    "28022001": (28, 2, 2001), "280201": (28, 2, 2001), "March": (None, 3, None), "nothing said": (None, None, None),
}


def test_dates(spark):
    got = [tuple(r) for r in values(spark, I.parse_dob, list(DATES))]
    assert dict(zip(DATES, got, strict=True)) == DATES
    assert values(spark, I.parse_dob, [None]) == [None]
    checks = values(spark, I.check_dob, ["07/31/1988", "7/8/1988", "31 July 1988", None], ["1988-07-31", "1988-07-08", "1988-07-31", "1988-07-31"])
    assert [(c.strict, c.lenient, c.us_order, c.parsed) for c in checks] == [
        (False, True, True, "7-31-1988"), (False, False, True, "7-8-1988"), (True, True, False, "31-7-1988"), (None,) * 4
    ]
    assert values(spark, I.dob_match, ["07/31/1988"], ["1988-07-31"]) == [True]


ADDRESS = dict(unit="6", number="21", street="acacia", type="road", suburb="fernhill", state="qld", postcode="4055")
FIELDS = "struct<" + ",".join(f"{n}:string" for n in ADDRESS) + ">"


def address(spark, function, said, parts=ADDRESS):
    df = spark.createDataFrame([(k, t, tuple(parts.values()) if parts else None) for k, t in enumerate(said)], f"k int, t string, a {FIELDS}")
    return [r.x for r in df.select("k", function(F.col("t"), F.col("a")).alias("x")).orderBy("k").collect()]


def test_addresses(spark):
    said = [
        "Unit six, twenty-one Acacia Road, Fernhill, Queensland, four oh five five", "6/21 Acacia Rd, Fernhill QLD 4055",
        "6/12 Acacia Rd, Fernhill QLD 4055", None,
    ]
    got = address(spark, I.check_address, said)
    assert [c["all"] for c in got] == [True, True, False, None]
    assert got[2].unit and not got[2].unit_order and not got[2].number and got[2].street
    plain = address(spark, I.check_address, said[:1], ADDRESS | {"unit": None})[0]
    assert plain.unit is None and plain.unit_order is None and plain["all"]
    assert address(spark, I.check_address, said[:1], None)[0]["all"] is None
    scores = address(spark, I.address_score, ["6/21 Acasia Rd, Fern hil QLD 4055", "", "6/21 Acacia Rd Fernhill"])
    assert scores[0].numbers_exact and 0.9 < scores[0].similarity < 1 and scores[1].similarity == 0.0 and not scores[2].numbers_exact


def one_by_one(a, b):
    """Jaro-Winkler as its definition reads."""
    if a == b:
        return 1.0
    far, taken = max(len(a), len(b)) // 2 - 1, []
    for i, x in enumerate(a):
        at = next((j for j, y in enumerate(b) if y == x and abs(i - j) <= far and j not in [t for _, t in taken]), None)
        taken += [(i, at)] if at is not None else []
    if not taken:
        return 0.0
    other = [b[j] for j in sorted(j for _, j in taken)]
    c, moved = len(taken), sum(a[i] != y for (i, _), y in zip(taken, other, strict=True)) / 2
    jaro = (c / len(a) + c / len(b) + (c - moved) / c) / 3
    start = next((k for k in range(4) if a[k : k + 1] != b[k : k + 1] or not a[k : k + 1]), 4)
    return jaro + 0.1 * start * (1 - jaro)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abcé", max_size=9), st.text("abcé", max_size=9)), max_size=5))
def test_similarity_of_batches(pairs):
    got = S.similarities([a for a, _ in pairs], [b for _, b in pairs])
    assert list(got) == pytest.approx([one_by_one(a, b) for a, b in pairs])


def test_similarity(spark):
    assert round(float(S.similarities(["dwayne"], ["duane"])[0]), 3) == 0.84
    assert S.similarities(["", "", "a"], ["", "b", ""]).tolist() == [1.0, 0.0, 0.0]
    assert S.similarities(["abcdef"], ["azzzzz"])[0] == pytest.approx(0.5)  # a common letter counts however little else agrees
    score = values(spark, I.name_score, ["I am mc intyre", "no", None], ["McIntyre"] * 3)
    assert (score[0].similarity, score[0].same_sound) == (1.0, True) and score[1].similarity < 0.6 and score[2].similarity is None
    assert values(spark, I.window_sim, ["zzharpereww", "", "harp"], ["harper"] * 3)[0] == 1.0
    assert values(spark, I.spelled_score, ["H A R P E R"], ["Harper"]) == [1.0]
    assert values(spark, I.jaro_winkler, ["same", None], ["same", "x"]) == [1.0, None]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("one two oh o ten twenty hundred thousand and double x 7 85 , for".split()), max_size=8))
def test_numbers_never_fail(tokens):
    assert all(isinstance(t, str) and t != "," for t in S.numbers_to_digits(tokens))


SOUNDS = {
    "Carlson": "C642", "Karlsen": "K642", "Whitby": "W310", "Ashcroft": "A261", "Burroughs": "B620", "O'Dell": "O340", "": "",
    "42": "", "Pfeiffer": "P160",
}


def test_sound_codes(spark):
    assert dict(zip(SOUNDS, values(spark, I.soundex, list(SOUNDS)), strict=True)) == SOUNDS


def test_ids_and_times(spark):
    df = spark.createDataFrame(
        [("name_1", "m:high", "2025-01-02T03:04:05+00:00Z"), ("flow_dob_name_1", "m:none", "2025-01-02T03:04:05Z"), ("x", "m", "?")],
        "id string, j string, t string",
    )
    got = df.select(
        I.recording_id(F.col("id")).alias("r"), I.parse_judge(F.col("j")).alias("j"), I.tolerant_timestamp(F.col("t")).alias("t")
    ).toPandas()
    assert list(got.r) == ["real_name_1", "flow_dob_real_name_1", "real_x"]
    assert [None if j is None else (j.model, j.effort) for j in got.j] == [("m", "high"), ("m", None), None]
    assert list(got.t.dropna().astype(str)) == ["2025-01-02 03:04:05"] * 2 and pd.isna(got.t[2])


def test_near_pairs_are_those_of_all_slices():
    draw = random.Random(5)
    for letters, most in (("ab", 5), ("abcdefgh", 12), ("abc\u00e4\u6f22\U0001f600", 70), ("".join(map(chr, range(0x4E00, 0x4F30))), 30)):
        word = lambda low, high: "".join(draw.choice(letters) for _ in range(draw.randint(low, high)))  # noqa: B023, E731
        targets = list(dict.fromkeys([word(0, most) for _ in range(15)] + ["", letters[0]]))
        texts = list(dict.fromkeys([word(0, 4) + draw.choice(targets)[draw.randint(0, 2) :] + word(0, 4) for _ in range(25)] + ["", "#"]))
        for least in (1.0, 0.9, 0.5):
            scores = {
                (i, j): S.best_similarities([S.slices_near(t, len(v))], [v])[0] for i, t in enumerate(texts) for j, v in enumerate(targets)
            }
            found = zip(*(x.tolist() for x in S.near_pairs(texts, targets, least)), strict=True)
            assert sorted(found) == sorted((i, j, s) for (i, j), s in scores.items() if s >= least)
    assert [len(x) for x in S.near_pairs([], [], 0.9)] == [0, 0, 0]
