import random

from speechlytics.functions import spoken
from speechlytics.operators import verification as V
from tests.conftest import rows

PARTS = "struct<given:string,surname:string,email:string,dob:string,unit:string,number:string,street:string,type:string,suburb:string,state:string,postcode:string>"
ITEM = f"id string, field string, item_set string, voice string, noise boolean, impostor boolean, homophone boolean, expected {PARTS}, record {PARTS}"
RESULT = "id string, vendor string, condition string, transcript string, ttfs double, error string, n int"


def part(**k):
    return tuple(k.get(f) for f in "given surname email dob unit number street type suburb state postcode".split())


ITEMS = [
    ("n1", "name", "synthetic", "v", False, False, False, part(given="Ann", surname="Nguyen"), part(given="Ann", surname="Nguyen")),
    ("n2", "name", "synthetic", "v", False, True, False, part(given="Bob", surname="Nugent"), part(given="Bob", surname="Nguyen")),
    ("e1", "email", "synthetic", "v", False, None, None, part(email="a@b.com"), part(email="a@b.com")),
    ("d1", "dob", "synthetic", "w", False, None, None, part(dob="1951-01-26"), None),
    ("a1", "address", "real", "w", False, None, None, part(number="14", street="wattle", type="street", suburb="dale", state="nsw", postcode="2150"), None),
    ("a2", "address", "real", "w", False, None, None, None, None),
]


def test_scores(spark):
    items = spark.createDataFrame(ITEMS, ITEM)
    results = spark.createDataFrame(
        [
            ("n1", "x", "none", "it's Ann Nguyen", 0.5, None, 1), ("n2", "x", "none", "Bob Nguyen", 0.5, None, 1),
            ("e1", "x", "none", "a at b dot com", 0.5, None, 1), ("d1", "x", "none", "01/26/1951", 0.7, None, 1),
            ("a1", "x", "none", "14 Wattle St, Dale NSW 2150", 0.5, None, 1), ("a2", "x", "none", "14 Wattle St", 0.5, None, 1),
        ],
        RESULT,
    )
    got = {r.id: r for r in V.score_rows(items, results).collect()}
    assert got["n1"].ok and got["n1"].ok_strict and got["n1"].record_leak is None
    assert not got["n2"].ok and got["n2"].record_leak
    assert got["e1"].ok and not got["e1"].ok_strict
    assert got["d1"].us_order and got["d1"].ok and not got["d1"].ok_strict and got["d1"].parsed == "1-26-1951"
    assert got["a1"].ok and got["a1"].addr_unit is None and got["a2"].ok is None
    scores = V.score_rows(items, results)
    acc = V.field_accuracy(scores).first()
    assert (acc.surname_passed, acc.surname_n, acc.dob_us_passed, acc.email_passed) == (1, 1, 1, 1)
    leak = V.impostor_leakage(scores).first()
    assert (leak.leak_similar_passed, leak.leak_similar_n, leak.leak_homophone_n) == (1, 1, 0)
    assert V.address_parts(scores).first().street_passed == 1
    assert V.by_voice(scores).count() == 2
    rules = {r.rule: r for r in V.name_rule_rates(items, results).collect()}
    assert rules["exact"].genuine_passed == 1 and rules["exact"].similar_passed == 1


def test_order_of_filtering_matters(spark):
    df = spark.createDataFrame([("i", "v", "none", "good", 0.1, None, 1), ("i", "v", "none", None, None, "bad", 2)], RESULT)
    assert V.latest_then_valid(df, ["n"]).isEmpty()
    assert V.valid_then_latest(df, ["n"]).first().transcript == "good"
    items = spark.createDataFrame([("i", "name", None, "v", False, None, None, None, None)], ITEM)
    assert rows(V.failures(items, df, ["n"])) == [("v", "none", 1)]


def test_flow(spark):
    callers = spark.createDataFrame(
        [("n1", "Nguyen", "1990-02-03", False, False), ("n2", "Nguyen", "1990-02-03", True, False), ("n3", "Smith", "1990-02-03", False, False)],
        "id string, surname string, dob string, impostor boolean, homophone boolean",
    )
    clip = lambda i, c, t: (i, "v", c, t, 0.1, None, 1)
    results = spark.createDataFrame(
        [
            clip("n1", "none", "I am Win"), clip("n1", "record", "Nguyen"), clip("flow_spelled_n1", "none", "N G U Y E N"),
            clip("flow_dob_n1", "none", "3 February 1990"),
            clip("n2", "none", "Nugent"), clip("n2", "record", "Nguyen"), clip("flow_spelled_n2", "none", "N U G E N T"),
            clip("flow_dob_n2", "none", "4 May 1980"), clip("n3", "none", "Smith"),
        ],
        RESULT,
    )
    got = {r.policy: r for r in V.verification_flow(callers, results).collect()}
    assert {p: got[p].genuine_n for p in got} == dict.fromkeys("A B C1 C2 D".split(), 1)  # n3 lacks clips
    assert [got[p].genuine_passed for p in ("A", "B", "C1", "C2", "D")] == [1, 0, 1, 1, 1]
    assert got["C1"].spelling_passed == 1 and got["B"].spelling_passed == 0
    assert [got[p].similar_passed for p in ("A", "C1", "D")] == [0, 0, 0]


def test_cross(spark):
    honest = spark.createDataFrame([("a", "v", "smith"), ("b", "v", "jones")], "id string, vendor string, text string")
    records = spark.createDataFrame([("a", "smith"), ("b", "jones"), ("c", "smith")], "id string, value string")
    assert V.impostor_pairs(honest, records).count() == 4
    got = V.cross_rates(honest, records, "window_sim", (1.0,)).first()
    assert (got.genuine_passed, got.genuine_n, got.impostor_passed, got.impostor_n) == (2, 2, 1, 4)
    pairs = spark.createDataFrame([("v", "name", True, False), ("v", "name", True, True)], "vendor string, kind string, synthetic_ok boolean, real_ok boolean")
    assert rows(V.paired_accuracy(pairs)) == [("v", "name", 2, 1.0, 0.5)]


def test_cross_makes_no_rows_of_pairs(spark, monkeypatch):
    def never(*args):
        raise AssertionError("all pairs as rows")

    monkeypatch.setattr(V, "all_against_all", never)
    draw, letters = random.Random(3), "abcdeghijklmnorstu"
    mails = ["".join(draw.choice(letters) for _ in range(draw.randint(6, 14))) + draw.choice(("@inboxly.example", "@post.example")) for _ in range(60)]
    heard = []
    for k, mail in enumerate(mails):
        at = draw.randrange(len(mail))
        slip = mail[:at] + draw.choice(("", "x", mail[at : at + 1] * 2)) + mail[at + 1 :]
        heard.append((f"i{k}", draw.choice(("v", "w", None)), draw.choice(("", "myemailis")) + draw.choice((mail, slip))))
    heard += [("i0", "v", ""), ("i1", "v", "no"), ("i2", "w", mails[3]), ("i3", "w", "x" * 70 + mails[3])]
    records = [(f"i{k}", mail) for k, mail in enumerate(mails)] + [("j", mails[0]), ("k", ""), ("l", "x" * 66 + mails[3])]
    rules, expected = (1.0, 0.95, 0.9), {}
    for i, vendor, text in heard:
        scores = spoken.best_similarities([spoken.slices_near(text, len(v)) for _, v in records], [v for _, v in records])
        for least in rules:
            sums = expected.setdefault((vendor, least), [0, 0, 0, 0])
            for (j, _), score in zip(records, scores.tolist(), strict=True):
                sums[0 if i == j else 2] += score >= least
                sums[1 if i == j else 3] += 1
    honest = spark.createDataFrame(heard, "id string, vendor string, text string")
    got = V.cross_rates(honest, spark.createDataFrame(records, "id string, value string"), "window_sim", rules)
    assert {(r.vendor, r.least): list(r[2:]) for r in got.collect()} == expected
    texts, values = honest.select("text").distinct(), spark.createDataFrame([(m, 1) for m in mails], "other string, m long")
    assert rows(V.near_pairs(texts, values, 0.9, block=7)) == rows(V.near_pairs(texts, values, 0.9)) != []
    assert V.cross_rates(honest, spark.createDataFrame([], "id string, value string"), "window_sim", rules).count() == 0
