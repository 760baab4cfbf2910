import random

import pytest

from speechlytics.llm import addresses as A
from speechlytics.llm.address_text import Parts, parse_fields, parse_text
from tests.conftest import rows


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("uh It's apartment 3 at 54 Elm St, Fotze Haven, South Australia, 6487.", ("3", "54", "elm", "street", "fotzehaven", "sa", "6487")),
        ("My address is Momka Court, nine slash four, that is in Labra W A five seven four four", ("9", "4", "momka", "court", "labra", "wa", "5744")),
        ("two hundred and forty B Momka Plc, Tovra, four eight two four", (None, "240b", "momka", "place", "tovra", None, "4824")),
        ("I live at Gidla, QLD, four three oh four, the street is Bobzi Crescent, number unit twenty-one, three", ("21", "3", "bobzi", "crescent", "gidla", "qld", "4304")),
        ("330 Hollo, St Dukki, WA, 5006", (None, "330", "hollo", None, "saintdukki", "wa", "5006")),
        ("2/218 nerto st radbe", ("2", "218", "nerto", "street", "radbe", None, None)),
        ("Dakre 4045, Fimve Par 58", (None, "58", "fimve", "parade", "dakre", None, "4045")),
        ("flat 3, number 54 Pub Court in Fotze, s.a.", ("3", "54", "pub", "court", "fotze", "sa", None)),
        ("", (None,) * 7),
        (None, (None,) * 7),
    ],
)
def test_parsing(text, parts):
    assert parse_text(text) == Parts(*parts)


def test_parsing_fields():
    full = {"unit": "3", "number": "#54", "street": "ELM", "type": "St.", "suburb": "Pt Fotze", "state": "s.a.", "postcode": "6487"}
    assert parse_fields(full) == Parts("3", "54", "elm", "street", "portfotze", "sa", "6487")
    assert parse_fields({"number": "u9 4", "street": "elm", "suburb": "oak rd"})[:5] == ("9", "4", "oak", "road", "elm")  # swapped
    assert parse_fields({"street": "Unit 23, 961 Elm Drive, Oak Tas 7148"}) == Parts("23", "961", "elm", "drive", "oak", "tas", "7148")
    assert parse_fields(None) == parse_fields({}) == Parts()


EXPECTED = "struct<unit:string,number:string,street:string,type:string,suburb:string,state:string,postcode:string>"


def simulated(seed=1):
    """Places in several localities, each written by several items with slips, abbreviations and missing parts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) + rng.choice(["ver", "gate", "rond"])
    towns = [(word(), rng.choice(["nsw", "vic"]), str(2000 + k)) for k in range(6)]
    places, items, texts, truth = set(), [], [], {}
    while len(places) < 60:
        town = rng.choice(towns)
        street = word()
        for kind in rng.sample(["street", "road", "lane"], rng.choice([1, 1, 2])):
            for number in rng.sample(range(1, 300), 2):
                places.add((rng.choice([None, None, "3", "12"]), str(number), street, kind, *town))

    def slip(name):
        k = rng.randrange(1, len(name) - 1)
        return rng.choice([name[:k] + name[k + 1 :], name[:k] + name[k + 1] + name[k] + name[k + 2 :], name[:k] + "x" + name[k + 1 :]])

    for n, (unit, number, street, kind, town, state, code) in enumerate(sorted(places, key=repr)):
        for copy in range(rng.choice([1, 2, 3])):
            i = f"address_{n:03d}_{copy}"
            truth[i] = n
            said = slip(street) if rng.random() < 0.3 else street
            drop = lambda x, p=0.3: None if rng.random() < p else x
            items.append((i, (unit, number, said, drop(kind), drop(town), drop(state), drop(code)) if rng.random() > 0.1 else None))
            for _ in range(rng.choice([1, 2])):
                name = slip(street) if rng.random() < 0.2 else street
                lead = f"{unit}/{number}" if unit else number
                texts.append((i, rng.choice([f"{lead} {name} {kind}, {town}, {state} {code}", f"{town} {code}, the street is {name} {kind}, number {lead}"])))
    return items, texts, truth


def test_same_places_are_found(spark):
    items, texts, truth = simulated()
    df = spark.createDataFrame(items + items[:5], f"id string, expected {EXPECTED}")
    heard = spark.createDataFrame([*texts, (None, "1 elm st"), ("address_000_0", None), ("address_000_0", "  ")], "id string, transcript string")
    resolved = A.resolve(df, heard)
    got = {tuple(r) for r in A.same_place(resolved).collect()}
    ids = sorted(truth)
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if truth[a] == truth[b]}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.02 * len(want)
    placed = {r.id: r for r in A.places(df, resolved).collect()}
    assert placed.keys() == truth.keys()
    assert sum(len({placed[a].place_id, placed[b].place_id}) == 1 for a, b in got) == len(got)


def test_nothing_known(spark):
    df = spark.createDataFrame([("a", None), ("b", None), (None, None)], f"id string, expected {EXPECTED}")
    none = spark.createDataFrame([], "id string, transcript string")
    assert A.resolve(df, none).isEmpty()
    assert rows(A.places(df, A.resolve(df, none))) == [("a", "a", 1), ("b", "b", 1)]
    assert A.resolve(df.limit(0), none).isEmpty()


def test_spellings_follow_the_dominating_one(spark):
    names = [("p", "momkaver", 40), ("p", "momkver", 3), ("p", "mokmaver", 1), ("p", "tanlibo", 9), ("p", "tanlibu", 8), ("q", "momkver", 5)]
    got = {(r.place, r.name): r.root for r in A.cluster_spellings(spark.createDataFrame(names, "place string, name string, n long")).collect()}
    assert got["p", "momkver"] == got["p", "mokmaver"] == "momkaver" and got["q", "momkver"] == "momkver"
    assert got["p", "tanlibu"] == "tanlibu"  # two streets that are both common stay apart


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("12 Old Mill Road, Richmond", (None, "12", "oldmill", "road", "richmond", None, None)),
        ("12-14 High Street, Kew", (None, "12-14", "high", "street", "kew", None, None)),
        ("1204 Pacific Highway, Pymble 2073", (None, "1204", "pacific", "highway", "pymble", None, "2073")),
        ("5 Martin Luther King Drive, Parkes", (None, "5", "martinlutherking", "drive", "parkes", None, None)),
        ("12 St Kilda Road, Melbourne VIC 3000", (None, "12", "saintkilda", "road", "melbourne", "vic", "3000")),
        ("3 Kings Court Road, Kew", (None, "3", "kingscourt", "road", "kew", None, None)),
        ("hulpibourne wa 5380 momvesham street 5", (None, "5", "momvesham", "street", "hulpibourne", "wa", "5380")),
    ],
)
def test_names_of_several_words_ranges_and_long_numbers(text, parts):
    assert parse_text(text) == Parts(*parts)


def test_fields_and_text_read_alike():
    fields = {"number": "12", "street": "Old Mill", "type": "Rd", "suburb": "Richmond"}
    assert parse_fields(fields) == parse_text("12 Old Mill Road, Richmond")
    assert parse_fields({"number": "1204", "street": "Pacific", "type": "Hwy"})[1:4] == ("1204", "pacific", "highway")


def paired(spark, texts):
    """The pairs found among addresses (id, transcript), one mention each or more."""
    ids = spark.createDataFrame([(i, None) for i in sorted({i for i, _ in texts})], f"id string, expected {EXPECTED}")
    heard = spark.createDataFrame(texts, "id string, transcript string")
    return {tuple(r) for r in A.same_place(A.resolve(ids, heard)).collect()}


def test_short_names_one_letter_apart_stay_two_streets(spark):
    assert paired(spark, [("a", "1 Hall Street, Kew 3101"), ("b", "2 Hill Street, Kew 3101"), ("c", "1 hall st, kew 3101")]) == {("a", "c")}
    # In one house, or at one address, they are one street.
    assert paired(spark, [("a", "1 Hall Street, Kew 3101"), ("b", "1 Hill Street, Kew 3101")]) == {("a", "b")}


def test_another_suburb_is_another_place(spark):
    texts = [("a", "7 Elmwood Road, Richmond 3121"), ("b", "7 Elmwood Rd, Burnley 3121"), ("c", "7 elmwood road, burnley, vic 3121")]
    assert paired(spark, texts) == {("b", "c")}
    assert paired(spark, [*texts[1:], ("d", "7 Elmwood Road 3121"), ("e", "7 Elmwood Road, Burnly 3121")]) == {(x, y) for x in "bcd" for y in "cde" if x < y}


def test_a_mistyped_postcode_gives_way_to_the_suburb(spark):
    texts = [(f"a{k}", f"{k + 3} Elmwood Road, Richmond 3121") for k in range(4)]
    assert paired(spark, [*texts, ("b", "3 Elmwood Road, Richmond 3112")]) == {("a0", "b")}
    assert paired(spark, [*texts, ("b", "3 Elmwood Road, Richmond 2753")]) == set()  # another Richmond


def test_no_place_is_guessed_from_a_street_alone(spark):
    assert paired(spark, [("a", "3 Elmwood Road, Richmond 3121"), ("b", "3 Elmwood Road")]) == set()
    assert paired(spark, [("a", "3 Elmwood Road, Richmond 3121"), ("b", "3 Elmwood Road, Richmnd")]) == {("a", "b")}


def test_chains_of_slips_end_in_one_root(spark):
    names = [("p", "abcdefghijklm"[: 7 + k], 4 ** (6 - k)) for k in range(6)]
    got = {r.name: r.root for r in A.cluster_spellings(spark.createDataFrame(names, "place string, name string, n long")).collect()}
    assert set(got.values()) == {"abcdefg"}


def test_no_table_is_sent_through_the_driver(spark):
    items, texts, truth = simulated()
    df = spark.createDataFrame(items, f"id string, expected {EXPECTED}")
    heard = spark.createDataFrame(texts, "id string, transcript string")
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()

    def executed():
        bus.waitUntilEmpty()
        runs = store.executionsList()
        return {r.executionId(): r.physicalPlanDescription() for r in (runs.apply(k) for k in range(runs.size()))}

    earlier = executed().keys()
    resolved = A.resolve(df, heard)
    assert A.same_place(resolved).count() > 0 and A.places(df, resolved).count() == len(truth)
    plans = [plan for k, plan in executed().items() if k not in earlier]
    assert sum("SortMergeJoin" in p for p in plans) >= 8
    # The tables are far below the session's threshold, which is compared with the length of compressed files.
    assert not any("Broadcast" in p for p in plans)
