import random
from datetime import datetime

import pytest

from speechlytics.operators import deliveries, orphans
from speechlytics.plans import integrity
from tests.conftest import rows

KEYS = ["id", "vendor"]


def brute_first(data):
    best, count = {}, {}
    for r in data:
        k = (r[0], r[1])
        order = tuple((x is None, x) if x is not None else (True, 0) for x in (r[3], r[2]))
        count[k] = count.get(k, 0) + 1
        if k not in best or order < best[k][0]:
            best[k] = (order, r)
    return {k: (r, count[k]) for k, (_, r) in best.items()}


def test_first_delivery_against_brute_force(spark):
    rng = random.Random(5)
    data = [
        (rng.choice(["a", "b", None, ""]), rng.choice(["x", None]), rng.choice(["t", "u", None]), rng.choice([1, 2, 3, None]))
        for _ in range(300)
    ]
    data += [("hot", "x", "same", 1)] * 500  # a hot identifier of equal rows
    df = spark.createDataFrame(data, "id string, vendor string, text string, at int").repartition(5)
    got = {(r.id, r.vendor): r for r in deliveries.first_delivery(df, KEYS, "at").collect()}
    want = brute_first(data)
    assert got.keys() == want.keys()
    for k, (r, n) in want.items():
        assert (got[k].text, got[k]["at"], got[k].n_copies) == (r[2], r[3], n)


def test_redelivered_admission_and_clashing_names(spark):
    schema = "id string, vendor string, at int, __rank int, __salt string"
    df = spark.createDataFrame([("a", "x", 1, 7, "s"), ("a", "x", 2, 8, "s"), ("b", None, 1, 9, "s")], schema)
    assert rows(deliveries.redelivered(df, KEYS, "at")) == [("a", "x")]
    first = deliveries.first_delivery(df, KEYS, "at")
    assert set(first.columns) == {*df.columns, "n_copies"} and first.filter("id = 'a'").first()["__rank"] == 7
    batch = spark.createDataFrame([("b", None, 5, 1, "s"), ("c", "x", 5, 1, "s"), ("c", "x", 4, 2, "s")], schema)
    assert [(r.id, r["at"]) for r in deliveries.admit_batch(df, batch, KEYS, "at").collect()] == [("c", 4)]
    assert deliveries.admit_batch(df, df, KEYS, "at").isEmpty()
    empty = df.limit(0)
    assert deliveries.first_delivery(empty, KEYS, "at").isEmpty()
    assert deliveries.admit_batch(empty, batch, KEYS, "at").count() == 2


def day(n):
    return datetime(2025, 1, n)


def test_temporal_orphans(spark):
    parents = spark.createDataFrame(
        [("a", day(5), day(10)), ("a", day(15), None), ("a", day(5), day(10)), ("", day(1), None), ("n", None, None), (None, day(1), None)],
        "parent_id string, valid_from timestamp, valid_to timestamp",
    )
    refs = [
        ("a", day(4), "early"), ("a", day(5), None), ("a", day(10), "removed"), ("a", day(12), "removed"), ("a", day(15), None),
        ("b", day(5), "missing"), ("", day(3), None), ("n", day(3), "removed"), (None, day(3), None), ("a", None, "removed"),
        ("b", None, "missing"),
    ]
    df = spark.createDataFrame([(i, t) for i, t, _ in refs], "ref_id string, ref_time timestamp")
    got = rows(orphans.temporal_orphans(df, parents))
    assert got == sorted(((i, t, r) for i, t, r in refs if r), key=repr)
    assert orphans.temporal_orphans(df.limit(0), parents).isEmpty()
    assert orphans.temporal_orphans(df, parents.limit(0)).count() == len([1 for i, _, _ in refs if i is not None])


def test_cascade_reaches_grandchildren_and_ends_on_cycles(spark):
    t = lambda data: spark.createDataFrame(data, "row_id string, up string")
    tables = {
        "a": t([("a1", None), ("a2", None)]),
        "b": t([("b1", "a1"), ("b2", "gone"), ("b3", None), ("b4", "a1")]),
        "c": t([("c1", "b1"), ("c2", "b2"), ("c3", "b3")]),
        "d": t([("d1", "d2"), ("d2", "d1"), ("d3", "c2")]),
    }
    tables["a"] = tables["a"].withColumn("key", tables["a"].row_id)
    tables = {n: df.withColumn("key", df.row_id) for n, df in tables.items()}
    keys = [
        orphans.ForeignKey("b", "up", "a", "key"), orphans.ForeignKey("c", "up", "b", "key"),
        orphans.ForeignKey("d", "up", "c", "key"),
    ]
    found = orphans.orphan_cascade(tables, keys, {"a": tables["a"].filter("row_id = 'a2'").select("row_id")})
    assert rows(found) == [
        ("a", "a2", "direct", 0), ("b", "b2", "direct", 0), ("c", "c2", "inherited", 1), ("d", "d1", "direct", 0),
        ("d", "d2", "direct", 0), ("d", "d3", "inherited", 2),
    ]
    cycle = {"d": spark.createDataFrame([("d1", "d2"), ("d2", "d1")], "row_id string, up string").selectExpr("*", "row_id AS key")}
    ring = orphans.orphan_cascade(cycle, [orphans.ForeignKey("d", "up", "d", "key")], {"d": cycle["d"].limit(1).select("row_id")})
    assert ring.count() == 2


def test_a_parent_key_with_one_live_row_is_alive(spark):
    parent = spark.createDataFrame([("p1", "k"), ("p2", "k")], "row_id string, key string")
    child = spark.createDataFrame([("c1", "k")], "row_id string, up string")
    key = [orphans.ForeignKey("child", "up", "parent", "key")]
    lost = parent.filter("row_id = 'p1'").select("row_id")
    assert orphans.orphan_cascade({"parent": parent, "child": child}, key, {"parent": lost}).count() == 1
    both = parent.select("row_id")
    assert orphans.orphan_cascade({"parent": parent, "child": child}, key, {"parent": both}).count() == 3


@pytest.fixture(scope="module")
def orphaned(spark, tmp_path_factory):
    """Tables whose orphans are known: sample a is there from 2025-01-05 to 2025-01-10, b from 2025-01-01 on."""
    folder = tmp_path_factory.mktemp("orphaned")

    def put(name, data, schema):
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")

    put("samples", [("A ", day(5), day(10)), ("b", day(1), None)], "sample_id string, added_at timestamp, removed_at timestamp")
    later = datetime(2025, 2, 3)
    put(
        "results",
        [
            (1, " a", "S", None, day(4)), (2, "a", "s", "", later), (3, "a", "s", "m", day(6)), (4, "a", "s", "m", day(12)),
            (5, "b", "s", "m", day(6)), (6, "gone", "s", "m", later), (7, None, "s", "m", later),
        ],
        "id long, sample_id string, service_name string, model_name string, timestamp timestamp",
    )
    put("gold_transcripts", [("a", later), ("A", later), ("b", later), ("c", day(7)), (None, day(7))], "sample_id string, generated_at timestamp")
    keys = ["s||a", "S||A ", "s||a", "s|m|a", "s|m|b", "s|m|gone", "no|such|key", "no|such|key", None]
    put("runs", [("j", k) for k in keys], "judge string, key string")
    return str(folder)


def test_whole_rows_of_all_tables_by_month_and_kind(spark, orphaned):
    assert rows(integrity.p5_cascade_months(spark, orphaned)) == sorted(
        [
            ("results", "2025-01", "direct", 0, 2), ("results", "2025-02", "direct", 0, 2),
            ("gold_transcripts", "2025-02", "direct", 0, 2), ("gold_transcripts", "2025-01", "direct", 0, 1),
            ("runs", None, "direct", 0, 2), ("runs", "2025-02", "inherited", 1, 4),
        ],
        key=repr,
    )


def test_orphan_references_come_from_the_cascade(spark, orphaned, monkeypatch):
    given = []

    def cascade(tables, keys, direct):
        given.append(set(tables))
        return orphans.orphan_cascade(tables, keys, direct)

    monkeypatch.setattr(integrity, "orphan_cascade", cascade)
    assert rows(integrity.p5_found(spark, orphaned)) == sorted(
        [
            ("results", "2025-01", "a", "early"), ("results", "2025-02", "a", "removed"), ("results", "2025-01", "a", "removed"),
            ("results", "2025-02", "gone", "missing"), ("gold_transcripts", "2025-02", "a", "removed"),
            ("gold_transcripts", "2025-01", "c", "missing"),
        ],
        key=repr,
    )
    assert ("gold_transcripts", "2025-02", "removed", 2, 1) in rows(integrity.p5_report(spark, orphaned))
    assert given == [{"results", "gold_transcripts", "runs"}] * 2
