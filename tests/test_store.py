import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechlytics.operators import store
from tests.conftest import rows

RESULT = "sample_id string, service_name string, model_name string, transcription string, error string, seq int"


def test_upsert_and_folders(spark, tmp_path):
    old = spark.createDataFrame([("a", "s", "", "one", None, 1), ("b", "s", "m", "two", None, 2), ("c", "t", "", "x", None, 3)], RESULT)
    new = spark.createDataFrame([("a", "s", None, "new", None, 4), ("a", "s", "", "newest", None, 5), ("d", "s", "", "d", None, 6)], RESULT)
    path = str(tmp_path / "results")
    store.write_results(old, path, ["seq"])
    store.write_results(new, path, ["seq"])
    got = spark.read.parquet(path)
    assert rows(got.select("sample_id", "model_name", "transcription")) == [
        ("a", "", "newest"), ("b", "m", "two"), ("c", "", "x"), ("d", "", "d"),
    ]
    assert store.upsert(old.limit(0), new.limit(0), ["sample_id"], ["seq"]).isEmpty()


def test_corrections_keep_the_first_text(spark):
    schema = "sample_id string, text string, verified_by string, verified_at string, original_text string"
    truth = spark.createDataFrame([("a", "v1", None, None, None), ("b", "v2", "x", "t", "v1"), ("c", "keep", None, None, None)], schema)
    fix = spark.createDataFrame([("a", "fixed", "me", "now"), ("b", "fixed", "me", "now")], "sample_id string, text string, verified_by string, verified_at string")
    got = {r.sample_id: r for r in store.correct_ground_truth(truth, fix).collect()}
    assert (got["a"].text, got["a"].original_text) == ("fixed", "v1")
    assert (got["b"].text, got["b"].original_text, got["b"].verified_by) == ("fixed", "v1", "me")
    assert (got["c"].text, got["c"].original_text) == ("keep", None)


def test_queues(spark):
    samples = spark.createDataFrame([(x,) for x in "abcde"], "sample_id string")
    truth = spark.createDataFrame([(x, x) for x in "abcd"], "sample_id string, text string")
    results = spark.createDataFrame(
        [("a", "s", "m1", "t", None, 1), ("a", "s", "m2", "t", None, 2), ("b", "s", "", "", None, 3), ("c", "s", "", None, "bad", 4), ("e", "s", "", "t", None, 5)],
        RESULT,
    )
    scores = spark.createDataFrame([("z", "s", "")], "sample_id string, service_name string, model_name string")
    assert rows(store.pending_samples(samples, results, "s")) == [("d",)]  # an error counts as a result
    assert rows(store.pending_samples(samples, results, "s", "m1")) == [("b",), ("c",), ("d",), ("e",)]
    assert rows(store.missing_truth(samples, truth)) == [("e",)]
    assert rows(store.pending_scores(samples, results, truth, scores, "s")) == [("a",), ("b",)]  # '' stays in the queue
    assert store.pending_scores(samples, results, truth, scores, "s", strict=True).count() == 3
    kept, gone = store.delete_service(results, "s", "")
    assert kept.count() == 2 and gone.first()[0] == 3
    assert rows(store.services_present(results)) == [("s", "m1"), ("s", "m2"), ("s", None)]


def test_latest_keeps_every_key_and_decides_ties(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), (None, 2, "z"), ("b", None, "w")], "k string, n int, v string")
    assert rows(store.latest(df, ["k"], ["n", "v"])) == [("a", 1, "y"), ("b", None, "w"), (None, 2, "z")]


def test_import_and_overlay(spark):
    generated = spark.createDataFrame([("a", "gen a"), ("b", "gen b"), ("x", "gen x"), ("c", None)], "sample_id string, transcription string")
    samples = spark.createDataFrame([("a",), ("b",), ("c",)], "sample_id string")
    truth = spark.createDataFrame([("b", "old")], "sample_id string, text string")
    edits = spark.createDataFrame([("a", "edited")], "sample_id string, corrected_text string")
    got = rows(store.import_transcripts(generated, samples, truth, edits))
    assert got == [("a", "edited", "human", "gen a")]
    assert store.import_transcripts(generated, samples, truth, edits, force=True).count() == 2
    items = spark.createDataFrame([("i", ("A", "B"))], "id string, rec struct<given:string,surname:string>")
    fixes = spark.createDataFrame([("i", (None, "C"))], "id string, rec struct<given:string,surname:string>")
    assert store.overlay(items, "rec", fixes, "id").first().rec == ("A", "C")
    assert store.overlay(items, "rec", fixes.limit(0), "id").first().rec == ("A", "B")


def test_schemas_and_small_reads(spark):
    df = spark.createDataFrame([("a", 1)], "sample_id string, extra int")
    schema = T.StructType().add("sample_id", "string").add("model_name", "string")
    assert store.conform(df, schema).columns == ["sample_id", "model_name"]
    bad = store.violations(spark.createDataFrame([(None, 1), ("a", None)], "s string, n int"), ["s", "n"])
    assert sorted(r["__missing"] for r in bad.collect()) == [["n"], ["s"]]
    source, target = spark.createDataFrame([(1,)], "n int"), spark.createDataFrame([(2,)], "n int")
    assert rows(store.copy_if_empty(source, target)) == [(2,)]
    assert rows(store.copy_if_empty(source, target.limit(0))) == [(1,)]
    ids = spark.range(1000).select(F.col("id").cast("string").alias("sample_id"))
    found = store.by_prefix(ids, "99").collect()
    assert len(found) == 10 and {r.n_matches for r in found} == {11}
    assert store.seeded_slice(ids, "sample_id", 1, 10, 5).count() == 5
    one = spark.createDataFrame([("a", 1)], "id string, n int")
    assert rows(store.union_last([one, one.withColumn("n", F.lit(2))], ["id"])) == [("a", 2)]
    known, unknown = store.missing_services([" S ", "Q"], spark.createDataFrame([("s",)], "service_name string"), spark)
    assert rows(known) == [("s",)] and rows(unknown) == [("q",)]


def test_written_tables_go_with_their_scope(spark):
    from speechlytics.session import Written, written_scope

    outer = Written(spark.range(3), "outer")
    with written_scope():
        inner = Written(spark.range(2), "inner")
        assert inner.read().count() == 2
    with pytest.raises(Exception):  # noqa: B017
        inner.read().count()
    assert outer.read().count() == 3


def test_scans_and_runs(spark):
    from speechlytics.operators import store as S

    rows_ = spark.createDataFrame([("a", 2, None), ("b", 1, "m"), ("c", None, "")], "sample_id string, dataset_index int, model_name string").withColumn("service_name", F.lit("s"))
    assert [r.sample_id for r in S.first_samples(rows_, 2).collect()] == ["b", "a"]
    assert [r.sample_id for r in S.lookup(rows_, dataset_index=None).collect()] == ["c"]
    assert {r.sample_id for r in S.first_service(rows_, ["sample_id"]).collect()} == {"a", "c"}
    registry = spark.createDataFrame([("s", None), ("t", False)], "service_name string, available boolean")
    assert [r.service_name for r in S.available_services(registry, ["ALL"]).collect()] == ["s"]
    assert [r.service_name for r in S.available_services(registry, [" T"]).collect()] == ["t"]
    good, bad = S.quarantine(rows_, ["dataset_index"], {"model_name": ["m"]})
    assert {r.sample_id for r in good.collect()} == {"a", "b"} and [r.reason for r in bad.collect()] == ["dataset_index missing"]
    assert S.quarantine(rows_.limit(0), ["sample_id"], {})[1].isEmpty()
