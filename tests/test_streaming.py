from datetime import datetime, timedelta

from pyspark.sql import functions as F

from speechlytics.streaming import segments as S
from tests.conftest import rows

T0 = datetime(2025, 1, 1, 12)
SCHEMA = "sample_id string, attempt int, seq int, ts timestamp, text string"


def at(sample, attempt, *pairs):
    return [(sample, attempt, k, T0 + timedelta(seconds=s), t) for k, (s, t) in enumerate(pairs)]


DATA = (
    at("three", 0, (0.0, "a"), (0.1, "b"), (0.9, "c"))
    + at("again", 0, (0.0, "old"))
    + at("again", 1, (5.0, "new"))
    + at("inside", 0, (0.0, "a"), (1.5, "b"))
    + at("exact", 0, (0.0, "a"), (2.0, "lost"))
    + at("over", 0, (0.0, "a"), (2.1, "lost"), (2.2, "lost too"))
    + at("cap", 0, *[(1.9 * k, str(k)) for k in range(8)])
)
WANT = {"three": "a b c", "again": "new", "inside": "a b", "exact": "a", "over": "a", "cap": "0 1 2 3 4 5"}


def test_batch_collection(spark):
    df = spark.createDataFrame(DATA, SCHEMA)
    got = {r.sample_id: r.transcription for r in S.collect_segments(df).collect()}
    assert got == WANT
    starts = spark.createDataFrame([("three", T0 - timedelta(seconds=9.5))], "sample_id string, silence_start timestamp")
    capped = {r.sample_id: r.transcription for r in S.collect_segments(df, starts).collect()}
    assert capped["three"] == "a b" and capped["inside"] == "a b"
    assert S.collect_segments(df.limit(0)).isEmpty()


def test_latency_and_metrics(spark):
    df = spark.createDataFrame(at("s", 0, (0.0, "a"), (0.4, "b"), (0.8, "c")), SCHEMA)
    stops = spark.createDataFrame([("s", T0, 0.2)], "sample_id string, vad_ts timestamp, stop_secs double")
    assert round(S.time_to_final(S.collect_segments(df), stops).first().ttfs, 3) == 1.0
    metrics = spark.createDataFrame([("s", T0, 0.0), ("s", T0 + timedelta(seconds=1), 0.3), ("s", T0 + timedelta(seconds=2), 0.0)], "sample_id string, ts timestamp, value double")
    assert rows(S.last_metric(metrics)) == [("s", 0.3)]
    samples = spark.createDataFrame([("s", "a.pcm"), ("t", "t.pcm"), ("u", None)], "sample_id string, audio_path string")
    got = {r.sample_id: (r.transcription, r.ttfb, r.error) for r in S.sample_results(samples, S.collect_segments(df), metrics).collect()}
    assert got == {"s": ("a b c", 0.3, None), "t": (None, None, None), "u": (None, None, "audio file missing")}


def test_stream_equals_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(DATA, SCHEMA).coalesce(1).write.parquet(source)
    flush = spark.createDataFrame(at("flush", 0, (600.0, "x")), SCHEMA).coalesce(1)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    query = S.run_collection(stream, out, str(tmp_path / "ck"))
    try:
        query.processAllAvailable()
        for k in range(2):  # later events move the watermark past the open collections
            flush.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {k * 60} SECONDS")).write.mode("append").parquet(source)
            query.processAllAvailable()
    finally:
        query.stop()
    got = {r.sample_id: r.transcription for r in S.read_sink(spark, out).collect()}
    got.pop("flush", None)
    assert got == WANT


def test_sink_is_idempotent(spark, tmp_path):
    write = S.sink_upsert(str(tmp_path / "t"), ["k"], ["n"])
    one = spark.createDataFrame([("a", 1), ("b", 1)], "k string, n int")
    write(one, 0)
    write(spark.createDataFrame([("a", 2)], "k string, n int"), 1)
    write(spark.createDataFrame([("a", 2)], "k string, n int"), 1)
    assert rows(S.read_sink(spark, str(tmp_path / "t"))) == [("a", 2), ("b", 1)]


def streamed(spark, tmp_path, batches, with_starts=False):
    """The sink after every list of rows was a micro-batch of its own."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write = lambda data: spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(source)
    query = S.run_collection(spark.readStream.schema(SCHEMA).parquet(source), out, str(tmp_path / "ck"), with_starts)
    try:
        later = [at("flush", k, (8000.0 + 60 * k, "x")) for k in range(2)]
        for data in [*batches, *later]:
            write(data)
            query.processAllAvailable()
    finally:
        query.stop()
    found = S.read_sink(spark, out)
    return {r.sample_id: r.transcription for r in found.collect() if r.sample_id != "flush"} if found else {}


def test_each_segment_a_batch_of_its_own(spark, tmp_path):
    data = [*DATA, *at("other", 0, (100.0, "between")), *[("three", 0, 9, T0 + timedelta(seconds=205), "late")]]
    data.sort(key=lambda r: (r[3], r[0]))
    batch = {r.sample_id: r.transcription for r in S.collect_segments(spark.createDataFrame(data, SCHEMA)).collect()}
    assert batch == WANT | {"other": "between"}
    assert streamed(spark, tmp_path, [[r] for r in data]) == batch


def test_an_old_attempt_does_not_come_back(spark, tmp_path):
    second, first = at("s", 2, (0.0, "second")), at("s", 1, (30.0, "first"))
    between = [at("t", 0, (60.0, "x")), at("t", 1, (90.0, "y"))]
    assert streamed(spark, tmp_path, [second, first, *between])["s"] == "second"


def test_start_of_the_silence(spark, tmp_path):
    # Segments before the silence do not close it; from its start gaps count, and the cap.
    said = at("s", 0, (-6.0, "a"), (-3.0, "b"), (1.9, "c"), (3.95, "lost")) + at("t", 0, (9.5, "a"), (9.9, "b"), (10.5, "lost"))
    said += at("u", 0, (10.5, "lost"))
    begins = [(k, T0) for k in "stu"]
    starts = spark.createDataFrame(begins, "sample_id string, silence_start timestamp")
    batch = {r.sample_id: r.transcription for r in S.collect_segments(spark.createDataFrame(said, SCHEMA), starts).collect()}
    assert batch == {"s": "a b c", "t": "a b"}
    events = sorted(said + [(k, 0, -1, at_, None) for k, at_ in begins], key=lambda r: (r[3], r[0]))
    assert streamed(spark, tmp_path, [[r] for r in events], True) == batch


def test_waiting(spark):
    metrics = spark.createDataFrame([("s", T0 + timedelta(seconds=k), v, o) for k, v, o in ((1, 0.5, "stt"), (13, 0.9, "stt"), (2, 0.7, "vad"))], "sample_id string, ts timestamp, value double, source string")
    starts = spark.createDataFrame([("s", T0)], "sample_id string, silence_start timestamp")
    samples = spark.createDataFrame([("s", "s.pcm")], "sample_id string, audio_path string")
    none = spark.createDataFrame([], S.COLLECTED)
    own = S.from_source(metrics, "stt")
    assert S.sample_results(samples, none, own, starts).first().ttfb == 0.5 and S.sample_results(samples, none, own).first().ttfb == 0.9
    assert rows(S.from_source(metrics, "vad").select("value")) == [(0.7,)]


def test_fixed_silence(spark):
    df = spark.createDataFrame(at("s", 0, (0.05, "a"), (0.2, "lost")), SCHEMA)
    starts = spark.createDataFrame([("s", T0)], "sample_id string, silence_start timestamp")
    assert S.collect_segments(df, starts, cap=S.FALLBACK).first().transcription == "a"


def test_a_batch_costs_what_it_holds_and_compaction_keeps_the_result(spark, tmp_path):
    path = str(tmp_path / "t")
    write = S.sink_append(path, ["k"], ["n"])
    for epoch, data in enumerate([[("a", 2)], [("a", 1), ("b", 1)], [("a", 2), ("c", 5)]]):
        write(spark.createDataFrame(data, "k string, n int"), epoch)
    assert rows(spark.read.parquet(f"{path}/epoch=1")) == [("a", 1), ("b", 1)]
    assert rows(S.read_sink(spark, path)) == [("a", 2), ("b", 1), ("c", 5)]
    S.compact_sink(spark, path)
    assert rows(S.read_sink(spark, path)) == [("a", 2), ("b", 1), ("c", 5)] and len(list((tmp_path / "t").glob("epoch=*"))) == 1
