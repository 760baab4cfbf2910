import math
import random
import statistics

from pyspark.sql import functions as F

from speechlytics.operators import judging
from tests.conftest import rows

RUN = "key string, repeat int, wer double, error_count int"


def test_repeats(spark):
    data = [("a", 0, 0.3, 3), ("a", 1, 0.1, 1), ("a", 2, 0.2, 2), ("b", 0, 0.1, 1), ("b", 1, None, None), ("c", 0, 0.5, 5), ("c", 1, 0.5, 5)]
    df = spark.createDataFrame(data, RUN)
    assert rows(judging.repeat_median(df, ["key"]).select("key", "wer", "repeat")) == [("a", 0.2, 2), ("c", 0.5, 1)]
    got = {r.key: r for r in judging.repeat_consistency(df, ["key"]).collect()}
    assert "b" not in got and got["c"].identical and not got["a"].identical
    assert math.isclose(got["a"].variance, statistics.pvariance([0.3, 0.1, 0.2]))
    noise = judging.judge_noise(judging.repeat_consistency(df, ["key"]).withColumn("e", F.col("key") == "a"), "e")
    value = judging.service_noise(noise, "e", F.lit(0.5)).first()[0]
    assert math.isclose(value, 1.96 * math.sqrt(0.5 * statistics.pvariance([0.3, 0.1, 0.2]) / 1000))


def test_bootstrap_interval_covers_the_mean(spark):
    rng = random.Random(2)
    data = [(i, rng.gauss(0.5, 1.0)) for i in range(400)]
    df = spark.createDataFrame(data, "key int, d double").withColumn("part", F.lit("all"))
    got = judging.bootstrap_mean(df, "key", "d", ["part"], draws=300).first()
    mean, se = statistics.mean(d for _, d in data), statistics.stdev(d for _, d in data) / 20
    assert math.isclose(got["mean"], mean)
    assert 1.5 * se < mean - got.low < 2.6 * se and 1.5 * se < got.high - mean < 2.6 * se
    hashes = spark.range(20000).select(judging.key_hash(F.col("id")).alias("h")).toPandas()["h"].to_numpy()
    weights = judging.poisson_weights(hashes, 3)[:, 1]
    m, v = weights.mean(), weights.var()
    assert abs(m - 1) < 0.03 and abs(v - 1) < 0.06


def test_sampling_and_ranking(spark):
    df = spark.createDataFrame([(f"k{i}", i % 3) for i in range(60)], "key string, errors int")
    drawn = judging.stratified_sample(df, "key", F.col("errors") > 0, 11, 1)
    assert rows(drawn.groupBy("stratum").count()) == [(False, 6), (True, 5)]
    assert judging.first_of_each(df, "errors", ["key"], 2).count() == 6
    pairs = spark.createDataFrame([("s", "x", 1, 5), ("s", "y", 3, 3), ("s", "z", 2, 0)], "service_name string, sample_id string, stored_error_count int, new_error_count int")
    assert [r.sample_id for r in judging.disagreements(pairs, 5).collect()] == ["x", "z"]


def test_guards(spark):
    df = spark.createDataFrame([("s", "j"), ("s", None), ("t", "j")], "service_name string, judge string")
    assert rows(judging.mixed_judges(df, "j")) == [("s", True), ("t", False)]
    assert rows(judging.judge_counts(df)) == [("j", 2), (None, 1)]
    log = spark.createDataFrame([("j", "k", 0, "old", 1), ("j", "k", 0, "new", 2), ("j", "k", 0, None, 3), ("i", "k", 0, "x", 4)], "judge string, key string, repeat int, result string, n int")
    assert [r.result for r in judging.usable_judgments(log, "j", ["n"]).collect()] == ["new"]
    assert spark.range(1).select(judging.judge_label("m", None, 3, "rules")).first()[0].startswith("m effort=none repeats=3 rev=")


def test_offline_judge(spark):
    df = spark.createDataFrame([("a b c", "a x c d"), ("", "x"), (None, None)], "r string, h string")
    got = [r[0] for r in df.select(judging.offline_judge(F.col("r"), F.col("h"))).collect()]
    assert [e.type for e in got[0]] == ["substitution", "insertion"] and [e.type for e in got[1]] == ["insertion"] and got[2] == []
