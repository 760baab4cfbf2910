import math
import random
import statistics

from pyspark.sql import functions as F

from speechlytics.operators import leaderboard, stats
from tests.conftest import rows


def test_order_statistics_against_sorting(spark):
    rng = random.Random(3)
    data = [("a", round(rng.gauss(0, 1), 2)) for _ in range(301)] + [("b", 1.0)] * 7 + [("c", None)]
    data += [(None, x) for x in (2.0, -1.0, 0.0, 1e13, -1e-12)] + [("d", float("nan")), ("d", 1.0)]
    df = spark.createDataFrame(data, "k string, x double")
    at = {"low": "0", "mid": "n div 2", "high": "n - 1", "beyond": "n"}
    got = {r.k: r for r in stats.order_statistics(df, ["k"], "x", at).collect()}
    assert "c" not in got
    for k in ("a", "b", None):
        values = sorted(x for g, x in data if g == k and x is not None)
        assert (got[k].n, got[k].low, got[k].mid, got[k].high) == (len(values), values[0], values[len(values) // 2], values[-1])
        assert got[k].beyond is None
    assert got["d"].low == 1.0 and math.isnan(got["d"].high)


def test_three_definitions_of_a_percentile(spark):
    for values in ([5.0], [1.0, 2.0], [1.0, 2.0, 3.0, 10.0], [float(x) for x in range(100)]):
        df = spark.createDataFrame([("g", v) for v in values], "k string, x double")
        n = len(values)
        linear = stats.linear_percentiles(df, ["k"], "x", [50, 95]).first()
        rank = stats.rank_percentiles(df, ["k"], "x").first()
        i = 0.95 * (n - 1)
        low = int(i)
        expected = values[low] + (i - low) * (values[min(low + 1, n - 1)] - values[low])
        assert math.isclose(linear.p95, expected) and math.isclose(linear.p50, statistics.median(values))
        assert rank.median == values[n // 2] and rank.p95 == values[min(int(n * 0.95), n - 1)]


def test_latency_statistics(spark):
    data = [
        ("s", 0.2, None, 1.0, "a"), ("s", 0.4, None, 3.0, ""), ("s", 9.0, "bad", 3.0, "b"), ("s", None, None, 6.0, None),
        ("t", None, "bad", 1.0, None), ("u", 0.0, None, 12.0, "x"),
    ]
    df = spark.createDataFrame(
        data, "service_name string, ttfb_seconds double, error string, audio_duration_seconds double, transcription string"
    )
    got = {r.service_name: r for r in stats.latency_statistics(df, ["service_name"]).collect()}
    assert (got["s"].num_samples, got["s"].num_errors, got["s"].ttfb_max) == (4, 1, 0.4)
    assert math.isclose(got["s"].ttfb_mean, 0.3) and math.isclose(got["s"].ttfb_std, statistics.stdev([0.2, 0.4]))
    assert got["t"].ttfb_mean is None and got["t"].ttfb_std is None
    assert got["u"].ttfb_std == 0.0
    assert rows(stats.latency_by_duration(df, ["service_name"]).select("service_name", "bucket")) == [
        ("s", "0-2s"), ("s", "2-5s"), ("u", "10s+"),
    ]
    runs = {r.service_name: r for r in stats.transcript_stats(df, ["service_name"]).collect()}
    assert (runs["s"].successful_transcripts, runs["s"].failed_transcripts) == (2, 2)
    assert runs["u"].ttfb_median == 0.0  # a latency of 0 does not count here


def test_histogram_keeps_empty_buckets(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (0.051,), (math.inf,), (None,)], "wer double")
    got = stats.wer_histogram(df, "wer").orderBy("ordinal").collect()
    assert [r.n for r in got] == [1, 1, 1, 0, 0, 1]


def test_infinite_rates(spark):
    schema = "k string, wer double, substitutions int, deletions int, insertions int, reference_words int"
    df = spark.createDataFrame([("a", 0.5, 1, 0, 0, 2), ("a", math.inf, 0, 0, 2, 0), ("b", math.inf, 0, 0, 1, 0)], schema)
    by = lambda p: {r.k: r for r in stats.wer_statistics(df, ["k"], p).collect()}
    assert (by("pooled_only")["a"].wer_mean, by("pooled_only")["a"].pooled_wer) == (0.5, 1.5)
    assert by("everywhere")["a"].wer_mean == math.inf
    assert by("nowhere")["a"].pooled_wer == 0.5 and "b" not in by("nowhere")
    assert by("pooled_only")["b"].pooled_wer == 0.0


def test_pareto_against_brute_force(spark):
    rng = random.Random(1)
    for size in (0, 1, 40):
        points = [(i, float(rng.randint(0, 9)), float(rng.randint(0, 9))) for i in range(size)] + [(99, None, 1.0)]
        df = spark.createDataFrame(points, "i int, x double, y double")
        held = [p for p in points if p[1] is not None]
        best = {
            p[0] for p in held
            if not any(q[1] <= p[1] and q[2] <= p[2] and (q[1] < p[1] or q[2] < p[2]) for q in held)
        }
        assert {r.i for r in leaderboard.pareto_frontier(df, "x", "y").collect()} == best


def test_labels_and_medals(spark):
    df = spark.createDataFrame([("A", "x"), ("A", "y"), ("A", "N/A"), ("B", "z")], "vendor string, model string")
    got = sorted(r.label for r in leaderboard.display_labels(df, "vendor", "model").collect())
    assert got == ["A", "A x", "A y", "B"]
    ranks = spark.createDataFrame([(1,), (4,), (None,)], "r int").select(leaderboard.medal(F.col("r")))
    assert [r[0] for r in ranks.collect()] == ["🥇", "4.", None]
