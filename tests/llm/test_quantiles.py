import math
import random

import numpy as np
import pytest

from speechlytics.llm import quantiles as Q

SCHEMA = "service string, day string, x double, run int"


def data():
    rng = random.Random(9)
    rows = [("big", f"d{rng.randint(0, 2)}", rng.lognormvariate(0, 2), 0) for _ in range(3000)]
    rows += [("ties", "d0", float(rng.randint(0, 3)), 0) for _ in range(800)] + [("same", "d1", 7.0, 0)] * 500
    rows += [(None, None, float(k), 0) for k in range(5)] + [("none", "d0", None, 0)] * 3 + [("one", "d0", -1.5, 0)]
    rows += [("wild", "d0", x, 0) for x in (float("inf"), float("-inf"), 0.0, 1e-300, 5e300)]
    return rows


@pytest.mark.parametrize("leaf", [4096, 8])
def test_against_sorting(spark, monkeypatch, leaf):
    monkeypatch.setattr(Q, "LEAF", leaf)
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {(r.service, r.day): r for r in Q.daily_and_overall(df, ["service"], "day", "x").collect()}
    want = {}
    for s, d, x, _ in rows:
        if x is not None:
            want.setdefault((s, d), []).append(x)
            want.setdefault((s, "all"), []).append(x)
    assert got.keys() == want.keys()
    for k, values in want.items():
        values.sort()
        assert got[k].n == len(values)
        for p in Q.PERCENTILES:
            assert got[k][f"p{p}"] == values[(p * len(values) + 99) // 100 - 1], (k, p)


def test_runs_of_days_combine(spark):
    rows = data()
    parts = [spark.createDataFrame([r for r in rows if r[1] == d], SCHEMA) for d in ("d0", "d1", "d2")]
    runs = [Q.sorted_runs(p, ["service"], "x").read() for p in parts]
    both = Q.multi_select(runs[0].unionByName(runs[1]).unionByName(runs[2]), ["service"])
    one = Q.multi_select(Q.sorted_runs(spark.createDataFrame([r for r in rows if r[1]], SCHEMA), ["service"], "x").read(), ["service"])
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, one.collect()))


def test_nan_is_greatest_and_empty_is_empty(spark):
    df = spark.createDataFrame([("a", "d", float("nan"), 0), ("a", "d", 1.0, 0)], SCHEMA)
    got = Q.multi_select(Q.sorted_runs(df, ["service"], "x").read(), ["service"]).first()
    assert got.p50 == 1.0 and math.isnan(got.p99)
    assert Q.daily_and_overall(df.limit(0), ["service"], "day", "x").isEmpty()
    assert Q._weighted_median([(3.0, 1), (1.0, 5), (np.inf, 1)]) == 1.0


def test_searches_of_very_many_groups(spark, monkeypatch):
    monkeypatch.setattr(Q, "SENT", 0)
    monkeypatch.setattr(Q, "LEAF", 8)
    test_against_sorting(spark, monkeypatch, 8)
