import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from speechlytics.llm import packing as P

tokenizers = pytest.importorskip("tiktoken")


@pytest.mark.parametrize("capacity", [16, 256, 1000])
@pytest.mark.parametrize("count", [1, 37])
def test_plans_hold_exactly_the_items(capacity, count):
    rng = random.Random(capacity)
    for scale in (0.1, 0.4, 0.9):
        sizes = Counter(max(1, min(capacity - 1, int(rng.gauss(capacity * scale, capacity / 6)))) for _ in range(400))
        histogram = Counter({s: n * count for s, n in sizes.items()})
        plan = P.plan_packing(histogram, capacity)
        held = Counter()
        for repeat, pattern in plan.rows:
            assert repeat > 0 and sum(pattern) <= capacity
            for s in pattern:
                held[s] += repeat
        assert held == histogram
        boxes, total = sum(r for r, _ in plan.rows), sum(s * n for s, n in histogram.items())
        over_half = sum(n for s, n in histogram.items() if 2 * s > capacity)
        assert boxes <= 1.04 * max(over_half, total / capacity) + 2
    assert P.plan_packing(Counter(), capacity).rows == []


def test_least_squares():
    patterns = np.array([[0, 1, -1], [0, 0, 2], [2, 2, -1]])
    x = P.nonnegative_least_squares(patterns, np.array([30.0, 10.0, 10.0]), 3000)
    assert np.allclose(x, [10, 10, 0], atol=0.2)


def test_packings(spark):
    rng = random.Random(6)
    texts = [(k, " ".join(rng.choice(["tea", "sugar", "lemonade", "x"]) for _ in range(rng.choice([0, 1, 5, 20, 30, 63, 64, 65, 200])))) for k in range(300)]
    texts += [(1000, None), (1001, ""), (1002, "<|endoftext|> is text"), (1003, "word " * 1000)] + [(2000 + k, "same length here") for k in range(150)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    kinds = spark.createDataFrame([("small", 64), ("large", 500), ("bad", 0), (None, None)], "container_kind string, capacity_tokens int")
    lengths = {r.doc_id: r.n_tokens for r in P.token_lengths(df).collect()}
    assert lengths[1000] == lengths[1001] == 0 and lengths[1002] > 3
    got = P.packings(df, kinds).collect()
    for kind, capacity in (("small", 64), ("large", 500)):
        mine = [r for r in got if r.container_kind == kind]
        load, parts = Counter(), defaultdict(list)
        for r in mine:
            load[r.container_id] += r.n_tokens
            parts[r.doc_id].append((r.part, r.first_token, r.n_tokens, r.container_id))
        assert parts.keys() == lengths.keys() and load.pop(0) == 0
        assert max(load.values()) <= capacity and sorted(load) == list(range(1, len(load) + 1))
        for doc, pieces in parts.items():
            pieces.sort()
            assert sum(n for _, _, n, _ in pieces) == lengths[doc]
            assert len(pieces) == max(1, -(-lengths[doc] // capacity))  # only longer documents are split
            assert [f for _, f, _, _ in pieces] == [k * capacity for k in range(len(pieces))]
        assert sum(load.values()) / (len(load) * capacity) > 0.93
    report = {r.container_kind: r for r in P.fill_report(P.packings(df, kinds), kinds).collect()}
    assert report.keys() == {"small", "large"} and report["large"].n_tokens == sum(lengths.values())
    assert P.packings(df.limit(0), kinds).isEmpty() and P.packings(df, kinds.limit(0)).isEmpty()
