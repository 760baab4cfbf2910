import random

import numpy as np
from pyspark.sql import functions as F

from speechlytics.llm import components, spans
from tests.conftest import rows

LEAST, SHINGLE = 40, 28


def brute_runs(texts):
    """Maximal common runs of pairs, by comparing every diagonal."""
    found = []
    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            s, t = texts[a] or "", texts[b] or ""
            for shift in range(-len(s) + 1, len(t)):
                i = max(0, -shift)
                run = 0
                while i < len(s) and i + shift < len(t):
                    run = run + 1 if s[i] == t[i + shift] else 0
                    i += 1
                    more = i < len(s) and i + shift < len(t) and s[i] == t[i + shift]
                    if run >= LEAST and not more:
                        found.append((a, b, i - run, i - run + shift, run))
    return found


def corpus():
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh ü€😀") for _ in range(n))
    shared = [word(n) for n in (39, 40, 41, 60, 150)]
    texts = {k: word(rng.randint(0, 120)) + rng.choice(shared) + word(30) + rng.choice(shared) + word(rng.randint(0, 60)) for k in range(25)}
    texts |= {100: shared[4], 101: shared[4], 102: None, 103: "", 104: "x" * 200, 105: "y" + "x" * 90, 106: shared[1][:-1]}
    return texts


def test_pairs_runs_and_amounts_against_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("gram", F.lit(1)).repartition(3)
    want = brute_runs(texts)
    assert rows(spans.sharing_pairs(df, LEAST, SHINGLE)) == sorted({(a, b) for a, b, *_ in want}, key=repr)
    # A text of one letter repeats itself at every shift; elsewhere runs are unique.
    plain = lambda r: r[0] < 104 and r[1] < 104
    assert [r for r in rows(spans.shared_runs(df, LEAST, SHINGLE)) if plain(r)] == sorted(filter(plain, want), key=repr)
    covered = {k: set() for k in texts}
    for a, b, i, j, n in want:
        covered[a] |= set(range(i, i + n))
        covered[b] |= set(range(j, j + n))
    got = {r.doc_id: r for r in spans.shared_amount(df, LEAST, SHINGLE).collect()}
    assert {k: r.shared_chars for k, r in got.items()} == {k: len(v) for k, v in covered.items()}
    assert got[102].n_chars == 0 and got[103].class_id == 103 and got[105].class_id == 104


def test_hashes_do_not_depend_on_the_place(spark):
    codes = np.frombuffer(("abc" * 50 + "zz" + "abc" * 50).encode("utf-32-le"), np.uint32)
    h = spans.shingle_hashes(codes, 30)
    assert h[0] == h[3] == h[152] and h[0] != h[1]
    values = np.random.default_rng(0).integers(0, 1 << 60, 100).astype(np.uint64)
    assert (spans.sliding_minimum(values, 7) == [min(values[i : i + 7]) for i in range(94)]).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spans.sharing_pairs(none).isEmpty() and spans.shared_amount(none).isEmpty()


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5), (None, 1)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "u long, v long")
    assert rows(components.connected_components(df)) == sorted(((i, find(i)) for i in root), key=repr)
    assert components.connected_components(df.limit(0)).isEmpty()


def test_one_notice_in_very_many_records(spark):
    rng = random.Random(3)
    notice = "".join(rng.choice("abcdefghij") for _ in range(150))
    own = lambda n: "".join(rng.choice("klmnopqrst") for _ in range(n))
    texts = [(k, own(rng.randint(0, 60)) + notice + own(rng.randint(0, 60))) for k in range(5000)] + [(9000, own(300))]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in spans.shared_amount(df, LEAST, SHINGLE).collect()}
    assert len(got) == 5001 and got[9000].shared_chars == 0 and got[9000].class_id == 9000
    # Neighbouring letters may agree by chance, so some records share a little more than the notice.
    assert all(r.class_id == 0 and 150 <= r.shared_chars <= 162 for k, r in got.items() if k < 5000)
    assert sum(r.n_links for r in got.values()) < 100 * len(got)
