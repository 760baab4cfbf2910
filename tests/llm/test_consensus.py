import numpy as np

from speechlytics.llm import consensus

SCHEMA = "item string, annotator string, repeat int, label int, service string"


def simulated(n=900, seed=0):
    """Items of two kinds with true labels 0-3; good, biased, random and copying annotators."""
    rng = np.random.default_rng(seed)
    kind = rng.integers(0, 2, n)
    true = np.where(kind == 0, rng.choice(4, n, p=[0.7, 0.2, 0.05, 0.05]), rng.choice(4, n, p=[0.1, 0.3, 0.3, 0.3]))
    labels = []
    copied = {}
    for name, right in (("good", 0.9), ("fair", 0.75), ("fair2", 0.75), ("low", None), ("noise", 0.25), ("copy", None)):
        for i in np.flatnonzero(rng.random(n) < 0.6):
            if name == "low":
                label = true[i] if rng.random() < 0.3 else 0
                copied[i] = label
            elif name == "copy":
                label = copied.get(i, 0) if rng.random() < 0.97 else rng.integers(4)
            else:
                label = true[i] if rng.random() < right else rng.integers(4)
            for repeat in range(rng.integers(1, 3)):
                labels.append((f"k{i}", name if name != "fair2" else None, repeat, int(label), f"s{kind[i]}"))
    return {f"k{i}": int(t) for i, t in enumerate(true)}, labels


def test_consensus_beats_the_vote(spark):
    true, labels = simulated()
    df = spark.createDataFrame(labels + labels[:200], SCHEMA)  # rows written twice
    fitted = consensus.fit_consensus(df, ["service"])
    got = {r["item"]: r for r in fitted.items().collect()}
    assert got.keys() == {i for i, *_ in labels}
    votes = {}
    for i, _, _, label, _ in labels:
        votes.setdefault(i, []).append(label)
    by_vote = np.mean([max(sorted(set(v)), key=v.count) == true[i] for i, v in votes.items()])
    by_fit = np.mean([r.label == true[i] for i, r in got.items()])
    assert by_fit > by_vote + 0.08 and by_fit > 0.82
    assert all(0 <= r.agreement <= 1 and 0 < r.confidence <= 1 for r in got.values())
    judges = {r.annotator: r for r in fitted.annotators().collect()}
    assert judges["good"].reliability > judges[None].reliability > judges["noise"].reliability
    assert judges["low"].bias < -0.3 and abs(judges["good"].bias) < 0.1
    assert {judges["low"].dependent_on, judges["copy"].dependent_on} & {"low", "copy"}


def test_the_classifier_helps_where_votes_are_few(spark):
    true, labels = simulated(seed=3)
    thin = [x for x in labels if x[1] in (None, "noise")]
    df = spark.createDataFrame(thin, SCHEMA)
    score = lambda c: np.mean([r.label == true[r["item"]] for r in consensus.fit_consensus(df, c).items().collect()])
    assert score(["service"]) >= score([])


def test_small_and_odd_inputs(spark):
    assert consensus.fit_consensus(spark.createDataFrame([], SCHEMA)) is None
    df = spark.createDataFrame([("a", "j", 0, 3, None), ("a", "j", 0, 3, None), (None, "j", 0, 1, None), ("b", None, 0, None, None), ("c", None, 0, 90, "s")], SCHEMA)
    got = {r["item"]: (r.label, r.agreement, r.n_annotators) for r in consensus.fit_consensus(df, ["service"]).items().collect()}
    assert got == {"a": (3, 1.0, 1), "c": (90, 1.0, 1)}


def test_many_label_values(spark):
    data = [(f"k{v}", j, 0, v, "s") for v in range(80) for j in ("a", "b", "c")]
    got = {r["item"]: r.label for r in consensus.fit_consensus(spark.createDataFrame(data, SCHEMA)).items().collect()}
    assert len(got) == 80 and got["k79"] == 79 and got["k3"] == 3


def many_labels(n=4000, k=60, seed=4):
    """Labels 0 to 59 by one good, one fair and one noisy annotator, and 40 that judged a few items each."""
    rng = np.random.default_rng(seed)
    true = rng.integers(0, k, n)
    rows = []
    for name, right in (("good", 0.95), ("fair", 0.7), ("noise", 0.2), *((f"few{j}", 0.8) for j in range(40))):
        for i in np.flatnonzero(rng.random(n) < (0.7 if not name.startswith("few") else 0.02)):
            rows.append((f"k{i}", name, 0, int(true[i]) if rng.random() < right else int(rng.integers(k)), "s"))
    return true, rows


def test_sixty_labels_and_every_annotator(spark):
    true, rows_ = many_labels()
    fitted = consensus.fit_consensus(spark.createDataFrame(rows_, SCHEMA))
    got = {r["item"]: r.label for r in fitted.items().collect()}
    assert set(got.values()) == set(range(60))
    assert np.mean([true[int(i[1:])] == x for i, x in got.items() if i in {r[0] for r in rows_ if r[1] == "good"}]) > 0.93
    judges = {r.annotator: r.reliability for r in fitted.annotators().collect()}
    assert len(judges) == 43 and abs(judges["good"] - 0.95) < 0.08 and abs(judges["fair"] - 0.7) < 0.08 and judges["noise"] < 0.3


def test_the_state_in_tables_gives_the_same(spark):
    true, labels = simulated(400)
    df = spark.createDataFrame(labels, SCHEMA)
    here = consensus.fit_consensus(df, ["service"], warm=0)
    there = consensus.fit_consensus(df, ["service"], local_cells=0, warm=0)
    assert there.fit.sharded and not here.fit.sharded
    a, b = ({r["item"]: r for r in f.items().collect()} for f in (here, there))
    assert a.keys() == b.keys() and all(abs(a[i].confidence - b[i].confidence) < 1e-6 and a[i].label == b[i].label for i in a)
    a, b = ({r.annotator: r for r in f.annotators().collect()} for f in (here, there))
    assert a.keys() == b.keys() and all(abs(a[j].reliability - b[j].reliability) < 1e-6 and a[j].dependent_on == b[j].dependent_on for j in a)


def test_reliability_weighs_labels_as_they_occur(spark):
    rng = np.random.default_rng(5)
    true = rng.choice(3, 1500, p=[0.8, 0.15, 0.05])
    rows_ = [(f"k{i}", j, 0, int(t), "s") for i, t in enumerate(true) for j in ("a", "b", "c")]
    rows_ += [(f"k{i}", "zero", 0, 0, "s") for i in range(1500)]  # right wherever the truth is 0
    judges = {r.annotator: r for r in consensus.fit_consensus(spark.createDataFrame(rows_, SCHEMA)).annotators().collect()}
    assert abs(judges["zero"].reliability - np.mean(true == 0)) < 0.02 and judges["a"].reliability > 0.98
    assert abs(judges["zero"].bias + true.mean()) < 0.03


def test_agreement_beyond_chance(spark):
    rows_ = [("a", j, 0, 1, "s") for j in ("x", "y", "z")] + [("b", "x", 0, 1, "s"), ("b", "y", 0, 2, "s"), ("c", "x", 0, 2, "s")]
    got = {r["item"]: r for r in consensus.fit_consensus(spark.createDataFrame(rows_, SCHEMA)).items().collect()}
    assert got["a"].agreement == got["a"].corrected == 1.0 and got["b"].agreement == 0.0
    assert got["b"].corrected < -0.5 and got["c"].agreement == 1.0 and got["c"].corrected is None
