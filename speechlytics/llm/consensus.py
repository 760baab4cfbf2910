"""Consensus from several annotators' labels.

Method: feature-assisted consensus. Expectation-maximisation jointly fits a regularised softmax classifier on item
features and one confusion matrix an annotator; the classifier's output is the prior of an item's label. Repeats of
one annotator on one item share a weight of 1. Annotators that agree with each other more than their matrices
explain are found on the way; where several of such a group judged an item, they share one vote.

Every label is a class and every annotator has a matrix of its own. All state is sparse: a matrix has a cell for each
(annotator, truth, label) that some item supports, an item's candidates are the truths that its votes have cells for,
and features are 64-bit hashes of their values. A round is one pass over the items, packed one row each in a table of
the shared folder, and a sum by cell. Up to LOCAL_CELLS cells, the sums go to the driver and the state to every task;
beyond that both stay tables: the items are split in shards, and each shard is joined with the cells of its own
annotators, labels and features (``sharded``). Both ways give the same numbers.

The rounds begin from a fit to a bounded sample of items (WARM, on the driver) and end on all items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechlytics.llm.components import connected_components
from speechlytics.session import Written

#: (annotator, label) pairs times labels up to which the state may be held by the driver and by every task.
LOCAL_CELLS = 400_000
#: Items of the sample that the fit begins with, and the most votes of an item in it.
WARM, WARM_VOTES = 20_000, 64
#: Items of a shard where the state is kept in tables.
SHARD = 100_000
#: Rounds on the sample before and after dependent annotators are known, and at most on all items.
FIRST_ROUNDS, NEXT_ROUNDS, ROUNDS = 6, 24, 10
#: Share of the votes' mass that may still move between cells when the rounds end.
STILL = 2e-3
#: Excess agreement, as a share of what is possible, from which annotators count as dependent, its least basis, and how
#: many standard deviations it must be (perfect annotators agree too).
DEPENDENT, LEAST_TOGETHER, SIGMAS = 0.5, 30, 4.0
#: Posteriors under this give no cells.
FAINT = 1e-6

CELL, POOL, WEIGHT, GROUP, CURVE, MASS = range(6)
_STATE = "kind int, a bigint, b bigint, c bigint, v double, w double"
_COLUMNS = ["kind", "a", "b", "c", "v", "w"]


def packed_items(labels: DataFrame, categories: list[str], numbers: list[str]) -> DataFrame:
    """One row an item: (item, j, l, n, f, x), the votes (annotator, label, number of repeats) and the features.

    Rows that repeat (item, annotator, repeat, label) count once. NULL items and labels are left out; a NULL
    annotator is an annotator of its own, a NULL category a value of its own, a NULL number 0.
    """
    clean = labels.filter(F.col("item").isNotNull() & F.col("label").isNotNull())
    carried = [*(F.min(c).alias(c) for c in categories), *(F.avg(c).alias(c) for c in numbers)]
    once = clean.groupBy("item", "annotator", "repeat", "label").agg(*carried, F.lit(1).alias("one"))
    votes = once.groupBy("item", "annotator", "label").agg(F.count("one").cast("double").alias("n"), *carried)
    vote = F.struct(annotator_id("annotator").alias("j"), F.col("label").cast("long").alias("l"), "n")
    names = [F.xxhash64(F.lit(c), F.coalesce(F.min(c).cast("string"), F.lit("\0"))) for c in categories]
    sizes = [F.coalesce(F.avg(c).cast("double"), F.lit(0.0)) for c in numbers]
    return votes.groupBy("item").agg(
        F.sort_array(F.collect_list(vote)).alias("v"),
        F.array(F.lit(0).cast("long"), *names, *(F.xxhash64(F.lit(c)) for c in numbers)).alias("f"),
        F.array(F.lit(1.0), *(F.lit(1.0) for _ in categories), *sizes).alias("x"),
    ).select("item", F.col("v.j").alias("j"), F.col("v.l").alias("l"), F.col("v.n").alias("n"), "f", "x")


def annotator_id(name: str | Column) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.xxhash64(F.coalesce(F.concat(F.lit("="), name.cast("string")), F.lit("")))


def _numbered(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place of each value in a sorted list; len(known) for those that are not in it."""
    if not len(known):
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, len(known))


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, back = np.unique(keys, return_inverse=True)
    return one, np.bincount(back, values, len(one))


class Model:
    """The fitted state as sorted keys with values; absent cells are smoothed by the pooled matrix."""

    def __init__(self, state: pd.DataFrame, classes: int, smooth: float):
        part = {k: state[state["kind"] == k] for k in (CELL, POOL, WEIGHT, GROUP)}
        cell, pool, weight, group = (
            tuple(part[k][c].to_numpy() for c in _COLUMNS[1:]) for k in (CELL, POOL, WEIGHT, GROUP)
        )
        self.smooth, self.classes, self.started = smooth, classes, len(cell[0]) > 0
        self.labels = np.unique(np.concatenate([cell[1], cell[2], pool[0], pool[1]]).astype(np.int64))
        self.judges = np.unique(cell[0].astype(np.int64))
        k = self.k = max(1, len(self.labels))
        label = lambda x: np.searchsorted(self.labels, x)
        judge = np.searchsorted(self.judges, cell[0])
        truth, said = label(cell[1]), label(cell[2])
        self.cells, self.counts = _sums((judge * k + said) * k + truth, cell[3])
        self.rows, self.row_counts = _sums(judge * k + truth, cell[3])
        self.pool, self.pool_counts = _sums(label(pool[1]) * k + label(pool[0]), pool[3])
        self.total = np.zeros(k)
        np.maximum.at(self.total, label(pool[1]), pool[4])
        np.maximum.at(self.total, truth, cell[4])
        self.features = np.unique(weight[0].astype(np.int64))
        self.weights, self.weight_values = _sums(np.searchsorted(self.features, weight[0]) * k + label(weight[1]), weight[3])
        order = np.argsort(group[0])
        self.grouped, self.roots = group[0][order].astype(np.int64), group[1][order].astype(np.int64)

    def log_chance(self, judge: np.ndarray, truth: np.ndarray, said: np.ndarray) -> np.ndarray:
        """The logarithm of the chance that an annotator gives a label to an item of a truth (all as places)."""
        k = self.k
        # Rare labels are taken to be right unless shown otherwise.
        common = _looked_up(self.pool, self.pool_counts, truth * k + said) + 0.5 / self.classes + 2.0 * (truth == said)
        common = common / (self.total[truth] + 2.5)
        seen = _looked_up(self.cells, self.counts, (judge * k + said) * k + truth)
        return np.log((seen + self.smooth * common) / (_looked_up(self.rows, self.row_counts, judge * k + truth) + self.smooth))


def _spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers first[k], ..., first[k] + many[k] - 1 of all k, one after the other."""
    ends = np.cumsum(many)
    return np.repeat(first - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)


class Expectation:
    """Packed items as flat arrays, with each item's candidates and their posteriors."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, model: Model):
        self.model, k = model, model.k
        if isinstance(batch, pa.Table):
            batch = batch.combine_chunks()
        flat = {c: _flattened(batch[c]) for c in ("j", "l", "n", "f", "x")}
        self.items = len(batch)
        sizes = flat["j"][1]
        self.item = np.repeat(np.arange(self.items), sizes)
        self.judge_ids, self.local = np.unique(flat["j"][0], return_inverse=True)
        self.judge = _numbered(model.judges, self.judge_ids)[self.local]
        self.said = np.searchsorted(model.labels, flat["l"][0])
        share = flat["n"][0]
        pair = self.item * max(1, len(self.judge_ids)) + self.local
        self.first = np.concatenate([[True], pair[1:] != pair[:-1]]) if len(pair) else np.empty(0, bool)
        self.pair = np.cumsum(self.first) - 1  # votes are sorted by annotator within the item
        self.share = share / np.bincount(self.pair, share)[self.pair] if len(pair) else share
        self.weight = self.share
        if len(model.grouped) and len(pair):
            at = np.minimum(np.searchsorted(model.grouped, self.judge_ids), len(model.grouped) - 1)
            root = np.where(model.grouped[at] == self.judge_ids, model.roots[at], self.judge_ids)
            _, root = np.unique(root, return_inverse=True)
            _, back = np.unique(self.item * (root.max() + 1) + root[self.local], return_inverse=True)
            self.weight = self.share / np.bincount(back, self.first)[back]
        wide = len(flat["f"][0]) // max(1, self.items)
        self.f = flat["f"][0].reshape(self.items, wide)
        self.x = flat["x"][0].reshape(self.items, wide)
        self.grid = None
        self._candidates(k)
        self._posterior(k)

    def _candidates(self, k: int) -> None:
        m = self.model
        keys = [self.item * k + self.said]
        if m.started and len(self.item):
            vote, back = np.unique(self.judge * k + self.said, return_inverse=True)
            low, high = np.searchsorted(m.cells, vote * k), np.searchsorted(m.cells, (vote + 1) * k)
            many = (high - low)[back]
            keys.append(np.repeat(self.item * k, many) + m.cells[_spread(low[back], many)] % k)
        found = np.unique(np.concatenate(keys))
        self.of, self.truth = found // k, found % k
        self.starts = np.searchsorted(self.of, np.arange(self.items))
        many = np.bincount(self.of, minlength=self.items)[self.item]
        self.vote = np.repeat(np.arange(len(self.item)), many)
        self.at = _spread(self.starts[self.item], many)

    def _softmax(self, score: np.ndarray) -> np.ndarray:
        if not len(score):
            return score
        score = np.exp(score - np.maximum.reduceat(score, self.starts)[self.of])
        return score / np.add.reduceat(score, self.starts)[self.of]

    def _posterior(self, k: int) -> None:
        m = self.model
        if not m.started:  # the start: smoothed votes
            score = 0.01 + np.bincount(self.at, (self.truth[self.at] == self.said[self.vote]) * self.weight[self.vote], len(self.of))
            self.prior = np.zeros(len(score))
            self.posterior = score / np.add.reduceat(score, self.starts)[self.of] if len(score) else score
            return
        places = _numbered(m.features, self.f.ravel()).reshape(self.f.shape)[self.of]
        logit = (_looked_up(m.weights, m.weight_values, (places * k + self.truth[:, None]).ravel()).reshape(places.shape) * self.x[self.of]).sum(1)
        self.prior = self._softmax(logit)
        chance = self._chance(self.judge[self.vote], self.truth[self.at], self.said[self.vote])
        score = np.log(self.prior + 1e-12) + np.bincount(self.at, chance * self.weight[self.vote], len(self.of))
        self.posterior = self._softmax(score)

    def _chance(self, judge: np.ndarray, truth: np.ndarray, said: np.ndarray) -> np.ndarray:
        """``Model.log_chance``, each one computed once where they repeat."""
        m, k = self.model, self.model.k
        a = len(m.judges) + 1
        if a * k * k > len(judge):
            return m.log_chance(judge, truth, said)
        if self.grid is None:
            at = np.arange(a * k * k)
            self.grid = m.log_chance(at // (k * k), at // k % k, at % k)
        return self.grid[(judge * k + truth) * k + said]

    def statistics(self) -> pa.RecordBatch:
        """Sums as rows of the state: cells, the classifier's gradient and curvature, the mass of each truth."""
        m, k = self.model, self.model.k
        keep = self.posterior[self.at] >= FAINT
        vote, at = self.vote[keep], self.at[keep]
        cell, n = _sums((self.local[vote] * k + self.truth[at]) * k + self.said[vote], self.posterior[at] * self.weight[vote])
        ids, local = np.unique(self.f.ravel(), return_inverse=True)
        local = local.reshape(self.f.shape)
        # The intercept starts at the labels' mass, so the classifier moves from the second round on.
        moved = (self.posterior - self.prior) if m.started else np.zeros(len(self.of))
        step, g = _sums((local[self.of] * k + self.truth[:, None]).ravel(), (moved[:, None] * self.x[self.of]).ravel())
        # A bound of the curvature by rows: features weigh with the item's sum of features.
        size = np.abs(self.x)
        curve = np.bincount(local.ravel(), (size * size.sum(1, keepdims=True)).ravel(), len(ids))
        truth, mass = _sums(self.truth, self.posterior)
        rows = [
            (CELL, self.judge_ids[cell // (k * k)], m.labels[cell // k % k], m.labels[cell % k], n),
            (WEIGHT, ids[step // k], m.labels[step % k], None, g),
            (CURVE, ids, None, None, curve),
            (MASS, None, m.labels[truth], None, mass),
        ]
        filled = lambda x, n: np.zeros(n, np.int64) if x is None else x
        arrays = [
            np.concatenate([np.full(len(r[4]), r[0], np.int32) for r in rows]),
            *(np.concatenate([filled(r[c], len(r[4])) for r in rows]) for c in (1, 2, 3)),
            np.concatenate([r[4] for r in rows]),
        ]
        arrays.append(np.zeros(len(arrays[0])))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=_COLUMNS)

    def agreement(self) -> pa.RecordBatch:
        """For each pair of annotators with items in common: how often they agree, and should by their matrices."""
        m, k, many = self.model, self.model.k, max(1, len(self.judge_ids))
        sums: dict[str, list] = {c: [] for c in ("key", "n", "agreed", "chance")}
        # Votes are sorted by item: pair each with those at a distance of 1, 2, ... while still of the same item.
        for step in range(1, len(self.item)):
            left = np.flatnonzero(self.item[:-step] == self.item[step:])
            if not len(left):
                break
            left = left[self.local[left] != self.local[left + step]]
            right = left + step
            mass = self.share[left] * self.share[right]
            # The chance that both say the same: over the item's truths, and over its candidates as labels.
            wide = np.bincount(self.of, minlength=self.items)[self.item[left]]
            of = np.repeat(np.arange(len(left)), wide)
            at = _spread(self.starts[self.item[left]], wide)
            deep = np.repeat(np.arange(len(of)), wide[of])
            said = self.truth[_spread(self.starts[self.item[left[of]]], wide[of])]
            truth = self.truth[at[deep]]
            both = self._chance(self.judge[left[of[deep]]], truth, said) + self._chance(self.judge[right[of[deep]]], truth, said)
            chance = np.bincount(of[deep], np.exp(both) * self.posterior[at[deep]], len(left))
            same = self.said[left] == self.said[right]
            sums["key"].append(self.local[left] * many + self.local[right])
            sums["n"].append(mass)
            sums["agreed"].append(mass * same)
            sums["chance"].append(mass * chance)
        joined = {c: np.concatenate(x) if x else np.empty(0, np.int64) for c, x in sums.items()}
        key, n = _sums(joined["key"], joined["n"])
        agreed, chance = (_sums(joined["key"], joined[c])[1] for c in ("agreed", "chance"))
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (self.judge_ids[key // many], self.judge_ids[key % many], n, agreed, chance)],
            names=["u", "v", "n", "agreed", "chance"],
        ) if len(key) else _no_rows("u bigint, v bigint, n double, agreed double, chance double")

    def results(self, items: pa.Array, chance: float) -> pa.RecordBatch:
        """Rows of ``Consensus.items``."""
        m, k = self.model, self.model.k
        best = np.zeros(self.items, np.int64)
        top = np.maximum.reduceat(self.posterior, self.starts) if self.items else np.empty(0)
        hit = np.flatnonzero(self.posterior == top[self.of])
        best[self.of[hit[::-1]]] = hit[::-1]  # the lowest of equals stays
        votes, mass = _sums(self.item * k + self.said, self.share)
        squares = np.bincount(votes // k, mass**2, self.items) - np.bincount(self.item, self.share**2, self.items)
        n = np.bincount(self.item[self.first], minlength=self.items)
        agreement = np.where(n > 1, np.minimum(1.0, squares / np.maximum(n * (n - 1.0), 1.0)), 1.0)
        corrected = np.where(n > 1, (agreement - chance) / max(1e-9, 1 - chance), np.nan) if chance < 1 else np.where(n > 1, 1.0, np.nan)
        return pa.RecordBatch.from_arrays(
            [
                items, pa.array(m.labels[self.truth[best]].astype(np.int32)), pa.array(self.posterior[best]),
                pa.array(agreement), pa.array(corrected, from_pandas=True), pa.array(n.astype(np.int64)),
            ],
            names=["item", "label", "confidence", "agreement", "corrected", "n_annotators"],
        )


def _flattened(column) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _no_rows(schema: str) -> pa.RecordBatch:
    types = {"bigint": pa.int64(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([], types[t]) for _, t in fields], names=[n for n, _ in fields])


def maximised(sums: pd.DataFrame, old: pd.DataFrame | None, ridge: float) -> pd.DataFrame:
    """The next state from the sums of a round and the state before it (the groups stay)."""
    kind = {k: sums[sums["kind"] == k] for k in (CELL, WEIGHT, CURVE, MASS)}
    cells = kind[CELL][["a", "b", "c", "v"]]
    total = cells.groupby("b")["v"].sum()
    pool = cells.groupby(["b", "c"], as_index=False)["v"].sum()
    old_weights = None if old is None else old[old["kind"] == WEIGHT]
    if old_weights is None or not len(old_weights):
        mass = kind[MASS]
        weights = pd.DataFrame({"a": 0, "b": mass["b"], "v": np.log(mass["v"] / mass["v"].sum() + 1e-9)})
    else:
        weights = old_weights[["a", "b", "v"]].merge(
            kind[WEIGHT][["a", "b", "v"]].rename(columns={"v": "g"}), how="outer", on=["a", "b"]
        ).fillna(0.0).merge(kind[CURVE][["a", "v"]].rename(columns={"v": "h"}), on="a", how="left").fillna(0.0)
        hold = np.where(weights["a"] == 0, 1e-6, ridge)  # the intercept is free
        weights["v"] += (weights["g"] - hold * weights["v"]) / (0.5 * weights["h"] + hold)
    parts = [
        cells.assign(kind=CELL, w=cells["b"].map(total)),
        pool.assign(kind=POOL, w=pool["b"].map(total)).rename(columns={"c": "a"}).assign(c=0),
        weights.assign(kind=WEIGHT, c=0, w=0.0),
        *([] if old is None else [old[old["kind"] == GROUP]]),
    ]
    whole = {"kind": np.int32, "a": np.int64, "b": np.int64, "c": np.int64}
    return pd.concat([p[_COLUMNS].astype(whole) for p in parts if len(p)], ignore_index=True)


def _next_table(sums: DataFrame, old: DataFrame, ridge: float) -> DataFrame:
    """``maximised`` for a state kept in a table."""
    cells = sums.filter(F.col("kind") == CELL).select("a", "b", "c", "v")
    total = cells.groupBy("b").agg(F.sum("v").alias("w"))
    pool = cells.groupBy("b", "c").agg(F.sum("v").alias("v")).join(total, "b")
    before = old.filter(F.col("kind") == WEIGHT).select("a", "b", "v")
    gradient = sums.filter(F.col("kind") == WEIGHT).select("a", "b", F.col("v").alias("g"))
    curve = sums.filter(F.col("kind") == CURVE).select("a", F.col("v").alias("h"))
    hold = F.when(F.col("a") == 0, 1e-6).otherwise(ridge)
    v, g, h = (F.coalesce(c, F.lit(0.0)) for c in ("v", "g", "h"))
    weights = before.join(gradient, ["a", "b"], "full").join(curve, "a", "left").select(
        "a", "b", (v + (g - hold * v) / (0.5 * h + hold)).alias("v"))
    if before.isEmpty():
        mass = sums.filter(F.col("kind") == MASS).select("b", "v")
        every = mass.agg(F.sum("v").alias("t"))
        intercept = F.log(F.col("v") / F.col("t") + 1e-9)
        weights = mass.join(F.broadcast(every)).select(F.lit(0).cast("long").alias("a"), "b", intercept.alias("v"))  # one row
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    return (
        cells.join(total, "b").select(F.lit(CELL).alias("kind"), "a", "b", "c", "v", "w")
        .unionByName(pool.select(F.lit(POOL).alias("kind"), F.col("c").alias("a"), "b", zero.alias("c"), "v", "w"))
        .unionByName(weights.select(F.lit(WEIGHT).alias("kind"), "a", "b", zero.alias("c"), "v", none.alias("w")))
        .unionByName(old.filter(F.col("kind") == GROUP).select(*_COLUMNS))
    )


@dataclass
class Fit:
    """A state and the ways to run passes over all items with it."""

    packed: DataFrame
    classes: int
    smooth: float
    ridge: float
    sharded: bool
    local: pd.DataFrame | None = None
    table: DataFrame | None = None
    presence: DataFrame | None = None
    written: list = field(default_factory=list)

    def over_items(self, make: Callable[[Expectation, pa.Array], pa.RecordBatch], schema: str) -> DataFrame:
        """Rows that ``make`` gives for the items, their expectations taken under the present state."""
        classes, smooth = self.classes, self.smooth
        if not self.sharded:
            model = self.packed.sparkSession.sparkContext.broadcast(Model(self.local, classes, smooth))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if len(batch):
                        yield make(Expectation(batch, model.value), batch["item"])

            return self.packed.mapInArrow(run, schema)

        def of_shard(items: pa.Table, state: pa.Table) -> pa.Table:
            model = Model(state.select(_COLUMNS).to_pandas(), classes, smooth)
            items = items.combine_chunks()
            names = items["item"].chunk(0) if items["item"].num_chunks == 1 else pa.concat_arrays(items["item"].chunks)
            return pa.Table.from_batches([make(Expectation(items, model), names)])

        need = self.table.join(self.presence, ["kind", "a"]).select("shard", *_COLUMNS)
        return self.packed.groupBy("shard").cogroup(need.groupBy("shard")).applyInArrow(of_shard, schema)

    def advance(self) -> float:
        """One round over all items; the share of the mass that moved between cells."""
        rows = self.over_items(lambda e, _: e.statistics(), _STATE)
        sums = rows.groupBy("kind", "a", "b", "c").agg(F.sum("v").alias("v"))
        if not self.sharded:
            old, self.local = self.local, maximised(sums.toPandas(), self.local, self.ridge)
            return _moved(old, self.local)
        step = Written(_next_table(Written(sums, "sums").read(), self.table, self.ridge), "state")
        both = [t.filter(F.col("kind") == CELL).select("a", "b", "c", (F.col("v") * s).alias("v")) for t, s in ((self.table, -1), (step.read(), 1))]
        moved = both[0].unionByName(both[1]).groupBy("a", "b", "c").agg(F.sum("v").alias("v"))
        moved = moved.agg(F.sum(F.abs("v")), F.sum("v")).first()[0]
        mass = step.read().filter(F.col("kind") == CELL).agg(F.sum("v")).first()[0]
        self._keep(step)
        return float(moved or 0) / max(1e-9, mass or 0)

    def _keep(self, step: Written) -> None:
        # Labels that the sample did not have need their place too.
        labels = self.presence.filter(F.col("kind") == POOL).select("a").distinct()
        rows = labels.select(F.lit(POOL).alias("kind"), "a", F.col("a").alias("b"), F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("v"), F.lit(0.0).alias("w"))
        self.table = step.read().unionByName(rows)

    def regroup(self) -> bool:
        """Find the annotators that agree beyond what their matrices explain; whether that changed."""
        rows = self.over_items(lambda e, _: e.agreement(), "u bigint, v bigint, n double, agreed double, chance double")
        pairs = rows.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(
            *(F.sum(c).alias(c) for c in ("n", "agreed", "chance")))
        more, room = F.col("agreed") - F.col("chance"), F.greatest(F.col("n") - F.col("chance"), F.lit(1e-9))
        noise = F.sqrt(F.col("chance") * room / F.col("n"))
        found = pairs.filter((F.col("n") >= LEAST_TOGETHER) & (more >= DEPENDENT * room) & (more >= SIGMAS * noise))
        found = found.select("u", "v")
        if self.sharded:
            found = Written(found, "dependent").read()
            groups = connected_components(found).select(
                F.lit(GROUP).alias("kind"), F.col("node").alias("a"), F.col("class_id").alias("b"),
                F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("v"), F.lit(0.0).alias("w"))
            before = self.table.filter(F.col("kind") == GROUP).select("a", "b")
            changed = not (before.exceptAll(groups.select("a", "b")).isEmpty() and groups.select("a", "b").exceptAll(before).isEmpty())
            self._keep(Written(self.table.filter(F.col("kind") != GROUP).unionByName(groups), "state"))
            return changed
        root: dict[int, int] = {}

        def top(i: int) -> int:
            while root.setdefault(i, i) != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for u, v in found.toPandas().itertuples(index=False):  # no more pairs than LOCAL_CELLS allows
            root[max(top(u), top(v))] = min(top(u), top(v))
        rows = sorted((i, top(i)) for i in root)
        old = self.local[self.local["kind"] == GROUP]
        changed = rows != sorted(zip(old["a"], old["b"], strict=True))
        groups = _state_rows(GROUP, *(np.array([r[c] for r in rows], np.int64) for c in (0, 1)))
        self.local = pd.concat([self.local[self.local["kind"] != GROUP], groups], ignore_index=True)
        return changed

    def settle(self) -> None:
        for _ in range(ROUNDS):
            if self.advance() < STILL:
                break

    def state(self) -> DataFrame:
        return self.table if self.sharded else self.packed.sparkSession.createDataFrame(self.local, _STATE)


def _warm(sample: pa.Table, state: pd.DataFrame, classes: int, smooth: float, ridge: float, rounds: int) -> pd.DataFrame:
    """Rounds over a sample on the driver, until its cells are still."""
    for _ in range(rounds):
        sums = Expectation(sample, Model(state, classes, smooth)).statistics().to_pandas()
        old, state = state, maximised(sums, state, ridge)
        if _moved(old, state) < STILL:
            break
    return state


def _moved(old: pd.DataFrame, new: pd.DataFrame) -> float:
    a, b = (s[s["kind"] == CELL].set_index(["a", "b", "c"])["v"] for s in (old, new))
    return float(a.sub(b, fill_value=0).abs().sum() / max(1e-9, b.sum()))


def _state_rows(kind: int, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    n = len(a)
    whole = lambda x: np.asarray(x, np.int64)
    return pd.DataFrame({
        "kind": np.full(n, kind, np.int32), "a": whole(a), "b": whole(b), "c": np.zeros(n, np.int64),
        "v": np.zeros(n), "w": np.zeros(n),
    })


def _label_rows(labels: np.ndarray) -> pd.DataFrame:
    return _state_rows(POOL, labels, labels)


@dataclass
class Consensus:
    """A fitted consensus: ``items()`` and ``annotators()`` are its results."""

    fit: Fit
    names: DataFrame

    def items(self) -> DataFrame:
        """(item, label, confidence, agreement, corrected, n_annotators).

        label is the class of the greatest posterior (the lower one of equals), confidence its probability;
        agreement the chance that two different annotators of the item, taken at random, give the same label, 1
        where only one judged it; corrected the same beyond chance, (agreement - c) / (1 - c) with c the chance that two
        labels of the whole table are equal, NULL where only one judged it.
        """
        cells = self.fit.state().filter(F.col("kind") == CELL)
        by_label = cells.groupBy("c").agg(F.sum("v").alias("n")).agg(F.sum(F.col("n") * F.col("n")), F.sum("n")).first()
        chance = by_label[0] / by_label[1] ** 2
        kind = self.fit.packed.schema["item"].dataType.simpleString()
        schema = f"item {kind}, label int, confidence double, agreement double, corrected double, n_annotators bigint"
        return self.fit.over_items(lambda e, items: e.results(items, chance), schema)

    def annotators(self) -> DataFrame:
        """(annotator, reliability, bias, n_votes, dependent_on): reliability is the chance of the right label on an item
        as the truths occur (weighted by the posterior mass of each), bias the mean excess of the given label, n_votes the
        votes' weight, dependent_on the least annotator of its group where that is another."""
        smooth, classes = self.fit.smooth, self.fit.classes
        state = self.fit.state()
        cells = state.filter(F.col("kind") == CELL)
        hit, far = F.col("b") == F.col("c"), (F.col("c") - F.col("b")) * F.col("v")
        of = lambda *by: cells.groupBy(*by).agg(
            F.sum("v").alias("n"), F.sum(F.when(hit, F.col("v")).otherwise(0.0)).alias("right"), F.sum(far).alias("far"))
        spread = cells.select("c").distinct().agg(F.sum("c").alias("labels"))
        share = F.col("n") / F.sum("n").over(_everything())
        truth = (
            of("b").join(F.broadcast(spread))  # one row
            .select(
                "b", share.alias("share"), ((F.col("right") + 0.5 / classes + 2) / (F.col("n") + 2.5)).alias("common"),
                ((F.col("far") + 0.5 * (F.col("labels") / classes - F.col("b"))) / (F.col("n") + 2.5)).alias("lean"),
            )
        )
        base = truth.agg(F.sum(F.col("share") * F.col("common")).alias("r"), F.sum(F.col("share") * F.col("lean")).alias("m"))
        own = of("a", "b").join(truth, "b")
        down = F.col("n") + smooth
        gain = own.groupBy("a").agg(
            F.sum(F.col("share") * ((F.col("right") + smooth * F.col("common")) / down - F.col("common"))).alias("r"),
            F.sum(F.col("share") * ((F.col("far") + smooth * F.col("lean")) / down - F.col("lean"))).alias("m"),
            F.sum("n").alias("n_votes"),
        )
        root = state.filter((F.col("kind") == GROUP) & (F.col("a") != F.col("b"))).select("a", "b")
        lead = self.names.select(F.col("a").alias("b"), F.col("annotator").alias("dependent_on"))
        return (
            gain.join(F.broadcast(base.select(F.col("r").alias("r0"), F.col("m").alias("m0"))))  # one row
            .join(self.names, "a").join(root, "a", "left").join(lead, "b", "left")
            .select("annotator", (F.col("r") + F.col("r0")).alias("reliability"), (F.col("m") + F.col("m0")).alias("bias"), "n_votes", "dependent_on")
        )


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))  # one row a label


def fit_consensus(
    labels: DataFrame,
    categories: list[str] | None = None,
    numbers: list[str] | None = None,
    ridge: float = 5.0,
    smooth: float = 4.0,
    local_cells: int = LOCAL_CELLS,
    warm: int = WARM,
) -> Consensus | None:
    """Fit the consensus of ``labels`` (item, annotator, repeat, label integer, features...); None if there are none.

    ``categories`` and ``numbers`` name feature columns of the item. ``ridge`` is the classifier's L2 penalty, ``smooth``
    the weight of the pooled matrix in each annotator's. ``warm`` bounds the sample of items that the rounds begin
    with; the last rounds, and all results, use every item. Beyond ``local_cells`` the state stays in tables.
    """
    categories, numbers = categories or [], numbers or []
    packed = Written(packed_items(labels, categories, numbers), "packed").read()
    voted = packed.select(F.explode(F.arrays_zip("j", "l")).alias("v")).select("v.j", "v.l").distinct()
    voted = voted.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    classes, pairs = voted.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not classes:
        return None
    names = labels.filter(F.col("item").isNotNull() & F.col("label").isNotNull()).select(
        annotator_id("annotator").alias("a"), F.col("annotator").cast("string").alias("annotator")).distinct()
    sharded = pairs * classes > local_cells
    items = packed.count()
    lucky = F.pmod(F.xxhash64(F.lit("sample"), "item"), F.lit(1 << 30)) < F.lit(int(min(1.0, warm / items) * (1 << 30)) + 1)
    sample = packed.filter(lucky & (F.size("j") <= WARM_VOTES)).limit(2 * warm).toArrow()
    known = np.unique(_flattened(sample["l"])[0]) if sharded else voted.select("l").toPandas()["l"].to_numpy()
    state = _label_rows(known)
    fit = Fit(packed, classes, smooth, ridge, sharded)
    if len(sample):
        state = _warm(sample, state, classes, smooth, ridge, FIRST_ROUNDS)
    fit.local = pd.concat([state, _label_rows(known)], ignore_index=True)
    if sharded:
        _to_tables(fit, items)
        if not len(sample):
            fit.advance()
        fit.regroup()
    else:
        if not len(sample):
            fit.advance()
        fit.regroup()
        if len(sample):
            state = _warm(sample, fit.local, classes, smooth, ridge, NEXT_ROUNDS)
            fit.local = pd.concat([state, _label_rows(known)], ignore_index=True)
    fit.settle()
    if fit.regroup():
        fit.settle()
    return Consensus(fit, names)


def _to_tables(fit: Fit, items: int) -> None:
    """Split the items in shards and move the state to a table."""
    shards = F.lit(-(-items // SHARD))
    fit.packed = Written(fit.packed.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "item"), shards)), "sharded").read()
    listed = lambda kind, column: fit.packed.select("shard", F.lit(kind).alias("kind"), F.explode(column).alias("a"))
    there = listed(CELL, "j").unionByName(listed(POOL, "l")).unionByName(listed(WEIGHT, "f")).unionByName(listed(GROUP, "j"))
    fit.presence = Written(there.distinct(), "presence").read()
    fit._keep(Written(fit.packed.sparkSession.createDataFrame(fit.local, _STATE), "state"))
