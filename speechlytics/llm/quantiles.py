"""Percentiles of very large numeric columns, per group, from parts that can be combined.

Method: distributed multi-select. The values lie in sorted runs (of a day, of a file, of a partition). For each group and
percentile, the partitions propose the medians of what their runs hold of the range still in question; their weighted
median becomes the pivot; all runs count the values below, at and above it; the side that cannot hold the wanted rank is
ruled out. This repeats until at most LEAF values are in question, which are then sorted. Results are exact order
statistics: the value of rank ceil(p * n / 100), with an error bound of 0 ranks and 0 in value.

Runs of different days or files combine by union: counts add up and proposals are weighed together, so the figures for
all days are put together from the days' runs without looking at the rows again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechlytics.session import Written

#: Values in a run, and values in question from which a rank is found by sorting them.
RUN, LEAF = 8192, 4096
#: Groups whose searches may be sent to every task; tasks that a group's runs are spread over beyond that.
SENT, SALTS = 20_000, 16
PERCENTILES = (50, 90, 95, 99)


def sorted_runs(rows: DataFrame, keys: list[str], value: str) -> Written:
    """The non-NULL values as sorted runs (keys..., run array<double>) of at most RUN values of one group.

    Keys may be NULL; NaN counts as greater than all numbers. Rows are rebalanced by key with AQE free to split a
    large group, so a group that holds a third of all rows is spread over many tasks, and small ones share one.
    """
    slim = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__value"))
    placed = slim.hint("rebalance", *keys).sortWithinPartitions(*keys, "__value")
    width = len(keys)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:width])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            same = np.ones(n - 1, bool)
            for c in range(width):
                code = batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                same &= code[1:] == code[:-1]
            starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
            sizes = np.diff(np.append(starts, n))
            starts = np.concatenate([np.arange(s, s + m, RUN) for s, m in zip(starts, sizes, strict=True)])
            values = batch.column(width).to_numpy(zero_copy_only=False)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, n), pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(starts)) for c in range(width)), lists], names=[*keys, "run"]
            )

    return Written(placed.mapInArrow(run, f"{fields}, run array<double>"), "runs")


def _slices(batch: pa.RecordBatch, runs: int, wanted: int) -> Iterator[tuple]:
    """(row, run, the rank searches in its group: list of dicts) of a batch."""
    lists = batch.column(runs)
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    for row, searches in enumerate(batch.column(wanted).to_pylist()):
        yield row, flat[offsets[row] : offsets[row + 1]], searches


def _inside(run: np.ndarray, search: dict) -> tuple[int, int]:
    low = 0 if search["lo"] is None else int(np.searchsorted(run, search["lo"], "right"))
    high = len(run) if search["hi"] is None else int(np.searchsorted(run, search["hi"], "left"))
    return low, max(low, high)


def _weighted_median(found: list[tuple[float, int]]) -> float:
    found.sort(key=lambda x: (np.isnan(x[0]), x[0]))
    half, seen = sum(w for _, w in found) / 2, 0
    for value, weight in found:
        seen += weight
        if seen >= half:
            return value
    return found[-1][0]


def _counting(width: int):
    """Three-way counts at the pivots, and the medians of both sides as proposals for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, list] = {}
        for batch in batches:
            groups = list(zip(*(batch.column(c).to_pylist() for c in range(width)), strict=True))
            for row, values, searches in _slices(batch, width, width + 1):
                for s in searches:
                    low, high = _inside(values, s)
                    if low == high:
                        continue
                    below, above = low, high  # without a pivot yet, all are proposed from
                    if s["pivot"] is not None:
                        below = min(max(int(np.searchsorted(values, s["pivot"], "left")), low), high)
                        above = min(max(int(np.searchsorted(values, s["pivot"], "right")), low), high)
                    t = totals.setdefault((*groups[row], s["p"]), [0, 0, 0, [], []])
                    t[0] += below - low
                    t[1] += above - below
                    t[2] += high - above
                    if s["pivot"] is None:
                        t[3].append((float(values[(low + high - 1) // 2]), high - low))
                        continue
                    if below > low:
                        t[3].append((float(values[(low + below - 1) // 2]), below - low))
                    if high > above:
                        t[4].append((float(values[(above + high - 1) // 2]), high - above))
        rows = [
            (*key, b, e, a, _weighted_median(x) if x else None, _weighted_median(y) if y else None)
            for key, (b, e, a, x, y) in totals.items()
        ]
        columns = list(zip(*rows, strict=True)) or [[]] * (width + 6)
        types = [*[pa.string()] * width, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = [*(f"k{c}" for c in range(width)), "p", "below", "equal", "above", "left", "right"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def _trimming(width: int, gather: bool):
    """Runs without the values that are ruled out for all percentiles; or, to finish, each value in question."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kept, which = [], [], []
            for row, values, searches in _slices(batch, width, width + 1):
                keep = np.zeros(len(values), bool)
                for s in searches:
                    low, high = _inside(values, s)
                    if gather and high > low:
                        rows.append(row)
                        which.append(s["p"])
                        kept.append(values[low:high])
                    keep[low:high] = True
                if not gather and keep.any():
                    rows.append(row)
                    kept.append(values[keep])
            keys = [batch.column(c).take(pa.array(rows, pa.int64())) for c in range(width)]
            lists = pa.array(kept, pa.list_(pa.float64()))
            more = [pa.array(which, pa.int32())] if gather else []
            names = [*(f"k{c}" for c in range(width)), *(["p"] if gather else []), "run"]
            yield pa.RecordBatch.from_arrays([*keys, *more, lists], names=names)

    return run


def multi_select(runs: DataFrame, keys: list[str], percentiles: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """(keys..., n, p50, p90, ...): exact percentiles of each group from its sorted runs.

    ``runs`` has the string columns ``keys`` and ``run``. The state of a search is one row a group and percentile;
    each round joins it to the runs (by broadcast up to SENT groups, beyond it with the runs of a group spread over SALTS
    tasks), sends back one row for
    each search and partition, and writes the new state. Ruled-out values are dropped from the runs whenever
    half of what is stored is no longer in question, so that all rounds together read about twice the data.
    """
    width, names = len(keys), [f"k{c}" for c in range(len(keys))]
    key_fields = ", ".join(f"{k} string" for k in names)
    # A NULL key is a group of its own; it gets a mark that a real key cannot begin with.
    marked = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("~")).alias(n) for k, n in zip(keys, names, strict=True)]
    base = runs.select(*marked, "run")
    counts = Written(
        base.groupBy(*names).agg(
            F.sum(F.size("run")).cast("bigint").alias("n"), F.count(F.lit(1)).alias("runs"), F.first("run").alias("run")
        ).withColumn("run", F.when(F.col("runs") == 1, F.col("run"))),
        "counts",
    ).read()
    # A group of one run needs no search: its ranks can be read off.
    at_once = counts.filter("runs = 1").select(
        *names, "n", *(F.expr(f"element_at(run, cast(({p} * n + 99) div 100 AS int))").alias(f"p{p}") for p in percentiles)
    )
    wanted = F.explode(F.array(*(F.lit(p) for p in percentiles))).alias("p")
    nothing = F.lit(None).cast("double")
    state = Written(
        counts.filter("runs > 1").select(*names, "n", wanted)
        .select(
            *names, "n", "p", F.expr("(p * n + 99) div 100").alias("rank"), F.col("n").alias("open"),
            nothing.alias("lo"), nothing.alias("hi"), nothing.alias("pivot"), nothing.alias("value"),
        ),
        "searches",
    )
    stored: Written | None = None

    def searching(data: DataFrame, rows: DataFrame, groups: int) -> DataFrame:
        todo = rows.groupBy(*names).agg(F.collect_list(F.struct("p", "lo", "hi", "pivot")).alias("searches"))
        if groups <= SENT:  # counted: a row for each, with a search for each percentile
            return data.join(F.broadcast(todo), names).select(*names, "run", "searches")
        salted = data.withColumn("__salt", F.pmod(F.xxhash64("run"), F.lit(SALTS)))
        spread = todo.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        return salted.join(spread, [*names, "__salt"]).select(*names, "run", "searches")

    size = None
    while True:
        now = state.read()
        busy = now.filter(F.col("value").isNull() & (F.col("open") > LEAF))
        left = now.filter(F.col("value").isNull()).groupBy(*names).agg(F.sum("open").alias("o"), F.max(F.col("open") > LEAF).alias("b"))
        many, some, groups = left.agg(F.sum(F.least(F.col("o"), F.lit(1 << 60))), F.count_if("b"), F.count(F.lit(1))).first()
        if not some:
            break
        data = stored.read() if stored else base
        if size is not None and many < size / 2:
            trimmed = Written(
                searching(data, now.filter(F.col("value").isNull()), groups).mapInArrow(
                    _trimming(width, False), f"{key_fields}, run array<double>"
                ),
                "trimmed",
            )
            if stored:
                stored.drop()
            stored, size = trimmed, many
            data = stored.read()
        size = size or many
        told = searching(data, busy, groups).mapInArrow(
            _counting(width),
            f"{key_fields}, p int, below bigint, equal bigint, above bigint, left double, right double",
        )
        median = lambda c, w: F.percentile(c, F.lit(0.5), w)  # noqa: E731  (weighted, over one row a partition)
        sums = told.groupBy(*names, "p").agg(
            F.sum("below").alias("below"), F.sum("equal").alias("equal"), F.sum("above").alias("above"),
            median("left", F.when(F.col("equal") + F.col("below") == 0, F.col("above")).otherwise(
                F.greatest("below", F.lit(1)))).alias("left"),
            median("right", F.greatest("above", F.lit(1))).alias("right"),
        )
        met = now.join(sums, [*names, "p"], "left")
        first = F.col("pivot").isNull()
        down, hit = F.col("rank") <= F.col("below"), F.col("rank") <= F.col("below") + F.col("equal")
        acted = F.col("below").isNotNull() & ~first
        stepped = met.select(
            *names, "n", "p",
            F.when(acted & ~down & ~hit, F.col("rank") - F.col("below") - F.col("equal")).otherwise(F.col("rank")).alias("rank"),
            F.when(acted & down, F.col("below")).when(acted & hit, F.lit(1)).when(acted, F.col("above"))
            .otherwise(F.col("open")).cast("bigint").alias("open"),
            F.when(acted & ~down & ~hit, F.col("pivot")).otherwise(F.col("lo")).alias("lo"),
            F.when(acted & down, F.col("pivot")).otherwise(F.col("hi")).alias("hi"),
            F.when(F.col("below").isNull(), F.col("pivot")).when(first | down, F.col("left")).otherwise(F.col("right")).alias("pivot"),
            F.when(acted & ~down & hit, F.col("pivot")).otherwise(F.col("value")).alias("value"),
        )
        following = Written(stepped, "searches")
        state.drop()
        state = following

    # At most LEAF values are in question in each search that is left: sort them and take the rank. Searches of a group
    # with the same bounds (as at the start) share their values, under the least percentile of them.
    final = state.read()
    lead = Window.partitionBy(*names, "lo", "hi")
    rest = final.filter(F.col("value").isNull()).withColumn("lead", F.min("p").over(lead))
    data = stored.read() if stored else base
    picked = (
        searching(data, rest.filter(F.col("p") == F.col("lead")), groups)
        .mapInArrow(_trimming(width, True), f"{key_fields}, p int, run array<double>")
        .groupBy(*names, F.col("p").alias("lead")).agg(F.array_sort(F.flatten(F.collect_list("run"))).alias("values"))
    )
    solved = rest.join(picked, [*names, "lead"]).select(
        *names, "n", "p", F.expr("element_at(values, cast(rank AS int))").alias("value")
    )
    every = solved.unionByName(final.filter(F.col("value").isNotNull()).select(*names, "n", "p", "value"))
    table = every.groupBy(*names, "n").agg(
        *(F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"p{p}") for p in percentiles)
    ).unionByName(at_once)
    real = [F.expr(f"CASE WHEN {n} = '~' THEN NULL ELSE substring({n}, 2) END").alias(k) for k, n in zip(keys, names, strict=True)]
    return table.select(*real, "n", *(f"p{p}" for p in percentiles))


def daily_and_overall(rows: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """(keys..., day, n, p50, p90, p95, p99) for each day and, with day 'all', for all days together.

    ``day`` is a string column. The values are sorted into runs once, by group and day; both results come from them.
    Groups without a non-NULL value do not appear.
    """
    runs = sorted_runs(rows, [*keys, day], value).read()
    daily = multi_select(runs, [*keys, day])
    overall = multi_select(runs.select(*keys, "run"), keys).withColumn(day, F.lit("all"))
    return daily.unionByName(overall)
