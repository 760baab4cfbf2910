"""Filling fixed-capacity containers with items.

Method: pattern packing by non-negative least squares. Patterns are pairs and triples of lengths that fill a box exactly;
a non-negative least-squares fit to the histogram of the lengths gives each pattern's repeat count, counts are rounded,
and what remains of the histogram is packed by best fit. A box is the container, half of it, a quarter and so on: first
the items over half a box are fitted, with any partners, then what is left is fitted to boxes half as large, two of
which make one. So short items too stand in patterns of two or three, however many of them a container holds.

Not all patterns are written down: the fit begins with the pairs, and patterns that would lower its distance most are
priced out of all triples and added until none helps (column generation). Nothing is thinned or left out.

Everything about the plan is a function of the histogram, whose size the capacity bounds; the items themselves are
only numbered within their length, once for all kinds of containers, and look their container up in the plan by
arithmetic on that number.
"""

from __future__ import annotations

import base64
import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlytics.session import Written

#: Rounds of pricing, and of the updates of a fit, after which it is good enough however much it still moves.
PRICINGS, UPDATES = 12, 400
#: Repeat counts under this are not rounded up.
NEVER = 0.02
#: The share of the items of at most a quarter of the capacity that is kept loose for the best fit of the residuals.
LOOSE = 0.04
_encoders: dict[str, object] = {}


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public tokenizers' package keeps a vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoder(path: str):
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        lines = Path(path).read_bytes().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
        _encoders[path] = tiktoken.Encoding(
            Path(path).stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _encoders[path]


def token_lengths(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens): the whole text's length in tokens of a public tokenizer; NULL and empty texts have 0."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def pairs_that_fill(sizes: np.ndarray, box: int, least: int) -> np.ndarray:
    """Pairs of sizes that fill a box, and single ones that do, as rows of places in ``sizes`` (-1: none).

    ``sizes`` are distinct and sorted; the larger of a pair is at least ``least``.
    """
    at = np.full(box + 1, -1)
    at[sizes] = np.arange(len(sizes))
    other = at[box - sizes]
    large = np.flatnonzero((other >= 0) & (2 * sizes >= box) & (sizes >= least))
    rows = np.stack([large, other[large], np.full(len(large), -1)], 1)
    full = at[box]
    return np.concatenate([rows, [[full, -1, -1]]]) if full >= 0 and box >= least else rows


def priced_triples(sizes: np.ndarray, box: int, least: int, rest: np.ndarray) -> np.ndarray:
    """For every size, as the largest and as the second of a triple that fills a box, the one with the most of ``rest``.

    Looks at all triples whose largest size is at least ``least``, and gives those with a positive sum; of equal ones the
    first counts.
    """
    at = np.full(box + 1, -1)
    at[sizes] = np.arange(len(sizes))
    found = []
    top, largest, smallest = np.full(len(sizes), 1e-6), np.full(len(sizes), -1), np.full(len(sizes), -1)
    for i in range(np.searchsorted(sizes, max(least, -(-box // 3))), len(sizes)):
        room = box - sizes[i]
        stop = np.searchsorted(sizes, min(sizes[i], room - 1), side="right")
        third = at[room - sizes[:stop]]
        second = np.flatnonzero((third >= 0) & (sizes[:stop] * 2 >= room))
        if not len(second):
            continue
        third = third[second]
        gain = rest[second] + rest[third] + rest[i]
        best = int(np.argmax(gain))
        if gain[best] > 1e-6:
            found.append((i, second[best], third[best]))
        better = gain > top[second]
        top[second[better]], largest[second[better]], smallest[second[better]] = gain[better], i, third[better]
    had = np.flatnonzero(largest >= 0)
    every = np.concatenate([np.array(found, np.int64).reshape(-1, 3), np.stack([largest[had], had, smallest[had]], 1)])
    return np.unique(every, axis=0)


def nonnegative_least_squares(patterns: np.ndarray, counts: np.ndarray, rounds: int = UPDATES, x: np.ndarray | None = None) -> np.ndarray:
    """x >= 0 that nearly minimises |a x - counts|, where column p of a counts the sizes in pattern p.

    Multiplicative updates: x * (a'b) / (a'a x) keeps x positive and never increases the distance, and with a few
    entries in a column costs one pass over the patterns a round. Ends when x moves by less than a ten-thousandth.
    """
    n = len(counts)
    columns = [np.where(c < 0, n, c) for c in patterns.T]  # with a slot for what is missing
    flat = np.concatenate(columns)
    target = np.append(counts, 0.0)

    def summed(values: np.ndarray) -> np.ndarray:
        out = values[columns[0]]
        for c in columns[1:]:
            out = out + values[c]
        return out

    wanted = summed(target)
    x = np.maximum(wanted, 1e-9) / max(1, len(patterns)) if x is None else x
    for k in range(rounds):
        now = np.bincount(flat, np.tile(x, len(columns)), n + 1)  # a x
        now[n] = 0
        old, x = x, x * wanted / np.maximum(summed(now), 1e-12)
        if k % 8 == 7 and np.abs(x - old).sum() < 1e-4 * x.sum():
            break
    return x


@dataclass
class Plan:
    """Containers by pattern: each row is (repeat count, lengths in it); the first ``fitted`` rows come from the fit."""

    capacity: int
    rows: list[tuple[int, tuple[int, ...]]] = field(default_factory=list)
    fitted: int = 0


def _fit(left: Counter, box: int, least: int) -> list[tuple[int, tuple]]:
    """Take from a histogram what patterns with fitted and rounded repeat counts hold; their largest size is ``least``
    or more."""
    sizes = np.array(sorted(s for s, n in left.items() if n and s <= box), np.int64)
    if not len(sizes) or sizes[-1] < least:
        return []
    counts = np.array([left[int(s)] for s in sizes], float)
    patterns, x = pairs_that_fill(sizes, box, least), None
    for _ in range(PRICINGS):
        x = nonnegative_least_squares(patterns, counts, UPDATES // 4, x) if len(patterns) else np.empty(0)
        held = np.bincount(np.where(patterns < 0, len(sizes), patterns).ravel(), np.repeat(x, 3), len(sizes) + 1)[:-1]
        more = priced_triples(sizes, box, least, counts - held)
        every = np.concatenate([patterns, more])
        _, first = np.unique(every @ np.array([1 << 40, 1 << 20, 1]), return_index=True)
        new = np.sort(first[first >= len(patterns)])
        if len(new) <= len(patterns) // 100:
            break
        started = counts[every[new]].min(1) / 4
        patterns, x = np.concatenate([patterns, every[new]]), np.concatenate([x, np.maximum(started, 1e-3)])
    if not len(patterns):
        return []
    x = nonnegative_least_squares(patterns, counts, x=x) if len(x) == len(patterns) else nonnegative_least_squares(patterns, counts)
    stock = counts.astype(np.int64)
    rows: list[tuple[int, tuple]] = []
    for p in np.argsort(-x, kind="stable"):
        if x[p] < NEVER:
            break
        need = Counter(int(i) for i in patterns[p] if i >= 0)
        repeat = min(max(1, int(x[p] + 0.5)), *(int(stock[i]) // m for i, m in need.items()))
        if repeat > 0:
            for i, m in need.items():
                stock[i] -= m * repeat
                left[int(sizes[i])] -= m * repeat
            rows.append((repeat, tuple(int(sizes[i]) for i in patterns[p] if i >= 0)))
    return rows


def _filled(left: Counter, box: int, smallest: int, large_first: bool = False) -> list[tuple[int, tuple]]:
    """Exactly filled boxes, taken from a histogram: items over half of the box first, then boxes half as large in twos.

    Boxes whose half is under ``smallest`` are not halved; all items are fitted to them, at once or the large ones first.
    """
    rows: list[tuple[int, tuple]] = []
    last = box % 2 or box // 2 < smallest
    for least in (1,) if last and not large_first else (box // 2 + 1, 1) if last else (box // 2 + 1,):
        while True:
            before = sum(left.values())
            rows += _fit(left, box, least)
            for s in [s for s, n in left.items() if not n]:
                del left[s]
            if before - sum(left.values()) <= before // 200:
                break
    return rows if last else rows + _in_twos(_filled(left, box // 2, smallest), left)


def _in_twos(halves: list[tuple[int, tuple]], left: Counter) -> list[tuple[int, tuple]]:
    """Two boxes to one, alike ones first; an odd one is given back."""
    rows, odd = [], None
    for repeat, sizes in halves:
        if odd is not None:
            rows.append((1, odd + sizes))
            repeat, odd = repeat - 1, None
        if repeat // 2:
            rows.append((repeat // 2, sizes + sizes))
        if repeat % 2:
            odd = sizes
    left.update(Counter(odd or ()))
    return rows


def _best_fit(histogram: Counter, capacity: int) -> list[tuple[int, tuple]]:
    """Pack a histogram largest first, each into the fullest open container it fits, whole runs at a time."""
    rooms: list[int] = []  # sorted room sizes that some open rows have
    open_rows: dict[int, list[list]] = {}
    done: list[tuple[int, tuple]] = []

    def add(repeat: int, sizes: tuple, room: int) -> None:
        if repeat == 0:
            return
        if room == 0:
            done.append((repeat, sizes))
            return
        if room not in open_rows:
            open_rows[room] = []
            bisect.insort(rooms, room)
        open_rows[room].append([repeat, sizes])

    for size in sorted(histogram, reverse=True):
        n = histogram[size]
        while n:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                many = capacity // size
                full, rest = divmod(n, many)
                add(full, (size,) * many, capacity - many * size)
                if rest:
                    add(1, (size,) * rest, capacity - rest * size)
                break
            room = rooms[at]
            repeat, sizes = open_rows[room].pop()
            if not open_rows[room]:
                del open_rows[room]
                rooms.pop(at)
            many = min(room // size, max(1, n // repeat))
            used = min(repeat, n // many) if n >= many else 0
            if used == 0:
                many, used = n, 1
            add(used, (*sizes, *(size,) * many), room - many * size)
            add(repeat - used, sizes, room)
            n -= used * many
    done += [(r, s) for rows in open_rows.values() for r, s in rows]
    return done


def plan_packing(histogram: Counter, capacity: int) -> Plan:
    """Containers for a histogram {length: count} of lengths from 1 to the capacity, holding exactly its items.

    The fit of a box is repeated on what rounding left, as long as that takes something, and what no pattern holds is
    packed by best fit, together with a small part of the short items (LOOSE), which fill its gaps.
    """
    left = Counter({s: n for s, n in histogram.items() if n > 0})
    if not left:
        return Plan(capacity)
    smallest = max(2, int(2 * sum(s * n for s, n in left.items()) / sum(left.values())))
    loose, owed = Counter(), 0.0
    for s in sorted(left):  # an even share of the short items stays loose
        if 4 * s <= capacity:
            owed += left[s] * LOOSE
            loose[s] = int(owed)
            owed -= loose[s]
    left -= loose
    best = None
    # Where a container holds few items and is not halved, both orders are tried.
    for large_first in (False, True) if capacity // 2 < smallest or capacity % 2 else (False,):
        rest = Counter(left)
        plan = Plan(capacity, _filled(rest, capacity, smallest, large_first))
        plan.fitted = len(plan.rows)
        plan.rows += _best_fit(+rest + loose, capacity)
        if best is None or sum(r for r, _ in plan.rows) < sum(r for r, _ in best.rows):
            best = plan
    return best


def pack(pieces: DataFrame, plans: dict[str, Plan]) -> DataFrame:
    """(container_kind, container_id, doc_id, part, first_token, n_tokens, by_pattern) for ``pieces`` (container_kind,
    doc_id, part, first_token, n_tokens), by one plan a kind that holds exactly its pieces.

    container_id counts from 1 within the kind; pieces without tokens need no room and are listed in container 0.
    by_pattern tells whether the container is a fitted pattern's.
    """
    # Items are numbered within their length: position in the slice, plus what the earlier slices hold.
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "part"), F.lit(1024)).cast("int"))
    counts = sliced.groupBy("container_kind", "n_tokens", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = "PARTITION BY container_kind, n_tokens ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    offsets = counts.select("container_kind", "n_tokens", "slice", F.expr(f"coalesce(sum(n) OVER ({before}), 0)").alias("base"))
    # A merge join, as the offsets grow with the slices and the items are already placed by the same keys.
    within = F.expr("row_number() OVER (PARTITION BY container_kind, n_tokens, slice ORDER BY doc_id, part)")
    ranked = (
        sliced.withColumn("k", within)
        .join(offsets.hint("merge"), ["container_kind", "n_tokens", "slice"])
        .withColumn("k", F.col("k") - 1 + F.col("base"))
    )
    return ranked.select("container_kind", "doc_id", "part", "first_token", "n_tokens", "k").mapInArrow(_placing(plans), PACKED)


PACKED = (
    "container_kind string, container_id bigint, doc_id bigint, part int, first_token bigint, n_tokens bigint, by_pattern boolean"
)


def pieces_of(lengths: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """Documents as pieces (container_kind, doc_id, part, first_token, n_tokens) of at most each kind's capacity.

    A document longer than the capacity is split into full pieces and a rest; no other is split.
    """
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(c).cast("long").alias("c")) for k, c in sorted(capacities.items())))
    each = lengths.withColumn("kind", F.explode(kinds)).select("doc_id", "n_tokens", F.col("kind.kind").alias("container_kind"), "kind.c")
    parts = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("c"))).cast("int")
    start = F.col("part").cast("long") * F.col("c")
    return (
        each.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("container_kind", "doc_id", "part", start.alias("first_token"), F.least("c", F.col("n_tokens") - start).alias("n_tokens"))
    )


def _placing(plans: dict[str, Plan]):
    """From (kind, length, number within the length) to the container, by tables of runs sorted by length and number."""
    tables = {kind: _runs(plan) for kind, plan in plans.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch["n_tokens"].to_numpy(zero_copy_only=False)
            k = batch["k"].to_numpy(zero_copy_only=False)
            box, fitted = np.zeros(len(n), np.int64), np.zeros(len(n), bool)
            coded = batch["container_kind"].dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            for code, kind in enumerate(coded.dictionary.to_pylist()):
                mine = np.flatnonzero((codes == code) & (n > 0))
                keys, start, first, step, border = tables[kind]
                at = np.searchsorted(keys, n[mine] * _WIDE + k[mine], side="right") - 1
                box[mine] = first[at] + (k[mine] - start[at]) // step[at]
                fitted[mine] = box[mine] < border
            yield pa.RecordBatch.from_arrays(
                [
                    batch["container_kind"], pa.array(box, pa.int64()),
                    *(batch[c] for c in ("doc_id", "part", "first_token", "n_tokens")), pa.array(fitted),
                ],
                names=["container_kind", "container_id", "doc_id", "part", "first_token", "n_tokens", "by_pattern"],
            )

    return run


_WIDE = 1 << 42


def _runs(plan: Plan) -> tuple:
    length, start, first, step = [], [], [], []
    seen: Counter = Counter()
    container, border = 1, 1
    for row, (repeat, sizes) in enumerate(plan.rows):
        for size, m in Counter(sizes).items():
            length.append(size)
            start.append(seen[size])
            first.append(container)
            step.append(m)  # m of them go into each of the run's containers
            seen[size] += repeat * m
        container += repeat
        if row < plan.fitted:
            border = container
    order = np.lexsort((start, length)) if length else np.empty(0, int)
    length, start, first, step = (np.array(x, np.int64)[order] for x in (length, start, first, step))
    return length * _WIDE + start, start, first, step, border


def packings(documents: DataFrame, containers: DataFrame, path: str | None = None) -> DataFrame:
    """One packing for each kind of ``containers`` (container_kind, capacity_tokens), of all documents (see ``pack``).

    doc_id is unique and not NULL. The documents are measured once, and all kinds are planned from one histogram and
    numbered in one pass. Kinds with a NULL capacity or one under 1 are left out; a kind stated twice is packed for its
    greatest capacity. ``containers`` is a short list of kinds and read by the driver.
    """
    kinds = (
        containers.filter((F.col("capacity_tokens") >= 1) & F.col("container_kind").isNotNull()).groupBy("container_kind")
        .agg(F.max("capacity_tokens").alias("c")).collect()
    )
    if not kinds:
        return documents.sparkSession.createDataFrame([], PACKED)
    capacities = {kind: int(c) for kind, c in kinds}
    lengths = Written(token_lengths(documents, path), "lengths").read()
    pieces = pieces_of(lengths, capacities)
    plans = plans_of(pieces.groupBy("container_kind", "n_tokens").agg(F.count(F.lit(1)).alias("n")), capacities)
    return pack(pieces, plans)


def plans_of(histograms: DataFrame, capacities: dict[str, int]) -> dict[str, Plan]:
    """A plan a kind for ``histograms`` (container_kind, n_tokens, n), each made in a task of its own.

    A kind has at most one row for each length up to its capacity, and its plan no more than some for each.
    """

    def plan(table: pa.Table) -> pa.Table:
        kind = table["container_kind"][0].as_py()
        sizes = zip(table["n_tokens"].to_pylist(), table["n"].to_pylist(), strict=True)
        made = plan_packing(Counter({s: n for s, n in sizes if s}), capacities[kind])
        return pa.table({
            "kind": pa.array([kind] * len(made.rows), pa.string()), "row": pa.array(range(len(made.rows)), pa.int32()),
            "fitted": pa.array([made.fitted] * len(made.rows), pa.int32()), "repeat": pa.array([r for r, _ in made.rows], pa.int64()),
            "sizes": pa.array([list(s) for _, s in made.rows], pa.list_(pa.int32())),
        })

    rows = histograms.groupBy("container_kind").applyInArrow(
        plan, "kind string, row int, fitted int, repeat bigint, sizes array<int>"
    )
    plans = {k: Plan(c) for k, c in capacities.items()}
    for kind, _, fitted, repeat, sizes in sorted(rows.toLocalIterator(), key=lambda r: (r[0], r[1])):
        plans[kind].fitted = fitted
        plans[kind].rows.append((repeat, tuple(sizes)))
    return plans


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind: (container_kind, capacity_tokens, n_containers, n_tokens, fill, pattern_share), fill the share of room
    used and pattern_share the share of the pieces that stand in a fitted pattern."""
    boxes = packed.filter(F.col("container_id") > 0).groupBy("container_kind", "container_id").agg(
        F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"), F.max("by_pattern").alias("fitted"))
    kinds = boxes.groupBy("container_kind").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens"),
        (F.sum(F.when(F.col("fitted"), F.col("pieces")).otherwise(0)) / F.sum("pieces")).alias("pattern_share"),
    )
    sizes = containers.groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    return kinds.join(sizes, "container_kind").select(
        "container_kind", "capacity_tokens", "n_containers", "n_tokens",
        (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("fill"), "pattern_share",
    )


def invariants(packed: DataFrame, lengths: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind: (container_kind, n_documents, over_capacity, split_needlessly, tokens_lost), the last three 0 in any packing."""
    sizes = containers.groupBy("container_kind").agg(F.max("capacity_tokens").alias("c"))
    boxes = packed.filter(F.col("container_id") > 0).groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("n"))
    over = boxes.join(sizes, "container_kind").groupBy("container_kind").agg(F.count_if(F.col("n") > F.col("c")).alias("over_capacity"))
    each = packed.groupBy("container_kind", "doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("n_tokens").alias("n"))
    wanted = lengths.select("doc_id", F.col("n_tokens").alias("length"))
    per_kind = (
        each.join(wanted, "doc_id").join(sizes, "container_kind").groupBy("container_kind").agg(
            F.count(F.lit(1)).alias("n_documents"),
            F.count_if((F.col("parts") > 1) & (F.col("length") <= F.col("c"))).alias("split_needlessly"),
            F.sum(F.abs(F.col("length") - F.col("n"))).alias("tokens_lost"),
        )
    )
    return per_kind.join(over, "container_kind", "left").select(
        "container_kind", "n_documents", F.coalesce("over_capacity", F.lit(0)).cast("bigint").alias("over_capacity"),
        "split_needlessly", "tokens_lost",
    )
