"""Long exact spans shared between records.

Method: MinHash banding over text windows. The paragraphs are all windows of ``least`` consecutive code points,
at every offset. A window's signature is the minimum of one hash over its shingles (runs of ``shingle`` code points),
used as one band of one row: of all ways to tune the bands this has the highest recall, and for the windows sought,
which are equal, it is 1: equal windows have equal signatures. Neighbouring windows mostly share the shingle that
gives the minimum, so a text of n code points has about 2n / (least - shingle + 2) distinct signatures ("anchors").
Colliding anchors are verified exactly by comparing the text around them, and records are clustered by components.

Natural paragraphs cannot give the result: a shared run need not begin or end with a paragraph, nor be a large
part of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlytics.llm.components import connected_components
from speechlytics.session import Written

#: Code points handled at once in the vectorised hashing; bounds the memory of a task, not what is found.
BLOCK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {"n": 0}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        _powers["up"] = np.cumprod(np.full(n, _BASE, np.uint64))
        _powers["down"] = np.cumprod(np.full(n, _INVERSE, np.uint64))
        _powers["n"] = n
    return _powers["up"][:n], _powers["down"][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= _MIX[0]
    x ^= x >> np.uint64(33)
    x *= _MIX[1]
    return x ^ (x >> np.uint64(33))


def shingle_hashes(codes: np.ndarray, shingle: int) -> np.ndarray:
    """A 64-bit hash of every run of ``shingle`` code points, equal for equal runs wherever they stand."""
    up, down = _power_tables(len(codes))
    total = np.cumsum((codes.astype(np.uint64) + np.uint64(0x51ED27)) * _MIX[0] * up)
    runs = total[shingle - 1 :].copy()
    runs[1:] -= total[:-shingle]
    return _mixed(runs * down[: len(runs)])


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values, in constant time a value."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(texts: list[str], least: int, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, position, hash) of the signatures of all windows of ``least`` code points.

    The texts, each of at least ``least`` code points, are hashed as one string; windows across a border do
    not count. Of equal minima in a window the first counts, so even a run of one character has few anchors.
    """
    width = least - shingle + 1
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    hashes = shingle_hashes(codes, shingle)
    # The high half decides; the low half is the position, so that keys are distinct and give the position back.
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    lowest = sliding_minimum(keys, width)
    inside = np.zeros(len(lowest), bool)
    steps = np.zeros(len(lowest) + 1, np.int32)
    np.add.at(steps, begins, 1)
    np.add.at(steps, np.minimum(begins + lengths - least + 1, len(lowest)), -1)
    inside = np.cumsum(steps[:-1]) > 0
    chosen = lowest[inside]
    chosen = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])] if len(chosen) else chosen
    at = (chosen & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.searchsorted(begins, at, side="right") - 1
    return owner, at - begins[owner], hashes[at].view(np.int64)


def _anchor_batches(least: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            long = [(i, t) for i, t in enumerate(batch.column(1).to_pylist()) if t is not None and len(t) >= least]
            start = 0
            while start < len(long):
                stop, size = start, 0
                while stop < len(long) and (stop == start or size + len(long[stop][1]) <= BLOCK):
                    size += len(long[stop][1])
                    stop += 1
                owner, position, gram = anchors([t for _, t in long[start:stop]], least, shingle)
                rows = np.fromiter((i for i, _ in long[start:stop]), np.int64, stop - start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[rows[owner]]), pa.array(position.astype(np.int32)), pa.array(gram)],
                    names=["doc_id", "pos", "gram"],
                )
                start = stop

    return run


def _context_batches(least: int, shingle: int):
    reach = least - shingle

    def code(text: str) -> int:
        return int.from_bytes(xxhash.xxh3_64_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, hits in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "hits")), strict=True):
                hits = sorted((h["pos"], h["gram"]) for h in hits)
                links = [
                    code(text[p : q + shingle]) for (p, _), (q, _) in zip(hits, hits[1:], strict=False)
                ]
                for k, (p, gram) in enumerate(hits):
                    end = p + shingle
                    out.append((
                        gram, code(text[p:end]), doc, p,
                        links[k - 1] if k else None, links[k] if k < len(links) else None,
                        text[max(0, p - reach) : p], text[end : end + reach],
                    ))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(x, t)
                    for x, t in zip(
                        zip(*out, strict=True) if out else [[]] * 8,
                        (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()),
                        strict=True,
                    )
                ],
                names=["gram", "check", "doc_id", "pos", "prev", "next", "left", "right"],
            )

    return run


def _common(a: str, b: str) -> int:
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left = [
            _common(a[::-1], b[::-1]) for a, b in zip(batch["left_a"].to_pylist(), batch["left_b"].to_pylist(), strict=True)
        ]
        right = [_common(a, b) for a, b in zip(batch["right_a"].to_pylist(), batch["right_b"].to_pylist(), strict=True)]
        keep = ["doc_a", "doc_b", "pos_a", "pos_b", "starts", "ends"]
        yield pa.RecordBatch.from_arrays(
            [*(batch[c] for c in keep), pa.array(left, pa.int32()), pa.array(right, pa.int32())],
            names=[*keep, "before", "after"],
        )


def _around(documents: DataFrame, least: int, shingle: int) -> DataFrame:
    """The occurrences of anchors that stand in more than one record, with the text beside them:
    (gram, check, doc_id, pos, prev, next, left, right)."""
    slim = documents.select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    found = Written(
        slim.mapInArrow(_anchor_batches(least, shingle), "doc_id bigint, pos int, gram bigint"), "anchors"
    )
    spread = found.read().groupBy("gram").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    shared = spread.filter(F.col("lo") < F.col("hi")).select("gram")
    hits = (
        found.read().join(shared, "gram", "left_semi")
        .groupBy("doc_id").agg(F.collect_set(F.struct("pos", "gram")).alias("hits"))
    )
    return Written(
        slim.join(hits, "doc_id").mapInArrow(
            _context_batches(least, shingle),
            "gram bigint, check bigint, doc_id bigint, pos int, prev bigint, next bigint, left string, right string",
        ),
        "contexts",
    ).read()


def anchor_pairs(
    documents: DataFrame, least: int = 400, shingle: int = 300, only_starts: bool = False
) -> DataFrame:
    """Pairs of records at the ends of what they share, with how far their texts agree around an anchor.

    Columns: doc_a < doc_b, pos_a, pos_b (of the anchor), starts, ends (the pair is not joined to one at the
    previous or next anchor), before, after (code points in agreement beside the anchor, at most
    least - shingle). A run shared by two records contains anchors common to both; within it, consecutive ones
    carry the hash of the whole text between them and are skipped, so a run gives its two ends and not a pair for
    each anchor. The first record's anchors with none before them always count.
    """
    every = _around(documents, least, shingle)
    ends = lambda c: (F.count(c) < F.count(F.lit(1))) | (F.min(c) != F.max(c))
    lively = every.groupBy("gram", "check").agg((ends("prev") if only_starts else ends("prev") | ends("next")).alias("on"))
    every = every.join(lively.filter("on").drop("on"), ["gram", "check"], "left_semi")
    side = lambda s: every.select("gram", "check", *(F.col(c).alias(f"{c}_{s}") for c in every.columns[2:]))
    a, b = side("a"), side("b")
    differ = lambda c: F.coalesce(F.col(f"{c}_a") != F.col(f"{c}_b"), F.lit(True))
    pairs = (
        a.join(b, ["gram", "check"])
        .filter(F.col("doc_id_a") < F.col("doc_id_b"))
        .filter(differ("prev") if only_starts else differ("prev") | differ("next"))
        .select(
            F.col("doc_id_a").alias("doc_a"), F.col("doc_id_b").alias("doc_b"), "pos_a", "pos_b",
            differ("prev").alias("starts"), differ("next").alias("ends"), "left_a", "left_b", "right_a", "right_b",
        )
    )
    return pairs.mapInArrow(
        _extended,
        "doc_a bigint, doc_b bigint, pos_a int, pos_b int, starts boolean, ends boolean, before int, after int",
    )


def sharing_pairs(documents: DataFrame, least: int = 400, shingle: int = 300) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: the pairs of records with a common run of at least ``least`` code points.

    Exact: case and white space count; a run repeated within one record only is no case. NULL and shorter
    texts share nothing, rows without a doc_id are left out, a row written twice counts once. ``documents`` has doc_id
    (of one text) and text; further columns are ignored.
    """
    pairs = anchor_pairs(documents, least, shingle, only_starts=True)
    return pairs.filter(F.col("before") + F.col("after") >= least - shingle).select("doc_a", "doc_b").distinct()


def shared_runs(documents: DataFrame, least: int = 400, shingle: int = 300) -> DataFrame:
    """The maximal common runs of at least ``least``: (doc_a, doc_b, begin_a, begin_b, n_chars)."""
    pairs = anchor_pairs(documents, least, shingle).withColumn("shift", F.col("pos_b") - F.col("pos_a"))
    along = "PARTITION BY doc_a, doc_b, shift ORDER BY pos_a ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    stop = F.expr(f"first(CASE WHEN ends THEN pos_a + {shingle} + after END, true) OVER ({along})")
    return (
        pairs.withColumn("stop", stop)
        .filter("starts")
        .select(
            "doc_a", "doc_b", (F.col("pos_a") - F.col("before")).alias("begin_a"),
            (F.col("pos_b") - F.col("before")).alias("begin_b"),
            (F.col("stop") - F.col("pos_a") + F.col("before")).alias("n_chars"),
        )
        .filter(F.col("n_chars") >= least)
    )


def _window_batches(reach: int):
    """The hash of every window of each context (left, right): (context, offset, window, lo, hi)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch[c].to_pylist() for c in ("left", "right")), strict=True))
            first = np.array([max(0, reach - len(r)) for _, r in rows], np.int64)
            many = np.array([max(0, min(reach, len(a)) + 1) for a, _ in rows], np.int64) - first
            many = np.maximum(many, 0)
            owner = np.repeat(np.arange(len(rows)), many)
            offset = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + first[owner]
            codes = np.empty(len(owner), np.uint64)
            for at, (k, o) in enumerate(zip(owner.tolist(), offset.tolist(), strict=True)):
                a, r = rows[k]
                codes[at] = xxhash.xxh3_64_intdigest(f"{a[len(a) - o :]}\0{r[: reach - o]}".encode("utf-8", "surrogatepass"))
            take = lambda c: batch[c].take(pa.array(owner))
            yield pa.RecordBatch.from_arrays(
                [take("gram"), take("check"), take("context"), pa.array(offset.astype(np.int32)), pa.array(codes.view(np.int64)), take("lo"), take("hi")],
                names=["gram", "check", "context", "offset", "window", "lo", "hi"],
            )

    return run


def shared_amount(documents: DataFrame, least: int = 400, shingle: int = 300) -> DataFrame:
    """One row a record: (doc_id, n_chars, shared_chars, n_links, class_id).

    shared_chars counts the code points that lie in a run of at least ``least`` common with another record; class_id is the
    least doc_id of the component of records that share, its own if it shares nothing. A NULL text has 0 characters.

    No pairs of records are made. Every window of ``least`` code points has one anchor; occurrences of an anchor with the
    same text on both sides are one context, and only where an anchor has several contexts are their windows compared, by
    hash: a window that several records have links each context to the least of those records (n_links counts a record's
    distinct links of this form, in either direction). The windows of one occurrence that are shared overlap, so the least and the
    greatest give the run. A text that stands in M records costs some rows for each of them, whatever surrounds it.
    """
    reach = least - shingle
    context = F.xxhash64(F.lit("context"), "left", "right")
    every = _around(documents, least, shingle).withColumn("context", context)
    keys = ["gram", "check", "context"]
    contexts = Written(
        every.filter(F.char_length("left") + F.char_length("right") >= reach)
        .groupBy(*keys).agg(F.first("left").alias("left"), F.first("right").alias("right"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")),
        "window-contexts",
    ).read()
    several = contexts.groupBy("gram", "check").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    windows = Written(
        contexts.join(several, ["gram", "check"], "left_semi").mapInArrow(
            _window_batches(reach),
            "gram bigint, check bigint, context bigint, offset int, window bigint, lo bigint, hi bigint",
        ),
        "windows",
    ).read()
    same = ["gram", "check", "offset", "window"]
    common = windows.groupBy(*same).agg(F.min("lo").alias("first"), F.max("hi").alias("last")).filter("first < last")
    met = windows.join(common, same).select(*keys, "offset", "lo", "hi", "first")
    # A context of several records shares all of its windows; another those that some other context has.
    low = F.greatest(F.lit(0), reach - F.char_length("right"))
    whole = contexts.filter("lo < hi").select(*keys, low.alias("from"), F.least(F.lit(reach), F.char_length("left")).alias("to"))
    reached = (
        met.select(*keys, F.col("offset").alias("from"), F.col("offset").alias("to")).unionByName(whole)
        .groupBy(*keys).agg(F.min("from").alias("from"), F.max("to").alias("to"))
    )
    spans = (
        every.join(reached, keys)
        .groupBy("doc_id", (F.col("pos") - F.col("to")).alias("s")).agg(F.max(F.col("pos") - F.col("from") + least).alias("e"))
    )
    before = "PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    covered = (
        spans.withColumn("reached", F.expr(f"coalesce(max(e) OVER ({before}), 0)"))
        .groupBy("doc_id")
        .agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "reached"))).alias("shared_chars"))
    )
    of_context = contexts.filter("lo < hi").select(*keys, "lo")
    edges = (
        met.select(F.col("first").alias("u"), F.col("lo").alias("v"))
        .union(every.join(of_context, keys).select(F.col("lo").alias("u"), F.col("doc_id").alias("v")))
        .filter("u <> v").distinct()
    )
    links = Written(edges, "links").read()
    classes = connected_components(links)
    many = links.select(F.explode(F.array("u", "v")).alias("doc_id")).groupBy("doc_id").count()
    return (
        documents.filter(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("n_chars"))
        .join(covered, "doc_id", "left")
        .join(many, "doc_id", "left")
        .join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select(
            "doc_id", "n_chars", F.coalesce("shared_chars", F.lit(0)).cast("bigint").alias("shared_chars"),
            F.coalesce("count", F.lit(0)).alias("n_links"), F.coalesce("class_id", "doc_id").alias("class_id"),
        )
    )
