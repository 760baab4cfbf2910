"""Judges: validation, repeats, consistency, comparison with stored scores, bootstrap intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechlytics.functions.wording import count_words, errors_valid, invented_insertions, weighted_count, word_error_rate
from speechlytics.operators.stats import beside, order_statistics, pooled
from speechlytics.operators.store import latest
from speechlytics.session import Written

BOOTSTRAPS = 2000
#: Transcriptions of one service that a mean is taken over when judging its noise.
SERVICE_SAMPLES = 1000


def score_judgments(judgments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scores, quarantine) of judgments (..., reference, hypothesis, errors array<struct<type, reference, hypothesis,...>>).

    Quarantined with a reason: lists that are none or have unknown types, and those that mostly add words the hypothesis
    does not contain; the next run of a work queue picks their samples up again.
    """
    reason = F.when(~errors_valid(F.col("errors")), F.lit("invalid error list")).when(
        invented_insertions(F.col("errors"), F.col("hypothesis")), F.lit("invented insertions")
    )
    checked = judgments.withColumn("reason", reason)
    good = checked.filter(F.col("reason").isNull()).drop("reason")
    counts = {f"{k}s": weighted_count(F.col("errors"), k) for k in ("substitution", "deletion", "insertion")}
    scored = good.withColumns(counts | {"reference_words": count_words(F.col("reference"))})
    wer = word_error_rate(*(F.col(c) for c in ("substitutions", "deletions", "insertions", "reference_words")))
    return scored.withColumn("wer", wer), checked.filter(F.col("reason").isNotNull())


#: How often a pair is judged again whose error list could not be used.
ATTEMPTS = 3


def judge_pending(pending: DataFrame, judge: Callable[[DataFrame], DataFrame], attempts: int = ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """(scores, quarantine) of the pairs (sample_id, service_name, model_name, reference, hypothesis) of a work queue.

    ``judge`` adds the column errors. Pairs with an unusable list are judged again, up to ``attempts`` times in all, and
    then set aside with the reason; what it gives no list for (NULL) is left out of both and stays pending.
    """
    key = ["sample_id", "service_name", "model_name"]
    left, done, bad = pending, None, None
    for k in range(attempts):
        judged = Written(judge(left), "judged").read()
        good, bad = score_judgments(judged.filter(F.col("errors").isNotNull()))
        done = good if done is None else done.unionByName(good)
        if k + 1 == attempts or bad.isEmpty():
            break
        left = left.join(bad.select(*key), key, "left_semi")
    return done, bad


def without_mixed(pending: DataFrame, scores: DataFrame | None, judge: str, force: bool = False) -> DataFrame:
    """A work queue without the services that have scores of another judge (NULL included), unless forced."""
    if scores is None or force:
        return pending
    mixed = mixed_judges(scores, judge).filter("mixed").select("service_name")
    return pending.join(mixed, "service_name", "left_anti")


def usable_judgments(log: DataFrame, judge: str, order: list[str]) -> DataFrame:
    """From a resumed log, this judge's judgments with a result, the last of each (key, repeat) by ``order``."""
    return latest(log.filter((F.col("judge") == judge) & F.col("result").isNotNull()), ["key", "repeat"], order)


def repeat_median(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Of the repeats of each key the one with the upper median wer (ties in order of repeat); a key with a failed repeat
    (NULL wer) has none. The repeats of one judge on one key are few."""
    by = Window.partitionBy(*keys)
    ordered = by.orderBy("wer", "repeat")
    return (
        runs.withColumn("__n", F.count(F.lit(1)).over(by))
        .withColumn("__failed", F.count_if(F.col("wer").isNull()).over(by))
        .withColumn("__k", F.row_number().over(ordered))
        .filter((F.col("__failed") == 0) & (F.col("__k") == F.expr("__n div 2 + 1")))
        .drop("__n", "__failed", "__k")
    )


def repeat_consistency(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Per key without a failed repeat: n, identical error counts, population variance of wer."""
    return (
        runs.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("wer").isNull()).alias("failed"),
            (F.min("error_count") == F.max("error_count")).alias("identical"), F.var_pop("wer").alias("variance"),
        )
        .filter("failed = 0").drop("failed")
    )


def judge_noise(consistency: DataFrame, stratum: str) -> DataFrame:
    """Per stratum: n, share identical, pooled standard deviation."""
    return consistency.groupBy(stratum).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("identical").cast("double")).alias("identical"),
        F.sqrt(F.avg("variance")).alias("sd"),
    )


def service_noise(noise: DataFrame, stratum: str, error_share: Column) -> DataFrame:
    """The 95 % noise of a service's mean wer that comes from the judge; NULL unless both strata are known."""
    sd = lambda with_errors: F.max(F.when(F.col(stratum) == with_errors, F.col("sd")))
    both = noise.agg(sd(True).alias("w"), sd(False).alias("o"))
    variance = error_share * F.col("w") ** 2 + (1 - error_share) * F.col("o") ** 2
    return both.select((1.96 * F.sqrt(variance / SERVICE_SAMPLES)).alias("service_mean_noise_95"))


def stratified_sample(pairs: DataFrame, key: str, has_errors: Column, count: int, seed: int) -> DataFrame:
    """``count`` pairs, half with errors and half without, in the order of md5(seed:key) within each half.

    A pair whose stratum is NULL is not drawn. The rank limit is applied before the shuffle.
    """
    position = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    drawn = pairs.withColumn("stratum", has_errors).filter(F.col("stratum").isNotNull()).withColumn(
        "__k", F.row_number().over(Window.partitionBy("stratum").orderBy(position, key))
    )
    quota = F.when(F.col("stratum"), F.lit(count // 2)).otherwise(F.lit(count - count // 2))
    # A constant bound beside the exact one, so that each task sends no more than this.
    return drawn.filter((F.col("__k") <= count - count // 2) & (F.col("__k") <= quota)).drop("__k")


def first_of_each(rows: DataFrame, by: str, order: list[str], count: int) -> DataFrame:
    ranked = rows.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.filter(F.col("__k") <= count).drop("__k")


#: A prime, and the fixed values of the cumulative probabilities of 0, 1, 2, ... draws (Poisson with mean 1) in units of 1 / PRIME.
PRIME = 2147483647
ENDS = (790015083, 1580030167, 1975037709, 2106706890, 2139624185, 2146207644, 2147304887, 2147461637, 2147481230, 2147483407, 2147483625, 2147483645)


def key_hash(key: Column) -> Column:
    """A number below PRIME from an md5 of the key, the same in every engine."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("bigint") % F.lit(PRIME)


def draw_factors(draws: int) -> tuple[np.ndarray, np.ndarray]:
    """For each draw the factor and the offset that turn a key's hash into its place between 0 and PRIME."""
    of = lambda name, k: int(hashlib.md5(f"{name}:{k}".encode()).hexdigest()[:7], 16)
    return (
        np.array([1 + of("a", k) for k in range(draws)], np.int64), np.array([of("b", k) for k in range(draws)], np.int64)
    )


def poisson_weights(hashes: np.ndarray, draws: int) -> np.ndarray:
    """How often each row is drawn in each bootstrap: rows x draws."""
    factor, offset = draw_factors(draws)
    return np.searchsorted(np.array(ENDS), (hashes[:, None] * factor + offset) % PRIME, side="right")


#: Rows weighed at once, and groups whose sums a task holds before it hands them on; they bound memory, not what is summed.
WEIGHED, HELD_GROUPS = 512, 256


def _weighted_sums(groups: list[str], draws: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def given() -> pa.RecordBatch:
            keys = list(held)
            n = len(keys)
            columns = [pa.array([k[c] for k in keys], t).take(pa.array(np.repeat(np.arange(n), draws))) for c, t in enumerate(kinds)]
            sums = np.stack(list(held.values())).transpose(1, 0, 2).reshape(2, -1)
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.tile(np.arange(draws, dtype=np.int32), n)), pa.array(sums[0]), pa.array(sums[1])],
                names=[*groups, "draw", "w", "wx"],
            )

        kinds: list = []
        for batch in batches:
            kinds = [batch[g].type for g in groups]
            keys = list(zip(*(batch[g].to_pylist() for g in groups), strict=True)) if groups else [()] * len(batch)
            number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            names, of = list(number), np.array([number[k] for k in keys], np.int64)
            order = np.argsort(of, kind="stable")
            h, x = (batch[c].to_numpy(zero_copy_only=False)[order] for c in ("__h", "__x"))
            of = of[order]
            for low in range(0, len(of), WEIGHED):
                part = of[low : low + WEIGHED]
                w = poisson_weights(h[low : low + WEIGHED], draws)
                starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                sums = np.stack([np.add.reduceat(w, starts), np.add.reduceat(w * x[low : low + WEIGHED, None], starts)], 1)
                for g, total in zip(part[starts], sums, strict=True):
                    held[names[g]] = held[names[g]] + total if names[g] in held else total.astype(float)
                if len(held) > HELD_GROUPS:
                    yield given()
                    held.clear()
        if held:
            yield given()

    return run


def bootstrap_mean(rows: DataFrame, key: str, value: str, groups: list[str], draws: int = BOOTSTRAPS) -> DataFrame:
    """Per group: n, mean, and the 95 % interval of the mean by ``draws`` resamplings (low, high).

    Resampling is by Poisson weights, which need no n and combine across partitions: each task adds its rows to one
    vector of ``draws`` sums a group, the vectors are added up, and the interval is read off the draws' means. Rows with a
    NULL key or value are left out.
    """
    held = rows.filter(F.col(value).isNotNull() & F.col(key).isNotNull())
    slim = held.select(*groups, key_hash(F.col(key)).alias("__h"), F.col(value).cast("double").alias("__x"))
    kinds = "".join(f"`{g}` {held.schema[g].dataType.simpleString()}, " for g in groups)
    sums = slim.mapInArrow(_weighted_sums(groups, draws), f"{kinds}draw int, w double, wx double")
    means = sums.groupBy(*groups, "draw").agg((F.sum("wx") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    at = {"low": "floor(0.025D * n)", "high": "floor(0.975D * n) - 1"}
    ends = order_statistics(means, groups, "m", at).drop("n")
    base = held.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return beside(base, ends, groups)


def impact(pairs: DataFrame, group: str) -> DataFrame:
    """Stored against new judge per service: means, pooled rates, share of changed error counts."""
    return pairs.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg("stored_wer").alias("stored_mean"), F.avg("new_wer").alias("new_mean"),
        pooled(F.col("stored_error_count"), F.col("stored_reference_words")).alias("stored_pooled"),
        pooled(F.col("new_error_count"), F.col("new_reference_words")).alias("new_pooled"),
        F.avg((F.col("stored_error_count") != F.col("new_error_count")).cast("double")).alias("changed"),
    )


def service_gaps(pairs: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Mean wer gap of each service to the next over the samples both have: (service_name, next_service, n, gap).

    ``pairs`` has one row for each (service_name, sample_id)."""
    a = pairs.select("service_name", "sample_id", F.col("new_wer").alias("a")).join(
        neighbours.select("service_name", "next_service").filter(F.col("next_service").isNotNull()), "service_name"
    )
    b = pairs.select(F.col("service_name").alias("next_service"), "sample_id", F.col("new_wer").alias("b"))
    gaps = a.join(b, ["next_service", "sample_id"])
    return gaps.groupBy("service_name", "next_service").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("b") - F.col("a")).alias("gap"))


def gap_intervals(pairs: DataFrame, neighbours: DataFrame) -> DataFrame:
    """``service_gaps`` with the 95 % interval of each gap (low, high), the samples resampled."""
    a = pairs.select("service_name", "sample_id", F.col("new_wer").alias("a")).join(
        neighbours.select("service_name", "next_service").filter(F.col("next_service").isNotNull()), "service_name"
    )
    b = pairs.select(F.col("service_name").alias("next_service"), "sample_id", F.col("new_wer").alias("b"))
    gaps = a.join(b, ["next_service", "sample_id"]).withColumn("gap", F.col("b") - F.col("a"))
    return bootstrap_mean(gaps, "sample_id", "gap", ["service_name", "next_service"]).withColumnRenamed("mean", "gap")


def disagreements(pairs: DataFrame, count: int) -> DataFrame:
    """The pairs whose two error counts differ most, ties by service and sample."""
    gap = F.abs(F.col("new_error_count") - F.col("stored_error_count"))
    return (
        pairs.withColumn("difference", gap).filter("difference > 0")
        .orderBy(F.desc("difference"), "service_name", "sample_id").limit(count)
    )


def baseline_pairs(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Samples scored in both databases over the same transcript, with finite rates."""
    finite = lambda rows: rows.filter(F.col("wer") < float("inf"))
    old = finite(baseline).select("key", "transcription", F.col("wer").alias("stored_wer"))
    new = finite(current).select("key", "transcription", F.col("wer").alias("new_wer"))
    return old.join(new, ["key", "transcription"])


def mixed_judges(scores: DataFrame, judge: str) -> DataFrame:
    """Per service whether it has scores of another judge, NULL included."""
    other = ~F.col("judge").eqNullSafe(F.lit(judge))
    return scores.groupBy("service_name").agg(F.bool_or(other).alias("mixed"))


def judge_counts(scores: DataFrame) -> DataFrame:
    return scores.groupBy("judge").agg(F.count(F.lit(1)).alias("n"))


def judge_label(model: str, effort: str | None, repeats: int, rules: str) -> Column:
    """The name of a judge: model, effort, repeats, and a fingerprint of its rules."""
    revision = F.substring(F.sha2(F.lit(rules), 256), 1, 8)
    return F.format_string("%s effort=%s repeats=%d rev=%s", F.lit(model), F.lit(effort or "none"), F.lit(repeats), revision)


def align_words(reference: list[str], hypothesis: list[str]) -> list[dict]:
    """The edits of a shortest word alignment, as a judge would list them: type, reference, hypothesis, position."""
    n, m = len(reference), len(hypothesis)
    number = {w: k for k, w in enumerate(dict.fromkeys([*reference, *hypothesis]))}
    a, b = (np.array([number[w] for w in x], np.int32) for x in (reference, hypothesis))
    places = np.arange(m + 1, dtype=np.int32)
    cost = np.empty((n + 1, m + 1), np.int32)
    cost[0] = places
    for i in range(n):  # a row at once: dropped or swapped, then added words carried on from the left
        row = cost[i] + 1
        row[1:] = np.minimum(row[1:], cost[i, :-1] + (b != a[i]))
        cost[i + 1] = np.minimum.accumulate(row - places) + places
    edits, i, j = [], n, m
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            if a[i] != b[j]:
                edits.append(("substitution", reference[i], hypothesis[j], i))
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
            edits.append(("deletion", reference[i], None, i))
        else:
            j -= 1
            edits.append(("insertion", None, hypothesis[j], i))
    return [dict(zip(("type", "reference", "hypothesis", "position"), e, strict=True)) for e in reversed(edits)]


def offline_judge(reference: Column, hypothesis: Column) -> Column:
    """Error lists by plain word alignment; a judge of its own, never to be mixed with others' scores.

    Words are compared as ``plain_words`` gives them. NULL texts count as empty.
    """
    import pandas as pd

    from speechlytics.functions.wording import plain_words

    schema = "array<struct<type string, reference string, hypothesis string, position int>>"

    def judge(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([align_words(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype=object)

    judge.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(judge, schema.replace(" string", ":string").replace(" int", ":int"))(
        plain_words(reference), plain_words(hypothesis)
    )
