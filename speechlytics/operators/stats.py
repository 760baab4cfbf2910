"""Latency statistics: three definitions of a percentile, buckets and summaries.

Percentiles are exact and never gather a group: values are counted by (group, value) with map-side combine, located in
buckets of a fixed monotone function of the value, and only counts are accumulated along them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper ends of the duration buckets in seconds, with the bucket from the last end on.
DURATION_BUCKETS = ((2.0, "0-2s"), (5.0, "2-5s"), (10.0, "5-10s"), (None, "10s+"))
#: Upper ends (inclusive) of the word error rate buckets.
WER_BUCKETS = (
    (0.0, "0% (perfect)"), (0.05, "1-5%"), (0.1, "6-10%"), (0.2, "11-20%"), (0.5, "21-50%"), (None, "50%+ (outliers)"),
)


def duration_bucket(seconds: Column) -> Column:
    """The bucket of a duration; NULL has none."""
    bucket = F.when(seconds.isNull(), F.lit(None).cast("string"))
    for end, label in DURATION_BUCKETS:
        bucket = bucket.when(seconds < end, label) if end is not None else bucket.otherwise(label)
    return bucket


def wer_bucket(wer: Column) -> Column:
    bucket = F.when(wer.isNull(), F.lit(None).cast("string"))
    for end, label in WER_BUCKETS:
        bucket = bucket.when(wer <= end, label) if end is not None else bucket.otherwise(label)
    return bucket


def value_bucket(value: Column) -> Column:
    """A monotone step function of a number, finer than one percent of its size; used to split groups evenly enough."""
    size = F.ceil(F.log(1.01, F.greatest(F.least(F.abs(value), F.lit(1e12)), F.lit(1e-9)))) + F.lit(3000)
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size).cast("int")


def order_statistics(rows: DataFrame, keys: list[str], value: str, at: dict[str, str]) -> DataFrame:
    """(keys..., n, one column for each of ``at``): the value at a 0-based index of each group's sorted values.

    ``at`` maps names to SQL expressions of ``n``, the group's number of non-NULL values; NULL keys are a group. Groups
    without values do not appear; an index outside of 0..n-1 gives NULL.
    """
    by = [F.col(k) for k in keys]
    held = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    counted = held.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c")).withColumn("__b", value_bucket(F.col("__v")))
    along, whole = Window.partitionBy(*by).orderBy("__b"), Window.partitionBy(*by)
    buckets = (
        counted.groupBy(*keys, "__b").agg(F.sum("__c").alias("__t"))
        .withColumn("n", F.sum("__t").over(whole))
        .withColumn("__from", F.sum("__t").over(along) - F.col("__t"))
    )
    wanted = F.filter(
        F.array(*(F.struct(F.lit(name).alias("name"), F.expr(f"cast({e} AS bigint)").alias("i")) for name, e in at.items())),
        lambda x: (x["i"] >= F.col("__from")) & (x["i"] < F.col("__from") + F.col("__t")),
    )
    # Only the buckets that hold a wanted index go on.
    hit = buckets.withColumn("__w", wanted).filter(F.size("__w") > 0).select(*keys, "__b", "n", "__from", "__w")
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]
    met = F.col("c.__b") == F.col("h.__b")
    for s in same:
        met = met & s
    inside = Window.partitionBy(*by, "__b").orderBy("__v")
    placed = (
        counted.alias("c").join(hit.alias("h"), met).select("c.*", "h.n", "h.__from", "h.__w")
        .withColumn("__to", F.col("__from") + F.sum("__c").over(inside))
    )
    here = lambda name: F.max(
        F.when(
            F.exists("__w", lambda x: (x["name"] == name) & (x["i"] < F.col("__to")) & (x["i"] >= F.col("__to") - F.col("__c"))),
            F.col("__v"),
        )
    )
    return placed.groupBy(*keys, "n").agg(*(here(name).alias(name) for name in at))


def linear_percentiles(rows: DataFrame, keys: list[str], value: str, percents: list[int]) -> DataFrame:
    """Interpolated between the two values around (n-1) * p / 100: (keys..., n, p50, ...)."""
    k = lambda p: f"(({p} / 100.0D) * (n - 1))"
    at = {f"lo{p}": f"floor({k(p)})" for p in percents} | {f"hi{p}": f"least(n - 1, floor({k(p)}) + 1)" for p in percents}
    found = order_statistics(rows, keys, value, at)
    between = lambda p: F.expr(f"lo{p} + ({k(p)} - floor({k(p)})) * (hi{p} - lo{p})").alias(f"p{p}")
    return found.select(*keys, "n", *(between(p) for p in percents))


#: Truncated rank: the value at index int(n * share), the only one if n is 1; upper median: the value at n // 2.
def truncated_rank(share: float) -> str:
    return f"floor(n * {share}D)"


UPPER_MEDIAN = "n div 2"


def true_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., n, median): the mean of the two values in the middle, which for an odd n are one."""
    found = order_statistics(rows, keys, value, {"lo": "(n - 1) div 2", "hi": "n div 2"})
    return found.select(*keys, "n", F.expr("CASE WHEN lo = hi THEN lo ELSE (lo + hi) / 2 END").alias("median"))


def beside(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys of which NULL is one; without keys the one row of each."""
    if not keys:
        return rows.join(F.broadcast(other))  # one row
    named = other.withColumnsRenamed({k: f"__{k}" for k in keys})
    return rows.join(named, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left").drop(*(f"__{k}" for k in keys))


def rank_percentiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., n, median, p95, p99) by rank: the upper median and truncated ranks, without interpolation."""
    return order_statistics(
        rows, keys, value, {"median": UPPER_MEDIAN, "p95": truncated_rank(0.95), "p99": truncated_rank(0.99)}
    )


def latency_statistics(results: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: num_samples, num_errors, and over successes mean, median, std, min, max, p50, p90, p95, p99.

    A success has a ttfb_seconds and no error; a row may be neither. Statistics are NULL without successes; the
    standard deviation of one value is 0.
    """
    good = F.col("ttfb_seconds").isNotNull() & F.col("error").isNull()
    value = F.when(good, F.col("ttfb_seconds"))
    base = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_samples"), F.count("error").alias("num_errors"), F.avg(value).alias("ttfb_mean"),
        F.when(F.count(value) > 0, F.coalesce(F.stddev_samp(value), F.lit(0.0))).alias("ttfb_std"),
        F.min(value).alias("ttfb_min"), F.max(value).alias("ttfb_max"),
    )
    ranks = linear_percentiles(results.filter(good), keys, "ttfb_seconds", [50, 90, 95, 99]).drop("n")
    names = {k: f"__{k}" for k in keys}
    ranks = ranks.withColumnsRenamed(names)
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return base.join(ranks, same, "left").select(
        *base.columns, F.col("p50").alias("ttfb_median"), *(F.col(f"p{p}").alias(f"ttfb_p{p}") for p in (50, 90, 95, 99))
    )


def latency_by_duration(results: DataFrame, keys: list[str]) -> DataFrame:
    """Mean latency of the successes per duration bucket; empty buckets do not appear."""
    good = results.filter(F.col("ttfb_seconds").isNotNull() & F.col("error").isNull())
    bucket = duration_bucket(F.col("audio_duration_seconds")).alias("bucket")
    return good.groupBy(*keys, bucket).agg(F.avg("ttfb_seconds").alias("ttfb_mean"), F.count(F.lit(1)).alias("n"))


def as_map(rows: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    """Long rows to one map a group, e.g. of the few duration buckets."""
    entry = F.struct(F.col(label), F.col(value))
    return rows.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias(value))


def duration_histogram(samples: DataFrame, seconds: str) -> DataFrame:
    return samples.groupBy(duration_bucket(F.col(seconds)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def wer_histogram(scores: DataFrame, wer: str) -> DataFrame:
    """All six buckets in order, with 0 for empty ones: (ordinal, bucket, n)."""
    spark = scores.sparkSession
    labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(WER_BUCKETS)], "ordinal int, bucket string")
    counts = scores.groupBy(wer_bucket(F.col(wer)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return labels.join(counts, "bucket", "left").select("ordinal", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def pooled(errors: Column, words: Column) -> Column:
    """Sum of errors over sum of words; 0 where there are no words."""
    total = F.sum(words)
    return F.when(F.coalesce(total, F.lit(0)) > 0, F.sum(errors) / F.nullif(total, F.lit(0))).otherwise(0.0)


def transcript_stats(results: DataFrame, keys: list[str]) -> DataFrame:
    """total_runs, successful and failed transcripts (empty counts as failed), success_rate, and rank percentiles of the
    latencies over 0 (0.0 where there are none)."""
    good = F.col("transcription").isNotNull() & (F.col("transcription") != "")
    base = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_runs"), F.count_if(good).alias("successful_transcripts"),
        F.count_if(~F.coalesce(good, F.lit(False))).alias("failed_transcripts"),
    ).withColumn("success_rate", F.col("successful_transcripts") / F.col("total_runs"))
    ranks = rank_percentiles(results.filter(F.col("ttfb_seconds") > 0), keys, "ttfb_seconds")
    ranks = ranks.withColumnsRenamed({k: f"__{k}" for k in keys})
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(f"ttfb_{c}")
    return base.join(ranks, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left").select(
        *base.columns, zero("median"), zero("p95"), zero("p99")
    )


def wer_statistics(scores: DataFrame, keys: list[str], infinite: str = "pooled_only") -> DataFrame:
    """num_samples, mean, median, std, min, max of wer, and the pooled rate.

    ``infinite`` says where rows with an infinite wer count: ``pooled_only`` (in counts and the pooled rate),
    ``nowhere``, or ``everywhere`` (the mean is then infinite).
    """
    finite = F.col("wer") < float("inf")
    if infinite == "nowhere":
        scores = scores.filter(finite)
    wer = F.col("wer") if infinite == "everywhere" else F.when(finite, F.col("wer"))
    errors = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    base = scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_samples"), zero(F.avg(wer)).alias("wer_mean"),
        zero(F.stddev_samp(wer)).alias("wer_std"), zero(F.min(wer)).alias("wer_min"), zero(F.max(wer)).alias("wer_max"),
        pooled(errors, F.col("reference_words")).alias("pooled_wer"),
    )
    middle = true_median(scores.withColumn("__wer", wer).filter(F.col("__wer").isNotNull()), keys, "__wer").drop("n")
    return beside(base, middle, keys).select(
        *keys, "num_samples", "wer_mean", zero(F.col("median")).alias("wer_median"), "wer_std", "wer_min", "wer_max", "pooled_wer"
    )


#: Rates from which a result counts as an outlier, and as one worth listing.
OUTLIER, LISTED = 0.5, 0.2


def outliers(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n, n_outliers, n_listed): scores above OUTLIER and above LISTED."""
    over = lambda limit: F.count_if(F.col("wer") > limit)
    return scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), over(OUTLIER).alias("n_outliers"), over(LISTED).alias("n_listed"))
