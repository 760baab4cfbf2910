"""Service summaries, rankings, the Pareto frontier, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechlytics.operators.stats import UPPER_MEDIAN, order_statistics, pooled, truncated_rank
from speechlytics.operators.store import no_model

_KEY = ["service_name", "model_name"]


def scored_results(scores: DataFrame, results: DataFrame) -> DataFrame:
    """Scores with the latency and transcript of the result they belong to, by sample, service and model."""
    heard = results.select("sample_id", "service_name", no_model().alias("model_name"), "ttfb_seconds", "transcription")
    return scores.withColumn("model_name", no_model()).join(heard, ["sample_id", *_KEY])


def service_summary(scores: DataFrame, results: DataFrame) -> DataFrame:
    """Per service and model over scores that have a result: counts, mean, rank median and p95 of wer, pooled_wer,
    perfect_count, and rank percentiles of the latencies (0 where there are none).

    An infinite wer counts everywhere. One join feeds all figures.
    """
    rows = scored_results(scores, results)
    errors = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    base = rows.groupBy(*_KEY).agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg("wer").alias("wer_mean"),
        pooled(errors, F.col("reference_words")).alias("pooled_wer"), F.count_if(F.col("wer") == 0).alias("perfect_count"),
    )
    # Both measures go through one ranking, as rows of (measure, value).
    measures = F.explode(F.array(*(
        F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in ("wer", "ttfb_seconds")
    ))).alias("m")
    long = rows.select(*_KEY, measures).select(*_KEY, "m.measure", "m.value")
    at = {"median": UPPER_MEDIAN, "p95": truncated_rank(0.95), "p99": truncated_rank(0.99)}
    ranks = order_statistics(long, [*_KEY, "measure"], "value", at)
    of = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    zero = lambda c: F.coalesce(of("ttfb_seconds", c), F.lit(0.0)).alias(f"ttfb_{c}")
    wide = ranks.groupBy(*_KEY).agg(
        of("wer", "median").alias("wer_median"), of("wer", "p95").alias("wer_p95"), zero("median"), zero("p95"), zero("p99")
    )
    return base.join(wide, _KEY, "left").withColumns(
        {c: F.coalesce(c, F.lit(0.0)) for c in ("ttfb_median", "ttfb_p95", "ttfb_p99")}
    )


def report_rows(scores: DataFrame, truth: DataFrame, results: DataFrame, samples: DataFrame) -> DataFrame:
    """Everything known of each scored sample; order by wer descending, then sample_id, for the worst ones."""
    return (
        scored_results(scores, results)
        .join(truth.select("sample_id", F.col("text").alias("ground_truth")), "sample_id")
        .join(samples.select("sample_id", F.col("duration_seconds").alias("duration")), "sample_id")
    )


def with_dataset_index(report: DataFrame, samples: DataFrame) -> DataFrame:
    """Report rows with the dataset_index of their sample, NULL where there is none."""
    one = samples.groupBy("sample_id").agg(F.min("dataset_index").alias("dataset_index"))
    return report.join(one, "sample_id", "left")


def by_mean_wer(summary: DataFrame) -> DataFrame:
    """A summary in order of mean wer, best first, with its place."""
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("wer_mean"), *_KEY)).alias("place")  # one row a service
    return summary.select("*", place).orderBy("place")


def worst(report: DataFrame, count: int) -> DataFrame:
    return report.orderBy(F.desc("wer"), "service_name", "model_name", "sample_id").limit(count)


def rankings(summary: DataFrame) -> DataFrame:
    """Ranks by perfect share (high first), pooled wer and median latency (low first), with the label of each.

    Ties keep the order of service and model. The summary has one row a service, so the unpartitioned windows are small.
    """
    tie = ["service_name", "model_name"]
    order = {
        "rank_perfect": [F.desc("perfect_pct"), *tie],
        "rank_pooled": [F.asc_nulls_last("pooled_wer"), *tie],
        "rank_latency": [F.asc_nulls_last("ttfb_median"), *tie],
    }
    ranked = summary.withColumn("perfect_pct", F.col("perfect_count") / F.col("sample_count") * 100)
    for name, columns in order.items():
        ranked = ranked.withColumn(name, F.row_number().over(Window.orderBy(*columns)))
        ranked = ranked.withColumn(name.replace("rank_", "medal_"), medal(F.col(name)))
    return ranked


def medal(rank: Column) -> Column:
    first = {1: "🥇", 2: "🥈", 3: "🥉"}
    label = F.when(rank.isNull(), F.lit(None).cast("string"))
    for place, sign in first.items():
        label = label.when(rank == place, sign)
    return label.otherwise(F.concat(rank.cast("string"), F.lit(".")))


def pareto_frontier(points: DataFrame, x: str, y: str) -> DataFrame:
    """The points that no other one beats in both x and y (low is good); equal points all stay; NULLs never count.

    A point is beaten iff some smaller x has a y not above its own, or its own x a smaller one. Points are first
    reduced to the least y of each x, and those, in ranges of x, to running minima: of every range the windows see
    only the distinct x, and the ranges' own minima.
    """
    held = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    steps = held.groupBy(F.col(x).alias("__x")).agg(F.min(y).alias("__y"))
    from speechlytics.operators.stats import value_bucket

    steps = steps.withColumn("__b", value_bucket(F.col("__x")))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = steps.groupBy("__b").agg(F.min("__y").alias("__m")).withColumn("__m", F.min("__m").over(before))
    within = Window.partitionBy("__b").orderBy("__x").rowsBetween(Window.unboundedPreceding, -1)
    least = steps.withColumn("__w", F.min("__y").over(within)).join(ranges, "__b")
    good = least.filter(
        (F.col("__w").isNull() | (F.col("__w") > F.col("__y"))) & (F.col("__m").isNull() | (F.col("__m") > F.col("__y")))
    ).select("__x", "__y")
    return held.join(good, (F.col(x) == F.col("__x")) & (F.col(y) == F.col("__y")), "left_semi").orderBy(x, y)


def display_labels(rows: DataFrame, vendor: str, model: str) -> DataFrame:
    """``rows`` with a ``label``: the vendor, or vendor and model where the vendor has several rows and a model to show."""
    several = F.count(F.lit(1)).over(Window.partitionBy(vendor)) > 1
    shown = F.col(model).isNotNull() & ~F.col(model).isin("", "N/A")
    return rows.withColumn("label", F.when(several & shown, F.concat_ws(" ", vendor, model)).otherwise(F.col(vendor)))


def rename_display(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Names replaced by those of (name, display) where there is one."""
    return rows.join(names, F.col(column) == F.col("name"), "left").withColumn(
        column, F.coalesce("display", column)
    ).drop("name", "display")


def table_order(rows: DataFrame) -> list[Column]:
    """Order of the published table: vendor, current models first, model; without case. Unknown rows count as current."""
    current = F.coalesce(F.col("is_current"), F.lit(True)) if "is_current" in rows.columns else F.lit(True)
    return [F.lower("vendor").asc(), current.desc(), F.lower("model").asc()]


def rank_shift(before: DataFrame, after: DataFrame, key: str, metric: str) -> DataFrame:
    """Old and new rank of each service by a metric (low first), and who follows it in the new order."""
    by = Window.orderBy(F.asc_nulls_last(metric), key)
    old = before.select(key, F.row_number().over(by).alias("old_rank"))
    new = after.select(key, metric, F.row_number().over(by).alias("new_rank"), F.lead(key).over(by).alias("next_service"))
    return new.join(old, key, "left").withColumn("moved", F.col("old_rank") - F.col("new_rank"))
