"""The queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlytics.llm import addresses, consensus, leakage, packing, quantiles, spans
from speechlytics.plans.registry import Registry
from speechlytics.session import Written, clean_key, table

llm_queries = Registry()


def judged(spark: SparkSession, sf_dir: str) -> consensus.Consensus | None:
    """The consensus of the judges' error counts, with the service, the model and the reference words as features."""
    runs = table(spark, sf_dir, "runs").filter(F.col("result").isNotNull())
    key = clean_key("key")
    labels = runs.select(
        key.alias("item"),
        clean_key("judge").alias("annotator"),
        "repeat",
        F.col("result.error_count").alias("label"),
        F.coalesce(F.split(key, "[|]").getItem(0), F.lit("")).alias("service"),
        F.concat_ws("|", F.slice(F.split(key, "[|]"), 1, 2)).alias("service_model"),
        F.log1p(F.greatest(F.col("result.reference_words"), F.lit(0)) / F.lit(10)).alias("length"),
    )
    return consensus.fit_consensus(labels, ["service", "service_model"], ["length"])


@llm_queries.query()
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consensus error count of every judged key."""
    fitted = judged(spark, sf_dir)
    if fitted is None:
        return spark.createDataFrame([], "key string, error_count int")
    return fitted.items().select(F.col("item").alias("key"), F.col("label").alias("error_count"))


@llm_queries.query()
def p1_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per judged key, the consensus with its probability and how far the judges agree."""
    fitted = judged(spark, sf_dir)
    if fitted is None:
        return spark.createDataFrame(
            [], "key string, error_count int, confidence double, agreement double, corrected double, n_judges bigint"
        )
    items = fitted.items()
    return items.select(
        F.col("item").alias("key"), F.col("label").alias("error_count"), "confidence", "agreement", "corrected",
        F.col("n_annotators").alias("n_judges"),
    )


@llm_queries.query()
def p1_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per judge, its reliability and bias, and on which judge it depends."""
    fitted = judged(spark, sf_dir)
    if fitted is None:
        return spark.createDataFrame([], "judge string, reliability double, bias double, n_votes double, dependent_on string")
    return fitted.annotators().withColumnRenamed("annotator", "judge")


def address_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "items").filter(clean_key("field") == "address")
    return items.select(clean_key("id").alias("id"), "expected", "record")


def heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "identity_results").select(clean_key("id").alias("id"), "transcript")


@llm_queries.query()
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of address items that denote the same place."""
    return addresses.same_place(addresses.resolve(address_items(spark, sf_dir), heard(spark, sf_dir)))


@llm_queries.query()
def p3_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each address item with its place, named by the least item id."""
    items = address_items(spark, sf_dir)
    return addresses.places(items, addresses.resolve(items, heard(spark, sf_dir)))


@llm_queries.query(
    """
    WITH v AS (
        SELECT lower(trim(service_name, ' ' || chr(9))) AS service_name, coalesce(model_name, '') AS model_name,
               strftime(timestamp AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, ttfb_seconds AS x
        FROM results WHERE ttfb_seconds IS NOT NULL),
    both_levels AS (SELECT * FROM v UNION ALL SELECT service_name, model_name, 'all', x FROM v),
    r AS (
        SELECT *, row_number() OVER (PARTITION BY service_name, model_name, day ORDER BY x) AS k,
               count(*) OVER (PARTITION BY service_name, model_name, day) AS n
        FROM both_levels)
    SELECT service_name, model_name, day, n,
           max(x) FILTER (k = (50 * n + 99) // 100) AS p50, max(x) FILTER (k = (90 * n + 99) // 100) AS p90,
           max(x) FILTER (k = (95 * n + 99) // 100) AS p95, max(x) FILTER (k = (99 * n + 99) // 100) AS p99
    FROM r GROUP BY service_name, model_name, day, n
    """
)
def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, p90, p95 and p99 of ttfb_seconds per service and model, per day and for all days; exact."""
    rows = table(spark, sf_dir, "results").select(
        clean_key("service_name").alias("service_name"),
        F.coalesce("model_name", F.lit("")).alias("model_name"),
        F.date_format("timestamp", "yyyy-MM-dd").alias("day"),
        "ttfb_seconds",
    )
    return quantiles.daily_and_overall(rows, ["service_name", "model_name"], "day", "ttfb_seconds")


@llm_queries.query()
def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's container, one packing for each kind of container."""
    return packing.packings(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))


@llm_queries.query()
def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind, the number of containers and how full they are."""
    kinds = table(spark, sf_dir, "containers")
    return packing.fill_report(packing.packings(table(spark, sf_dir, "documents"), kinds), kinds)


@llm_queries.query(
    """
    SELECT container_kind, (SELECT count(DISTINCT doc_id) FROM documents) AS n_documents, 0::BIGINT AS over_capacity,
           0::BIGINT AS split_needlessly, 0::BIGINT AS tokens_lost
    FROM containers WHERE capacity_tokens >= 1 GROUP BY container_kind
    """
)
def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind what must hold of a packing: every document is there, no container is over its capacity, no document is split
    that fits, and every document's tokens are all packed once."""
    documents, kinds = table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers")
    lengths = Written(packing.token_lengths(documents), "lengths").read()
    packed = Written(packing.packings(documents, kinds), "packed").read()
    return packing.invariants(packed, lengths, kinds)


@llm_queries.query()
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the held-out items it contains a passage of."""
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "test_items"))


@llm_queries.query()
def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which held-out items leaked, and into how many documents."""
    return leakage.leakage_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "test_items"))


@llm_queries.query()
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of documents with a common run of at least 400 code points."""
    return spans.sharing_pairs(table(spark, sf_dir, "documents"))


@llm_queries.query()
def p8_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, how many of its characters other documents share, and its class."""
    return spans.shared_amount(table(spark, sf_dir, "documents"))
