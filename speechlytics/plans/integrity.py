"""Queries on redelivered messages (p2) and on orphan references (p5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlytics.operators.deliveries import admit_batch, first_delivery, redelivered
from speechlytics.operators.orphans import ForeignKey, orphan_cascade, temporal_orphans
from speechlytics.plans.registry import Registry
from speechlytics.session import Written, clean_key, clean_key_or, table

integrity = Registry()

MESSAGE_KEY = ["id", "vendor", "condition"]
#: Messages received from this time on count as new batches in the admission query.
NEW_FROM = "2025-06-01 00:00:00"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identity_results with its identifier cleaned by the key rule."""
    return table(spark, sf_dir, "identity_results").withColumns(
        {"id": clean_key("id"), "vendor": clean_key("vendor"), "condition": clean_key_or("condition", "none")}
    )


_MESSAGES_SQL = """
    SELECT lower(trim(id, ' ' || chr(9))) AS id, lower(trim(vendor, ' ' || chr(9))) AS vendor,
           coalesce(nullif(lower(trim(condition, ' ' || chr(9))), ''), 'none') AS condition,
           transcript, ttfs, error, batch, received_at
    FROM identity_results
"""


@integrity.query(
    f"""
    SELECT id, vendor, condition FROM ({_MESSAGES_SQL}) m GROUP BY id, vendor, condition HAVING count(*) > 1
    """
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every identifier that stands in more than one row."""
    return redelivered(messages(spark, sf_dir), MESSAGE_KEY, "received_at")


@integrity.query(
    f"""
    SELECT id, vendor, condition, transcript, ttfs, error, batch, received_at, n_copies FROM (
        SELECT *, row_number() OVER (PARTITION BY id, vendor, condition ORDER BY received_at ASC NULLS LAST,
                   batch ASC NULLS LAST, error ASC NULLS LAST, transcript ASC NULLS LAST, ttfs ASC NULLS LAST) AS rn,
               count(*) OVER (PARTITION BY id, vendor, condition) AS n_copies
        FROM ({_MESSAGES_SQL}) m) r
    WHERE rn = 1
    """
)
def p2_first_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages with exactly one row an identifier."""
    return first_delivery(messages(spark, sf_dir), MESSAGE_KEY, "received_at")


@integrity.query(
    f"""
    WITH m AS ({_MESSAGES_SQL}),
    new AS (
        SELECT *, row_number() OVER (PARTITION BY id, vendor, condition ORDER BY received_at ASC NULLS LAST,
                   batch ASC NULLS LAST, error ASC NULLS LAST, transcript ASC NULLS LAST, ttfs ASC NULLS LAST) AS rn
        FROM m WHERE received_at >= TIMESTAMPTZ '{NEW_FROM}+00')
    SELECT id, vendor, condition, transcript, ttfs, error, batch, received_at FROM new
    WHERE rn = 1 AND NOT EXISTS (
        SELECT 1 FROM m WHERE m.received_at < TIMESTAMPTZ '{NEW_FROM}+00'
          AND m.id IS NOT DISTINCT FROM new.id AND m.vendor IS NOT DISTINCT FROM new.vendor
          AND m.condition IS NOT DISTINCT FROM new.condition)
    """
)
def p2_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the later batches, the messages whose identifier the earlier ones had not brought."""
    everything, border = messages(spark, sf_dir), F.lit(NEW_FROM).cast("timestamp")
    stored = everything.filter(F.col("received_at") < border)
    return admit_batch(stored, everything.filter(F.col("received_at") >= border), MESSAGE_KEY, "received_at")


def sample_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "samples").select(
        clean_key("sample_id").alias("parent_id"),
        F.col("added_at").alias("valid_from"),
        F.col("removed_at").alias("valid_to"),
    )


def _period() -> Column:
    return F.date_format("ref_time", "yyyy-MM").alias("period")


_ORPHANS_SQL = """
    WITH s AS (SELECT lower(trim(sample_id, ' ' || chr(9))) AS sid, added_at, removed_at FROM samples
               WHERE sample_id IS NOT NULL),
    refs AS (
        SELECT 'results' AS table_name, lower(trim(sample_id, ' ' || chr(9))) AS sid, timestamp AS t FROM results
        UNION ALL
        SELECT 'gold_transcripts', lower(trim(sample_id, ' ' || chr(9))), generated_at FROM gold_transcripts),
    k AS (SELECT sid, min(added_at) AS first_at FROM s GROUP BY sid),
    lost AS (
        SELECT r.table_name, strftime(r.t AT TIME ZONE 'UTC', '%Y-%m') AS period, r.sid AS sample_id,
               CASE WHEN k.sid IS NULL THEN 'missing' WHEN r.t < k.first_at THEN 'early' ELSE 'removed' END AS reason
        FROM refs r LEFT JOIN k ON r.sid = k.sid
        WHERE r.sid IS NOT NULL AND NOT EXISTS (
            SELECT 1 FROM s WHERE s.sid = r.sid AND s.added_at <= r.t AND (s.removed_at IS NULL OR r.t < s.removed_at)))
"""


@integrity.query(_ORPHANS_SQL + "SELECT DISTINCT table_name, period, sample_id, reason FROM lost")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orphan references to samples, per table and month: the cascade's rows of level 0 that refer to samples."""
    return sample_orphans(spark, sf_dir).select("table_name", "period", "sample_id", "reason").distinct()


@integrity.query(
    _ORPHANS_SQL
    + """
    SELECT table_name, period, reason, count(*) AS n_rows, count(DISTINCT sample_id) AS n_ids
    FROM lost GROUP BY table_name, period, reason
    """
)
def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many references are orphans, per table, month and reason."""
    lost = sample_orphans(spark, sf_dir)
    by_id = lost.groupBy("table_name", "period", "reason", "sample_id").agg(F.sum("n").alias("n"))
    return by_id.groupBy("table_name", "period", "reason").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_ids")
    )


@integrity.query(
    """
    WITH s AS (SELECT lower(trim(sample_id, ' ' || chr(9))) AS sid, added_at, removed_at FROM samples
               WHERE sample_id IS NOT NULL),
    r AS (
        SELECT lower(trim(service_name, ' ' || chr(9))) || '|'
               || coalesce(lower(trim(model_name, ' ' || chr(9))), '') || '|'
               || lower(trim(sample_id, ' ' || chr(9))) AS key,
               NOT EXISTS (SELECT 1 FROM s WHERE s.sid = lower(trim(results.sample_id, ' ' || chr(9)))
                   AND s.added_at <= timestamp AND (s.removed_at IS NULL OR timestamp < s.removed_at)) AS lost
        FROM results WHERE sample_id IS NOT NULL),
    p AS (SELECT key, bool_and(lost) AS lost FROM r GROUP BY key),
    j AS (SELECT DISTINCT lower(trim(key, ' ' || chr(9))) AS key FROM runs WHERE key IS NOT NULL)
    SELECT 'results' AS table_name, 'direct' AS kind, 0 AS level, count(*) AS n_rows FROM r WHERE lost
    UNION ALL
    SELECT 'runs', 'direct', 0, count(*) FROM j WHERE key NOT IN (SELECT key FROM p WHERE key IS NOT NULL)
    HAVING count(*) > 0
    UNION ALL
    SELECT 'runs', 'inherited', 1, count(*) FROM j JOIN p USING (key) WHERE p.lost HAVING count(*) > 0
    """
)
def p5_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct and inherited orphans: judged keys hang from results, results hang from samples.

    As its SQL states, it counts distinct judged keys and leaves out gold_transcripts and months;
    ``p5_cascade_months`` reports whole rows of all three tables.
    """
    results = table(spark, sf_dir, "results").filter(F.col("sample_id").isNotNull())
    key = F.concat_ws(
        "|", clean_key("service_name"), F.coalesce(clean_key("model_name"), F.lit("")), clean_key("sample_id")
    )
    rows = results.select(
        F.col("id").alias("row_id"), key.alias("key"), clean_key("sample_id").alias("ref_id"),
        F.col("timestamp").alias("ref_time"),
    )
    lost = temporal_orphans(rows, sample_periods(spark, sf_dir)).select("row_id")
    judged = (
        table(spark, sf_dir, "runs").select(clean_key("key").alias("key")).filter(F.col("key").isNotNull()).distinct()
    )
    tables = {"results": rows.select("row_id", "key"), "runs": judged.select(F.col("key").alias("row_id"), "key")}
    found = orphan_cascade(tables, [ForeignKey("runs", "key", "results", "key")], {"results": lost})
    return found.groupBy("table_name", "kind", "level").agg(F.count(F.lit(1)).alias("n_rows"))


def orphan_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orphans of results, gold_transcripts and runs: (table_name, period, sample_id, reason, kind, level, n).

    References to samples are direct orphans by ``temporal_orphans``; a judgment is one where no result has its key, and
    inherits where all results of its key are orphans. runs has no time of its own: an inherited orphan takes the month
    of the last of its results, as they are all orphans only from then on, and a direct one has no month. Rows
    of gold_transcripts and runs that are alike in all that matters here are one record that stands for n rows.
    """
    key = F.concat(
        clean_key("service_name"), F.lit("|"), F.coalesce(clean_key("model_name"), F.lit("")), F.lit("|"),
        clean_key("sample_id"),
    )
    results = (
        table(spark, sf_dir, "results")
        .filter(F.col("sample_id").isNotNull())
        .select(
            F.lit("results").alias("table_name"), F.col("id").cast("string").alias("row_id"), key.alias("key"),
            clean_key("sample_id").alias("ref_id"), F.col("timestamp").alias("ref_time"), F.lit(1).cast("long").alias("n"),
        )
    )
    texts = (
        table(spark, sf_dir, "gold_transcripts")
        .filter(F.col("sample_id").isNotNull())
        .groupBy(clean_key("sample_id").alias("ref_id"), F.col("generated_at").alias("ref_time"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    at = F.coalesce(F.unix_micros("ref_time").cast("string"), F.lit(""))
    texts = texts.select(
        F.lit("gold_transcripts").alias("table_name"), F.concat(at, F.lit(" "), "ref_id").alias("row_id"),
        F.lit(None).cast("string").alias("key"), "ref_id", "ref_time", "n",
    )
    runs = table(spark, sf_dir, "runs").select(clean_key("key").alias("key")).filter(F.col("key").isNotNull())
    judged = runs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(F.col("key").alias("row_id"), "key", "n")

    lost = Written(temporal_orphans(results.unionByName(texts), sample_periods(spark, sf_dir)), "orphan-references").read()
    tables = {"results": results, "gold_transcripts": texts, "runs": judged}
    direct = {n: lost.filter(F.col("table_name") == n).select("row_id") for n in ("results", "gold_transcripts")}
    found = orphan_cascade(tables, [ForeignKey("runs", "key", "results", "key")], direct)
    references = found.join(lost, ["table_name", "row_id"]).select(
        "table_name", _period(), F.col("ref_id").alias("sample_id"), "reason", "kind", "level", "n"
    )
    last = lost.filter(F.col("key").isNotNull()).groupBy("key").agg(F.max("ref_time").alias("ref_time"))
    none = F.lit(None).cast("string")
    judgments = (
        found.filter(F.col("table_name") == "runs")
        .join(judged, "row_id")
        .join(last, "key", "left")
        .select("table_name", _period(), none.alias("sample_id"), none.alias("reason"), "kind", "level", "n")
    )
    return references.unionByName(judgments)


def sample_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the orphans, the references to samples, which are all of level 0."""
    found = orphan_records(spark, sf_dir)
    return found.filter(F.col("table_name").isin("results", "gold_transcripts") & (F.col("level") == 0))


@integrity.query(
    _ORPHANS_SQL
    + """
    , r AS (
        SELECT lower(trim(service_name, ' ' || chr(9))) || '|'
               || coalesce(lower(trim(model_name, ' ' || chr(9))), '') || '|'
               || lower(trim(sample_id, ' ' || chr(9))) AS key, timestamp AS t,
               NOT EXISTS (SELECT 1 FROM s WHERE s.sid = lower(trim(results.sample_id, ' ' || chr(9)))
                   AND s.added_at <= timestamp AND (s.removed_at IS NULL OR timestamp < s.removed_at)) AS lost
        FROM results WHERE sample_id IS NOT NULL),
    p AS (SELECT key, bool_and(lost) AS lost, max(t) AS t FROM r WHERE key IS NOT NULL GROUP BY key),
    j AS (SELECT lower(trim(key, ' ' || chr(9))) AS key FROM runs WHERE key IS NOT NULL)
    SELECT table_name, period, 'direct' AS kind, 0 AS level, count(*) AS n_rows FROM lost GROUP BY table_name, period
    UNION ALL
    SELECT 'runs', NULL, 'direct', 0, count(*) FROM j WHERE key NOT IN (SELECT key FROM p) HAVING count(*) > 0
    UNION ALL
    SELECT 'runs', strftime(p.t AT TIME ZONE 'UTC', '%Y-%m'), 'inherited', 1, count(*)
    FROM j JOIN p USING (key) WHERE p.lost GROUP BY 2
    """
)
def p5_cascade_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of results, gold_transcripts and runs are direct or inherited orphans, per month."""
    found = orphan_records(spark, sf_dir)
    return found.groupBy("table_name", "period", "kind", "level").agg(F.sum("n").alias("n_rows"))
