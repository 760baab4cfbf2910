"""Queries on latencies, transcripts and scores of the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlytics.functions.wording import count_words, weighted_count
from speechlytics.operators import judging, leaderboard, stats, store
from speechlytics.plans.registry import Registry
from speechlytics.session import clean_key, table

latency = Registry()
_ROUND = 6


def rounded(df: DataFrame, *columns: str, digits: int = _ROUND) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """results with clean ids, and no model as ''."""
    return table(spark, sf_dir, "results").withColumns(
        {"sample_id": clean_key("sample_id"), "model_name": store.no_model()}
    )


RESULTS_SQL = """
    r AS (SELECT id, lower(trim(sample_id, ' ' || chr(9))) AS sample_id, service_name, coalesce(model_name, '') AS model_name,
                 ttfb_seconds, transcription, audio_duration_seconds, timestamp, error FROM results)
"""


@latency.query(
    f"""
    WITH {RESULTS_SQL},
    g AS (SELECT service_name, count(*) AS num_samples, count(error) AS num_errors,
                 avg(x) AS m, coalesce(stddev_samp(x), 0) AS s, min(x) AS lo, max(x) AS hi,
                 quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.9) AS p90, quantile_cont(x, 0.95) AS p95,
                 quantile_cont(x, 0.99) AS p99
          FROM (SELECT *, CASE WHEN error IS NULL THEN ttfb_seconds END AS x FROM r) GROUP BY service_name)
    SELECT service_name, num_samples, num_errors, round(m, 6) AS ttfb_mean, round(s, 6) AS ttfb_std, lo AS ttfb_min,
           hi AS ttfb_max, round(p50, 6) AS ttfb_median, round(p50, 6) AS ttfb_p50, round(p90, 6) AS ttfb_p90,
           round(p95, 6) AS ttfb_p95, round(p99, 6) AS ttfb_p99,
           row_number() OVER (ORDER BY round(p50, 6) NULLS LAST, service_name) AS latency_rank
    FROM g
    """
)
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency statistics per service with interpolated percentiles, ranked by median."""
    found = stats.latency_statistics(results(spark, sf_dir), ["service_name"])
    found = rounded(found, "ttfb_mean", "ttfb_std", "ttfb_median", *(f"ttfb_p{p}" for p in (50, 90, 95, 99)))
    rank = F.expr("row_number() OVER (ORDER BY ttfb_median ASC NULLS LAST, service_name)")
    return found.withColumn("latency_rank", rank)


@latency.query(
    f"""
    WITH {RESULTS_SQL},
    k AS (SELECT service_name, model_name, ttfb_seconds AS x,
                 row_number() OVER (PARTITION BY service_name, model_name ORDER BY ttfb_seconds) - 1 AS i,
                 count(*) OVER (PARTITION BY service_name, model_name) AS n
          FROM r WHERE ttfb_seconds IS NOT NULL)
    SELECT service_name, model_name, n, max(x) FILTER (i = n // 2) AS median,
           max(x) FILTER (i = floor(n * 0.95::DOUBLE)::BIGINT) AS p95, max(x) FILTER (i = floor(n * 0.99::DOUBLE)::BIGINT) AS p99
    FROM k GROUP BY service_name, model_name, n
    """
)
def latency_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median and truncated-rank percentiles, without interpolation."""
    return stats.rank_percentiles(results(spark, sf_dir), ["service_name", "model_name"], "ttfb_seconds")


_DURATION_SQL = """CASE WHEN audio_duration_seconds IS NULL THEN NULL WHEN audio_duration_seconds < 2 THEN '0-2s'
    WHEN audio_duration_seconds < 5 THEN '2-5s' WHEN audio_duration_seconds < 10 THEN '5-10s' ELSE '10s+' END"""


@latency.query(
    f"""
    WITH {RESULTS_SQL}
    SELECT service_name, {_DURATION_SQL} AS bucket, round(avg(ttfb_seconds), 6) AS ttfb_mean, count(*) AS n
    FROM r WHERE ttfb_seconds IS NOT NULL AND error IS NULL GROUP BY 1, 2
    """
)
def latency_by_duration_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.latency_by_duration(results(spark, sf_dir), ["service_name"]), "ttfb_mean")


@latency.query(f"WITH {RESULTS_SQL} SELECT {_DURATION_SQL} AS bucket, count(*) AS n FROM r GROUP BY 1")
def duration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.duration_histogram(results(spark, sf_dir), "audio_duration_seconds")


@latency.query(
    f"""
    WITH {RESULTS_SQL},
    g AS (SELECT service_name, model_name, count(*) AS total_runs,
                 count(*) FILTER (transcription IS NOT NULL AND transcription <> '') AS successful_transcripts
          FROM r GROUP BY ALL),
    k AS (SELECT service_name, model_name, ttfb_seconds AS x,
                 row_number() OVER (PARTITION BY service_name, model_name ORDER BY ttfb_seconds) - 1 AS i,
                 count(*) OVER (PARTITION BY service_name, model_name) AS n
          FROM r WHERE ttfb_seconds > 0),
    p AS (SELECT service_name, model_name, max(x) FILTER (i = n // 2) AS m,
                 max(x) FILTER (i = floor(n * 0.95::DOUBLE)::BIGINT) AS p95, max(x) FILTER (i = floor(n * 0.99::DOUBLE)::BIGINT) AS p99
          FROM k GROUP BY ALL)
    SELECT service_name, model_name, total_runs, successful_transcripts,
           total_runs - successful_transcripts AS failed_transcripts,
           round(successful_transcripts / total_runs, 6) AS success_rate, coalesce(m, 0) AS ttfb_median,
           coalesce(p95, 0) AS ttfb_p95, coalesce(p99, 0) AS ttfb_p99
    FROM g LEFT JOIN p USING (service_name, model_name)
    """
)
def transcript_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success rates (an empty transcript failed) and rank percentiles of latencies over 0."""
    return rounded(stats.transcript_stats(results(spark, sf_dir), ["service_name", "model_name"]), "success_rate")


#: The judge whose first repeats stand for the stored scores, and the one compared with it.
STORED_JUDGE, NEW_JUDGE = "orbit-2:high", "lumen-pro:medium"


def scores(spark: SparkSession, sf_dir: str, judge: str = STORED_JUDGE) -> DataFrame:
    """One judge's first results as stored scores: one row a judged key, weighted by error type."""
    runs = table(spark, sf_dir, "runs").filter(F.col("result").isNotNull())
    own = runs.filter((clean_key("judge") == judge) & (F.col("repeat") == 0)).select(clean_key("key").alias("key"), "result")
    one = store.latest(own, ["key"], ["result"])
    part = lambda k: F.split("key", r"\|").getItem(k)
    counts = {f"{k}s": weighted_count(F.col("result.errors"), k) for k in ("substitution", "deletion", "insertion")}
    return one.select(
        "key", part(0).alias("service_name"), part(1).alias("model_name"), part(2).alias("sample_id"),
        F.col("result.wer").alias("wer"), F.col("result.error_count").alias("error_count"),
        F.col("result.reference_words").alias("reference_words"), *(c.alias(n) for n, c in counts.items()),
        F.lit(judge).alias("judge"),
    )


def scores_sql(judge: str = STORED_JUDGE, name: str = "w") -> str:
    return f"""
    {name} AS (
        SELECT key, split_part(key, '|', 1) AS service_name, split_part(key, '|', 2) AS model_name,
               split_part(key, '|', 3) AS sample_id, res.wer AS wer, res.error_count AS error_count,
               res.reference_words AS reference_words,
               len(list_filter(res.errors, lambda e: e.type = 'substitution')) AS substitutions,
               len(list_filter(res.errors, lambda e: e.type = 'deletion')) AS deletions,
               len(list_filter(res.errors, lambda e: e.type = 'insertion')) AS insertions
        FROM (SELECT lower(trim(key, ' ' || chr(9))) AS key, result AS res,
                     row_number() OVER (PARTITION BY lower(trim(key, ' ' || chr(9))) ORDER BY result.wer DESC) AS rn
              FROM runs WHERE result IS NOT NULL AND repeat = 0
                AND lower(trim(judge, ' ' || chr(9))) = '{judge}')
        WHERE rn = 1)
    """


@latency.query(
    f"""
    WITH {scores_sql()},
    b(ordinal, bucket, lo, hi) AS (VALUES (0, '0% (perfect)', -1e300, 0.0), (1, '1-5%', 0.0, 0.05), (2, '6-10%', 0.05, 0.1),
        (3, '11-20%', 0.1, 0.2), (4, '21-50%', 0.2, 0.5), (5, '50%+ (outliers)', 0.5, 1e300))
    SELECT ordinal, bucket, count(w.wer) AS n FROM b LEFT JOIN w ON w.wer > lo AND w.wer <= hi GROUP BY ALL
    """
)
def wer_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six buckets of word error rates, empty ones with 0."""
    return stats.wer_histogram(scores(spark, sf_dir), "wer")


@latency.query(
    f"""
    WITH {scores_sql()}
    SELECT service_name, count(*) AS num_samples, round(avg(wer), 6) AS wer_mean, round(median(wer), 6) AS wer_median,
           round(coalesce(stddev_samp(wer), 0), 6) AS wer_std, min(wer) AS wer_min, max(wer) AS wer_max,
           round(sum(substitutions + deletions + insertions) / sum(reference_words), 6) AS pooled_wer
    FROM w GROUP BY service_name
    """
)
def mean_vs_pooled_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.wer_statistics(scores(spark, sf_dir), ["service_name"])
    return rounded(found, "wer_mean", "wer_median", "wer_std", "pooled_wer")


@latency.query(
    f"""
    WITH {scores_sql()},
    x AS (SELECT service_name, reference_words, substitutions + deletions + insertions AS e,
                 CASE WHEN reference_words <= 8 THEN 'Infinity'::DOUBLE ELSE wer END AS wer FROM w)
    SELECT service_name, 'pooled_only' AS policy, count(*) AS num_samples,
           round(coalesce(avg(wer) FILTER (wer < 'Infinity'::DOUBLE), 0), 6) AS wer_mean,
           round(sum(e) / sum(reference_words), 6) AS pooled_wer FROM x GROUP BY 1
    UNION ALL
    SELECT service_name, 'nowhere', count(*), round(avg(wer), 6), round(sum(e) / sum(reference_words), 6)
    FROM x WHERE wer < 'Infinity'::DOUBLE GROUP BY 1
    UNION ALL
    SELECT service_name, 'everywhere', count(*), round(avg(wer), 6), round(sum(e) / sum(reference_words), 6)
    FROM x GROUP BY 1
    """
)
def infinite_wer_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three ways infinite rates count; here references of up to 8 words are given one."""
    rows = scores(spark, sf_dir).withColumn(
        "wer", F.when(F.col("reference_words") <= 8, F.lit(float("inf"))).otherwise(F.col("wer"))
    )
    out = None
    for policy in ("pooled_only", "nowhere", "everywhere"):
        part = stats.wer_statistics(rows, ["service_name"], policy)
        part = part.select("service_name", F.lit(policy).alias("policy"), "num_samples", "wer_mean", "pooled_wer")
        out = part if out is None else out.unionByName(part)
    return rounded(out, "wer_mean", "pooled_wer")


_SUMMARY_SQL = f"""
    WITH {RESULTS_SQL}, {scores_sql()},
    j AS (SELECT w.*, r.ttfb_seconds FROM w JOIN r USING (sample_id, service_name, model_name)),
    a AS (SELECT service_name, model_name, count(*) AS sample_count, avg(wer) AS wer_mean,
                 coalesce(sum(substitutions + deletions + insertions) / nullif(sum(reference_words), 0), 0) AS pooled_wer,
                 count(*) FILTER (wer = 0) AS perfect_count FROM j GROUP BY ALL),
    wk AS (SELECT service_name, model_name, wer, row_number() OVER (PARTITION BY service_name, model_name ORDER BY wer) - 1 AS i,
                  count(*) OVER (PARTITION BY service_name, model_name) AS n FROM j),
    wp AS (SELECT service_name, model_name, max(wer) FILTER (i = n // 2) AS wer_median,
                  max(wer) FILTER (i = floor(n * 0.95::DOUBLE)::BIGINT) AS wer_p95 FROM wk GROUP BY ALL),
    tk AS (SELECT service_name, model_name, ttfb_seconds AS x,
                  row_number() OVER (PARTITION BY service_name, model_name ORDER BY ttfb_seconds) - 1 AS i,
                  count(*) OVER (PARTITION BY service_name, model_name) AS n FROM j WHERE ttfb_seconds IS NOT NULL),
    tp AS (SELECT service_name, model_name, max(x) FILTER (i = n // 2) AS m, max(x) FILTER (i = floor(n * 0.95::DOUBLE)::BIGINT) AS p95,
                  max(x) FILTER (i = floor(n * 0.99::DOUBLE)::BIGINT) AS p99 FROM tk GROUP BY ALL),
    s AS (SELECT service_name, model_name, sample_count, round(wer_mean, 6) AS wer_mean, round(pooled_wer, 6) AS pooled_wer,
                 perfect_count, wer_median, wer_p95, coalesce(m, 0) AS ttfb_median, coalesce(p95, 0) AS ttfb_p95,
                 coalesce(p99, 0) AS ttfb_p99
          FROM a JOIN wp USING (service_name, model_name) LEFT JOIN tp USING (service_name, model_name))
"""


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaderboard.service_summary(scores(spark, sf_dir), results(spark, sf_dir))
    return rounded(found, "wer_mean", "pooled_wer")


@latency.query(_SUMMARY_SQL + "SELECT * FROM s")
def service_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaderboard row of each service and model, from one join."""
    return _summary(spark, sf_dir)


@latency.query(
    _SUMMARY_SQL
    + """
    , k AS (SELECT service_name, model_name, perfect_count / sample_count * 100 AS perfect_pct, pooled_wer, ttfb_median FROM s),
    o AS (SELECT *, row_number() OVER (ORDER BY perfect_pct DESC, service_name, model_name) AS rank_perfect,
               row_number() OVER (ORDER BY pooled_wer, service_name, model_name) AS rank_pooled,
               row_number() OVER (ORDER BY ttfb_median, service_name, model_name) AS rank_latency FROM k)
    SELECT service_name, model_name, rank_perfect, rank_pooled, rank_latency,
           CASE rank_pooled WHEN 1 THEN '🥇' WHEN 2 THEN '🥈' WHEN 3 THEN '🥉' ELSE rank_pooled || '.' END AS medal_pooled
    FROM o
    """
)
def rankings_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.rankings(_summary(spark, sf_dir)).select(
        "service_name", "model_name", "rank_perfect", "rank_pooled", "rank_latency", "medal_pooled"
    )


@latency.query(
    _SUMMARY_SQL
    + """
    SELECT service_name, model_name, pooled_wer, ttfb_median FROM s a
    WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.ttfb_median <= a.ttfb_median AND b.pooled_wer <= a.pooled_wer
                      AND (b.ttfb_median < a.ttfb_median OR b.pooled_wer < a.pooled_wer))
    """
)
def pareto_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services that no other one beats in both latency and error rate."""
    found = leaderboard.pareto_frontier(_summary(spark, sf_dir), "ttfb_median", "pooled_wer")
    return found.select("service_name", "model_name", "pooled_wer", "ttfb_median")


@latency.query(
    """
    SELECT p_partkey, p_size, p_retailprice FROM part a
    WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size <= a.p_size AND b.p_retailprice <= a.p_retailprice
                      AND (b.p_size < a.p_size OR b.p_retailprice < a.p_retailprice))
    """
)
def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frontier of a larger set of points, with ties."""
    points = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return leaderboard.pareto_frontier(points, "p_size", "p_retailprice")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last version of each ground-truth text."""
    rows = table(spark, sf_dir, "gold_transcripts").withColumn("sample_id", clean_key("sample_id"))
    return store.latest(rows, ["sample_id"], ["generated_at", "verified_at", "text"])


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each sample."""
    rows = table(spark, sf_dir, "samples").withColumn("sample_id", clean_key("sample_id"))
    return store.latest(rows, ["sample_id"], ["added_at", "dataset_index", "language"])


TRUTH_SQL = """
    g AS (SELECT * EXCLUDE (rn) FROM (
        SELECT lower(trim(sample_id, ' ' || chr(9))) AS sample_id, text, model_used, generated_at, verified_by, verified_at,
               original_text, row_number() OVER (PARTITION BY lower(trim(sample_id, ' ' || chr(9)))
                   ORDER BY generated_at DESC NULLS LAST, verified_at DESC NULLS LAST, text DESC NULLS LAST) AS rn
        FROM gold_transcripts) WHERE rn = 1)
"""
SAMPLES_SQL = """
    s AS (SELECT * EXCLUDE (rn) FROM (
        SELECT lower(trim(sample_id, ' ' || chr(9))) AS sample_id, audio_path, duration_seconds, language, dataset_index,
               added_at, removed_at, row_number() OVER (PARTITION BY lower(trim(sample_id, ' ' || chr(9)))
                   ORDER BY added_at DESC NULLS LAST, dataset_index DESC NULLS LAST, language DESC NULLS LAST) AS rn
        FROM samples) WHERE rn = 1)
"""


@latency.query(
    f"""
    WITH {RESULTS_SQL}, {scores_sql()}, {TRUTH_SQL}, {SAMPLES_SQL}
    SELECT w.sample_id, w.service_name, w.model_name, w.wer, r.ttfb_seconds, r.transcription, g.text AS ground_truth,
           s.duration_seconds AS duration
    FROM w JOIN g USING (sample_id) JOIN r USING (sample_id, service_name, model_name) JOIN s USING (sample_id)
    """
)
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything known of each scored sample: a four-way join."""
    args = (spark, sf_dir)
    rows = leaderboard.report_rows(scores(*args), truth(*args), results(*args), samples(*args))
    return rows.select(
        "sample_id", "service_name", "model_name", "wer", "ttfb_seconds", "transcription", "ground_truth", "duration"
    )


@latency.query(
    f"""
    WITH {RESULTS_SQL}, {scores_sql()}, {TRUTH_SQL}, {SAMPLES_SQL}, top AS (
    SELECT DISTINCT w.sample_id, w.service_name, w.model_name, w.wer, w.error_count
    FROM w JOIN g USING (sample_id) JOIN r USING (sample_id, service_name, model_name) JOIN s USING (sample_id))
    SELECT * FROM top ORDER BY wer DESC, service_name, model_name, sample_id LIMIT 20
    """
)
def worst_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 worst scored samples, ties by key (a top-k report)."""
    args = (spark, sf_dir)
    rows = leaderboard.report_rows(scores(*args), truth(*args), results(*args), samples(*args))
    rows = rows.select("sample_id", "service_name", "model_name", "wer", "error_count").distinct()
    return leaderboard.worst(rows, 20)


@latency.query(
    f"""
    WITH {SAMPLES_SQL}, {RESULTS_SQL}
    SELECT sample_id, dataset_index FROM s
    WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.sample_id = s.sample_id AND r.service_name = 'cantor')
    """
)
def pending_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples without any result of a service."""
    queue = store.pending_samples(samples(spark, sf_dir), results(spark, sf_dir), "cantor")
    return queue.select("sample_id", "dataset_index")


@latency.query(f"WITH {SAMPLES_SQL}, {TRUTH_SQL} SELECT sample_id FROM s WHERE sample_id NOT IN (SELECT sample_id FROM g)")
def missing_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.missing_truth(samples(spark, sf_dir), truth(spark, sf_dir)).select("sample_id")


_PENDING_SQL = f"""
    WITH {SAMPLES_SQL}, {TRUTH_SQL}, {RESULTS_SQL}, {scores_sql()}
    SELECT {{}} s.sample_id FROM s JOIN r USING (sample_id) JOIN g USING (sample_id)
    WHERE r.service_name = 'voxaria' AND r.transcription IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM w WHERE w.sample_id = s.sample_id AND w.service_name = 'voxaria')
"""


@latency.query(_PENDING_SQL.format("DISTINCT"))
def pending_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcribed samples with ground truth that are not scored yet."""
    args = (spark, sf_dir)
    queue = store.pending_scores(samples(*args), results(*args), truth(*args), scores(*args), "voxaria")
    return queue.select("sample_id")


@latency.query(_PENDING_SQL.format(""))
def pending_scores_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a row for each result, as a join gives it."""
    args = (spark, sf_dir)
    queue = store.pending_scores(samples(*args), results(*args), truth(*args), scores(*args), "voxaria", strict=True)
    return queue.select("sample_id")


@latency.query(
    f"""
    WITH {RESULTS_SQL}
    SELECT sample_id, service_name, model_name, id, ttfb_seconds FROM (
        SELECT *, row_number() OVER (PARTITION BY sample_id, service_name, model_name ORDER BY timestamp DESC, id DESC) AS rn FROM r)
    WHERE rn = 1
    """
)
def latest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result log after keyed replacement: the later half upserted into the earlier."""
    rows = results(spark, sf_dir)
    border = F.lit("2025-05-01").cast("timestamp")
    stored, new = rows.filter(F.col("timestamp") < border), rows.filter(F.col("timestamp") >= border)
    merged = store.upsert(stored, new, store.RESULT_KEY, ["timestamp", "id"])
    return merged.select("sample_id", "service_name", "model_name", "id", "ttfb_seconds")


@latency.query(
    f"""
    WITH {TRUTH_SQL}, c AS (SELECT sample_id, upper(text) AS fixed FROM g WHERE verified_by IS NULL)
    SELECT g.sample_id, coalesce(c.fixed, g.text) AS text,
           CASE WHEN c.fixed IS NULL THEN g.original_text ELSE coalesce(g.original_text, g.text) END AS original_text,
           CASE WHEN c.fixed IS NULL THEN g.verified_by ELSE 'reviewer' END AS verified_by
    FROM g LEFT JOIN c USING (sample_id)
    """
)
def ground_truth_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections keep the first text they replace; here unverified texts are put in capitals."""
    rows = truth(spark, sf_dir)
    fixes = rows.filter(F.col("verified_by").isNull()).select(
        "sample_id", F.upper("text").alias("text"), F.lit("reviewer").alias("verified_by"),
        F.lit("2025-09-01").cast("timestamp").alias("verified_at"),
    )
    return store.correct_ground_truth(rows, fixes).select("sample_id", "text", "original_text", "verified_by")


@latency.query(
    f"""
    WITH {RESULTS_SQL}
    SELECT 'stays' AS part, count(*) AS n FROM r WHERE NOT (service_name = 'voxaria' AND model_name = 'vox-2')
    UNION ALL SELECT 'goes', count(*) FROM r WHERE service_name = 'voxaria' AND model_name = 'vox-2'
    """
)
def delete_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, gone = store.delete_service(results(spark, sf_dir), "voxaria", "vox-2")
    stays = kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit("stays").alias("part"), "n")
    return stays.unionByName(gone.select(F.lit("goes").alias("part"), F.col("n_deleted").alias("n")))


@latency.query(f"WITH {RESULTS_SQL} SELECT DISTINCT service_name, nullif(model_name, '') AS model_name FROM r")
def distinct_service_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.services_present(results(spark, sf_dir))


@latency.query(
    f"""
    WITH {RESULTS_SQL}, {TRUTH_SQL}
    SELECT r.id, r.sample_id, r.service_name, r.transcription, g.text AS reference FROM r JOIN g USING (sample_id)
    """
)
def result_with_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = store.result_with_truth(results(spark, sf_dir), truth(spark, sf_dir))
    return joined.select("id", "sample_id", "service_name", "transcription", "reference")


@latency.query(
    f"""
    WITH {SAMPLES_SQL}
    SELECT sample_id, dataset_index FROM (
        SELECT sample_id, dataset_index, row_number() OVER (ORDER BY md5('42:' || sample_id), sample_id) AS k FROM s)
    WHERE k > 100 AND k <= 150
    """
)
def seeded_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice of a seeded shuffle (a sampling operator)."""
    rows = samples(spark, sf_dir).select("sample_id", "dataset_index")
    return store.seeded_slice(rows, "sample_id", 42, 100, 50)


@latency.query(
    f"""
    WITH {SAMPLES_SQL}
    SELECT sample_id, dataset_index, duration_seconds, language FROM s
    WHERE lower(language) IN ('eng', 'en') AND duration_seconds BETWEEN 2 AND 5 AND removed_at IS NULL
    """
)
def filtered_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English samples of 2 to 5 seconds that are still valid."""
    rows = samples(spark, sf_dir)
    keep = F.lower("language").isin("eng", "en") & F.col("duration_seconds").between(2, 5) & F.col("removed_at").isNull()
    return rows.filter(keep).select("sample_id", "dataset_index", "duration_seconds", "language")


@latency.query(
    f"""
    WITH {RESULTS_SQL},
    v AS (SELECT DISTINCT split_part(service_name, '_', 1) AS vendor, nullif(model_name, '') AS model FROM r),
    c AS (SELECT *, count(*) OVER (PARTITION BY vendor) AS n FROM v)
    SELECT vendor, model, CASE WHEN n > 1 AND model IS NOT NULL AND model NOT IN ('', 'N/A') THEN vendor || ' ' || model
                               ELSE vendor END AS label FROM c
    """
)
def label_disambiguation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir).select(
        F.substring_index("service_name", "_", 1).alias("vendor"), F.nullif(F.col("model_name"), F.lit("")).alias("model")
    )
    return leaderboard.display_labels(rows.distinct(), "vendor", "model")


_WORDS_SQL = """
    list_filter(list_transform(string_split_regex(lower(replace({0}, '’', '''')), '\\s+'),
        lambda t: trim(t, '.,!?;:"()[]{{}}…')), lambda t: regexp_matches(t, '[\\p{{L}}\\p{{N}}]'))
"""
COUNT_WORDS_SQL = (
    f"(len({_WORDS_SQL}) + len(list_filter({_WORDS_SQL}, lambda t: regexp_matches(t, "
    "'(n''t|''m|''re|''ve|''ll|''d)$|^(it|that|what|there|here|he|she|who|where|how|when|why|let)''s$'))))"
)


@latency.query(f"SELECT sample_id, generated_at, {COUNT_WORDS_SQL.format('text')}::INT AS words FROM gold_transcripts")
def reference_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "gold_transcripts")
    return rows.select("sample_id", "generated_at", count_words(F.col("text")).alias("words"))


#: What counts as white space (Unicode), which the engines' own classes differ in; everything else of a text is read.
_SPACES = "\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


@latency.query(
    f"""
    SELECT doc_id, {COUNT_WORDS_SQL.format(f"regexp_replace(text, '[{_SPACES}]', ' ', 'g')")}::INT AS words
    FROM documents WHERE text IS NOT NULL
    """
)
def document_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of whole documents."""
    return table(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).select(
        "doc_id", count_words(F.col("text")).alias("words")
    )
