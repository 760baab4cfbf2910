"""Queries on judges' results: repeats, comparison of judges, error lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlytics.functions.wording import error_weight, errors_text, invented_insertions, weighted_count, word_error_rate
from speechlytics.operators import judging, leaderboard, store
from speechlytics.plans.latency import (
    COUNT_WORDS_SQL,
    NEW_JUDGE,
    RESULTS_SQL,
    STORED_JUDGE,
    results,
    rounded,
    scores,
    scores_sql,
)
from speechlytics.plans.registry import Registry
from speechlytics.session import clean_key, table

judges = Registry()

RUNS_SQL = """
    u AS (SELECT DISTINCT lower(trim(judge, ' ' || chr(9))) AS judge, lower(trim(key, ' ' || chr(9))) AS key, repeat,
                 result.wer AS wer, result.error_count AS error_count, result IS NULL AS failed FROM runs)
"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judgment log, cleaned; rows written twice count once."""
    return (
        table(spark, sf_dir, "runs")
        .select(
            clean_key("judge").alias("judge"), clean_key("key").alias("key"), "repeat", F.col("result.wer").alias("wer"),
            F.col("result.error_count").alias("error_count"), F.col("result").isNull().alias("failed"),
        )
        .distinct()
    )


@judges.query(f"WITH {RUNS_SQL} SELECT judge, count(*) AS n FROM u GROUP BY judge")
def judge_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments by judge; NULL is a judge of its own."""
    return judging.judge_counts(runs(spark, sf_dir))


@judges.query(
    f"""
    WITH {RUNS_SQL}
    SELECT split_part(key, '|', 1) AS service_name, bool_or(judge IS DISTINCT FROM '{STORED_JUDGE}') AS mixed
    FROM u GROUP BY 1
    """
)
def mixed_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir).select(F.substring_index("key", "|", 1).alias("service_name"), "judge")
    return judging.mixed_judges(rows, STORED_JUDGE)


@judges.query(
    f"""
    WITH {RUNS_SQL},
    x AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (wer IS NULL) OVER w AS bad,
                 row_number() OVER (PARTITION BY judge, key ORDER BY wer NULLS FIRST, repeat, error_count) AS k
          FROM u WINDOW w AS (PARTITION BY judge, key))
    SELECT judge, key, n AS n_repeats, wer, error_count FROM x WHERE bad = 0 AND k = n // 2 + 1
    """
)
def repeat_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median repeat of each judge and key; failed repeats void the key."""
    rows = runs(spark, sf_dir)
    n = rows.groupBy("judge", "key").agg(F.count(F.lit(1)).alias("n_repeats"))
    found = judging.repeat_median(rows, ["judge", "key"]).alias("m")
    same = F.col("m.judge").eqNullSafe(F.col("c.judge")) & (F.col("m.key") == F.col("c.key"))
    return found.join(n.alias("c"), same).select("m.judge", "m.key", "n_repeats", "wer", "error_count")


_CONSISTENCY_SQL = f"""
    WITH {RUNS_SQL},
    c AS (SELECT judge, key, count(*) AS n, min(error_count) = max(error_count) AS identical, var_pop(wer) AS variance,
                 max(error_count) > 0 AS has_errors
          FROM u GROUP BY judge, key HAVING count(*) FILTER (wer IS NULL) = 0)
"""


@judges.query(_CONSISTENCY_SQL + "SELECT judge, key, n, identical, round(variance, 9) AS variance FROM c WHERE n > 1")
def repeat_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judging.repeat_consistency(runs(spark, sf_dir), ["judge", "key"]).filter("n > 1")
    return rounded(found, "variance", digits=9)


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir)
    errors = rows.groupBy("judge", "key").agg((F.max("error_count") > 0).alias("has_errors"))
    found = judging.repeat_consistency(rows, ["judge", "key"]).filter("n > 1").alias("m")
    same = F.col("m.judge").eqNullSafe(F.col("c.judge")) & (F.col("m.key") == F.col("c.key"))
    return found.join(errors.alias("c"), same).select("m.*", "has_errors")


_NOISE_SQL = (
    _CONSISTENCY_SQL
    + """, s AS (SELECT has_errors, count(*) AS n, avg(identical::INT) AS identical, sqrt(avg(variance)) AS sd
                 FROM c WHERE n > 1 GROUP BY has_errors)
    """
)


@judges.query(_NOISE_SQL + "SELECT has_errors, n, round(identical, 6) AS identical, round(sd, 6) AS sd FROM s")
def judge_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(judging.judge_noise(_strata(spark, sf_dir), "has_errors"), "identical", "sd")


@judges.query(
    _NOISE_SQL
    + """
    SELECT round(1.96 * sqrt((0.3 * max(sd) FILTER (has_errors) ** 2 + 0.7 * max(sd) FILTER (NOT has_errors) ** 2) / 1000), 9)
        AS service_mean_noise_95 FROM s
    """
)
def service_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judge's part in the noise of a service's mean, for a given share of clips with errors."""
    noise = judging.judge_noise(_strata(spark, sf_dir), "has_errors")
    return rounded(judging.service_noise(noise, "has_errors", F.lit(0.3)), "service_mean_noise_95", digits=9)


@judges.query(
    f"""
    WITH {scores_sql()},
    d AS (SELECT key, error_count > 0 AS stratum,
                 row_number() OVER (PARTITION BY error_count > 0 ORDER BY md5('7:' || key), key) AS k FROM w)
    SELECT key, stratum FROM d WHERE k <= 20
    """
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 judged keys, half with errors, in a seeded order (a sampling operator)."""
    rows = scores(spark, sf_dir)
    return judging.stratified_sample(rows, "key", F.col("error_count") > 0, 40, 7).select("key", "stratum")


def judge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys scored by both judges: stored and new figures side by side."""
    sides = {"stored": STORED_JUDGE, "new": NEW_JUDGE}
    old, new = (
        scores(spark, sf_dir, judge).select(
            "key", *(F.col(c).alias(f"{side}_{c}") for c in ("wer", "error_count", "reference_words"))
        )
        for side, judge in sides.items()
    )
    part = lambda k, name: F.split("key", r"\|").getItem(k).alias(name)
    return old.join(new, "key").select(part(0, "service_name"), part(2, "sample_id"), "*")


PAIRS_SQL = f"""
    {scores_sql()}, {scores_sql(NEW_JUDGE, "v")},
    p AS (SELECT key, w.service_name, w.sample_id, w.wer AS stored_wer, v.wer AS new_wer, w.error_count AS stored_error_count,
                 v.error_count AS new_error_count, w.reference_words AS stored_reference_words,
                 v.reference_words AS new_reference_words FROM w JOIN v USING (key))
"""


@judges.query(
    f"""
    WITH {PAIRS_SQL}
    SELECT service_name, count(*) AS n, round(avg(stored_wer), 6) AS stored_mean, round(avg(new_wer), 6) AS new_mean,
           round(sum(stored_error_count) / sum(stored_reference_words), 6) AS stored_pooled,
           round(sum(new_error_count) / sum(new_reference_words), 6) AS new_pooled,
           round(avg((stored_error_count <> new_error_count)::INT), 6) AS changed
    FROM p GROUP BY service_name
    """
)
def judge_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judging.impact(judge_pairs(spark, sf_dir), "service_name")
    return rounded(found, "stored_mean", "new_mean", "stored_pooled", "new_pooled", "changed")


@judges.query(
    f"""
    WITH {PAIRS_SQL},
    m AS (SELECT service_name, round(avg(stored_wer), 6) AS s, round(avg(new_wer), 6) AS v FROM p GROUP BY 1),
    o AS (SELECT service_name, v AS mean_wer, row_number() OVER (ORDER BY s, service_name) AS old_rank,
                 row_number() OVER (ORDER BY v, service_name) AS new_rank,
                 lead(service_name) OVER (ORDER BY v, service_name) AS next_service FROM m)
    SELECT *, old_rank - new_rank AS moved FROM o
    """
)
def rank_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How services move when the judge changes."""
    means = rounded(judging.impact(judge_pairs(spark, sf_dir), "service_name"), "stored_mean", "new_mean")
    old = means.select("service_name", F.col("stored_mean").alias("mean_wer"))
    return leaderboard.rank_shift(
        old, means.select("service_name", F.col("new_mean").alias("mean_wer")), "service_name", "mean_wer"
    )


#: The draws of a bootstrap, and how often a row with hash h is drawn in one (``judging.poisson_weights``).
DRAWS_SQL = """
    draws AS (SELECT i AS draw, 1 + ('0x' || substr(md5('a:' || i), 1, 7))::BIGINT AS fa,
                     ('0x' || substr(md5('b:' || i), 1, 7))::BIGINT AS fb FROM range(2000) t(i))
"""
WEIGHT_SQL = f"list_sum(list_transform({list(judging.ENDS)}, lambda e: ((h * fa + fb) % 2147483647 >= e)::INT))"

#: Every judge's scores of a service's samples, and the services' neighbours in the ranking by their mean.
NEIGHBOURS_SQL = f"""
    {RUNS_SQL},
    q AS (SELECT split_part(key, '|', 1) AS service_name, split_part(key, '|', 3) AS sample_id, avg(wer) AS wer
          FROM u WHERE wer < 'inf'::DOUBLE AND key IS NOT NULL GROUP BY ALL),
    m AS (SELECT service_name, round(avg(wer), 6) AS v FROM q GROUP BY 1),
    o AS (SELECT service_name, lead(service_name) OVER (ORDER BY v, service_name) AS next_service FROM m),
    g AS (SELECT a.service_name, o.next_service, a.sample_id, b.wer - a.wer AS gap
          FROM q a JOIN o USING (service_name) JOIN q b ON b.service_name = o.next_service AND b.sample_id = a.sample_id)
"""


def _neighbours(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    of = lambda k: F.split_part("key", F.lit("|"), F.lit(k))
    known = runs(spark, sf_dir).filter((F.col("wer") < float("inf")) & F.col("key").isNotNull())
    each = known.groupBy(of(1).alias("service_name"), of(3).alias("sample_id")).agg(F.avg("wer").alias("new_wer"))
    means = rounded(each.groupBy("service_name").agg(F.avg("new_wer").alias("v")), "v")
    return each, means.select("service_name", F.expr("lead(service_name) OVER (ORDER BY v, service_name)").alias("next_service"))


@judges.query(
    f"""
    WITH {NEIGHBOURS_SQL}
    SELECT service_name, next_service, count(*) AS n, round(avg(gap), 6) AS gap FROM g GROUP BY ALL
    """
)
def service_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap between neighbours in the ranking by all judges' scores, over the samples both have."""
    return rounded(judging.service_gaps(*_neighbours(spark, sf_dir)), "gap")


@judges.query(
    f"""
    WITH {NEIGHBOURS_SQL}, {DRAWS_SQL},
    d AS (SELECT service_name, next_service, gap AS x, ('0x' || substr(md5(sample_id), 1, 15))::BIGINT % 2147483647 AS h FROM g),
    k AS (SELECT service_name, next_service, draw, x, {WEIGHT_SQL} AS w FROM d, draws),
    b AS (SELECT service_name, next_service, draw, sum(w * x) / sum(w) AS m FROM k GROUP BY ALL HAVING sum(w) > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY service_name, next_service ORDER BY m) - 1 AS i,
                 count(*) OVER (PARTITION BY service_name, next_service) AS n FROM b),
    e AS (SELECT service_name, next_service, round(max(m) FILTER (i = floor(0.025::DOUBLE * n)::BIGINT), 6) AS low,
                 round(max(m) FILTER (i = floor(0.975::DOUBLE * n)::BIGINT - 1), 6) AS high FROM r GROUP BY ALL)
    SELECT service_name, next_service, count(*) AS n, round(avg(gap), 6) AS gap, any_value(low) AS low, any_value(high) AS high
    FROM g JOIN e USING (service_name, next_service) GROUP BY ALL
    """
)
def service_gap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gaps between neighbours with their 95 % intervals."""
    return rounded(judging.gap_intervals(*_neighbours(spark, sf_dir)), "gap", "low", "high")


@judges.query(
    f"""
    WITH {PAIRS_SQL}
    SELECT service_name, sample_id, key, stored_error_count, new_error_count, abs(new_error_count - stored_error_count) AS difference
    FROM p WHERE new_error_count <> stored_error_count ORDER BY difference DESC, service_name, sample_id, key LIMIT 15
    """
)
def top_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 largest disagreements (a top-k report)."""
    pairs = judge_pairs(spark, sf_dir).withColumn("sample_id", F.struct("sample_id", "key"))
    found = judging.disagreements(pairs, 15)
    return found.select(
        "service_name", "sample_id.sample_id", "key", "stored_error_count", "new_error_count", "difference"
    )


@judges.query(
    f"""
    WITH {PAIRS_SQL},
    d AS (SELECT ('0x' || substr(md5(key), 1, 15))::BIGINT % 2147483647 AS h, new_wer - stored_wer AS x FROM p),
    {DRAWS_SQL},
    k AS (SELECT draw, x, {WEIGHT_SQL} AS w FROM d, draws),
    m AS (SELECT draw, sum(w * x) / sum(w) AS m FROM k WHERE w > 0 GROUP BY draw),
    o AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS i, count(*) OVER () AS n FROM m)
    SELECT 'all' AS part, (SELECT count(*) FROM d) AS n, (SELECT round(avg(x), 6) FROM d) AS mean,
           round(max(m) FILTER (i = floor(0.025::DOUBLE * n)::BIGINT), 6) AS low,
           round(max(m) FILTER (i = floor(0.975::DOUBLE * n)::BIGINT - 1), 6) AS high FROM o
    """
)
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95 % interval of the mean difference between two judges, by 2000 resamplings."""
    pairs = judge_pairs(spark, sf_dir).select(
        F.lit("all").alias("part"), "key", (F.col("new_wer") - F.col("stored_wer")).alias("d")
    )
    return rounded(judging.bootstrap_mean(pairs, "key", "d", ["part"]), "mean", "low", "high")


@judges.query(
    f"""
    WITH {RESULTS_SQL}, t AS (SELECT service_name || '|' || model_name || '|' || sample_id AS key, max(transcription) AS t
                              FROM r WHERE transcription IS NOT NULL GROUP BY 1),
    {scores_sql()}, {scores_sql(NEW_JUDGE, "v")}
    SELECT w.key, w.wer AS stored_wer, v.wer AS new_wer FROM w JOIN v USING (key) JOIN t USING (key)
    """
)
def baseline_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples scored in two databases over the same transcript."""
    rows = results(spark, sf_dir).filter(F.col("transcription").isNotNull())
    heard = rows.groupBy(F.concat_ws("|", "service_name", "model_name", "sample_id").alias("key")).agg(
        F.max("transcription").alias("transcription")
    )
    side = lambda judge: scores(spark, sf_dir, judge).select("key", "wer").join(heard, "key")
    return judging.baseline_pairs(side(STORED_JUDGE), side(NEW_JUDGE)).select("key", "stored_wer", "new_wer")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judges' error entries, one row each."""
    rows = table(spark, sf_dir, "runs").select(clean_key("key").alias("key"), F.explode("result.errors").alias("e"))
    return rows.select("key", "e.type", "e.reference", "e.hypothesis", "e.position")


_WEIGHT_SQL = f"""
    CASE WHEN type = 'deletion' THEN greatest({COUNT_WORDS_SQL.format("coalesce(reference, '')")}, 1)
         WHEN type = 'insertion' THEN greatest({COUNT_WORDS_SQL.format("coalesce(hypothesis, '')")}, 1)
         WHEN least({COUNT_WORDS_SQL.format("coalesce(reference, '')")}, {COUNT_WORDS_SQL.format("coalesce(hypothesis, '')")}) <= 1 THEN 1
         ELSE {COUNT_WORDS_SQL.format("coalesce(reference, '')")} END
"""


@judges.query(
    f"""
    WITH e AS (SELECT unnest(result.errors, recursive := true) FROM runs WHERE result IS NOT NULL)
    SELECT type, count(*) AS n, sum({_WEIGHT_SQL})::BIGINT AS weight, count(reference) AS n_reference FROM e GROUP BY type
    """
)
def error_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error entries by type with their weights."""
    weight = error_weight(F.col("type"), F.col("reference"), F.col("hypothesis"))
    return entries(spark, sf_dir).groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(weight).alias("weight"), F.count("reference").alias("n_reference")
    )


_VALUES = (
    ("substitution", "one", "two"), ("substitution", "one", "two three"), ("substitution", "one two", "three"),
    ("substitution", "one two three", "four five"), ("deletion", "a b c d e", None), ("deletion", None, None),
    ("insertion", None, "two words"), ("insertion", None, None), ("deletion", "it's they'll can't Bob's", None),
)
_VALUES_SQL = ", ".join(
    "(" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in v) + ")" for v in _VALUES
)


@judges.query(
    f"""
    WITH e(type, reference, hypothesis) AS (VALUES {_VALUES_SQL})
    SELECT type, reference, hypothesis, ({_WEIGHT_SQL})::INT AS weight FROM e
    """
)
def error_weight_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of stated cases: words split, merged, missing, contractions."""
    rows = spark.createDataFrame(list(_VALUES), "type string, reference string, hypothesis string")
    return rows.withColumn("weight", error_weight(F.col("type"), F.col("reference"), F.col("hypothesis")))


@judges.query(
    """
    WITH x AS (
        SELECT DISTINCT lower(trim(key, ' ' || chr(9))) AS key, result.reference_words AS reference_words,
               len(list_filter(result.errors, lambda e: e.type = 'substitution'))::INT AS s,
               len(list_filter(result.errors, lambda e: e.type = 'deletion'))::INT AS d,
               len(list_filter(result.errors, lambda e: e.type = 'insertion'))::INT AS i
        FROM runs WHERE result IS NOT NULL)
    SELECT key, reference_words, s, d, i,
           CASE WHEN reference_words = 0 AND s + d + i = 0 THEN 0.0 WHEN reference_words = 0 THEN 'Infinity'::DOUBLE
                ELSE round((s + d + i) / reference_words, 6) END AS wer FROM x
    """
)
def wer_from_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates computed from the error lists."""
    rows = table(spark, sf_dir, "runs").filter(F.col("result").isNotNull())
    count = lambda k, name: weighted_count(F.col("result.errors"), k).alias(name)
    counts = rows.select(
        clean_key("key").alias("key"), F.col("result.reference_words").alias("reference_words"),
        count("substitution", "s"), count("deletion", "d"), count("insertion", "i"),
    ).distinct()
    return rounded(
        counts.withColumn("wer", word_error_rate(F.col("s"), F.col("d"), F.col("i"), F.col("reference_words"))), "wer"
    )


@judges.query(
    f"""
    WITH {RESULTS_SQL}, t AS (SELECT service_name || '|' || model_name || '|' || sample_id AS key, max(transcription) AS t
                              FROM r WHERE transcription IS NOT NULL GROUP BY 1),
    x AS (SELECT lower(trim(key, ' ' || chr(9))) AS key, result.errors AS e, repeat, judge FROM runs WHERE result IS NOT NULL),
    v AS (SELECT key, list_distinct(flatten(list_transform(
              list_transform(string_split_regex(lower(replace(t, '’', '''')), '[\\s\\-]+'), lambda p: trim(p, '.,!?;:"''()[]{{}}…')),
              lambda p: [p] || CASE WHEN p[-2:] IN ('''s', '''m', '''d') THEN [p[:-3]] WHEN p[-3:] IN ('''re', '''ve', '''ll', 'n''t') THEN [p[:-4]] ELSE [] END
                  || CASE WHEN p[-2:] = '''s' THEN ['is', 'has'] WHEN p[-2:] = '''m' THEN ['am'] WHEN p[-2:] = '''d' THEN ['would', 'had']
                          WHEN p[-3:] = '''re' THEN ['are'] WHEN p[-3:] = '''ve' THEN ['have'] WHEN p[-3:] = '''ll' THEN ['will']
                          WHEN p[-3:] = 'n''t' THEN ['not'] ELSE [] END))) AS known FROM t),
    w AS (SELECT x.key, judge, repeat, known, list_transform(flatten(list_transform(list_filter(e, lambda q: q.type = 'insertion'),
              lambda q: list_filter(string_split_regex(lower(coalesce(q.hypothesis, '')), '\\s+'), lambda z: z <> ''))),
              lambda z: trim(z, '.,!?;:"''()[]{{}}…')) AS ins FROM x JOIN v USING (key))
    SELECT count(*) AS n, count(*) FILTER (m >= 3 AND m * 2 > len(ins)) AS invented, sum(m)::BIGINT AS missing
    FROM (SELECT ins, len(list_filter(ins, lambda z: z <> '' AND NOT regexp_matches(z, '^[0-9]+$')
                 AND NOT list_contains(known, z))) AS m FROM w)
    """
)
def invented_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many error lists mostly add words that the transcript does not contain."""
    from speechlytics.functions.wording import vocabulary

    rows = results(spark, sf_dir).filter(F.col("transcription").isNotNull())
    heard = rows.groupBy(F.concat_ws("|", "service_name", "model_name", "sample_id").alias("key")).agg(
        F.max("transcription").alias("t")
    )
    lists = table(spark, sf_dir, "runs").filter(F.col("result").isNotNull()).select(
        clean_key("key").alias("key"), F.col("result.errors").alias("errors")
    )
    joined = lists.join(heard.withColumn("known", vocabulary(F.col("t"))), "key")
    words = F.flatten(F.transform(
        F.filter("errors", lambda e: e["type"] == "insertion"),
        lambda e: F.filter(F.split(F.lower(F.coalesce(e["hypothesis"], F.lit(""))), r"\s+"), lambda z: z != ""),
    ))
    bare = F.transform(words, lambda z: F.btrim(z, F.lit(".,!?;:\"'()[]{}…")))
    missing = F.size(F.filter(bare, lambda z: (z != "") & ~z.rlike("^[0-9]+$") & ~F.array_contains("known", z)))
    return joined.select(
        missing.alias("m"), invented_insertions(F.col("errors"), F.col("t")).alias("invented")
    ).agg(F.count(F.lit(1)).alias("n"), F.count_if("invented").alias("invented"), F.sum("m").alias("missing"))


@judges.query(
    """
    SELECT lower(trim(key, ' ' || chr(9))) AS key, repeat, result.error_count AS error_count,
           coalesce(nullif(list_aggregate(list_transform(result.errors, lambda e: e.type || ': ' || coalesce(nullif(e.reference, ''), '∅')
               || ' → ' || coalesce(nullif(e.hypothesis, ''), '∅')), 'string_agg', '; '), ''), 'none') AS text
    FROM runs WHERE result IS NOT NULL
    """
)
def error_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error lists on one line each."""
    rows = table(spark, sf_dir, "runs").filter(F.col("result").isNotNull())
    text = errors_text(F.col("result.errors"), ["type", "reference", "hypothesis", "position"])
    return rows.select(clean_key("key").alias("key"), "repeat", F.col("result.error_count").alias("error_count"), text.alias("text"))


@judges.query(
    f"""
    WITH {RUNS_SQL}
    SELECT key, repeat, max(error_count) AS error_count FROM u
    WHERE judge = '{STORED_JUDGE}' AND NOT failed GROUP BY key, repeat
    """
)
def usable_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a resumed run of a judge can keep from its log."""
    log = table(spark, sf_dir, "runs").withColumns({"judge": clean_key("judge"), "key": clean_key("key")})
    log = log.withColumn("error_count", F.col("result.error_count"))
    return judging.usable_judgments(log, STORED_JUDGE, ["error_count"]).select("key", "repeat", "error_count")


@judges.query()
def offline_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts scored by plain word alignment, as a judge of its own."""
    from speechlytics.plans.latency import truth

    rows = store.result_with_truth(results(spark, sf_dir), truth(spark, sf_dir))
    rows = rows.filter(F.col("transcription").isNotNull() & (F.trim("transcription") != ""))
    judged = rows.select(
        "id", "service_name", "reference", F.col("transcription").alias("hypothesis"),
        judging.offline_judge(F.col("reference"), F.col("transcription")).alias("errors"),
    )
    scored, _ = judging.score_judgments(judged)
    return rounded(scored.select("id", "service_name", "substitutions", "deletions", "insertions", "reference_words", "wer"), "wer")
