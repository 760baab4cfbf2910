"""Queries on scans, entity tables, formats and readings, and what is written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlytics.functions import identity as I
from speechlytics.functions import wording as W
from speechlytics.operators import judging, leaderboard, stats, store
from speechlytics.operators import verification as V
from speechlytics.plans.identities import ITEMS_SQL, MESSAGES_SQL, items
from speechlytics.plans.integrity import messages
from speechlytics.plans.latency import RESULTS_SQL, SAMPLES_SQL, TRUTH_SQL, results, rounded, samples, scores, scores_sql, truth
from speechlytics.plans.registry import Registry
from speechlytics.session import clean_key, shared_dir, table
from speechlytics.sources import readers, sinks

records = Registry()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a round trip; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/speechlytics/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


@records.query("SELECT sample_id, dataset_index, language FROM samples ORDER BY dataset_index, sample_id, audio_path, duration_seconds, language, added_at, removed_at LIMIT 25")
def first_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 samples of the dataset (a top-k)."""
    return store.first_samples(table(spark, sf_dir, "samples"), 25).select("sample_id", "dataset_index", "language")


@records.query(f"WITH {RESULTS_SQL} SELECT id, sample_id, timestamp FROM r ORDER BY timestamp DESC NULLS LAST, id DESC LIMIT 25")
def newest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 newest results (a top-k)."""
    return store.newest_first(results(spark, sf_dir), "timestamp", "id").select("id", "sample_id", "timestamp").limit(25)


@records.query(f"WITH {RESULTS_SQL} SELECT id, sample_id, service_name, model_name FROM r WHERE id = 77")
def result_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result by its id."""
    return store.lookup(results(spark, sf_dir), id=77).select("id", "sample_id", "service_name", "model_name")


@records.query(
    f"""
    WITH {RESULTS_SQL}, f AS (SELECT service_name, model_name FROM r ORDER BY id LIMIT 1)
    SELECT service_name, model_name, count(*) AS n, count(*) FILTER (ttfb_seconds IS NOT NULL AND error IS NULL) AS n_success
    FROM r JOIN f USING (service_name, model_name) GROUP BY ALL
    """
)
def first_service_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the service that the first row belongs to, as where no service is named."""
    rows = store.first_service(results(spark, sf_dir), ["id"])
    good = F.col("ttfb_seconds").isNotNull() & F.col("error").isNull()
    return rows.groupBy("service_name", "model_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("n_success"))


@records.query(
    f"""
    WITH {scores_sql()} SELECT service_name, count(*) AS n, count(*) FILTER (wer > 0.5) AS n_outliers,
           count(*) FILTER (wer > 0.2) AS n_listed FROM w GROUP BY service_name
    """
)
def wer_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.outliers(scores(spark, sf_dir), ["service_name"])


@records.query(
    f"""
    WITH {SAMPLES_SQL}, p AS (SELECT sample_id FROM s WHERE starts_with(sample_id, 'a'))
    SELECT sample_id, (SELECT count(*) FROM p) AS n_matches FROM p ORDER BY sample_id LIMIT 10
    """
)
def samples_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten samples whose id begins with a, with the number of all (a listing)."""
    return store.by_prefix(samples(spark, sf_dir), "a")


@records.query(
    f"""
    WITH {RESULTS_SQL}, n AS (SELECT unnest(['voxaria', 'nobody', 'cantor']) AS service_name)
    SELECT service_name, service_name IN (SELECT service_name FROM r) AS registered FROM n
    """
)
def requested_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the services asked for there are."""
    known = results(spark, sf_dir).select("service_name").distinct()
    there, unknown = store.missing_services([" Voxaria", "nobody", "CANTOR "], known, spark)
    mark = lambda rows, x: rows.select("service_name", F.lit(x).alias("registered"))
    return mark(there, True).unionByName(mark(unknown, False))


@records.query(
    f"""
    WITH {RESULTS_SQL} SELECT CASE service_name WHEN 'voxaria' THEN 'Voxaria AI' WHEN 'cantor' THEN 'Cantor' ELSE service_name END AS service_name,
           count(*) AS n FROM r GROUP BY 1
    """
)
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("voxaria", "Voxaria AI"), ("cantor", "Cantor")], "name string, display string")
    return leaderboard.rename_display(results(spark, sf_dir), "service_name", names).groupBy("service_name").agg(F.count(F.lit(1)).alias("n"))


@records.query(
    f"""
    WITH {SAMPLES_SQL}, {RESULTS_SQL}
    SELECT sample_id FROM s WHERE duration_seconds BETWEEN 2 AND 5
      AND NOT EXISTS (SELECT 1 FROM r WHERE r.sample_id = s.sample_id AND r.service_name = 'cantor')
    """
)
def selected_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the samples a service has to do, those selected by their length."""
    every = samples(spark, sf_dir)
    queue = store.pending_samples(every, results(spark, sf_dir), "cantor")
    return store.in_selection(queue, every.filter(F.col("duration_seconds").between(2, 5))).select("sample_id")


@records.query(
    f"""
    WITH {scores_sql()}, {SAMPLES_SQL}, d AS (SELECT sample_id, min(dataset_index) AS dataset_index FROM s GROUP BY 1)
    SELECT key, w.sample_id, dataset_index FROM w LEFT JOIN d USING (sample_id)
    """
)
def report_dataset_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows with the place of their sample in the dataset."""
    return leaderboard.with_dataset_index(scores(spark, sf_dir), samples(spark, sf_dir)).select("key", "sample_id", "dataset_index")


@records.query(
    f"""
    WITH {SAMPLES_SQL}, {TRUTH_SQL},
    t AS (SELECT sample_id, max(text) AS transcription FROM g GROUP BY 1),
    e AS (SELECT sample_id, max(original_text) AS corrected_text FROM g WHERE original_text IS NOT NULL GROUP BY 1)
    SELECT t.sample_id, coalesce(corrected_text, transcription) AS text, CASE WHEN corrected_text IS NOT NULL THEN 'human' END AS verified_by,
           CASE WHEN corrected_text IS NOT NULL THEN transcription END AS original_text
    FROM t LEFT JOIN e USING (sample_id) WHERE t.transcription IS NOT NULL AND t.sample_id IN (SELECT sample_id FROM s)
    """
)
def imported_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth from generated transcripts with edits put in their place; here texts stand for both."""
    gold = truth(spark, sf_dir)
    generated = gold.groupBy("sample_id").agg(F.max("text").alias("transcription"))
    edits = gold.filter(F.col("original_text").isNotNull()).groupBy("sample_id").agg(F.max("original_text").alias("corrected_text"))
    return store.import_transcripts(generated, samples(spark, sf_dir), gold, edits, force=True)


@records.query(
    f"""
    WITH {RESULTS_SQL} SELECT service_name, id FROM (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY id) AS k FROM r) WHERE k <= 3
    """
)
def first_of_each_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three results of each service (a top-k)."""
    return judging.first_of_each(results(spark, sf_dir), "service_name", ["id"], 3).select("service_name", "id")


@records.query(
    f"""
    WITH {MESSAGES_SQL}
    SELECT vendor, condition, CASE condition WHEN 'none' THEN 0 WHEN 'generic' THEN 1 WHEN 'domain' THEN 2 WHEN 'record' THEN 3 ELSE 4 END AS place,
           count(*) AS n FROM m GROUP BY ALL
    """
)
def conditions_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by vendor and condition with the condition's place in reports."""
    counts = messages(spark, sf_dir).groupBy("vendor", "condition").agg(F.count(F.lit(1)).alias("n"))
    return V.in_fixed_order(counts).withColumn("place", V.place_in("condition", V.CONDITIONS))


@records.query(
    f"""
    WITH {scores_sql()}, m AS (SELECT service_name, model_name, avg(wer) AS wer_mean FROM w GROUP BY ALL)
    SELECT service_name, model_name, round(wer_mean, 6) AS wer_mean,
           row_number() OVER (ORDER BY round(wer_mean, 6), service_name, model_name) AS place FROM m
    """
)
def services_by_mean_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = scores(spark, sf_dir).groupBy("service_name", "model_name").agg(F.avg("wer").alias("wer_mean"))
    return leaderboard.by_mean_wer(rounded(means, "wer_mean"))


@records.query(
    f"""
    WITH {MESSAGES_SQL}, f AS (SELECT vendor, count(*) FILTER (transcript IS NOT NULL) AS k, count(*) AS n FROM m GROUP BY 1)
    SELECT vendor, k || '/' || n || ' (' || round_even(100 * k / n, 0)::INT || '%)' AS rate FROM f
    """
)
def transcript_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many messages of a vendor have a transcript, as text."""
    counts = messages(spark, sf_dir).groupBy("vendor").agg(F.count("transcript").alias("k"), F.count(F.lit(1)).alias("n"))
    return counts.select("vendor", V.rate_text(F.col("k"), F.col("n")).alias("rate"))


@records.query(
    """
    SELECT reason, count(*) AS n FROM (
        SELECT CASE WHEN ttfb_seconds IS NULL THEN 'ttfb_seconds missing' WHEN service_name NOT IN ('voxaria', 'cantor', 'parley')
                    THEN 'service_name unknown' ELSE 'good' END AS reason FROM results) GROUP BY 1
    """
)
def quarantined_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that a strict reading would set aside, by reason."""
    good, bad = store.quarantine(table(spark, sf_dir, "results"), ["ttfb_seconds"], {"service_name": ["voxaria", "cantor", "parley"]})
    return good.select(F.lit("good").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@records.query("SELECT sample_id, duration_seconds, NULL::VARCHAR AS note FROM samples")
def conformed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in a declared schema that lacks some of their columns and has one more."""
    from pyspark.sql.types import StructType

    return store.conform(table(spark, sf_dir, "samples"), StructType.fromDDL("sample_id string, duration_seconds double, note string"))


@records.query("SELECT sample_id, dataset_index FROM samples")
def copied_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty table of samples filled from another."""
    source = table(spark, sf_dir, "samples")
    return store.copy_if_empty(source, source.limit(0)).select("sample_id", "dataset_index")


@records.query("SELECT * FROM (VALUES ('a', '2025-01-02', 5), ('b', NULL, 7)) v(run_id, completed, num_samples)")
def run_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run is started once, another too, and the first is finished."""
    schema = "run_id string, completed_at timestamp, num_samples int"
    of = lambda *data: spark.createDataFrame(list(data), schema)
    runs = store.start_run(store.start_run(None, of(("a", None, 4))), of(("b", None, 7)))
    runs = store.start_run(runs, of(("a", None, 9)))
    done = of(("a", None, 5)).withColumn("completed_at", F.lit("2025-01-02").cast("timestamp"))
    return store.finish_run(runs, done).select("run_id", F.date_format("completed_at", "yyyy-MM-dd").alias("completed"), "num_samples")


@records.query(f"WITH {RESULTS_SQL} SELECT id, service_name || '|' || model_name || '|' || sample_id AS key FROM r")
def pair_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("id", I.pair_key(F.col("service_name"), F.col("model_name"), F.col("sample_id")).alias("key"))


@records.query(
    "SELECT 'm effort=' || effort || ' repeats=3 rev=' || substr(sha256('rules of 2025'), 1, 8) AS label FROM (VALUES ('high'), ('none')) v(effort)"
)
def judge_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = spark.range(1)
    label = lambda effort: one.select(judging.judge_label("m", effort, 3, "rules of 2025").alias("label"))
    return label("high").unionByName(label(None))


@records.query("SELECT judge, key, repeat, result.error_count AS error_count, len(result.errors) AS n_errors FROM runs WHERE judge IS NOT NULL")
def judgment_log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judges' log written as JSON lines and read again; lines begin with the judge, so those without one are not lines."""
    path = scratch(spark, "log")
    sinks.append_json_lines(table(spark, sf_dir, "runs"), path)
    return readers.judgments(spark, path).select(
        "judge", "key", "repeat", F.col("result.error_count").alias("error_count"),
        F.when(F.col("result.errors").isNotNull(), F.size("result.errors")).cast("bigint").alias("n_errors"),
    )


@records.query(f"WITH {RESULTS_SQL} SELECT id, nullif(sample_id, '') AS sample_id, service_name, nullif(model_name, '') AS model_name, nullif(error, '') AS error FROM r")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as CSV and read again; empty and NULL texts are one there."""
    path = scratch(spark, "csv")
    rows = results(spark, sf_dir).select("id", "sample_id", "service_name", "model_name", "error")
    sinks.write_csv(rows, path)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(rows.schema).csv(path)
    return back.withColumns({c: F.nullif(c, F.lit("")) for c in ("sample_id", "model_name", "error")})


@records.query("SELECT sample_id, text, generated_at FROM gold_transcripts")
def dataset_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "dataset")
    sinks.write_dataset(table(spark, sf_dir, "gold_transcripts").select("sample_id", "text", "generated_at"), path)
    return spark.read.parquet(path)


@records.query(f"WITH {RESULTS_SQL} SELECT id, sample_id, error FROM r WHERE service_name = 'voxaria'")
def envelope_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of a service written as one JSON document over several files, and its lines read again."""
    path = scratch(spark, "envelope")
    rows = store.for_service(results(spark, sf_dir), "voxaria").select("id", "sample_id", "error")
    sinks.write_json_envelope(rows, {"service": "voxaria"}, path)
    body = spark.read.text(path).select(F.from_json(F.regexp_replace("value", "^,", ""), rows.schema).alias("x"))
    return body.filter(F.col("x.id").isNotNull()).select("x.*")


@records.query(
    f"""
    WITH {RESULTS_SQL} SELECT sample_id, service_name, model_name, id FROM (
        SELECT *, row_number() OVER (PARTITION BY sample_id, service_name, model_name ORDER BY timestamp DESC NULLS LAST, id DESC) AS k FROM r) WHERE k = 1
    """
)
def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written to a table twice over: each sample, service and model keeps its last."""
    path = scratch(spark, "results")
    rows = results(spark, sf_dir).select("id", "sample_id", "service_name", "model_name", "timestamp")
    for _ in range(2):
        store.write_results(rows, path, ["timestamp", "id"])
    return spark.read.parquet(path).select("sample_id", "service_name", "model_name", "id")


@records.query(
    f"""
    WITH {MESSAGES_SQL}, {ITEMS_SQL} SELECT m.id, vendor, condition, i.field FROM m JOIN i USING (id) WHERE i.field IS NOT NULL
    """
)
def item_messages_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and messages written as JSON lines and read again by their readers."""
    a, b = scratch(spark, "items"), scratch(spark, "messages")
    sinks.append_json_lines(items(spark, sf_dir).withColumnRenamed("item_set", "set"), a)
    sinks.append_json_lines(messages(spark, sf_dir), b)
    kept = readers.identity_items(spark, [a]).filter(F.col("field").isNotNull()).select("id", "field")
    return readers.identity_results(spark, b).select("id", "vendor", "condition").join(kept, "id")


def said(name: str, columns: str, cases: dict, make) -> None:
    """A query over literal cases: a Column function against the results it must give."""
    names = columns.split()

    def cell(x: object) -> str:
        if isinstance(x, float):
            return f"{x!r}::DOUBLE"
        return "NULL" if x is None else str(x) if isinstance(x, bool | int) else "'" + str(x).replace("'", "''") + "'"

    tuples = [((k,) if isinstance(k, str) else k) + (v if isinstance(v, tuple) else (v,)) for k, v in cases.items()]
    n = len(next(iter(cases))) if isinstance(next(iter(cases)), tuple) else 1
    values = ", ".join(f"({', '.join(map(cell, t))})" for t in tuples)
    sql = f"SELECT * FROM (VALUES {values}) v({', '.join(names)})"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = spark.createDataFrame([t[:n] for t in tuples], ", ".join(f"{c} string" for c in names[:n]))
        found = make(*(F.col(c) for c in names[:n]))
        found = [found] if isinstance(found, Column) else found
        return given.select(*names[:n], *(c.alias(m) for c, m in zip(found, names[n:], strict=True)))

    run.__name__, run.__doc__ = name, f"Literal cases: {columns}."
    records.query(sql)(run)


def _fields(struct: Column, *names: str) -> list[Column]:
    return [struct[n] for n in names]


said("spoken_numbers", "text digits", {
    "four seven one nine": "4719", "oh six two oh": "0620", "triple four": "444", "thirty-one": "31", "three hundred and six": "306",
    "one thousand and ten": "1010", "oh well": "oh well", "sixty oh": "60 0", "unit eight, four": "unit 8 4",
}, I.digits)
said("spoken_letters", "text letters", {
    "H, A, L": "hal", "K for kilo, E, I, R": "keir", "double t, o, m": "ttom", "b as in bravo, o": "bo", "are they there": "",
}, I.spelled)
said("spoken_names", "text name strict lenient near_miss", {
    ("this is Orla D'Arcy", "D'Arcy"): (True, True, 1.0), ("this is Darsy", "D'Arcy"): (False, False, 0.8),
    ("d a r c y", "D'Arcy"): (False, True, 0.333), ("", "D'Arcy"): (False, False, 0.0),
}, lambda t, n: _fields(I.check_name(t, n), "strict", "lenient", "near_miss"))
said("spoken_spellings", "text name strict lenient", {
    ("halvor, H A L V O R", "Halvor"): (True, True), ("no H A L V E R", "Halvor"): (False, False), ("H-A-L-V-O-R", "Halvor"): (True, True),
}, lambda t, n: _fields(I.check_spelled(t, n), "strict", "lenient"))
said("spoken_emails", "text email strict lenient normalised", {
    ("m dot falk nineteen at post dot example", "m.falk19@post.example"): (False, True, "m.falk19@post.example"),
    ("M.Falk 19 @post.example", "m.falk19@post.example"): (True, True, "m.falk19@post.example"),
    ("m dot falk ninety at post dot example", "m.falk19@post.example"): (False, False, "m.falk90@post.example"),
}, lambda t, e: [*_fields(I.check_email(t, e), "strict", "lenient"), I.normalise_email(t)])
said("spoken_dates", "text dob strict lenient us_order parsed", {
    ("the ninth of June, nineteen seventy-two", "1972-06-09"): (True, True, False, "9-6-1972"),
    ("07/31/1988", "1988-07-31"): (False, True, True, "7-31-1988"), ("7/8/1988", "1988-07-08"): (False, False, True, "7-8-1988"),
    ("two one one two fifty eight", "1958-12-21"): (True, True, False, "21-12-1958"), ("March", "1958-03-01"): (False, False, False, "?-3-?"),
}, lambda t, d: _fields(I.check_dob(t, d), "strict", "lenient", "us_order", "parsed"))
said("spoken_addresses", "text normalised", {
    "6/21 Acacia Rd, Fernhill QLD 4055": " 6 21 acacia road fernhill qld 4055 ",
    "Unit six, twenty-one Acacia Road, New South Wales, two one five oh": " unit 6 21 acacia road nsw 2150 ",
}, I.normalise_address)
said("similar_names", "a b similarity", {
    ("dwayne", "duane"): 0.84, ("dixon", "dicksonx"): 0.813333, ("abcdef", "azzzzz"): 0.5, ("", "x"): 0.0, ("same", "same"): 1.0,
}, lambda a, b: F.round(I.jaro_winkler(a, b), 6))
said("names_in_texts", "text name similarity same_sound", {
    ("I am mc intyre", "McIntyre"): (1.0, True), ("karlsen", "Carlson"): (0.809524, False),
}, lambda t, n: [F.round(I.name_score(t, n)["similarity"], 6), I.name_score(t, n)["same_sound"]])
said("slices_of_texts", "text name similarity", {("zzharpereww", "harper"): 1.0, ("h a r p e r", "x"): 0.0}, I.window_sim)
said("born_on", "text dob matched", {("the ninth of June 1972", "1972-06-09"): True, ("9 July 1972", "1972-06-09"): False}, I.dob_match)
said("sound_codes", "name code", {
    "Carlson": "C642", "Whitby": "W310", "Ashcroft": "A261", "O'Dell": "O340", "42": "", "Pfeiffer": "P160",
}, I.soundex)
said("tolerant_times", "text time", {
    "2025-01-02T03:04:05+00:00Z": "2025-01-02 03:04:05", "2025-01-02T03:04:05Z": "2025-01-02 03:04:05", "no time": None,
}, lambda t: F.date_format(I.tolerant_timestamp(t), "yyyy-MM-dd HH:mm:ss"))
said("blank_scores", "reference hypothesis wer deletions insertions reference_words", {
    ("", " "): ("0.0", 0, 0, 0), ("it's here", " "): ("1.0", 3, 0, 3), (" ", "two words"): ("inf", 0, 2, 0),
}, lambda r, h: [
    F.when(W.blank_case(r, h)["wer"] == float("inf"), "inf").otherwise(W.blank_case(r, h)["wer"].cast("string")),
    *_fields(W.blank_case(r, h), "deletions", "insertions", "reference_words"),
])
