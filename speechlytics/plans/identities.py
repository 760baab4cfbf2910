"""Queries on spoken identity details."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlytics.functions import identity as I
from speechlytics.operators import store
from speechlytics.operators import verification as V
from speechlytics.plans.integrity import messages
from speechlytics.plans.registry import Registry
from speechlytics.session import clean_key, table

identities = Registry()
#: Ties in time between deliveries are decided by the batch and the content.
ORDER = ["received_at", "batch", "error", "transcript", "ttfs"]

ITEMS_SQL = """
    i AS (SELECT * EXCLUDE (rn) FROM (
        SELECT * REPLACE (lower(trim(id, ' ' || chr(9))) AS id), row_number() OVER (PARTITION BY lower(trim(id, ' ' || chr(9)))
            ORDER BY voice DESC NULLS LAST, caller DESC NULLS LAST, rate DESC NULLS LAST, style DESC NULLS LAST) AS rn FROM items)
        WHERE rn = 1)
"""
MESSAGES_SQL = """
    m AS (SELECT lower(trim(id, ' ' || chr(9))) AS id, lower(trim(vendor, ' ' || chr(9))) AS vendor,
                 coalesce(nullif(lower(trim(condition, ' ' || chr(9))), ''), 'none') AS condition,
                 transcript, ttfs, error, batch, received_at FROM identity_results)
"""
_LAST = "PARTITION BY vendor, condition, id ORDER BY received_at DESC NULLS LAST, batch DESC NULLS LAST, error DESC NULLS LAST, transcript DESC NULLS LAST, ttfs DESC NULLS LAST"
VALID_SQL = f"""
    v AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER ({_LAST}) AS rn FROM m
          WHERE transcript IS NOT NULL AND coalesce(error, '') = '') WHERE rn = 1)
"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an item; of rows written twice any, as they are equal."""
    rows = table(spark, sf_dir, "items").withColumn("id", clean_key("id"))
    return store.latest(rows, ["id"], ["voice", "caller", "rate", "style"])


def valid_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.valid_then_latest(messages(spark, sf_dir), ORDER)


@identities.query(f"WITH {MESSAGES_SQL}, {VALID_SQL} SELECT id, vendor, condition, transcript FROM v")
def results_valid_then_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last usable transcript of each message: a failure after it does not hide it."""
    return valid_results(spark, sf_dir).select("id", "vendor", "condition", "transcript")


@identities.query(
    f"""
    WITH {MESSAGES_SQL}
    SELECT id, vendor, condition, transcript FROM (SELECT *, row_number() OVER ({_LAST}) AS rn FROM m)
    WHERE rn = 1 AND transcript IS NOT NULL AND coalesce(error, '') = ''
    """
)
def results_latest_then_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last message, if usable: a failure after a transcript hides it."""
    return V.latest_then_valid(messages(spark, sf_dir), ORDER).select("id", "vendor", "condition", "transcript")


@identities.query(
    f"""
    WITH {MESSAGES_SQL}, {ITEMS_SQL}
    SELECT vendor, condition, count(*) AS n FROM (SELECT *, row_number() OVER ({_LAST}) AS rn FROM m)
    WHERE rn = 1 AND NOT (transcript IS NOT NULL AND coalesce(error, '') = '')
      AND id IN (SELECT id FROM i WHERE coalesce(item_set, 'synthetic') = 'synthetic' AND NOT starts_with(field, 'flow_'))
    GROUP BY ALL
    """
)
def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without a usable result, per vendor and condition."""
    return V.failures(items(spark, sf_dir), messages(spark, sf_dir), ORDER)


_NORM = "regexp_replace(lower({}), '[^a-z]', '', 'g')"
_NAME_SQL = f"""
    WITH {MESSAGES_SQL}, {VALID_SQL}, {ITEMS_SQL},
    x AS (SELECT v.*, i.field, i.impostor, i.homophone, i.voice, i.expected.surname AS surname,
                 list_filter(list_transform(string_split_regex(transcript, '[\\s,.;:!?]+'), lambda t: {_NORM.format("t")}),
                             lambda t: t <> '') AS tokens
          FROM v JOIN i USING (id) WHERE field = 'name' AND expected.surname IS NOT NULL),
    s AS (SELECT *, list_contains(tokens, {_NORM.format("surname")}) AS ok FROM x)
"""


def name_tokens_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a word of the transcript is the said surname, with built-ins only."""
    named = items(spark, sf_dir).filter((F.col("field") == "name") & F.col("expected.surname").isNotNull())
    rows = valid_results(spark, sf_dir).join(
        named.select("id", "impostor", "homophone", "voice", F.col("expected.surname").alias("surname")), "id"
    )
    tokens = F.transform(F.split("transcript", r"[\s,.;:!?]+"), I.norm_name)
    return rows.withColumn("ok", F.array_contains(tokens, I.norm_name(F.col("surname"))))


@identities.query(
    _NAME_SQL
    + """
    SELECT vendor, condition, count(*) FILTER (NOT coalesce(impostor, false)) AS genuine_n,
           count(*) FILTER (ok AND NOT coalesce(impostor, false)) AS genuine_passed,
           count(*) FILTER (coalesce(impostor, false) AND NOT coalesce(homophone, false)) AS similar_n,
           count(*) FILTER (ok AND coalesce(impostor, false) AND NOT coalesce(homophone, false)) AS similar_passed
    FROM s GROUP BY ALL
    """
)
def field_accuracy_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surnames heard as said, genuine callers and impostors, in one pass of conditional counts."""
    rows = name_tokens_scored(spark, sf_dir)
    wrong, alike = F.coalesce("impostor", F.lit(False)), F.coalesce("homophone", F.lit(False))
    genuine, similar = V.share(F.col("ok"), ~wrong), V.share(F.col("ok"), wrong & ~alike)
    return rows.groupBy("vendor", "condition").agg(
        genuine[1].alias("genuine_n"), genuine[0].alias("genuine_passed"),
        similar[1].alias("similar_n"), similar[0].alias("similar_passed"),
    )


@identities.query(
    _NAME_SQL
    + """
    SELECT voice, vendor, count(*) AS n, count(*) FILTER (ok) AS passed FROM s
    WHERE condition = 'none' AND NOT coalesce(impostor, false) GROUP BY ALL
    """
)
def accuracy_by_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = name_tokens_scored(spark, sf_dir).filter(
        (F.col("condition") == "none") & ~F.coalesce("impostor", F.lit(False))
    )
    return rows.groupBy("voice", "vendor").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("passed"))


@identities.query(
    f"""
    WITH {MESSAGES_SQL}, {VALID_SQL}, {ITEMS_SQL}
    SELECT vendor, condition, count(*) AS n,
           count(*) FILTER (contains(regexp_replace(lower(transcript), '\\s+', '', 'g'), lower(expected.email))) AS strict
    FROM v JOIN i USING (id) WHERE field = 'email' AND expected.email IS NOT NULL GROUP BY ALL
    """
)
def email_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = items(spark, sf_dir).filter(F.col("field") == "email").select("id", F.col("expected.email").alias("email"))
    rows = valid_results(spark, sf_dir).join(said.filter(F.col("email").isNotNull()), "id")
    strict = F.contains(F.regexp_replace(F.lower("transcript"), r"\s+", ""), F.lower("email"))
    return rows.groupBy("vendor", "condition").agg(F.count(F.lit(1)).alias("n"), F.count_if(strict).alias("strict"))


@identities.query(
    f"""
    WITH {MESSAGES_SQL}, {VALID_SQL}, {ITEMS_SQL},
    h AS (SELECT v.id, vendor, {_NORM.format("transcript")} AS letters FROM v JOIN i USING (id)
          WHERE field IN ('spelled', 'flow_spelled') AND condition = 'none'),
    o AS (SELECT id AS other_id, {_NORM.format("record.surname")} AS name FROM i
          WHERE field IN ('spelled', 'flow_spelled') AND record.surname IS NOT NULL)
    SELECT vendor, count(*) AS n, count(*) FILTER (contains(letters, name)) AS passed FROM h JOIN o ON h.id <> o.other_id
    GROUP BY vendor
    """
)
def impostor_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelled surnames against every other record: how often another customer's name would pass."""
    those = items(spark, sf_dir).filter(F.col("field").isin("spelled", "flow_spelled"))
    honest = (
        valid_results(spark, sf_dir).filter(F.col("condition") == "none").join(those.select("id"), "id", "left_semi")
        .select("id", "vendor", I.norm_name(F.col("transcript")).alias("text"))
    )
    records = those.select("id", I.norm_name(F.col("record.surname")).alias("value")).filter(F.col("value").isNotNull())
    pairs = V.impostor_pairs(honest, records)
    return pairs.groupBy("vendor").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.contains("text", "other")).alias("passed"))


@identities.query(
    f"""
    WITH {MESSAGES_SQL}, {VALID_SQL}, t AS (SELECT id, vendor, condition,
        list_filter(list_transform(string_split_regex(transcript, '[\\s,.;:!?]+'), lambda t: {_NORM.format("t")}), lambda t: t <> '') AS k FROM v)
    SELECT id, vendor, condition, len(k)::INT AS n_tokens,
           array_to_string(k || list_transform(range(1, len(k)), lambda i: k[i] || k[i + 1]), ' ') AS candidates FROM t
    """
)
def name_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and joined neighbours of each transcript."""
    tokens = F.filter(F.transform(F.split("transcript", r"[\s,.;:!?]+"), I.norm_name), lambda t: t != "")
    return valid_results(spark, sf_dir).select(
        "id", "vendor", "condition", F.size(tokens).alias("n_tokens"),
        F.array_join(I.name_candidates(F.col("transcript")), " ").alias("candidates"),
    )


@identities.query(
    f"""
    WITH {ITEMS_SQL}
    SELECT id, substr(md5('7:' || id), 1, 8) || '-' || substr(md5('7:' || id), 9, 4) || '-' || substr(md5('7:' || id), 13, 4) || '-'
               || substr(md5('7:' || id), 17, 4) || '-' || substr(md5('7:' || id), 21, 12) AS uuid,
           substr(sha256(coalesce(script, '')), 1, 12) AS script_hash,
           CASE WHEN starts_with(id, 'flow_spelled_') THEN 'flow_spelled_real_' || substr(id, 14)
                WHEN starts_with(id, 'flow_dob_') THEN 'flow_dob_real_' || substr(id, 10) ELSE 'real_' || id END AS recording
    FROM i
    """
)
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select(
        "id", I.stable_uuid(F.lit("7"), F.col("id")).alias("uuid"),
        I.short_hash(F.coalesce("script", F.lit(""))).alias("script_hash"), I.recording_id(F.col("id")).alias("recording"),
    )


@identities.query(
    f"""
    WITH {ITEMS_SQL}
    SELECT id, array_to_string(list_filter([record.given, record.surname, record.email, record.street, record.suburb],
               lambda p: p IS NOT NULL AND p <> ''), ',') AS terms FROM i
    """
)
def record_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = I.hint_terms(F.lit("record"), ["account"], F.col("record"))
    return items(spark, sf_dir).select("id", F.array_join(terms, ",").alias("terms"))


@identities.query(
    """
    SELECT DISTINCT split_part(lower(trim(judge, ' ' || chr(9))), ':', 1) AS model,
           nullif(split_part(lower(trim(judge, ' ' || chr(9))), ':', 2), 'none') AS effort
    FROM runs WHERE contains(judge, ':')
    """
)
def judge_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = I.parse_judge(clean_key("judge")).alias("j")
    rows = table(spark, sf_dir, "runs").select(parsed).filter(F.col("j").isNotNull())
    return rows.select("j.model", "j.effort").distinct()


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.latest_then_valid(messages(spark, sf_dir), ORDER)
    scores = V.score_rows(items(spark, sf_dir), rows)
    return scores.filter((F.coalesce("item_set", F.lit("synthetic")) == "synthetic") & ~F.col("field").startswith("flow_"))


@identities.query()
def identity_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of details, genuine callers, per vendor and condition."""
    return V.field_accuracy(_scored(spark, sf_dir))


@identities.query()
def identity_address_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.address_parts(_scored(spark, sf_dir))


@identities.query()
def identity_impostor_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.impostor_leakage(_scored(spark, sf_dir))


@identities.query()
def identity_by_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.by_voice(_scored(spark, sf_dir))


@identities.query()
def identity_name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genuine callers and impostors under five rules of surname similarity."""
    return V.name_rule_rates(items(spark, sf_dir), valid_results(spark, sf_dir))


@identities.query()
def identity_email_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses of callers against their own and all other records, three thresholds."""
    those = items(spark, sf_dir).filter(F.col("field") == "email")
    records = those.select("id", F.lower("record.email").alias("value")).filter(F.col("value").isNotNull())
    honest = valid_results(spark, sf_dir).filter(F.col("condition") == "none").join(those.select("id"), "id", "left_semi")
    heard = honest.select("id", "vendor", I.normalise_email(F.col("transcript")).alias("text"))
    return V.cross_rates(heard, records, "window_sim", (1.0, 0.95, 0.9))


@identities.query()
def identity_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision a caller under five policies, whoever transcribed each clip (few callers have all of theirs from one
    vendor); of several transcripts of a caller's clip the one with the least id and vendor counts."""
    every = items(spark, sf_dir)
    born = every.filter((F.col("field") == "flow_dob") & F.col("record.dob").isNotNull())
    born = born.groupBy(F.col("caller").alias("id")).agg(F.min_by("record.dob", "id").alias("dob"))
    callers = every.filter((F.col("field") == "name") & F.col("record.surname").isNotNull()).select(
        "id", F.col("record.surname").alias("surname"), "impostor", "homophone"
    )
    of_flow = F.col("field").startswith("flow_") & F.col("caller").isNotNull()
    clip = F.when(of_flow, F.concat_ws("_", "field", "caller")).otherwise(F.col("id"))
    heard = (
        valid_results(spark, sf_dir).join(every.select("id", "field", "caller"), "id")
        .groupBy("condition", clip.alias("clip")).agg(F.min_by("transcript", F.struct("id", "vendor")).alias("transcript"))
        .select("condition", F.col("clip").alias("id"), "transcript", F.lit("any").alias("vendor"))
    )
    return V.verification_flow(callers.join(born, "id"), heard, hinted="domain")


_SOUND_SQL = "translate(regexp_replace(substr(n, 2), '[hw]', '', 'g'), 'bfpvcgjkqsxzdtlmnraeiouy', '111122222222334556000000')"
for _d in "123456":
    _SOUND_SQL = f"regexp_replace({_SOUND_SQL}, '{_d}+', '{_d}', 'g')"


@identities.query(
    f"""
    WITH {ITEMS_SQL},
    a AS (SELECT id, regexp_replace(lower(record.surname), '[^a-z]', '', 'g') AS n FROM i WHERE record.surname IS NOT NULL),
    b AS (SELECT id, n, translate(left(n, 1), 'bfpvcgjkqsxzdtlmnraeiouyhw', '11112222222233455600000099') AS f, {_SOUND_SQL} AS c FROM a),
    d AS (SELECT id, CASE WHEN n = '' THEN '' ELSE left(upper(left(n, 1))
          || replace(CASE WHEN left(c, 1) = f THEN substr(c, 2) ELSE c END, '0', '') || '000', 4) END AS code FROM b)
    SELECT code, count(*) AS n, min(id) AS first_id FROM d GROUP BY code
    """
)
def identity_sound_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surnames of records with their sound codes and sizes of equal-sounding groups."""
    named = items(spark, sf_dir).filter(F.col("record.surname").isNotNull()).select(
        "id", I.soundex(F.col("record.surname")).alias("code")
    )
    return named.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@identities.query()
def identity_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts with number words as digits, and their readings as a date and an address."""
    rows = valid_results(spark, sf_dir)
    text = F.col("transcript")
    return rows.select(
        "id", "vendor", "condition", I.digits(text).alias("digits"), I.parse_dob(text).alias("date"),
        I.normalise_address(text).alias("address"), I.letter_runs(text).alias("letters"),
    )


@identities.query()
def identity_paired_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same kind of detail in real and in synthetic voices, by vendor; items pair by script."""
    scores = V.score_rows(items(spark, sf_dir), valid_results(spark, sf_dir)).filter(F.col("condition") == "none")
    scripts = items(spark, sf_dir).select("id", "script")
    joined = scores.join(scripts, "id").filter(F.col("script").isNotNull() & F.col("ok").isNotNull())
    side = lambda name: joined.filter(F.col("item_set") == name).groupBy("vendor", "kind", "script").agg(
        F.bool_and("ok").alias(f"{name}_ok")
    )
    return V.paired_accuracy(side("real").join(side("synthetic"), ["vendor", "kind", "script"]))
