"""Queries on segments, metrics, audio frames and logs, over the tables that stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlytics.operators import audio, store
from speechlytics.plans.latency import latency, rounded
from speechlytics.plans.registry import Registry
from speechlytics.session import table
from speechlytics.streaming import segments

streams = Registry()
#: Events of a user stand for segments of a sample; their quiet period and cap are in hours instead of seconds.
QUIET, CAP = 6 * 3600.0, 30 * 86400.0


def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("sample_id"), F.lit(0).alias("attempt"), F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("text"),
    )


_COLLECT_SQL = f"""
    WITH e AS (SELECT user_id::VARCHAR AS sample_id, event_id, ts, event_type, epoch_us(ts) / 1e6 AS secs FROM events),
    g AS (SELECT *, secs - lag(secs) OVER w AS gap, min(secs) OVER (PARTITION BY sample_id) AS begun FROM e
          WINDOW w AS (PARTITION BY sample_id ORDER BY ts, event_id)),
    k AS (SELECT *, max((coalesce(gap, 0) >= {QUIET})::INT) OVER (PARTITION BY sample_id ORDER BY ts, event_id) AS closed
          FROM g WHERE secs - begun <= {CAP}),
    c AS (SELECT sample_id, string_agg(event_type, ' ' ORDER BY ts, event_id) AS transcription, count(*)::INT AS n_segments,
                 max(ts) AS last_ts, min(ts) AS first_ts FROM k WHERE closed = 0 GROUP BY sample_id)
"""


@streams.query(_COLLECT_SQL + "SELECT sample_id, transcription, n_segments FROM c")
def segment_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments joined until the first quiet period."""
    found = segments.collect_segments(event_segments(spark, sf_dir), quiet=QUIET, cap=CAP)
    return found.select("sample_id", "transcription", "n_segments")


@streams.query(
    _COLLECT_SQL
    + "SELECT sample_id, round(epoch_us(last_ts) / 1e6 - (epoch_us(first_ts) / 1e6 - 0.2), 3) AS ttfs FROM c"
)
def time_to_last_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency to the last segment; here speech ends with the first one."""
    found = segments.collect_segments(event_segments(spark, sf_dir), quiet=QUIET, cap=CAP)
    stops = found.select("sample_id", F.col("first_ts").alias("vad_ts"), F.lit(0.2).alias("stop_secs"))
    return rounded(segments.time_to_final(found, stops), "ttfs", digits=3)


@streams.query(
    """
    SELECT user_id::VARCHAR AS sample_id, arg_max(value, (ts, value)) AS ttfb FROM events
    WHERE value <> 0 GROUP BY user_id
    """
)
def last_nonzero_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("sample_id"), "ts", "value")
    return segments.last_metric(rows)


@streams.query(
    """
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k
               FROM documents WHERE doc_kind = 'call' AND text IS NOT NULL),
    b AS (SELECT *, (regexp_matches(array_to_string(regexp_extract_all(lower(t), '[a-z0-9]+'), ' '), '^(agent|caller)')
                     OR k = 0)::INT AS b FROM l),
    g AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS line FROM b)
    SELECT doc_id::VARCHAR AS recording, line::BIGINT AS line, string_agg(t, ' ' ORDER BY k) AS text, min(k)::INT AS first_island,
           max(k)::INT AS last_island FROM g GROUP BY ALL
    """
)
def line_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks joined to lines, each begun by an opener; here the lines of call transcripts."""
    calls = table(spark, sf_dir, "documents").filter((F.col("doc_kind") == "call") & F.col("text").isNotNull())
    chunks = calls.select(
        F.col("doc_id").cast("string").alias("recording"), F.posexplode(F.split("text", "\n")).alias("island", "text")
    )
    return audio.lines(audio.line_groups(chunks, "^(agent|caller)"))


_FRAMES_SQL = """
    WITH f AS (SELECT vec_id AS recording, unnest(range(0, 8)) AS frame_no, embedding FROM embeddings),
    d AS (SELECT recording, frame_no::INT AS frame_no, round(20 * log10(sqrt(list_sum(list_transform(
              embedding[frame_no * 8 + 1 : frame_no * 8 + 8], lambda x: x::DOUBLE * x::DOUBLE)) / 8) + 1e-9), 6) AS db FROM f)
"""


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as recordings of eight frames."""
    cut = audio.frames(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)
    return rounded(cut.select("recording", "frame_no", audio.level_db(F.col("samples")).alias("db")), "db")


@streams.query(_FRAMES_SQL + "SELECT recording, frame_no, db FROM d")
def frame_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels(spark, sf_dir)


@streams.query(
    _FRAMES_SQL
    + """
    , q AS (SELECT recording, quantile_cont(db, 0.15) AS floor FROM d GROUP BY recording)
    SELECT recording, frame_no, db > floor + 12 AS speech FROM d JOIN q USING (recording)
    """
)
def speech_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.speech_frames(levels(spark, sf_dir)).select("recording", "frame_no", "speech")


_ISLANDS_SQL = """
    WITH f AS (SELECT user_id AS recording, value > 40 AS speech,
                      (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS frame_no FROM events),
    o AS (SELECT *, frame_no - lag(frame_no) OVER (PARTITION BY recording ORDER BY frame_no) AS gap FROM f WHERE speech),
    r AS (SELECT *, sum((coalesce(gap, 0) > 15)::INT) OVER (PARTITION BY recording ORDER BY frame_no) AS run FROM o),
    i AS (SELECT recording, run, min(frame_no) AS first_frame, max(frame_no) + 1 AS end_frame FROM r GROUP BY ALL
          HAVING max(frame_no) + 1 - min(frame_no) >= 5),
    n AS (SELECT recording, (row_number() OVER (PARTITION BY recording ORDER BY first_frame) - 1)::INT AS island, first_frame,
                 end_frame FROM i),
    t AS (SELECT recording, max(frame_no) + 1 AS total FROM f GROUP BY recording)
"""


def islands(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    order = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1"
    speech = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("recording"), F.expr(order).alias("frame_no"), (F.col("value") > 40).alias("speech")
    )
    return speech, audio.speech_islands(speech)


@streams.query(_ISLANDS_SQL + "SELECT recording, island, first_frame, end_frame FROM n")
def speech_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of speech between pauses; events of a user stand for the frames of a recording."""
    return islands(spark, sf_dir)[1]


@streams.query(
    _ISLANDS_SQL
    + """
    SELECT recording, island,
           coalesce((lag(end_frame) OVER w + first_frame) // 2 * 320, 0)::BIGINT AS cut_from,
           coalesce((end_frame + lead(first_frame) OVER w) // 2 * 320, total * 320)::BIGINT AS cut_to
    FROM n JOIN t USING (recording) WINDOW w AS (PARTITION BY recording ORDER BY first_frame)
    """
)
def cut_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    speech, found = islands(spark, sf_dir)
    total = speech.groupBy("recording").agg((F.max("frame_no") + 1).alias("total_frames"))
    return audio.cut_points(found.join(total, "recording")).select("recording", "island", "cut_from", "cut_to")


@streams.query(
    """
    WITH e AS (SELECT user_id, event_type, ts, event_id, json_extract(props, '$.k')::INT AS k FROM events)
    SELECT user_id, event_type, k FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM e) WHERE rn = 1
    """
)
def json_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last JSON record of each key of a log."""
    rows = table(spark, sf_dir, "events").select(
        "user_id", "event_type", "ts", "event_id", F.from_json("props", "k int")["k"].alias("k")
    )
    return store.latest(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "k")


@streams.query(
    latency.sqls["service_summary"].rsplit("SELECT * FROM s", 1)[0]
    + f"""
    , rates AS ({latency.sqls["transcript_stats"]})
    SELECT upper(left(service_name, 1)) || lower(substr(service_name, 2)) AS vendor,
           CASE WHEN model_name = '' THEN 'N/A' ELSE model_name END AS model,
           printf('%.1f', success_rate * 100)::DOUBLE AS success_rate, printf('%.1f', perfect_count / sample_count * 100)::DOUBLE AS perfect_pct,
           printf('%.2f', wer_mean * 100)::DOUBLE AS wer_mean, printf('%.2f', pooled_wer * 100)::DOUBLE AS pooled_wer,
           printf('%.0f', s.ttfb_median * 1000)::DOUBLE AS ttfb_median, printf('%.0f', s.ttfb_p95 * 1000)::DOUBLE AS ttfb_p95,
           printf('%.0f', s.ttfb_p99 * 1000)::DOUBLE AS ttfb_p99, false AS previous_judge
    FROM s JOIN rates USING (service_name, model_name)
    """
)
def published_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaderboard written as the published table and parsed again."""
    from speechlytics.plans.latency import results, scores, transcript_stats
    from speechlytics.operators.leaderboard import service_summary
    from speechlytics.sources import results_table as T

    found = service_summary(scores(spark, sf_dir), results(spark, sf_dir))
    rates = transcript_stats(spark, sf_dir).select("service_name", "model_name", "success_rate")
    named = found.join(rates, ["service_name", "model_name"]).withColumns(
        {"vendor": F.initcap("service_name"), "model": F.when(F.col("model_name") == "", "N/A").otherwise(F.col("model_name"))}
    )
    return T.parse_table(spark, T.render(T.published(named)))
