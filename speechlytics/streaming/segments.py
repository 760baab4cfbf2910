"""Transcript segments and metrics as they arrive: collection per sample, in batches and as a stream.

Segments are (sample_id, attempt, seq, ts, text). A sample's silence phase begins when its audio has been sent. It waits up
to CAP for a first segment; from then, or from the start of the silence if a segment came before it, the collection drains:
it closes when QUIET has passed both since the drain began and since the last segment, or at CAP after the silence began.
Later segments are lost. A new attempt of a sample discards earlier ones. Where nothing tells that segments arrive, the
silence has a fixed length (FALLBACK) and nothing is waited for.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

QUIET, CAP = 2.0, 10.0
#: Five chunks of 20 ms of silence, where there is no event to wait for.
FALLBACK = 5 * 0.020
#: How long a caller waits for the transcript and, after it, for a latency metric.
TRANSCRIPT_WAIT, METRIC_WAIT = 10.0, 2.5
#: How long the stream remembers that an attempt is closed, in event time.
REMEMBER = 3600.0
COLLECTED = "sample_id string, attempt int, transcription string, n_segments int, first_ts timestamp, last_ts timestamp"


def _seconds(column: str) -> F.Column:
    return F.unix_micros(column) / 1e6


def collect_segments(segments: DataFrame, starts: DataFrame | None = None, quiet: float = QUIET, cap: float = CAP) -> DataFrame:
    """COLLECTED rows, one a sample that has a segment: the last attempt's segments up to the close, joined by a space.

    ``starts`` (sample_id, silence_start) bounds the time; without it the first segment's time stands for it. The segment
    that ends a gap of ``quiet`` or more, and all after it, are left out, as are those after the cap. Gaps count from the
    start of the silence at the earliest.
    """
    along = Window.partitionBy("sample_id", "attempt").orderBy("ts", "seq")
    newest = segments.withColumn("__last", F.max("attempt").over(Window.partitionBy("sample_id"))).filter("attempt = __last")
    begun = F.min("ts").over(Window.partitionBy("sample_id", "attempt"))
    if starts is None:
        timed = newest.withColumn("__start", begun)
    else:
        timed = newest.join(starts.select("sample_id", F.col("silence_start").alias("__start")), "sample_id", "left")
        timed = timed.withColumn("__start", F.coalesce("__start", begun))
    before = F.lag(_seconds("ts")).over(along)
    gap = F.when(before.isNotNull(), _seconds("ts") - F.greatest(before, _seconds("__start")))
    kept = (
        timed.filter((_seconds("ts") - _seconds("__start")) <= cap)
        .withColumn("__closed", F.max((F.coalesce(gap, F.lit(0.0)) >= quiet).cast("int")).over(along))
        .filter("__closed = 0")
    )
    return kept.groupBy("sample_id", "attempt").agg(
        F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY ts, seq)").alias("transcription"),
        F.count(F.lit(1)).cast("int").alias("n_segments"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def time_to_final(collected: DataFrame, stops: DataFrame) -> DataFrame:
    """(sample_id, ttfs): from the end of speech (vad_ts less stop_secs) to the last segment, in seconds."""
    joined = collected.join(stops, "sample_id")
    return joined.select("sample_id", (_seconds("last_ts") - (_seconds("vad_ts") - F.col("stop_secs"))).alias("ttfs"))


def last_metric(metrics: DataFrame) -> DataFrame:
    """(sample_id, ttfb): the last value other than 0 of each sample; ties in time go to the greater value."""
    return metrics.filter(F.col("value") != 0).groupBy("sample_id").agg(
        F.max(F.struct("ts", "value"))["value"].alias("ttfb")
    )


def in_time(events: DataFrame, starts: DataFrame, wait: float) -> DataFrame:
    """The events (sample_id, ts, ...) not later than ``wait`` seconds after their sample's silence_start; what comes
    later finds nobody waiting. Samples without a start keep all."""
    begun = starts.select("sample_id", F.col("silence_start").alias("__start"))
    late = (_seconds("ts") - _seconds("__start")) > wait
    return events.join(begun, "sample_id", "left").filter(~F.coalesce(late, F.lit(False))).drop("__start")


def from_source(events: DataFrame, source: str) -> DataFrame:
    """The events that a given service sent (column source); those of others, or of nobody, do not count."""
    return events.filter(F.col("source") == source)


def sample_results(samples: DataFrame, collected: DataFrame, metrics: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """One row a sample: transcript and latency where they came; a sample without has NULLs and no error, one without
    audio has an error. With ``starts``, metrics later than TRANSCRIPT_WAIT and METRIC_WAIT after it are not waited for."""
    if starts is not None:
        metrics = in_time(metrics, starts, TRANSCRIPT_WAIT + METRIC_WAIT)
    rows = samples.join(collected.select("sample_id", "transcription"), "sample_id", "left").join(
        last_metric(metrics), "sample_id", "left"
    )
    missing = F.col("audio_path").isNull()
    return rows.withColumn("error", F.when(missing, F.lit("audio file missing")))


_STATE = "attempt int, closed boolean, start bigint, times array<bigint>, texts array<string>"


def _kept(times: list[int], start: int, quiet: int, cap: int) -> tuple[int, int]:
    """How many of the segments (in order of time) a collection takes, and when it ends at the latest known."""
    for k, at in enumerate(times):
        drain = max(times[k - 1], start) if k else None
        if at - start > cap or (k and at - drain >= quiet):
            return k, at
    return len(times), min(max(times[-1], start) + quiet, start + cap) if times else start + cap


def _collector(quiet: float, cap: float, remember: float, with_starts: bool) -> Callable:
    quiet_us, cap_us, keep_us = (int(x * 1e6) for x in (quiet, cap, remember))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempt, closed, start, times, texts = state.get if state.exists else (-1, False, None, [], [])
        times, texts = list(times), list(texts)
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["attempt", "ts", "seq"], kind="stable")
            for r in rows.itertuples():
                at = r.ts.value // 1000  # microseconds, as whole numbers
                if r.attempt > attempt:
                    attempt, closed, start, times, texts = int(r.attempt), False, None, [], []
                if r.attempt < attempt or closed:
                    continue
                if r.text is None:
                    start = at
                else:
                    times, texts = [*times, at], [*texts, r.text]
        elif closed:
            state.remove()
            return
        watermark = state.getCurrentWatermarkMs()
        known = start if start is not None else times[0] if times and (not with_starts or state.hasTimedOut) else None
        if known is None and not closed:  # the start of the silence may still come
            end = max(times) + cap_us if times else 0
        elif not closed:
            order = sorted(range(len(times)), key=times.__getitem__)
            times, texts = [times[k] for k in order], [texts[k] for k in order]
            n, end = _kept(times, known, quiet_us, cap_us)
            if n < len(times) or state.hasTimedOut:
                closed, end = True, max(end, known + cap_us)
                if n:
                    yield _collected(key[0], attempt, texts[:n], times[0], times[n - 1])
                times, texts = [], []
        else:
            end = 0
        if closed:  # remembered, so that later segments change nothing
            end = max(end, (known if known is not None else 0) + cap_us) + keep_us
            if end // 1000 + 1 <= watermark and state.hasTimedOut:
                state.remove()
                return
        state.update((attempt, closed, known if closed else start, times, texts))
        state.setTimeoutTimestamp(max(int(end // 1000) + 1, watermark + 1))

    return step


def _collected(sample: str, attempt: int, texts: list[str], first: int, last: int) -> pd.DataFrame:
    at = lambda us: pd.Timestamp(us, unit="us")
    row = (sample, attempt, " ".join(texts), len(texts), at(first), at(last))
    return pd.DataFrame([row], columns=["sample_id", "attempt", "transcription", "n_segments", "first_ts", "last_ts"])


def collect_stream(
    segments: DataFrame, quiet: float = QUIET, cap: float = CAP, remember: float = REMEMBER, waits: bool = True,
    with_starts: bool = False,
) -> DataFrame:
    """COLLECTED rows of a streaming DataFrame of segments, each emitted when its collection closes.

    A row with a NULL text is the start of the silence of its sample and attempt; ``with_starts`` says that these come, so
    that segments before it do not close a collection. State is kept per sample; a collection closes when a segment after its end or the watermark (``cap`` behind the newest event) shows that it has ended.
    That it is closed is remembered for ``remember`` seconds of event time, in which segments of the same or an earlier
    attempt change nothing. Segments behind the watermark are dropped. ``waits=False`` is the fixed silence (FALLBACK).
    """
    span = cap if waits else FALLBACK
    watched = segments.withWatermark("ts", f"{int(cap)} seconds")
    return watched.groupBy("sample_id").applyInPandasWithState(
        _collector(quiet, span, remember, with_starts), COLLECTED, _STATE, "append", GroupStateTimeout.EventTimeTimeout,
    )


def sink_append(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds each batch to a Parquet folder as a folder of its own.

    A batch costs what it holds, whatever was written before; written again it replaces itself. ``read_sink`` gives one row
    a key: the greatest by ``order``, of equal ones the one of the earliest batch.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        where, fs = _folder(spark, f"{path}/keys.json")
        if not fs.exists(where):
            out = fs.create(where, True)
            out.write(bytearray(json.dumps({"keys": keys, "order": order}).encode()))
            out.close()
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


#: The former name; a sink is an upsert when it is read.
sink_upsert = sink_append


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def read_sink(spark: SparkSession, path: str) -> DataFrame | None:
    """One row a key of what ``sink_append`` wrote (complete batches only), or None if there is nothing."""
    where, fs = _folder(spark, f"{path}/epoch=*/_SUCCESS")
    done = [str(s.getPath().getParent()) for s in fs.globStatus(where)]
    if not done:
        return None
    rule = json.loads(spark.read.text(f"{path}/keys.json", wholetext=True).first()[0]) if fs.exists(_folder(spark, f"{path}/keys.json")[0]) else {}
    rows = spark.read.option("basePath", path).parquet(*done)
    first = Window.partitionBy(*rule["keys"]).orderBy(*(F.desc_nulls_last(c) for c in rule["order"]), "epoch")
    return rows.withColumn("__rank", F.row_number().over(first)).filter("__rank = 1").drop("__rank", "epoch")


def compact_sink(spark: SparkSession, path: str) -> None:
    """Replace all complete batches by one with their result; for a stopped stream, or batches that will not come again."""
    where, fs = _folder(spark, f"{path}/epoch=*/_SUCCESS")
    done = [s.getPath().getParent() for s in fs.globStatus(where)]
    if len(done) < 2:
        return
    last = max(done, key=lambda p: int(p.getName().split("=")[1]))
    made, _ = _folder(spark, f"{path}/_compacted")
    read_sink(spark, path).write.mode("overwrite").parquet(str(made))
    for old in done:
        fs.delete(old, True)
    fs.rename(made, last)


def run_collection(segments: DataFrame, path: str, checkpoint: str, with_starts: bool = False) -> StreamingQuery:
    """Collect a stream of segments into an upserted folder until it is stopped."""
    return (
        collect_stream(segments, with_starts=with_starts).writeStream.outputMode("append")
        .foreachBatch(sink_append(path, ["sample_id"], ["attempt"]))
        .option("checkpointLocation", checkpoint).start()
    )
