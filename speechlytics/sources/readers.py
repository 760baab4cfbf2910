"""Readers of run files, notes, judgment logs, identity results, result tables and audio.

JSON lines are read as text and parsed with declared schemas, so malformed lines become NULL rows that are dropped.
Line order within a file is kept: the reader says where a line stands, as "the last one counts".
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlytics.functions.identity import tolerant_timestamp
from speechlytics.operators.store import latest

RUN_LINE = (
    "type string, run_id string, model string, prompt_hash string, prompt_text string, num_samples int, started_at string,"
    " sample_id string, audio_path string, duration_seconds double, transcription string, error string, generated_at string,"
    " completed_at string, total_samples int, successful int, errors int"
)
NOTE_LINE = (
    "type string, run_id string, evaluator string, started_at string, sample_id string, status string, note string,"
    " reviewed_at string, original_text string, corrected_text string, edited_at string"
)
JUDGMENT_LINE = (
    "judge string, key string, repeat int, result struct<wer:double,error_count:int,reference_words:int,"
    "errors:array<struct<type:string,reference:string,hypothesis:string,position:int>>>"
)
RESULT_LINE = "id string, vendor string, condition string, transcript string, ttfs double, error string"
_FIELDS = "given surname email dob unit number street type suburb state postcode".split()
_PARTS = f"struct<{','.join(f'{f}:string' for f in _FIELDS)}>"
ITEM_LINE = (
    "id string, field string, script string, `set` string, voice string, noise boolean, impostor boolean, homophone boolean,"
    f" rate string, style string, caller string, pair string, script_key string, expected {_PARTS}, record {_PARTS}"
)


def json_lines(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Parsed lines with file and line_no, a struct (block, row) that sorts lines as they stand in their file.

    Files are read in blocks by as many tasks as there are. The lines of a block come in order to one task, so their order
    is that of the blocks' starts and, within one, of the task's rows. Blank and malformed lines are dropped.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), place.alias("line_no"), F.col("value").alias("line")
    )
    parsed = lines.select("file", "line_no", F.from_json("line", schema, {"mode": "PERMISSIVE"}).alias("x"))
    first = "x." + schema.split()[0].strip("`")
    return parsed.filter(F.col("x").isNotNull() & F.col(first).isNotNull()).select("file", "line_no", "x.*")


def run_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(header, samples, footer) of run files; the last header and footer of a file count. Raises if none has a header."""
    rows = json_lines(spark, path, RUN_LINE).withColumns(
        {c: tolerant_timestamp(F.col(c)) for c in ("started_at", "generated_at", "completed_at")}
    )
    of = lambda kind: rows.filter(F.col("type") == kind)
    header = latest(of("header"), ["file"], ["line_no"]).select(
        "file", "run_id", "model", "prompt_hash", "prompt_text", "num_samples", "started_at"
    )
    if header.isEmpty():
        raise ValueError(f"no header line in {path}")
    samples = of("sample").select(
        "file", "line_no", "sample_id", "audio_path", "duration_seconds", "transcription", "error", "generated_at"
    )
    footer = latest(of("footer"), ["file"], ["line_no"]).select(
        "file", "run_id", "completed_at", "total_samples", "successful", "errors"
    )
    return header, samples, footer


def notes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(reviews, edits) of notes files, the last line of each sample counting."""
    rows = json_lines(spark, path, NOTE_LINE)
    reviews = latest(rows.filter(F.col("type") == "review"), ["sample_id"], ["file", "line_no"])
    edits = latest(rows.filter(F.col("type") == "edit"), ["sample_id"], ["file", "line_no"])
    return reviews.select("sample_id", "status", "note", "reviewed_at"), edits.select(
        "sample_id", "original_text", "corrected_text", "edited_at"
    )


def review_counts(reviews: DataFrame, edits: DataFrame) -> DataFrame:
    """Reviews by status, and edited samples as a status of their own."""
    by = reviews.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return by.unionByName(edits.agg(F.lit("edited").alias("status"), F.count(F.lit(1)).alias("n")).select("status", "n"))


def run_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of a folder: (run, run_id, model, started_at, n_samples, n_reviewed); notes files are *_notes.jsonl."""
    name = F.regexp_extract("file", r"([^/]+?)(_notes)?\.jsonl$", 1)
    rows = json_lines(spark, f"{folder}/*.jsonl", RUN_LINE).withColumn("run", name)
    own = rows.filter(~F.col("file").endswith("_notes.jsonl"))
    header = latest(own.filter(F.col("type") == "header"), ["run"], ["line_no"]).select("run", "run_id", "model", "started_at")
    counts = own.filter(F.col("type") == "sample").groupBy("run").agg(F.count(F.lit(1)).alias("n_samples"))
    reviews = json_lines(spark, f"{folder}/*.jsonl", NOTE_LINE).withColumn("run", name).filter(F.col("type") == "review")
    reviewed = reviews.groupBy("run").agg(F.count_distinct("sample_id").alias("n_reviewed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return header.join(counts, "run", "left").join(reviewed, "run", "left").select(
        *header.columns, zero("n_samples"), zero("n_reviewed")
    )


def judgments(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, JUDGMENT_LINE)


def identity_results(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return json_lines(spark, paths, RESULT_LINE)


def identity_items(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Items of several files: the set is 'synthetic' unless said, of a repeated id the later file's row counts."""
    rank = F.lit(0)
    rows = json_lines(spark, paths, ITEM_LINE)
    for k, p in enumerate(paths):
        rank = F.when(F.col("file").endswith("/" + Path(p).name), F.lit(k)).otherwise(rank)
    last = latest(rows.withColumn("__file", rank), ["id"], ["__file", "line_no"])
    return last.withColumn("item_set", F.coalesce("set", F.lit("synthetic"))).drop("set", "file", "line_no", "__file")


def pcm_files(spark: SparkSession, folder: str, pattern: str = "*.pcm") -> DataFrame:
    """(audio_path, content) of raw audio files, one row a file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.col("path").alias("audio_path"), "content")


def with_audio(samples: DataFrame, audio: DataFrame) -> DataFrame:
    """Samples whose audio file exists, by file name."""
    base = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    return samples.join(audio.select(base("audio_path").alias("__f")), base(F.col("audio_path")) == F.col("__f"), "left_semi")


def chart_config(path: str | None, overrides: dict, defaults: dict) -> dict:
    """Settings of a report: overrides that are not None before the JSON file's before the defaults."""
    stored = json.loads(Path(path).read_text()) if path else {}
    return defaults | stored | {k: v for k, v in overrides.items() if v is not None}
