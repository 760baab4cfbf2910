"""Exports: CSV, a JSON envelope, JSON lines, a disagreement report, Parquet datasets."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlytics.functions.wording import errors_text
from speechlytics.session import Written


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a heading; quotes are doubled; nested columns are written as JSON."""
    flat = [F.to_json(n).alias(n) if t.startswith(("array", "struct", "map")) else F.col(n) for n, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json_envelope(rows: DataFrame, metadata: dict[str, str], path: str) -> None:
    """One JSON document {metadata, results: [...]} over the part files of a folder: their lines, file after file, are it.

    A row is a line; no task holds more than its own rows.
    """
    spark = rows.sparkSession
    kept = Written(rows.select(F.to_json(F.struct(*rows.columns)).alias("value"), F.monotonically_increasing_id().alias("__id")), "envelope")
    stored = kept.read()
    first = stored.agg(F.min("__id")).first()[0]
    line = lambda text: spark.createDataFrame([(text,)], "value string").coalesce(1)
    head = line(json.dumps({"metadata": metadata})[:-1] + ', "results": [')
    of = lambda where, text: stored.filter(where).select(text.alias("value"))
    body = of(F.col("__id") == F.lit(first), F.col("value")).coalesce(1).union(
        of(F.col("__id") != F.lit(first), F.concat(F.lit(","), "value"))
    )
    head.union(body).union(line("]}")).write.mode("overwrite").text(path)
    kept.drop()


def read_json_envelope(spark: SparkSession, path: str) -> str:
    """The text of a document that ``write_json_envelope`` wrote; for small ones."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
    return "".join(r.value for r in files.orderBy("name").collect())


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_dataset(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def disagreement_report(pairs: DataFrame, fields: list[str]) -> str:
    """Markdown on the largest disagreements; ``pairs`` is their short list (see ``judging.disagreements``)."""
    rows = pairs.withColumns(
        {c: errors_text(F.col(c), fields) for c in ("stored_errors", "new_errors") if c in pairs.columns}
    ).collect()
    parts = [f"# Largest judge disagreements ({len(rows)})"]
    for r in rows:
        d = r.asDict()
        parts.append(
            f"## {d['service_name']} / {d['sample_id']}\n\n- **Reference:** {d.get('reference')}\n"
            f"- **Hypothesis:** {d.get('transcription')}\n"
            f"- **Stored judge** ({d['stored_error_count']} errors): {d.get('stored_errors', 'none')}\n"
            f"- **New judge** ({d['new_error_count']} errors): {d.get('new_errors', 'none')}"
        )
    return "\n\n".join(parts) + "\n"


def service_report(histogram: list[tuple[str, int]], summary: dict) -> str:
    """A service's validation report as text, from its few aggregates."""
    total = sum(n for _, n in histogram) or 1
    lines = [f"# {summary['service_name']} {summary.get('model_name') or ''}".rstrip(), ""]
    lines += [f"- {k}: {v}" for k, v in summary.items() if k not in ("service_name", "model_name")]
    lines += ["", "| WER | samples | share |", "|---|---|---|"]
    lines += [f"| {label} | {n} | {100 * n / total:.1f}% |" for label, n in histogram]
    return "\n".join(lines) + "\n"


def summary_report(rows: list[dict], title: str = "Results") -> str:
    """All services' figures as text, from the few rows of a ranked summary: a table and who leads each ranking."""
    percent, ms = lambda v: "-" if v is None else f"{100 * v:.2f}%", lambda v: "-" if v is None else f"{1000 * v:.0f}ms"
    named = lambda r: f"{r['service_name']} {r['model_name']}".strip()
    lines = [f"# {title}", "", f"{len(rows)} services, {sum(r['sample_count'] for r in rows)} scored samples", ""]
    for rank, what in (("rank_perfect", "most samples without an error"), ("rank_pooled", "lowest pooled error rate"), ("rank_latency", "fastest")):
        lines += [f"- {what}: {named(r)}" for r in rows if r.get(rank) == 1]
    lines += ["", "| service | samples | without error | mean WER | pooled WER | median latency |", "|---|---|---|---|---|---|"]
    for r in rows:
        share = r["perfect_count"] / r["sample_count"] if r["sample_count"] else None
        lines.append(
            f"| {named(r)} | {r['sample_count']} | {percent(share)} | {percent(r['wer_mean'])} | {percent(r['pooled_wer'])} | {ms(r['ttfb_median'])} |"
        )
    return "\n".join(lines) + "\n"


def save_text(text: str, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text)
