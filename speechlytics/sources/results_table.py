"""The published results table: a markdown block of nine columns, parsed, formatted, merged.

The table has a row a service, so text is handled on the driver; merging works on DataFrames.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlytics.operators.leaderboard import table_order

# The markers around the table, its heading, and the mark of rows scored by an earlier judge.
START, END = "<!-- RESULTS_TABLE:START -->", "<!-- RESULTS_TABLE:END -->"
TITLES = ("Vendor", "Model", "Transcripts", "Perfect", "WER Mean", "Pooled WER", "TTFS Median", "TTFS P95", "TTFS P99")
PREVIOUS_JUDGE = "†"
METRICS = ("success_rate", "perfect_pct", "wer_mean", "pooled_wer", "ttfb_median", "ttfb_p95", "ttfb_p99")
ROW = "vendor string, model string, " + ", ".join(f"{m} double" for m in METRICS) + ", previous_judge boolean"


def parse_lines(lines: DataFrame) -> DataFrame:
    """Table rows from a DataFrame of lines (value): data rows only; heading, rule and other lines are left out."""
    cells = F.transform(F.split(F.btrim(F.btrim("value"), F.lit("|")), r"\|"), lambda c: F.btrim(c))
    number = lambda c: F.try_to_number(F.regexp_replace(c, "%|ms", ""), F.lit("999999999.999999"))
    plain = lambda c: F.expr(f"try_cast(trim(regexp_replace({c}, '%|ms', '')) AS double)")
    rate = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^([0-9.]+)%\\\\s*(†)?$', 1) AS double)")
    del number
    rows = lines.filter(F.btrim("value").startswith("|")).select(cells.alias("c")).filter(F.size("c") >= 9)
    rows = rows.select(*(F.element_at("c", k + 1).alias(f"c{k}") for k in range(9)))
    marked = F.col("c4").endswith(PREVIOUS_JUDGE) | F.col("c5").endswith(PREVIOUS_JUDGE)
    parsed = rows.select(
        F.col("c0").alias("vendor"), F.col("c1").alias("model"), plain("c2").alias("success_rate"),
        plain("c3").alias("perfect_pct"), rate("c4").alias("wer_mean"), rate("c5").alias("pooled_wer"),
        plain("c6").alias("ttfb_median"), plain("c7").alias("ttfb_p95"), plain("c8").alias("ttfb_p99"),
        marked.alias("previous_judge"),
    )
    data = (F.lower("vendor") != "vendor") & ~F.col("vendor").rlike("^[-: ]*$")
    for m in METRICS:
        data = data & F.col(m).isNotNull()
    return parsed.filter(data)


def block(text: str) -> str:
    """What stands between the markers, or the whole text without them."""
    return text.split(START, 1)[1].split(END, 1)[0] if START in text and END in text else text


def parse_table(spark: SparkSession, text: str) -> DataFrame:
    return parse_lines(spark.createDataFrame([(x,) for x in block(text).splitlines()], "value string"))


def format_row(row: dict) -> str:
    """One line of the table; numbers are rounded as Python does."""
    mark = PREVIOUS_JUDGE if row.get("previous_judge") else ""
    cells = [
        row["vendor"], row["model"], f"{row['success_rate']:.1f}%", f"{row['perfect_pct']:.1f}%",
        f"{row['wer_mean']:.2f}%{mark}", f"{row['pooled_wer']:.2f}%{mark}",
        *(f"{row[m]:.0f}ms" for m in METRICS[4:]),
    ]
    return f"| {' | '.join(cells)} |"


def published(summary: DataFrame) -> DataFrame:
    """Metrics of a summary in the table's units: shares to percent, seconds to milliseconds."""
    percent, ms = lambda c: (F.col(c) * 100).alias(c), lambda c: (F.col(c) * 1000).alias(c)
    return summary.select(
        "vendor", "model", percent("success_rate"),
        (F.col("perfect_count") / F.nullif(F.col("sample_count"), F.lit(0)) * 100).alias("perfect_pct"),
        percent("wer_mean"), percent("pooled_wer"), ms("ttfb_median"), ms("ttfb_p95"), ms("ttfb_p99"),
    )


def merge_rows(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` replace those of the same vendor and model (without case); all others stay as they are."""
    key: list[Column] = [F.lower("vendor").alias("__v"), F.lower("model").alias("__m")]
    fresh_keys = new.select(*key)
    kept = existing.select("*", *key).join(fresh_keys, ["__v", "__m"], "left_anti").drop("__v", "__m")
    return kept.unionByName(new, allowMissingColumns=True)


def render(rows: DataFrame) -> str:
    """The table as text, in its order; a row a service is brought to the driver."""
    head = f"| {' | '.join(TITLES)} |"
    rule = f"|{'|'.join(['---'] * len(TITLES))}|"
    return "\n".join([head, rule, *(format_row(r.asDict()) for r in rows.orderBy(*table_order(rows)).collect())])


def replace_block(path: str, table: str) -> bool:
    """Put a table between the markers of a file; False if the file or the markers are missing."""
    file = Path(path)
    text = file.read_text() if file.exists() else ""
    if START not in text or END not in text:
        return False
    before, rest = text.split(START, 1)
    file.write_text(f"{before}{START}\n{table}\n{END}{rest.split(END, 1)[1]}")
    return True


def upsert_rows(spark: SparkSession, path: str, new: DataFrame, registry: DataFrame | None = None) -> list[str]:
    """Insert or replace single rows of the table in a file; gives the labels written.

    ``registry`` (vendor, model, is_current) decides the order within a vendor; unknown rows count as current.
    """
    file = Path(path)
    if not file.exists():
        raise FileNotFoundError(path)
    text = file.read_text()
    if START not in text or END not in text:
        raise ValueError(f"no table markers in {path}")
    merged = merge_rows(parse_table(spark, text), new)
    if registry is not None:
        known = registry.select(F.lower("vendor").alias("__v"), F.lower("model").alias("__m"), "is_current")
        merged = merged.join(
            known, (F.lower("vendor") == F.col("__v")) & (F.lower("model") == F.col("__m")), "left"
        ).drop("__v", "__m")
    replace_block(path, render(merged))
    return [f"{r['vendor']} — {r['model']}" for r in new.select("vendor", "model").collect()]


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-")
