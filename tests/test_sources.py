import json

import pytest
from pyspark.sql import functions as F

from speechlytics.sources import readers, sinks
from speechlytics.sources import results_table as T
from tests.conftest import rows


def write(path, *lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")


def test_run_and_notes_files(spark, tmp_path):
    sample = {"type": "sample", "sample_id": "a", "audio_path": "a.pcm", "duration_seconds": 1.5, "transcription": "hi", "generated_at": "2025-01-02T03:04:05+00:00Z"}
    write(tmp_path / "r1.jsonl", {"type": "header", "run_id": "old", "model": "m", "num_samples": 2}, {"type": "header", "run_id": "r1", "model": "m", "num_samples": 2}, sample, "", "{broken", sample | {"sample_id": "b", "transcription": None, "error": "bad"}, {"type": "footer", "run_id": "r1", "total_samples": 2, "successful": 1, "errors": 1})
    write(tmp_path / "r1_notes.jsonl", {"type": "header", "run_id": "r1", "evaluator": "e"}, {"type": "review", "sample_id": "a", "status": "noted"}, {"type": "review", "sample_id": "a", "status": "approved"}, {"type": "edit", "sample_id": "a", "corrected_text": "one"}, {"type": "edit", "sample_id": "a", "corrected_text": "two"})
    header, samples, footer = readers.run_file(spark, str(tmp_path / "r1.jsonl"))
    assert [r.run_id for r in header.collect()] == ["r1"] and footer.first().errors == 1
    assert str(samples.filter("sample_id = 'a'").first().generated_at) == "2025-01-02 03:04:05"
    reviews, edits = readers.notes(spark, str(tmp_path / "r1_notes.jsonl"))
    assert reviews.first().status == "approved" and edits.first().corrected_text == "two"
    assert rows(readers.review_counts(reviews, edits)) == [("approved", 1), ("edited", 1)]
    catalog = readers.run_catalog(spark, str(tmp_path)).collect()
    assert [(r.run, r.run_id, r.n_samples, r.n_reviewed) for r in catalog] == [("r1", "r1", 2, 1)]
    write(tmp_path / "headless.jsonl", sample)
    with pytest.raises(ValueError):
        readers.run_file(spark, str(tmp_path / "headless.jsonl"))


def test_items_and_results(spark, tmp_path):
    write(tmp_path / "items.jsonl", {"id": "i1", "field": "name", "expected": {"surname": "A"}}, {"id": "i2", "field": "dob"})
    write(tmp_path / "more.jsonl", {"id": "i1", "field": "name", "set": "real", "expected": {"surname": "B"}})
    got = readers.identity_items(spark, [str(tmp_path / "items.jsonl"), str(tmp_path / "more.jsonl")])
    assert {(r.id, r.item_set, r.expected and r.expected.surname) for r in got.collect()} == {("i1", "real", "B"), ("i2", "synthetic", None)}
    write(tmp_path / "res.jsonl", {"id": "i1", "vendor": "v", "condition": "none", "transcript": "x"}, {"id": "i1", "vendor": "v", "condition": "none", "transcript": None, "error": "bad"})
    assert readers.identity_results(spark, str(tmp_path / "res.jsonl")).count() == 2
    write(tmp_path / "judge.jsonl", {"judge": "j", "key": "k", "repeat": 0, "result": {"wer": 0.5, "error_count": 1, "reference_words": 2, "errors": [{"type": "deletion", "reference": "a"}]}}, {"judge": "j", "key": "k", "repeat": 1, "result": None})
    judged = readers.judgments(spark, str(tmp_path / "judge.jsonl")).orderBy("repeat").collect()
    assert judged[0].result.errors[0].type == "deletion" and judged[1].result is None


def test_audio_files_and_config(spark, tmp_path):
    (tmp_path / "a.pcm").write_bytes(b"\x00\x01")
    audio = readers.pcm_files(spark, str(tmp_path))
    samples = spark.createDataFrame([("a", "x/a.pcm"), ("b", "x/b.pcm")], "sample_id string, audio_path string")
    assert [r.sample_id for r in readers.with_audio(samples, audio).collect()] == ["a"]
    (tmp_path / "c.json").write_text('{"x": 2, "y": 2}')
    assert readers.chart_config(str(tmp_path / "c.json"), {"y": 3, "z": None}, {"x": 1, "z": 1}) == {"x": 2, "y": 3, "z": 1}
    assert readers.chart_config(None, {}, {"x": 1}) == {"x": 1}


ROW = dict(vendor="Acme", model="m-1", success_rate=99.8, perfect_pct=76.5, wer_mean=1.71, pooled_wer=1.62, ttfb_median=247.0, ttfb_p95=298.0, ttfb_p99=326.0)
LINE = "| Acme | m-1 | 99.8% | 76.5% | 1.71% | 1.62% | 247ms | 298ms | 326ms |"


def document(*lines):
    return "\n".join(["# Results", T.START, f"| {' | '.join(T.TITLES)} |", "|---|---|---|---|---|---|---|---|---|", *lines, T.END, "## After"])


def frame(spark, *updates):
    return spark.createDataFrame([{**ROW, "previous_judge": False, **u} for u in updates], T.ROW)


def test_table_round_trip(spark):
    assert T.format_row(ROW) == LINE
    assert T.format_row(ROW | {"previous_judge": True}).count("†") == 2
    parsed = T.parse_table(spark, document(LINE, "| text | only | a | b | c | d | e | f | g |")).collect()
    assert len(parsed) == 1 and T.format_row(parsed[0].asDict()) == LINE and not parsed[0].previous_judge
    marked = T.parse_table(spark, LINE.replace("1.71%", "1.71%†")).first()
    assert marked.previous_judge and marked.wer_mean == 1.71
    assert T.parse_table(spark, "no table").isEmpty()


def test_table_upserts(spark, tmp_path):
    path = tmp_path / "doc.md"
    path.write_text(document(LINE, LINE.replace("Acme", "Zeta").replace("1.71%", "1.71%†")))
    assert T.upsert_rows(spark, str(path), frame(spark, {"vendor": "Mid"})) == ["Mid — m-1"]
    vendors = [r.vendor for r in T.parse_table(spark, path.read_text()).collect()]
    assert vendors == ["Acme", "Mid", "Zeta"] and path.read_text().endswith("## After")
    before = path.read_text()
    T.upsert_rows(spark, str(path), frame(spark, {"vendor": "Mid"}))
    assert path.read_text() == before  # doing it again changes nothing
    T.upsert_rows(spark, str(path), frame(spark, {"vendor": "zeta", "wer_mean": 0.5}))
    zeta = T.parse_table(spark, path.read_text()).filter("lower(vendor) = 'zeta'").collect()
    assert [(r.wer_mean, r.previous_judge) for r in zeta] == [(0.5, False)]
    registry = spark.createDataFrame([("Mid", "m-1", False)], "vendor string, model string, is_current boolean")
    T.upsert_rows(spark, str(path), frame(spark, {"vendor": "Mid", "model": "z-2"}), registry)
    assert [r.model for r in T.parse_table(spark, path.read_text()).filter("vendor = 'Mid'").collect()] == ["z-2", "m-1"]
    with pytest.raises(FileNotFoundError):
        T.upsert_rows(spark, str(tmp_path / "none.md"), frame(spark, {}))
    (tmp_path / "bare.md").write_text("x")
    with pytest.raises(ValueError):
        T.upsert_rows(spark, str(tmp_path / "bare.md"), frame(spark, {}))
    assert not T.replace_block(str(tmp_path / "bare.md"), "t")


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "hi", x', [1, 2])], "k string, t string, n array<int>")
    sinks.write_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert back.t == 'say "hi", x' and back.n == "[1,2]"
    sinks.write_json_envelope(df.union(df).repartition(3), {"service": "s"}, str(tmp_path / "envelope"))
    doc = json.loads(sinks.read_json_envelope(spark, str(tmp_path / "envelope")))
    assert doc["metadata"] == {"service": "s"} and doc["results"][0]["n"] == [1, 2]
    sinks.append_json_lines(df, str(tmp_path / "log"))
    sinks.append_json_lines(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    sinks.write_dataset(df, str(tmp_path / "data"))
    assert spark.read.parquet(str(tmp_path / "data")).count() == 1
    pairs = spark.createDataFrame([("s", "x", 1, 2, "ref", "hyp")], "service_name string, sample_id string, stored_error_count int, new_error_count int, reference string, transcription string")
    assert "## s / x" in sinks.disagreement_report(pairs, [])
    assert "| 0% (perfect) | 3 | 75.0% |" in sinks.service_report([("0% (perfect)", 3), ("1-5%", 1)], {"service_name": "s"})
    published = T.published(spark.createDataFrame([("v", "m", 0.5, 1, 4, 0.1, 0.2, 0.3, 0.4, 0.5)], "vendor string, model string, success_rate double, perfect_count int, sample_count int, wer_mean double, pooled_wer double, ttfb_median double, ttfb_p95 double, ttfb_p99 double"))
    assert published.select(F.round("perfect_pct"), F.round("ttfb_median")).first() == (25.0, 300.0)
