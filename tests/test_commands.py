import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from speechlytics import __main__ as commands
from speechlytics.plans import latency
from speechlytics.sources import registry, sinks
from speechlytics.sources import results_table as T
from tests.conftest import rows
from tests.test_queries import DATA

needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture
def here(spark, monkeypatch):
    monkeypatch.setattr(commands, "get_spark", lambda: spark)
    return str(DATA)


def test_registry(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text("\n".join(json.dumps(x) for x in [
        {"service_name": " A ", "vendor": "Acme", "model_label": "", "is_current": True},
        {"service_name": "b", "vendor": "Beta", "model_label": "x", "is_current": False},
        {"service_name": "c", "vendor": "Beta", "model_label": "x", "is_current": False},
    ]))
    found = registry.service_registry(spark, str(path))
    assert rows(found)[0] == ("a", "Acme", "N/A", True)
    assert {r.problem for r in registry.registry_problems(found).collect()} == {"written twice", "no current row"}


@needs_data
def test_commands(spark, here, tmp_path, capsys):
    commands.main(["queries"])
    assert "latency_summary" in capsys.readouterr().out
    commands.main(["run", "duration_histogram", "--data", here, "--out", str(tmp_path / "h")])
    assert spark.read.parquet(str(tmp_path / "h")).count() == 4
    with pytest.raises(SystemExit):
        commands.main(["report", "--data", here, "--errors", "3"])
    commands.main(["report", "--data", here, "--service", "voxaria"])
    assert "| 0% (perfect) |" in capsys.readouterr().out
    commands.main(["export", "--data", here, "--service", "voxaria", "--out", str(tmp_path / "x")])
    document = json.loads(sinks.read_json_envelope(spark, str(tmp_path / "x/json")))
    assert document["metadata"] == {"service": "voxaria"}
    names = spark.read.parquet(f"{here}/results.parquet").select("service_name").distinct().limit(3).collect()
    path, doc = tmp_path / "reg.jsonl", tmp_path / "doc.md"
    path.write_text("\n".join(json.dumps({"service_name": r[0], "vendor": r[0].title(), "model_label": "m", "is_current": True}) for r in names))
    doc.write_text(f"{T.START}\n{T.END}\n")
    commands.main(["update-table", "--data", here, "--registry", str(path), "--document", str(doc)])
    assert doc.read_text().startswith(T.START)


@needs_data
def test_scoring(spark, here, tmp_path, capsys):
    out = str(tmp_path / "scores")
    commands.main(["wer", "--data", here, "--scores", out, "--service", "voxaria"])
    first = spark.read.parquet(out)
    n = first.count()
    assert n and {r.service_name for r in first.select("service_name").distinct().collect()} == {"voxaria"}
    commands.main(["wer", "--data", here, "--scores", out, "--service", "voxaria"])  # nothing is left to do
    assert spark.read.parquet(out).count() == n
    spark.read.parquet(out).withColumn("judge", F.lit("another")).write.parquet(str(tmp_path / "others"))
    spark.read.parquet(str(tmp_path / "others")).limit(1).write.parquet(str(tmp_path / "one"))
    commands.main(["wer", "--data", here, "--scores", str(tmp_path / "one"), "--service", "voxaria"])
    assert spark.read.parquet(str(tmp_path / "one")).count() == 1  # scored by another judge
    commands.main(["wer", "--data", here, "--scores", str(tmp_path / "one"), "--service", "voxaria", "--force"])
    assert spark.read.parquet(str(tmp_path / "one")).count() == n


@needs_data
def test_benchmark_goes_on(spark, here, tmp_path):
    ids = [r[0] for r in latency.samples(spark, here).select("sample_id").distinct().orderBy("sample_id").limit(3).collect()]
    at = datetime(2025, 1, 1)
    said = [(i, 0, 0, at, "hello", "voxaria") for i in ids] + [(ids[0], 0, 1, at, "of another", "cantor")]
    spark.createDataFrame(said, "sample_id string, attempt int, seq int, ts timestamp, text string, source string").write.parquet(str(tmp_path / "s"))
    spark.createDataFrame([(ids[0], at, 0.4, "voxaria")], "sample_id string, ts timestamp, value double, source string").write.parquet(str(tmp_path / "m"))
    command = ["benchmark", "--data", here, "--service", "voxaria", "--segments", str(tmp_path / "s"), "--metrics", str(tmp_path / "m"), "--results", str(tmp_path / "r")]
    commands.main([*command, "--limit", "4"])
    some = spark.read.parquet(str(tmp_path / "r")).count()
    commands.main(command)
    found = {r.sample_id: r for r in spark.read.parquet(str(tmp_path / "r")).collect()}
    assert some <= 4 < len(found) and found[ids[0]].transcription == "hello" and found[ids[0]].ttfb_seconds == 0.4
    assert found[ids[1]].ttfb_seconds is None and found[ids[1]].error is None


@needs_data
def test_ground_truth(spark, here, tmp_path, capsys):
    sample = latency.samples(spark, here).first().sample_id
    lines = [{"type": "header", "run_id": "r", "model": "m"}, {"type": "sample", "sample_id": sample, "transcription": "heard"}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n")
    on = ["--runs", str(tmp_path), "--run", "r", "--sample", sample]
    commands.main(["ground-truth", "review", *on, "--status", "noted"])
    commands.main(["ground-truth", "edit", *on, "--text", "better"])
    commands.main(["ground-truth", "list", "--runs", str(tmp_path)])
    assert "|r  |r     |m    |" in capsys.readouterr().out
    commands.main(["ground-truth", "import", *on, "--data", here, "--out", str(tmp_path / "gold"), "--force"])
    row = spark.read.parquet(str(tmp_path / "gold")).first()
    assert (row.text, row.original_text, row.verified_by) == ("better", "heard", "human")


@needs_data
def test_tables_and_charts(spark, here, tmp_path, capsys):
    commands.main(["judge", "consistency", "--data", here])
    commands.main(["judge", "impact", "--data", here, "--out", str(tmp_path / "d.md")])
    assert (tmp_path / "d.md").read_text().startswith("# Largest judge disagreements")
    commands.main(["identity", "score", "--data", here, "--out", str(tmp_path / "i")])
    commands.main(["identity", "matcher", "--data", here])
    assert "surname_passed" in capsys.readouterr().out and (tmp_path / "i/failures").exists()
    commands.main(["plot", "--data", here, "--out", str(tmp_path / "p.svg"), "--title", "A & B"])
    assert "A &amp; B" in (tmp_path / "p.svg").read_text() and "<circle" in (tmp_path / "p.svg").read_text()
    commands.main(["report", "--data", here, "-o", str(tmp_path / "all")])
    assert "most samples without an error: " in (tmp_path / "all/report.md").read_text()
    commands.main(["report", "--data", here, "--service", "voxaria", "-m", "", "-o", str(tmp_path / "rep")])
    assert "dataset_index" in spark.read.option("header", True).csv(str(tmp_path / "rep")).columns


@needs_data
def test_download(spark, here, tmp_path, capsys):
    data = [(f"x{k}", "en" if k % 4 else "de", k % 5 == 0, f"{k}.pcm", float(k % 12)) for k in range(60)]
    spark.createDataFrame(data, "id string, language string, synthetic boolean, audio_path string, duration_seconds double").write.parquet(str(tmp_path / "set"))
    command = ["download", "--source", str(tmp_path / "set"), "--data", str(tmp_path / "d"), "--limit", "10", "--seed", "3"]
    commands.main(command)
    commands.main(command)  # changes nothing
    commands.main([*command, "--offset", "10"])
    got = spark.read.parquet(str(tmp_path / "d/samples.parquet")).collect()
    assert sorted(r.dataset_index for r in got) == list(range(20)) and len({r.sample_id for r in got}) == 20
    kept = {f"{k}.pcm" for k in range(60) if k % 4 and k % 5}
    assert {r.audio_path for r in got} <= kept and len({r.audio_path for r in got}) == 20
