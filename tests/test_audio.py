import math

import numpy as np
from pyspark.sql import functions as F

from speechlytics.operators import audio
from tests.conftest import rows


def frame_rows(name, flags):
    return [(name, i, bool(f)) for i, f in enumerate(flags)]


def test_levels_and_frames(spark):
    df = spark.createDataFrame([("r", [3.0, -4.0] * 3), ("short", [1.0]), ("none", [])], "rec string, x array<double>")
    got = {(r.recording, r.frame_no): r.db for r in audio.frames(df, "rec", "x", 4).select("*", audio.level_db(F.col("samples")).alias("db")).collect()}
    assert list(got) == [("r", 0)]
    assert math.isclose(got["r", 0], 20 * math.log10(math.sqrt(12.5) + 1e-9))
    assert spark.createDataFrame([([],)], "x array<double>").select(audio.level_db(F.col("x"))).first()[0] is None


def test_speech_is_above_the_floor(spark):
    df = spark.createDataFrame([("r", i, 60.0 if i in (5, 6) else 10.0 + i / 100) for i in range(20)], "recording string, frame_no int, db double")
    assert [r.frame_no for r in audio.speech_frames(df).filter("speech").orderBy("frame_no").collect()] == [5, 6]


def test_islands_merge_and_split(spark):
    tone = [1] * 6
    data = frame_rows("merge", tone + [0] * 14 + tone) + frame_rows("split", tone + [0] * 15 + tone)
    data += frame_rows("click", [1] * 4 + [0] * 20 + [1] * 5) + frame_rows("silent", [0] * 9)
    df = spark.createDataFrame(data, "recording string, frame_no int, speech boolean")
    found = audio.speech_islands(df)
    assert rows(found) == [
        ("click", 0, 24, 29), ("merge", 0, 0, 26), ("split", 0, 0, 6), ("split", 1, 21, 27),
    ]
    cuts = audio.cut_points(found.filter("recording = 'split'").withColumn("total_frames", F.lit(27)))
    assert [(r.cut_from, r.cut_to) for r in cuts.orderBy("island").collect()] == [(0, 13 * 320), (13 * 320, 27 * 320)]
    trimmed = {r.recording: (r.from_frame, r.to_frame) for r in audio.trim_to_speech(df).collect()}
    assert trimmed["split"] == (0, 36) and "silent" not in trimmed


def test_lines_and_alignment(spark):
    chunks = spark.createDataFrame(
        [("r", 0, "noise first"), ("r", 1, "My name is Ann"), ("r", 2, "Lee"), ("r", 3, "My name is Ann Lee"), ("r", 4, "my name is Bob")],
        "recording string, island int, text string",
    )
    found = audio.lines(audio.line_groups(chunks, "^my nam"))
    assert [r.text for r in found.orderBy("line").collect()] == ["noise first", "My name is Ann Lee", "My name is Ann Lee", "my name is Bob"]
    script = spark.createDataFrame([("r", 0, "My name is Ann Lee."), ("r", 1, "My name is Bob."), ("r", 2, "Absent entirely")], "recording string, script_line int, text string")
    aligned = audio.align_script(found, script)
    assert [r.line for r in aligned.orderBy("script_line").collect()] == [2, 3, None]  # the later take wins
    assert [r.line for r in audio.unused_lines(found, aligned).orderBy("line").collect()] == [0, 1]
    assert audio.comparable("Thank you. the thirteenth of May, 13th") == audio.comparable("the 13 of May 13")


def test_samples(spark):
    tone = np.sin(np.arange(800) * 2 * np.pi * 440 / 8000)
    up = audio.resample(tone.astype(np.float32), 8000)
    assert len(up) == 1600 and np.abs(up[200:-200:2][: len(tone[100:-100])] - tone[100:-100]).max() < 0.05
    assert list(audio.to_pcm(np.array([0.5, -0.50001, 2.0, -2.0]))) == [16383, -16383, 32767, -32767]
    raw = np.array([16384, -32768], "<i2").tobytes()
    df = spark.createDataFrame([(raw, 16000), (None, 16000), (b"", 8000)], "c binary, r int")
    got = df.select(audio.pcm_samples(F.col("c")).alias("s"), audio.pcm_column(F.col("c"), F.col("r")).alias("p"), audio.pcm_seconds(F.col("c")).alias("t")).collect()
    assert got[0].s == [0.5, -1.0] and len(got[0].p) == 4 and got[0].t == 2 / 16000
    assert got[1].s is None and got[1].p is None and got[2].s == []
    wrapped = [r[0] for r in df.select(audio.wav_column(F.col("c"))).collect()]
    assert wrapped[0][:4] == b"RIFF" and wrapped[0].endswith(raw) and len(wrapped[0]) == 48 and wrapped[1] is None
