"""Speech in recordings: frames, levels, islands of speech, line groups, alignment to a script, resampling.

Recordings are rows of frames (recording, frame_no, level) or of samples; frame numbers start at 0. Windows run within
one recording.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechlytics.functions.spoken import ORDINALS, numbers_to_digits, words

RATE, FRAME = 16_000, 320
#: Silent frames that end an island, frames of the shortest one that counts, and frames kept around speech.
PAUSE, SHORTEST, MARGIN = 15, 5, 10
#: The noise floor is this percentile of a recording's levels; speech lies more than so many dB above it.
FLOOR, ABOVE = 0.15, 12.0


def level_db(samples: Column) -> Column:
    """The level of a frame (array of numbers) in dB, 20 log10(rms + 1e-9); NULL for an empty frame."""
    squares = F.aggregate(samples, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, 20 * F.log10(F.sqrt(squares / F.size(samples)) + 1e-9))


def frames(recordings: DataFrame, recording: str, samples: str, frame: int = FRAME) -> DataFrame:
    """(recording, frame_no, samples) for an array of samples; an incomplete last frame is dropped."""
    n = F.floor(F.size(samples) / frame).cast("int")
    number = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("frame_no")
    return recordings.select(F.col(recording).alias("recording"), samples, number).select(
        "recording", "frame_no", F.slice(F.col(samples), F.col("frame_no") * frame + 1, F.lit(frame)).alias("samples")
    )


def speech_frames(levels: DataFrame) -> DataFrame:
    """(recording, frame_no, db) with ``speech``: clearly above the recording's own noise floor."""
    floor = levels.groupBy("recording").agg(F.percentile("db", F.lit(FLOOR)).alias("floor"))
    return levels.join(floor, "recording").withColumn("speech", F.col("db") > F.col("floor") + ABOVE).drop("floor")


def speech_islands(speech: DataFrame) -> DataFrame:
    """(recording, island, first_frame, end_frame): runs of speech, ended by PAUSE silent frames, of at least SHORTEST
    frames. end_frame is the one after the last; islands count from 0."""
    along = Window.partitionBy("recording").orderBy("frame_no")
    on = speech.filter("speech").withColumn("gap", F.col("frame_no") - F.lag("frame_no").over(along))
    numbered = on.withColumn("run", F.sum((F.coalesce("gap", F.lit(0)) > PAUSE).cast("int")).over(along))
    runs = numbered.groupBy("recording", "run").agg(
        F.min("frame_no").alias("first_frame"), (F.max("frame_no") + 1).alias("end_frame")
    ).filter(F.col("end_frame") - F.col("first_frame") >= SHORTEST)
    order = Window.partitionBy("recording").orderBy("first_frame")
    return runs.select("recording", (F.row_number().over(order) - 1).alias("island"), "first_frame", "end_frame")


def cut_points(islands: DataFrame, total_frames: str = "total_frames", frame: int = FRAME) -> DataFrame:
    """Islands with sample ranges that end mid-pause: (cut_from, cut_to); the ends of the recording at its borders."""
    order = Window.partitionBy("recording").orderBy("first_frame")
    middle = lambda a, b: F.floor((a + b) / 2) * frame
    before, after = F.lag("end_frame").over(order), F.lead("first_frame").over(order)
    return islands.withColumn(
        "cut_from", F.coalesce(middle(before, F.col("first_frame")), F.lit(0)).cast("bigint")
    ).withColumn("cut_to", F.coalesce(middle(F.col("end_frame"), after), F.col(total_frames) * frame).cast("bigint"))


def line_groups(chunks: DataFrame, opener: str) -> DataFrame:
    """Chunks (recording, island, text) with ``line``: a chunk that starts like an opener begins a line, as does the first."""
    plain = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9]+)"), F.lit(1)), " ")
    order = Window.partitionBy("recording").orderBy("island")
    begins = plain.rlike(opener) | (F.row_number().over(order) == 1)
    return chunks.withColumn("__b", begins.cast("int")).withColumn("line", F.sum("__b").over(order) - 1).drop("__b")


def lines(grouped: DataFrame) -> DataFrame:
    """One row a line: its text and its first and last island."""
    return grouped.groupBy("recording", "line").agg(
        F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY island)").alias("text"),
        F.min("island").alias("first_island"), F.max("island").alias("last_island"),
    )


def trim_to_speech(speech: DataFrame, margin: int = MARGIN) -> DataFrame:
    """(recording, from_frame, to_frame) of the speech with a margin on both sides; recordings without speech are absent."""
    return speech.filter("speech").groupBy("recording").agg(
        F.greatest(F.lit(0), F.min("frame_no") - margin).alias("from_frame"), (F.max("frame_no") + margin).alias("to_frame")
    )


_SIGN_OFFS = re.compile(r"(?i)\b(?:thank you|thanks for watching|i'?ll see you next time|bye|uh-huh)\b[.!]?")


def comparable(text: str) -> str:
    """A line for comparison: without stock sign-offs, ordinals and number words as digits."""
    tokens = [t for t in words(_SIGN_OFFS.sub(" ", text), breaks=True) if t not in ("st", "nd", "rd", "th")]
    return " ".join(numbers_to_digits([ORDINALS.get(t, t) for t in tokens]))


def align_lines(found: list[str], wanted: list[str], least: float = 0.5) -> list[int | None]:
    """For each wanted line the index of the found line it aligns to, in order, by greatest total similarity.

    Lines under ``least`` never match; of equal alignments later found lines win by a tiny bonus. Where scores are the
    same, passing over a wanted line goes before passing over a found one, and that before a match.
    """
    n, m = len(found), len(wanted)
    likeness = np.array([[SequenceMatcher(None, f, w).ratio() for w in wanted] for f in found]).reshape(n, m)
    gain = np.where(likeness >= least, likeness + 1e-4 * np.arange(1, n + 1)[:, None], -np.inf)
    score = np.zeros((n + 1, m + 1))
    for i in range(n):  # a row at once: from above, or by a match, or carried on from the left
        score[i + 1, 1:] = np.maximum(score[i, 1:], score[i, :-1] + gain[i])
        score[i + 1] = np.maximum.accumulate(score[i + 1])
    result: list[int | None] = [None] * m
    i, j = n, m
    while i and j:
        if score[i, j] == score[i, j - 1]:
            j -= 1
        elif score[i, j] == score[i - 1, j]:
            i -= 1
        else:
            i, j = i - 1, j - 1
            result[j] = i
    return result


def align_script(found: DataFrame, script: DataFrame) -> DataFrame:
    """(recording, script_line, line, similarity): each recording's lines aligned to its script.

    ``found`` is (recording, line, text), ``script`` (recording, script_line, text). A recording is one file with at most
    some hundred lines, and is aligned as a whole; several are aligned in parallel. Script lines without a match have
    a NULL line.
    """

    def align(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("line"), b.sort_values("script_line")
        got, want = list(map(comparable, a["text"])), list(map(comparable, b["text"]))
        to = align_lines(got, want)
        return pd.DataFrame({
            "recording": key[0],
            "script_line": b["script_line"].to_numpy(),
            "line": pd.array([None if k is None else int(a["line"].iloc[k]) for k in to], dtype="Int64"),
            "similarity": [
                None if k is None else SequenceMatcher(None, got[k], w).ratio() for k, w in zip(to, want, strict=True)
            ],
        })

    a = found.select("recording", "line", "text").groupBy("recording")
    b = script.select("recording", "script_line", "text").groupBy("recording")
    return a.cogroup(b).applyInPandas(align, "recording string, script_line bigint, line bigint, similarity double")


def unused_lines(found: DataFrame, aligned: DataFrame) -> DataFrame:
    """Found lines that no script line took: false starts and earlier takes."""
    used = aligned.filter(F.col("line").isNotNull()).select("recording", "line")
    return found.join(used, ["recording", "line"], "left_anti")


def resample(samples: np.ndarray, rate: int, target: int = RATE) -> np.ndarray:
    """Band-limited resampling by the Fourier method; the length is rounded down."""
    n = int(len(samples) * target / rate)
    if rate == target or not len(samples) or not n:
        return samples[:n].astype(np.float32)
    spectrum = np.fft.rfft(samples)
    bins = n // 2 + 1
    kept = np.zeros(bins, complex)
    k = min(bins, len(spectrum))
    kept[:k] = spectrum[:k]
    return (np.fft.irfft(kept, n) * (n / len(samples))).astype(np.float32)


def to_pcm(samples: np.ndarray) -> np.ndarray:
    """Floats in -1..1 to 16-bit integers, clipped, cut toward zero."""
    return (np.clip(samples, -1.0, 1.0) * 32767).astype(np.int16)


def pcm_column(content: Column, rate: Column) -> Column:
    """s16le bytes at ``rate`` to s16le bytes at 16 kHz."""

    def convert(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(raw: bytes | None, r: int | None) -> bytes | None:
            if raw is None or r is None:
                return None
            floats = np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float32) / 32768
            return to_pcm(resample(floats, int(r))).astype("<i2").tobytes()

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    convert.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(convert, "binary")(content, rate)


def pcm_samples(content: Column) -> Column:
    """s16le bytes to an array of floats in -1..1."""

    def convert(a: pd.Series) -> pd.Series:
        one = lambda raw: None if raw is None else np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float32) / 32768
        return pd.Series([one(x) for x in a], dtype=object)

    convert.__annotations__ = {"a": pd.Series, "return": pd.Series}
    return F.pandas_udf(convert, "array<float>")(content)


def wav_column(content: Column, rate: int = RATE) -> Column:
    """s16le mono bytes with a WAV header before them."""
    import io
    import wave

    def wrap(a: pd.Series) -> pd.Series:
        def one(raw: bytes | None) -> bytes | None:
            if raw is None:
                return None
            out = io.BytesIO()
            with wave.open(out, "wb") as w:
                w.setnchannels(1)
                w.setsampwidth(2)
                w.setframerate(rate)
                w.writeframes(raw)
            return out.getvalue()

        return pd.Series([one(x) for x in a], dtype=object)

    wrap.__annotations__ = {"a": pd.Series, "return": pd.Series}
    return F.pandas_udf(wrap, "binary")(content)


def pcm_seconds(content: Column, rate: int = RATE) -> Column:
    return F.octet_length(content) / 2 / rate
