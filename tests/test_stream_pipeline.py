"""Recordings to levels to detector events, as a stream and as a batch."""

import numpy as np

from utterscope.operators.levels import levels_of_recordings
from utterscope.operators.vad import VadConfig, detect
from utterscope.streaming.vad_stream import append_stream, detect_stream

CONFIG = VadConfig(5, 2, 4, 50, 40, 12.0, 6.0, -35.0, -40.0, 0.02)
RATE, PER_FILE = 1000, 400


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = []
    for session in ("a", "b"):
        loud = np.repeat(rng.random(60) < 0.5, 20)[: 3 * PER_FILE]
        samples = (rng.normal(0, 1, 3 * PER_FILE) * np.where(loud, 6000, 60)).astype(np.int16)
        rows += [(session, part, samples[part * PER_FILE : (part + 1) * PER_FILE].tolist(), RATE, 1) for part in range(3)]
    chunks = spark.createDataFrame(rows, "session string, part bigint, samples array<smallint>, sample_rate_hz int, channels int")
    per_part = PER_FILE // 20

    def windows(df):
        levels = levels_of_recordings(df, ("session", "part"))
        return levels.selectExpr("session", f"part * {per_part} + window_idx as window_idx", "dbfs", f"part * {PER_FILE} + end_frame as end_frame")

    for part in range(3):
        chunks.where(f"part = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    append_stream(detect_stream(windows(stream), CONFIG), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    key = lambda r: (r["session"], r["window_idx"], r["event"], r["at_frame"], r["mean_speech_dbfs"])
    got = sorted((key(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    assert got == sorted((key(r) for r in detect(windows(chunks), "session", CONFIG).collect()), key=str)
    assert sum(r[2] == "speech_ended" for r in got) >= 2
