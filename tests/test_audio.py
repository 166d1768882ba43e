import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from utterscope.functions import audio
from utterscope.functions.audio import Resampler, resampled
from utterscope.operators.levels import levels_of_frames, levels_of_recordings
from utterscope.sources.wav import read_wavs, write_wavs

RECORDING = "id string, samples array<smallint>, sample_rate_hz int, channels int"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_samples(spark):
    got = one(spark, *[audio.i16_from_float(F.lit(x)).alias(f"f{i}") for i, x in enumerate((-1.0, 0.0, 1.0, 2.0, float("nan"), 0.5))], *[audio.i16_from_u16(F.lit(x)).alias(f"u{x}") for x in (0, 32768, 65535)])
    assert list(got) == [-32767, 0, 32767, 32767, 0, 16384, -32768, 0, 32767]


def test_levels_of_windows(spark):
    rows = [("a", [16384, -16384] * 5, 200, 1), ("silent", [0] * 4, 200, 1), ("stereo", [16384, 0] * 4, 200, 2), ("short", [1, 2, 3], 200, 1)]
    got = {(r["id"], r["window_idx"]): r for r in levels_of_recordings(spark.createDataFrame(rows, RECORDING)).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("silent", 0), ("stereo", 0)}
    assert got["a", 1]["rms"] == pytest.approx(0.5) and got["a", 1]["dbfs"] == pytest.approx(-6.0206, abs=1e-4) and got["a", 1]["end_frame"] == 8
    assert got["silent", 0]["dbfs"] == pytest.approx(-240) and got["stereo", 0]["rms"] == pytest.approx(0.25)


def test_levels_of_frames_leave_out_the_rest(spark):
    df = spark.createDataFrame([("s", i, 0.5) for i in range(11)], "session string, frame bigint, x double")
    assert sorted((r["window_idx"], r["end_frame"]) for r in levels_of_frames(df, ["session"], "frame", "x", 4).collect()) == [(0, 4), (1, 8)]


def test_mono(spark):
    df = spark.createDataFrame([([32767, -32768, 16384, 16384], 2), ([], 2)], "s array<smallint>, c int")
    got = [r[0] for r in df.select(audio.mono(F.col("s"), F.col("c"))).collect()]
    assert got[0] == pytest.approx([-0.5 / 32768, 0.5]) and got[1] == []
    for bad in (([1, 2, 3], 2), ([1], 0)):
        with pytest.raises(Exception, match="incomplete frame"):
            spark.createDataFrame([bad], df.schema).select(audio.mono(F.col("s"), F.col("c"))).collect()


def test_resample(spark):
    t = np.arange(48_000) / 48_000
    low, high = np.sin(2 * np.pi * 440 * t), np.sin(2 * np.pi * 12_000 * t)
    got = audio.resampled(low + high, 48_000)
    away = np.abs(got - np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000))
    assert len(got) == 16_000 and away[100:-100].max() < 1e-3  # at the ends the filter reaches into the silence about the signal
    assert audio.resampled(np.ones(5), 16_000).tolist() == [1.0] * 5 and len(audio.resampled(np.zeros(0), 48_000)) == 0
    with pytest.raises(ValueError):
        audio.resampled(np.ones(3), 0)
    df = spark.createDataFrame([("a", [100] * 480, 48_000, 1)], RECORDING)
    assert len(df.select(audio.prepare_for_stt("samples", "sample_rate_hz", "channels")).first()[0]) == 160
    with pytest.raises(Exception, match="no samples"):
        spark.createDataFrame([("a", [], 48_000, 1)], RECORDING).select(audio.prepare_for_stt("samples", "sample_rate_hz", "channels")).collect()


def test_slices_and_meter(spark):
    samples = F.array(*[F.lit(i).cast("smallint") for i in range(8)])
    got = one(
        spark, audio.slice_frames(samples, F.lit(2), F.lit(1), F.lit(3)).alias("a"), audio.pre_roll_start(F.lit(100).cast("bigint"), F.lit(1000)).alias("b"),
        audio.pre_roll_start(F.lit(500).cast("bigint"), F.lit(1000)).alias("c"), audio.windows_for(F.lit(141)).alias("d"), audio.frames_for(F.lit(44_100), 0.02).alias("e"), audio.meter(F.lit(-30.0)).alias("m"),
    )
    assert got["a"] == [2, 3, 4, 5] and (got["b"], got["c"], got["d"], got["e"]) == (0, 200, 8, 882) and got["m"] == "#" * 10 + "-" * 10
    with pytest.raises(Exception, match="out of bounds"):
        one(spark, audio.slice_frames(samples, F.lit(2), F.lit(1), F.lit(5)))


def test_wav_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", [1, -2, 3, -4], 16_000, 2), ("b", [], 8_000, 1)], RECORDING)
    paths = {r["id"]: r["audio_path"] for r in write_wavs(df, str(tmp_path)).collect()}
    assert paths == {"a": "audio/a.wav", "b": "audio/b.wav"}
    got = {r["path"].rsplit("/", 1)[1]: (r["samples"], r["sample_rate_hz"], r["channels"]) for r in read_wavs(spark, str(tmp_path)).collect()}
    assert got == {"a.wav": ([1, -2, 3, -4], 16_000, 2), "b.wav": ([], 8_000, 1)}
    (tmp_path / "audio" / "bad.wav").write_bytes(b"no")
    with pytest.raises(PythonException):
        read_wavs(spark, str(tmp_path)).collect()


def _db(x):
    return 20 * np.log10(np.sqrt(np.mean(np.square(x))) + 1e-12)


@pytest.mark.parametrize("source, target", [(48_000, 16_000), (44_100, 16_000), (8_000, 16_000), (47_999, 16_000), (22_050, 16_000)])
def test_resampling_keeps_the_band_and_stops_what_is_above(source, target):
    t = np.arange(source) / source
    limit = min(source, target) / 2
    for hz in (50, 0.5 * limit, 0.9 * limit):
        y = resampled(np.sin(2 * np.pi * hz * t), source, target)
        want = np.sin(2 * np.pi * hz * np.arange(len(y)) / target)
        assert len(y) == target and np.abs(y - want)[400:-400].max() < 2e-3
    if source > target:
        for hz in (1.01 * limit, 1.3 * limit, 0.98 * source / 2):
            assert _db(resampled(np.sin(2 * np.pi * hz * t), source, target)[400:-400]) < -60 - 3
    assert np.abs(resampled(np.ones(source), source, target)[400:-400] - 1).max() < 1e-6


def test_resampling_in_blocks_is_that_of_the_whole():
    rng = np.random.default_rng(0)
    for source, target in ((48_000, 16_000), (11_025, 16_000), (7, 3), (12_345, 16_001)):
        x = rng.normal(0, 1, 3001)
        whole = resampled(x, source, target)
        assert len(whole) == int(3001 * target / source + 0.5)
        for block in (1, 97, 3000):
            assert np.array_equal(resampled(x, source, target, block), whole)
        r = Resampler(source, target)
        for k in range(0, 3001, 100):
            r.feed(x[k : k + 100])
            assert len(r.held) <= 2 * r.half + 100 + r.down // r.up + 1


def test_resampling_short_and_odd_signals():
    assert len(resampled(np.zeros(0), 48_000)) == 0 and len(resampled(np.ones(1), 48_000)) == 1 and len(resampled(np.ones(2), 8_000)) == 4
    with pytest.raises(ValueError):
        resampled(np.ones(4), 0)


def test_samples_go_back_in_parts():
    import pandas as pd

    rows = (pd.Series([np.ones(n) if n else None for n in [0, 5, 7, 0, 3, 20, 1]]), pd.Series([2] * 7))
    got = list(audio.in_parts(iter([rows, rows]), lambda s, k: np.repeat(s, k), 20))
    assert [[None if x is None else len(x) for x in part] for part in got] == 2 * [[None, 10, 14], [None, 6, 40], [2]]


def test_a_batch_of_recordings_is_prepared_in_parts(spark, monkeypatch):
    df = spark.range(60).coalesce(1).selectExpr("id", "if(id % 7 = 3, null, transform(sequence(1, 40000 + cast(id as int)), x -> cast(x % 9000 as smallint))) as samples", "500 as rate", "1 as channels")
    got = df.select("id", audio.prepare_for_stt("samples", "rate", "channels").alias("x")).selectExpr("id", "size(x) as n").collect()
    assert {r["id"]: r["n"] for r in got} == {i: None if i % 7 == 3 else (40000 + i) * 32 for i in range(60)}
