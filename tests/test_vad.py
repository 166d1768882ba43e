import numpy as np
import pytest

from utterscope.operators.vad import Detector, VadConfig, detect, first_loud_run, followed, segments
from utterscope.operators.vad_chunks import detect_long
from utterscope.streaming.vad_stream import append_stream, detect_stream

SMALL = dict(calibration_windows=3, speech_start_windows=2, speech_end_windows=2, max_wait_windows=4, max_speech_windows=5, start_margin_db=12, end_margin_db=6, minimum_start_level_dbfs=-100, minimum_end_level_dbfs=-110, noise_ema_alpha=0.0)
QUIET = [-51, -50, -49]


def run(levels, **changes):
    """Events of levels; window i ends at frame i + 1."""
    n = np.arange(len(levels))
    return Detector(VadConfig(**{**SMALL, **changes})).feed(n, np.array(levels, np.float32), n + 1)


def names(events):
    return [(e["event"], e["at_frame"]) for e in events]


def test_start():
    got = run([*QUIET, -30, -29])
    assert names(got) == [("calibrated", 3), ("speech_started", 5)] and got[0]["noise_floor_dbfs"] == -50


def test_hysteresis():
    assert names(run([*QUIET, -30, -30, -48, -30, -48, -48]))[1:] == [("speech_started", 5), ("speech_ended", 9)]


def test_timeout():
    assert names(run([*QUIET, -50, -50, -50, -50]))[1:] == [("timed_out", 7)]


def test_too_long():
    got = run([*QUIET, -30, -30, -30, -30, -30, -30, -30])
    assert names(got)[-1] == ("speech_ended", 10) and got[-1]["end_reason"] == "maximum_duration"


def test_digital_silence_does_not_calibrate():
    assert run([-240, -240, -50])[0]["noise_floor_dbfs"] == -50
    assert run([-240, -240, -240])[0]["noise_floor_dbfs"] == -90


def test_absolute_limits():
    got = run([-90, -90, -90, -40, -40, -30, -30, -42, -42], minimum_start_level_dbfs=-35, minimum_end_level_dbfs=-40, max_wait_windows=9)
    assert names(got)[1:] == [("speech_started", 7), ("speech_ended", 9)]


def test_metrics():
    end = run([*QUIET, -30, -30, -28, -48, -48])[-1]
    assert end["peak_dbfs"] == -28 and end["mean_speech_dbfs"] == pytest.approx(-29.3333, abs=1e-4) and end["median_speech_dbfs"] == -30
    assert (end["speech_windows"], end["silence_windows"], end["trailing_silence_windows"], end["detected_windows"]) == (3, 2, 2, 5)


def test_floor_stays_for_the_next_utterance():
    got = run([*QUIET, -30, -30, -48, -48, -30, -30])
    assert names(got) == [("calibrated", 3), ("speech_started", 5), ("speech_ended", 7), ("speech_started", 9)] and got[-1]["utterance"] == 1


def test_floor_follows_quiet_levels():
    assert followed(-50.0, np.array([-60, -240], np.float32), np.float32(0.5)) == -55
    start, floor = first_loud_run(np.array([-60, -240, -30, -30], np.float32), -50.0, VadConfig(**{**SMALL, "noise_ema_alpha": 0.5}))
    assert (start, floor) == (2, -55)


def plain_events(levels, c):
    """Every window on its own: what the windows of its phase and the noise floor say."""
    floor, since, utterance, out = None, [], 0, []
    for i, x in enumerate(np.array(levels, np.float32)):
        since.append(x)
        if floor is None:
            if len(since) == c.calibration_windows:
                heard = [v for v in since if v > -120]
                floor, since = np.float32(np.median(heard) if heard else -90), []
                out.append((utterance, "calibrated", i))
                speaking = 0
            continue
        if not speaking:
            loud = x >= c.start_limit(floor)
            if not loud and x > -120:
                alpha = np.float32(c.noise_ema_alpha)
                floor = (np.float32(1) - alpha) * floor + alpha * x
            run = run + 1 if loud and len(since) > 1 else int(loud)
            if run == c.speech_start_windows:
                speaking, since = 1, []
                out.append((utterance, "speech_started", i))
            elif len(since) == c.max_wait_windows:
                out.append((utterance, "timed_out", i))
                utterance, since = utterance + 1, []
            continue
        quiet = [v < c.end_limit(floor) for v in since[-c.speech_end_windows :]]
        if len(quiet) == c.speech_end_windows and all(quiet) or len(since) == c.max_speech_windows:
            out.append((utterance, "speech_ended", i))
            utterance, since, speaking = utterance + 1, [], 0
    return out


@pytest.mark.parametrize("seed", range(30))
def test_any_split_gives_the_events_of_single_windows(seed):
    rng = np.random.default_rng(seed)
    c = VadConfig(*(int(rng.integers(1, k)) for k in (8, 4, 6, 60, 40)), 12, 6, float(rng.choice([-35, -50, -100])), -110, float(rng.random() * 0.3))
    n = 800
    levels = (np.where(np.repeat(rng.random(n) < 0.4, 3)[:n], -30, -55) + rng.normal(0, 8, n)).astype(np.float32)
    levels[rng.random(n) < 0.05] = -240
    cuts, d, got = sorted(rng.integers(0, n + 1, 12).tolist()), Detector(c), []
    for a, b in zip([0, *cuts], [*cuts, n]):
        got += d.feed(np.arange(a, b), levels[a:b], np.arange(a, b))
    assert [(e["utterance"], e["event"], e["window_idx"]) for e in got] == plain_events(levels, c) and len(d.levels) <= 100


@pytest.mark.parametrize("bad", [{"calibration_windows": 0}, {"noise_ema_alpha": 2}, {"start_margin_db": 6}, {"minimum_start_level_dbfs": -110}])
def test_config_is_checked(bad):
    with pytest.raises(ValueError):
        VadConfig(**{**SMALL, **bad})


def _levels(n=300, sessions=5):
    rng = np.random.default_rng(5)
    return [(f"s{s}", i, float(np.float32(x)), (i + 1) * 10) for s in range(sessions) for i, x in enumerate(np.where(rng.random(n).cumsum() % 9 < 4, -20, -55) + rng.normal(0, 4, n))]


def test_batch_and_stream_agree_with_the_fold(spark, tmp_path):
    config = VadConfig(**{**SMALL, "noise_ema_alpha": 0.1, "minimum_start_level_dbfs": -70, "minimum_end_level_dbfs": -80})
    rows = _levels()
    df = spark.createDataFrame(rows, "session string, window_idx bigint, dbfs float, end_frame bigint")
    key = lambda e: (e["session"], e["window_idx"], e["event"], e["at_frame"], e["end_reason"], e["mean_speech_dbfs"])
    batch = sorted((key(r) for r in detect(df, "session", config).collect()), key=str)
    want = []
    for s in {r[0] for r in rows}:
        for e in Detector(config).feed(*(np.array(c) for c in zip(*(r[1:] for r in rows if r[0] == s)))):
            want.append((s, e["window_idx"], e["event"], e["at_frame"], e.get("end_reason"), None if e.get("mean_speech_dbfs") is None else float(np.float32(e["mean_speech_dbfs"]))))
    assert batch == sorted(want, key=str) and len(batch) > 50

    for part in range(3):  # three files, one a micro-batch
        df.where(f"window_idx >= {part * 100} and window_idx < {part * 100 + 100}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    append_stream(detect_stream(stream, config), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted((key(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    assert got == batch


def test_segments_have_a_pre_roll(spark):
    rows = [("s", i, float(x), (i + 1) * 10) for i, x in enumerate([*QUIET, -30, -30, -48, -48])]
    df = spark.createDataFrame(rows, "session string, window_idx bigint, dbfs float, end_frame bigint")
    row = segments(detect(df, "session", VadConfig(**SMALL)), 100).first()
    assert (row["start_frame"], row["end_frame"]) == (20, 70)


def test_no_windows(spark):
    df = spark.createDataFrame([], "session string, window_idx bigint, dbfs float, end_frame bigint")
    assert detect(df).count() == 0


@pytest.mark.parametrize("chunk", [90, 5000])
def test_chunks_in_parallel_give_the_events_of_the_fold(spark, chunk):
    config = VadConfig(**{**SMALL, "noise_ema_alpha": 0.1, "minimum_start_level_dbfs": -70, "minimum_end_level_dbfs": -80})
    rows = [r for r in _levels(400, 3) if not (r[0] == "s1" and 100 <= r[1] < 170)]  # whole chunks are missing
    df = spark.createDataFrame(rows, "session string, window_idx bigint, dbfs float, end_frame bigint")
    text = lambda found: sorted(map(str, found.select(sorted(found.columns)).collect()))
    want = text(detect(df, "session", config))
    assert text(detect_long(df, "session", config, chunk)) == want and len(want) > 50
    assert detect_long(df.limit(0), "session", config, chunk).count() == 0


def test_rounds_of_short_chunks_are_few(spark, monkeypatch):
    from utterscope.operators import vad_chunks

    config = VadConfig(**{**SMALL, "minimum_start_level_dbfs": -70, "minimum_end_level_dbfs": -80})
    df = spark.createDataFrame(_levels(600, 5), "session string, window_idx bigint, dbfs float, end_frame bigint")
    text = lambda found: sorted(map(str, found.select(sorted(found.columns)).collect()))
    want, paths = text(detect(df, "session", config)), []
    made = vad_chunks.new_path
    monkeypatch.setattr(vad_chunks, "new_path", lambda spark, name: paths.append(name) or made(spark, name))
    assert text(detect_long(df, "session", config, 10)) == want and len(want) > 50
    assert paths.count("wrong") <= 7  # of 60 chunks, that no state is guessed in
