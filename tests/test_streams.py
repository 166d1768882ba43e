"""Stateful streams against plain loops: any split into batches, restarts, state that ends with its session."""

import json
import random
import struct
import time

import numpy as np
import pytest

from utterscope.operators.levels import levels_of_recordings, window_levels
from utterscope.operators.vad import Detector, VadConfig
from utterscope.sources import recordings, wav
from utterscope.streaming.capture import capture_stream
from utterscope.streaming.level_stream import levels_stream
from utterscope.streaming.timers import elapsed_stream
from utterscope.streaming.vad_stream import append_stream, detect_stream

CONFIG = VadConfig(5, 2, 4, 30, 40, 12.0, 6.0, -35.0, -40.0, 0.02)


@pytest.fixture(autouse=True)
def one_partition(spark):
    """State has a partition; more only make more workers."""
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", kept)


class Stream:
    """A table that grows by batches, a query over it and the table that the query appends to."""

    def __init__(self, spark, folder, schema, make):
        self.spark, self.folder, self.schema, self.make = spark, folder, schema, make

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def run(self):
        """What is there is taken in, a file a micro-batch; a new query each time, so each goes on from the checkpoint."""
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        made = self.make(stream)
        query = append_stream(made, f"{self.folder}/out", f"{self.folder}/checkpoint")
        query.awaitTermination()
        self.out = made.schema
        return query

    def rows(self):
        return self.spark.read.schema(self.out).parquet(f"{self.folder}/out").collect()


def state_rows(query):
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


# --- the detector

LEVELS = "session string, window_idx bigint, dbfs float, end_frame bigint, session_ended boolean"


def session_levels(seed, n=300):
    rng = np.random.default_rng(seed)
    loud = np.repeat(rng.random(n // 10) < 0.4, 10)
    return (np.where(loud, -20, -60) + rng.normal(0, 4, n)).astype(np.float32)


def detector_rows(levels):
    n = np.arange(len(levels))
    return [(e["utterance"], e["event"], e["window_idx"]) for e in Detector(CONFIG).feed(n, levels, (n + 1) * 10)]


def test_a_detector_goes_on_after_restarts_and_ends_with_its_session(spark, tmp_path):
    s = Stream(spark, tmp_path, LEVELS, lambda x: detect_stream(x, CONFIG))
    levels = {k: session_levels(i) for i, k in enumerate("abc")}
    row = lambda k, i, end=False: (k, i, float(levels[k][i]), (i + 1) * 10, end)
    s.put([row(k, i) for k in levels for i in range(110)])
    first = s.run()
    s.put([row(k, i) for k in levels for i in range(100, 200)])  # ten windows again
    s.run()
    s.put([row(k, i, k != "c" and i == 299) for k in levels for i in range(200, 300)])
    last = s.run()
    got = sorted((r["session"], r["utterance"], r["event"], r["window_idx"]) for r in s.rows())
    assert got == sorted((k, *e) for k in levels for e in detector_rows(levels[k])) and len(got) > 20
    assert 0 < state_rows(last) < state_rows(first)
    s.put([("c", 300, None, None, True)])
    assert state_rows(s.run()) == 0 and len(s.rows()) == len(got)
    s.put([row("a", i) for i in range(6)])  # a new session of the same name
    s.run()
    assert ("a", 0, "calibrated", 4) in [(r["session"], r["utterance"], r["event"], r["window_idx"]) for r in s.rows()][-1:] or len(s.rows()) == len(got) + 1


def until(condition, seconds=40):
    for _ in range(seconds * 4):
        if condition():
            return True
        time.sleep(0.25)
    return False


def test_silent_sessions_are_forgotten(spark, tmp_path):
    s = Stream(spark, tmp_path, LEVELS, lambda x: detect_stream(x, CONFIG, idle_ms=4000))
    s.put([(k, i, -60.0, i, False) for k in "abcdefgh" for i in range(3)])
    stream = spark.readStream.schema(s.schema).parquet(f"{tmp_path}/in")
    query = append_stream(s.make(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint", processingTime="1 second")
    try:
        rows = lambda: [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        assert until(lambda: max(rows(), default=0) > 0)
        many = max(rows())
        assert until(lambda: rows()[-1] < many / 2)
    finally:
        query.stop()


def test_state_takes_on_new_fields(spark, tmp_path):
    from utterscope.streaming.vad_stream import VadProcessor

    s = Stream(spark, tmp_path, LEVELS, lambda x: detect_stream(x, CONFIG))
    levels = session_levels(7)
    s.put([("a", i, float(levels[i]), (i + 1) * 10, False) for i in range(150)])
    s.run()
    s.put([("a", i, float(levels[i]), (i + 1) * 10, False) for i in range(150, 300)])
    old = VadProcessor.HEAD
    VadProcessor.HEAD = old + ", note string"
    unwidened = VadProcessor._detector

    def detector(self):
        head = self.head
        self.head = type("Head", (), {"get": lambda _: head.get()[:4] if head.exists() else None})()
        try:
            return unwidened(self)
        finally:
            self.head = type("Wide", (), {"get": lambda _: head.get(), "clear": lambda _: head.clear(), "update": lambda _, v: head.update((*v, "new"))})()

    VadProcessor._detector = detector
    try:
        s.run()
    finally:
        VadProcessor.HEAD, VadProcessor._detector = old, unwidened
    assert sorted((r["utterance"], r["event"], r["window_idx"]) for r in s.rows()) == sorted(detector_rows(levels))


# --- levels

CHUNKS = "session string, start_frame bigint, samples array<smallint>, sample_rate_hz int, channels int"


@pytest.mark.parametrize("channels", [1, 3])
def test_any_split_gives_the_levels_of_the_whole(spark, tmp_path, channels):
    rng = random.Random(channels)
    samples = np.random.default_rng(channels).integers(-32768, 32768, 997 * channels).astype(np.int16)
    cuts = sorted({0, *rng.sample(range(1, 997), 40)})
    chunks = [("a", a, samples[a * channels : b * channels].tolist(), 1000, channels) for a, b in zip(cuts, [*cuts[1:], 997])]
    s = Stream(spark, tmp_path, CHUNKS, levels_stream)
    for k in range(0, len(chunks), 21):
        s.put(chunks[max(0, k - 2) : k + 21])  # two chunks again
    s.run()
    got = sorted((r["window_idx"], r["rms"], r["end_frame"]) for r in s.rows())
    assert got == [(i, float(x), (i + 1) * 20) for i, x in enumerate(window_levels(samples, channels, 20))]
    whole = spark.createDataFrame([("a", samples.tolist(), 1000, channels)], "session string, samples array<smallint>, sample_rate_hz int, channels int")
    want = {(r["window_idx"], r["rms"], r["dbfs"]) for r in levels_of_recordings(whole, ("session",)).collect()}
    assert {(r["window_idx"], r["rms"], r["dbfs"]) for r in s.rows()} == want


def test_windows_that_lack_frames_are_left_out(spark, tmp_path):
    s = Stream(spark, tmp_path, CHUNKS, levels_stream)
    ones = lambda a, b: ("a", a, [1000] * (b - a), 1000, 1)
    s.put([ones(0, 50), ("b", 30, [5] * 60, 1000, 1), ("c", 0, None, 1000, 1)])
    s.put([ones(70, 100), ones(95, 121)])  # 50 to 69 are missing; an overlap
    s.run()
    assert sorted((r["session"], r["window_idx"]) for r in s.rows()) == [("a", 0), ("a", 1), ("a", 4), ("a", 5), ("b", 2), ("b", 3)]


# --- captures

PLACES = "session string, place bigint, command string, samples array<smallint>"


def plain_captures(rows):
    began, held, out = None, [], []
    for place, command, samples in rows:
        if command == "begin":
            began, held = place, []
        elif command in ("pause", "cancel"):
            began = None
        elif command == "finish":
            out.append((place, began, None if began is None else held))
            began = None
        elif began is not None and command is None and samples is not None:
            held = held + samples
    return out


def test_captures_of_any_split(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for place in range(400):
        command = rng.choices([None, "begin", "pause", "cancel", "finish", "other"], [12, 2, 1, 1, 3, 1])[0]
        rows.append((place, command, [rng.randint(-9, 9) for _ in range(rng.randint(0, 4))] if command is None and rng.random() < 0.95 else None))
    s = Stream(spark, tmp_path, PLACES, capture_stream)
    cuts = [0, 3, 200, 400]
    for a, b in zip(cuts, cuts[1:]):
        s.put([("a", *r) for r in rows[max(0, a - 3) : b]])
    s.run()
    got = sorted((r["finished_at"], r["began_at"], r["samples"]) for r in s.rows())
    assert got == plain_captures(rows) and sum(x[1] is None for x in got) > 3 and len(got) > 30
    assert all(r["n_samples"] == (None if r["samples"] is None else len(r["samples"])) for r in s.rows())


# --- timers

TIMERS = "event_id string, duration_seconds bigint, fire_at timestamp, moment timestamp"


def test_timers_fire_once_and_after_a_restart(spark, tmp_path):
    s = Stream(spark, tmp_path, TIMERS, lambda x: elapsed_stream(x.withWatermark("moment", "0 seconds")))
    at = lambda t: spark.sql(f"select timestamp_seconds({t}) t").first()["t"]
    s.put([(k, 10, at(110 + i), at(100)) for i, k in enumerate("abc")] + [("late", 500, at(600), at(100)), ("a", 10, at(110), at(100))])
    assert state_rows(s.run()) > 0 and s.rows() == []
    s.put([("d", 5, at(116), at(111))])
    s.run()
    assert sorted(r["event_id"] for r in s.rows()) in (["a", "b"], ["a"])  # due up to 111
    s.put([("e", 5, at(305), at(300))])
    s.run()
    s.put([("f", 5, at(306), at(301))])
    last = s.run()
    got = sorted((r["event_id"], r["duration_seconds"]) for r in s.rows())
    assert got == [("a", 10), ("b", 10), ("c", 10), ("d", 5)] and state_rows(last) > 0
    assert {r["event_id"]: r["fire_at"] for r in s.rows()}["c"] == at(112)


def test_rows_without_a_timer_move_event_time(spark, tmp_path):
    s = Stream(spark, tmp_path, TIMERS, lambda x: elapsed_stream(x.withWatermark("moment", "0 seconds")))
    at = lambda t: spark.sql(f"select timestamp_seconds({t}) t").first()["t"]
    began, due = at(100), at(105)
    s.put([(f"t{i}", 5, due, began) for i in range(500)] + [("later", 90, at(190), began)])
    s.put([("none", None, None, at(150))])
    query = s.run()
    assert sorted(r["event_id"] for r in s.rows()) == sorted(f"t{i}" for i in range(500))
    assert query.lastProgress["stateOperators"][0]["operatorName"] != "transformWithStateInPandasExec"


# --- recordings in pieces


def riff(samples, rate=1000, channels=1, before=b"", data=None, kind=b"RIFF", bits=16):
    body = np.asarray(samples, "<i2").tobytes()
    chunks = before + b"fmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * 2 * channels, 2 * channels, bits)
    return kind + struct.pack("<I", 0) + b"WAVE" + chunks + b"data" + struct.pack("<I", len(body) if data is None else data) + body


def pieces_of(spark, path, **options):
    rows = recordings.read_pieces(spark, str(path), **options).orderBy("session", "start_frame").collect()
    return [(r["session"], r["start_frame"], r["samples"], r["session_ended"]) for r in rows]


@pytest.mark.parametrize("split", [9, 50, 1 << 20])
def test_pieces_are_the_recording(spark, tmp_path, split):
    samples = list(range(-50, 55))
    odd = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    (tmp_path / "a.wav").write_bytes(riff(samples))
    (tmp_path / "b.wav").write_bytes(riff(samples[:104], channels=2, before=odd))
    (tmp_path / "open.wav").write_bytes(riff(samples, data=0xFFFFFFFF))
    long = b"ds64" + struct.pack("<IQQQI", 28, 0, 60, 30, 0)
    (tmp_path / "rf64.wav").write_bytes(riff(samples, before=long, data=0xFFFFFFFF, kind=b"RF64"))
    (tmp_path / "empty.wav").write_bytes(riff([]))
    got = pieces_of(spark, tmp_path, pieceWindows=1, splitBytes=split)
    for name, want, width in (("a", samples, 1), ("b", samples[:104], 2), ("open", samples, 1), ("rf64", samples[:30], 1)):
        own = [p for p in got if p[0] == name]
        assert [x for p in own for x in p[2]] == want and [p[1] for p in own] == list(range(0, len(want) // width, 20))
        assert [p[3] for p in own] == [False] * (len(own) - 1) + [True]
    assert not [p for p in got if p[0] == "empty"]


@pytest.mark.parametrize("content", [b"RIFX", riff([1], bits=8), b"RIFF\0\0\0\0WAVE", b"RIFF\0\0\0\0WAVEdata\2\0\0\0ab"])
def test_what_is_no_recording_is_an_error(spark, tmp_path, content):
    (tmp_path / "x.wav").write_bytes(content.ljust(12, b"\0"))
    with pytest.raises(Exception, match="WAV|PCM|unpack"):
        pieces_of(spark, tmp_path)


def test_a_stream_of_frames_goes_on_after_a_restart(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(k, rng.integers(-9000, 9000, n).astype(np.int16).tolist(), 1000, 1) for k, n in (("a", 500), ("b", 333), ("c", 41))]
    df = spark.createDataFrame(rows, "id string, samples array<smallint>, sample_rate_hz int, channels int")
    wav.write_wavs(df, str(tmp_path)).count()
    options = {"maxFrames": 180, "pieceWindows": 3, "progress": str(tmp_path / "progress" / "at.json")}
    for _ in range(9):  # a run takes one step and ends; the next goes on
        stream = levels_stream(recordings.stream_pieces(spark, str(tmp_path / "audio"), **options))
        query = append_stream(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"] > 3 * 3] == []  # 180 frames in pieces of 60
        if json.loads((tmp_path / "progress" / "at.json").read_text())["frame"] >= 522:  # bytes of the longest file, halved
            break
    got = sorted((r["session"], r["window_idx"], r["rms"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((k, i, float(x)) for k, s, *_ in rows for i, x in enumerate(window_levels(np.array(s, np.int16), 1, 20)))


def test_short_files_share_tasks_and_are_listed_once(spark, tmp_path, monkeypatch):
    for k in range(300):
        (tmp_path / f"{k}.wav").write_bytes(riff([k] * 50))
    tasks = recordings.PieceReader({"path": str(tmp_path), "splitBytes": "64"}).partitions()
    assert len(tasks) <= 70
    covered = sorted((path, a, b) for t in tasks for path, _, a, b in t.ranges)
    assert [a for _, a, _ in covered] == [0 if k == 0 or covered[k - 1][0] != p else covered[k - 1][2] for k, (p, *_) in enumerate(covered)]
    assert sum(b - a for _, a, b in covered) == 300 * 144
    stream = recordings.PieceStream({"path": str(tmp_path)})
    assert len(stream.partitions({"frame": 0}, {"frame": 40})) <= 70
    monkeypatch.setattr(recordings, "_files", None)  # tasks don't list
    reader = recordings.PieceReader({"path": str(tmp_path), "splitBytes": "64", "pieceWindows": "1"})
    got = [r for t in tasks for batch in reader.read(t) for r in batch.to_pylist()]
    assert sorted((r["session"], r["start_frame"]) for r in got) == sorted((str(k), a) for k in range(300) for a in (0, 20, 40))


def test_a_long_file_is_dealt_by_its_splits():
    got = recordings.dealt([("a", 1 << 30), ("b", 100)], 64 << 20, 64)
    assert max(sum(b - a for _, _, a, b in own) for own in got) <= 65 << 20 and len(got) >= 16
