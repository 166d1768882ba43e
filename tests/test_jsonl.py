import json

import pytest

from utterscope.functions.spoken import rate_text
from utterscope.operators import collect, evaluate, process, review
from utterscope.plans import adapter
from utterscope.plans.report import dataset_report
from utterscope.schema import event_schema
from utterscope.sources.jsonl import InvalidLog, InvalidPlan, append_events, append_labels, latest_labels, numbered_lines, read_events, read_labels, read_plan

EVENT = {"schema_version": 1, "id": "a", "timestamp": "2024-01-01T00:00:00Z", "input": {"device": "mic ", "sample_rate_hz": 16000, "channels": 1}, "execution_result": {"status": "succeeded", "response": None, "error": None}}
LABEL = {"schema_version": 1, "event_id": "a", "labeled_at": "2024", "actual_speech": True, "corrected_transcript": "включи музыку", "correct_intent": "play_music", "notes": None}


def event(**changes):
    return json.dumps({**EVENT, **changes}, ensure_ascii=False)


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_lines_are_numbered_over_splits(spark, tmp_path):
    path = write(tmp_path / "x.jsonl", *[f"{i:05d}" for i in range(1, 3001)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = numbered_lines(spark, path)
        assert rows.rdd.getNumPartitions() > 3
        assert all(int(r["value"]) == r["line_no"] for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_old_and_new_records(spark, tmp_path):
    path = write(tmp_path / "e.jsonl", event(), "", "  ", event(id="b", collection={"source": "prompted", "campaign": "c", "prompt_id": "p", "expected_transcript": "t", "expected_intent": "unknown"}, extra=1, vad={"speech_windows": 7}))
    rows = {r["id"]: r for r in read_events(spark, path).collect()}
    assert rows["a"]["line_no"] == 1 and rows["b"]["line_no"] == 4 and rows["a"]["collection"] is None and rows["b"]["vad"]["speech_windows"] == 7


@pytest.mark.parametrize(
    "bad",
    ["{}", "not json", event(execution_result={"status": "lost"}), event(id=None), event(input={"device": "m", "channels": 1}), event(collection={"source": "other"}), event(ground_truth=None), event(vad={"speech_windows": -1}), event(prediction={"slots": {}})],
)
def test_first_bad_line_is_named(spark, tmp_path, bad):
    path = write(tmp_path / "e.jsonl", event(), "", bad, "also not json")
    with pytest.raises(InvalidLog, match="line 3 "):
        read_events(spark, path)


def test_labels(spark, tmp_path):
    assert read_labels(spark, str(tmp_path / "none.jsonl")).count() == 0
    path = write(tmp_path / "l.jsonl", json.dumps(LABEL), json.dumps({**LABEL, "correct_intent": "unknown", "labeled_at": "1999"}), json.dumps({**LABEL, "event_id": "b"}))
    got = {r["event_id"]: r["correct_intent"] for r in latest_labels(read_labels(spark, path)).collect()}
    assert got == {"a": "unknown", "b": "play_music"}
    with pytest.raises(InvalidLog, match="line 1 "):
        read_labels(spark, write(tmp_path / "bad.jsonl", json.dumps({"event_id": "a"})))


def test_append_round_trip_and_null_rules(spark, tmp_path):
    events = adapter.events(spark, "/root/testdata/sf0.001").drop("line_no", "moment")
    append_events(events.where("id < 'evt-00000100'"), str(tmp_path / "log"))
    append_events(events.where("id >= 'evt-00000100'"), str(tmp_path / "log"))
    back = read_events(spark, str(tmp_path / "log")).select(*event_schema().fieldNames())
    want = events.selectExpr(*[c if c in events.columns else f"null as {c}" for c in back.columns])
    text = lambda df: sorted(str(r) for r in df.collect())
    assert text(back) == text(spark.createDataFrame(want.rdd, back.schema))
    line = json.loads(numbered_lines(spark, str(tmp_path / "log")).select("value").where("value like '%evt-00000000%'").first()[0])
    assert "provenance" not in line and "collection" not in line and line["processing_error"] is None
    labels = adapter.labels(spark, "/root/testdata/sf0.001").drop("label_seq")
    append_labels(labels, str(tmp_path / "labels"))
    assert read_labels(spark, str(tmp_path / "labels")).count() == labels.count()


PLAN = {"schema_version": 1, "campaign": "c", "prompts": [{"id": "p1", "transcript": "который час", "intent": "tell_time"}, {"id": "p2", "transcript": "да", "intent": "unknown"}]}


def test_plan(spark, tmp_path):
    path = write(tmp_path / "p.json", json.dumps(PLAN, indent=1))
    assert [(r["prompt_id"], r["intent"]) for r in read_plan(spark, path).orderBy("place").collect()] == [("p1", "tell_time"), ("p2", "unknown")]


@pytest.mark.parametrize(
    "change, why",
    [
        ({"schema_version": 2}, "schema 2"), ({"campaign": " "}, "campaign"), ({"prompts": []}, "at least one"),
        ({"prompts": [{"id": "", "transcript": "a", "intent": "no_speech"}]}, "must not be empty"), ({"prompts": [{"id": "a", "transcript": "a", "intent": "no_speech"}]}, "unsupported expected intent 'no_speech'"),
        ({"prompts": [{"id": "a", "transcript": "a", "intent": "unknown"}] * 2}, "duplicate collection prompt ID 'a'"),
    ],
)
def test_plan_rules(spark, tmp_path, change, why):
    with pytest.raises(InvalidPlan, match=why):
        read_plan(spark, write(tmp_path / "p.json", json.dumps({**PLAN, **change})))


def test_prompts_and_review(spark, tmp_path):
    plan = read_plan(spark, write(tmp_path / "p.json", json.dumps(PLAN)))
    events = read_events(spark, write(tmp_path / "e.jsonl", event(id="x", transcript="который час", prediction={"intent": "unknown", "slots": {}}), event(id="y"), event(id="z", transcript="[шум]", prediction={"intent": "no_speech", "slots": {}})))
    prompted = collect.with_prompt(events.selectExpr("*", "if(id = 'x', 'p1', null) as prompt_id"), plan)
    labels = collect.prompt_labels(prompted)
    assert [(r["event_id"], r["actual_speech"], r["correct_intent"]) for r in labels.collect()] == [("x", True, "tell_time")]
    assert collect.prompt_evaluation(evaluate.replayed(prompted)).first().asDict() == {"prompt_id": "p1", "expected": "tell_time", "events": 1, "historical_correct": 0, "current_correct": 1}
    skipped = spark.createDataFrame([("p2",)], "prompt_id string")
    assert tuple(collect.collection_summary(plan, prompted, skipped).first()) == (1, 1, 0)
    queue = review.review_queue(events, labels)
    assert {r["id"]: (r["default_speech"], r["shown_current"]) for r in queue.collect()} == {"y": (False, None), "z": (False, None)}
    decisions = spark.createDataFrame([("y", "save", True, "слово", None, ""), ("z", "skip", None, None, None, None)], "event_id string, action string, actual_speech boolean, corrected_transcript string, correct_intent string, notes string")
    made = review.apply_decisions(queue, decisions).collect()
    assert [(r["event_id"], r["corrected_transcript"], r["correct_intent"], r["notes"]) for r in made] == [("y", "слово", "unknown", None)]
    assert tuple(review.review_summary(queue, decisions).first()) == (1, 1, 1)


def test_timers_and_model(spark):
    row = "'t' as id, '2024-01-01T00:00:00Z' as timestamp, named_struct('intent', 'set_timer', 'slots', map('duration_seconds', '90')) as prediction, named_struct('status', 'succeeded') as execution_result"
    got = process.timers(spark.sql(f"select {row}")).selectExpr("event_id", "duration_seconds", "cast(fire_at as string)").first()
    assert tuple(got) == ("t", 90, "2024-01-01 00:01:30")
    heard = process.transcribe(spark.sql("select 'a' as id, array(1.0f, 2.0f) as samples"), lambda s: f" {len(s)} words ")
    assert heard.first()["transcript"] == "2 words"


def load_noting():
    import os
    import tempfile

    with open(f"{tempfile.gettempdir()}/loads-of-{os.environ['USER_OF_LOADS']}", "a") as f:
        f.write(f"{os.getpid()}\n")
    return lambda samples: "said"


def test_a_model_is_loaded_once_by_a_process(tmp_path, monkeypatch):
    import tempfile

    monkeypatch.setenv("USER_OF_LOADS", "test")
    monkeypatch.setattr(tempfile, "tempdir", str(tmp_path))
    assert {process.loaded(load_noting)(None) for _ in range(3)} == {"said"}
    assert len((tmp_path / "loads-of-test").read_text().split()) == 1


def test_transcripts_need_one_model_and_samples(spark):
    rows = spark.sql("select 'a' as id, cast(null as array<float>) as samples")
    assert process.transcribe(rows, lambda s: "x").first()["transcript"] is None
    with pytest.raises(ValueError):
        process.transcribe(rows)


def test_report(spark, tmp_path):
    events = write(tmp_path / "events.jsonl", event(transcript="включи музыку", prediction={"intent": "unknown", "slots": {}}, audio_path="a.wav", vad={"speech_windows": 10, "duration_ms": 200, "noise_floor_dbfs": -50.25, "end_reason": "silence"}), event(id="b", transcript="[шум]", vad={"speech_windows": 2}), event(id="c", execution_result={"status": "rejected"}))
    labels = write(tmp_path / "labels.jsonl", json.dumps({**LABEL, "corrected_transcript": "включи эту музыку"}), json.dumps({**LABEL, "event_id": "b", "actual_speech": False, "correct_intent": "no_speech", "corrected_transcript": None}))
    text = "\n".join(dataset_report(spark, events, labels))
    for line in (
        "Events: 3", "Short rejections: 1", "Changed predictions: 1", "Labeled pipeline evaluation: 2 / 3", "  Negative samples (non-speech or unsupported speech): 1",
        "  Aggregate WER: 33.3%", "  Correct: 0 / 1 (0.0%)", "  Correct: 1 / 1 (100.0%)", "    play_music -> unknown: 1", "    a: play_music -> unknown | \"включи музыку\"", "  Candidates: 200 ms (configuration unchanged)",
        "  unknown -> play_music: 1", "  mic: 3", "  noise floor: -50.2 dBFS / -50.2 dBFS / -50.2 dBFS / -50.2 dBFS", "  end threshold: no data", "    (none)",
    ):
        assert line in text.split("\n"), line
    empty = "\n".join(dataset_report(spark, write(tmp_path / "none.jsonl", ""), str(tmp_path / "no-labels")))
    assert "Events: 0" in empty and "Candidates: no labeled VAD data" in empty and "  (no data)" in empty and "  Aggregate WER: n/a" in empty


def test_rate_text():
    assert [rate_text(x) for x in (None, 0.0, 1.0, 1 / 3)] == ["n/a", "0.0%", "100.0%", "33.3%"]


def test_report_shows_every_case_once(spark, tmp_path):
    one = event(id="same", transcript="включи музыку", prediction={"intent": "unknown", "slots": {}})
    events = write(tmp_path / "events.jsonl", *[one] * 3)
    labels = write(tmp_path / "labels.jsonl", json.dumps({**LABEL, "event_id": "same", "corrected_transcript": "включи музыку"}))
    case = "    same: play_music -> unknown | \"включи музыку\""
    assert list(dataset_report(spark, events, labels)).count(case) == 3
    short = list(dataset_report(spark, events, labels, max_cases=2))
    assert short.count(case) == 2 and "    (and 1 more)" in short
