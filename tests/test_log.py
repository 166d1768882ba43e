"""Appending logs: order, whole appends, tokens, writers at the same time."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from utterscope.sources.jsonl import append_labels, latest_labels, numbered_lines, read_labels
from utterscope.sources.log import append_line_stream, append_lines


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1)


def labels(spark, *intents):
    rows = [(1, "a", "2024", True, None, i, None) for i in intents]
    return spark.createDataFrame(rows, "schema_version smallint, event_id string, labeled_at string, actual_speech boolean, corrected_transcript string, correct_intent string, notes string")


def read(spark, path):
    rows = numbered_lines(spark, path).orderBy("file", "line_no").collect()
    return [r["value"] for r in rows]


@pytest.mark.parametrize("n", range(4))
def test_the_last_of_many_appends_wins(spark, tmp_path, n):
    path = str(tmp_path / "labels")
    for intent in ("unknown", "no_speech", f"tell_time {n}"):
        append_labels(labels(spark, intent), path)
    assert [r["correct_intent"] for r in latest_labels(read_labels(spark, path)).collect()] == [f"tell_time {n}"]
    assert read_labels(spark, path).count() == 3


def test_rows_keep_their_order_in_and_over_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    many = spark.range(0, 40, numPartitions=5).select(F.format_string("%05d", "id").alias("value"))
    assert [append_lines(many, path), append_lines(lines(spark, "b", "a"), path), append_lines(many, path)] == [1, 2, 3]
    own = [f"{i:05d}" for i in range(40)]
    assert read(spark, path) == [*own, "b", "a", *own]


def test_more_appends_than_nine(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in range(11):
        append_lines(lines(spark, str(i)), path)
    assert read(spark, path) == [str(i) for i in range(11)]


def test_what_was_not_committed_is_not_read(spark, tmp_path):
    path = tmp_path / "log"
    append_lines(lines(spark, "a"), str(path))
    (path / "_new-dead").mkdir()
    (path / "_new-dead" / "part-00000-x.txt").write_text("lost\n")
    append_lines(lines(spark, "b"), str(path))
    assert read(spark, str(path)) == ["a", "b"]


def test_a_token_appends_once(spark, tmp_path):
    path = str(tmp_path / "log")
    assert append_lines(lines(spark, "a"), path, "t-1") == 1 and append_lines(lines(spark, "a"), path, "t-1") is None
    assert append_lines(lines(spark, "a"), path, "t-2") == 2 and read(spark, path) == ["a", "a"]


def test_writers_at_the_same_time_get_numbers_of_their_own(spark, tmp_path):
    path, numbers = str(tmp_path / "log"), []
    threads = [threading.Thread(target=lambda i=i: numbers.append((append_lines(lines(spark, str(i)), path), str(i)))) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(n for n, _ in numbers) == list(range(1, 7)) and read(spark, path) == [text for _, text in sorted(numbers)]


def test_a_stream_appends_its_batches_once(spark, tmp_path):
    source, path, checkpoint = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "checkpoint")
    for i in range(3):
        lines(spark, f"{i}a", f"{i}b").write.mode("append").parquet(str(source))
    stream = lambda: spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).parquet(str(source))
    append_line_stream(stream(), path, checkpoint, "s").awaitTermination()
    want = ["0a", "0b", "1a", "1b", "2a", "2b"]
    assert read(spark, path) == want
    (tmp_path / "checkpoint" / "commits" / "2").unlink()  # as if the driver had died before it noted the last batch
    for crc in (tmp_path / "checkpoint" / "commits").glob(".2*"):
        crc.unlink()
    append_line_stream(stream(), path, checkpoint, "s").awaitTermination()
    assert read(spark, path) == want


def test_plain_files_and_folders_are_read_as_before(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text(json.dumps({"a": 1}) + "\n\n2\n")
    assert read(spark, str(tmp_path / "x.jsonl")) == ['{"a": 1}', "", "2"] == read(spark, str(tmp_path))
