"""python -m utterscope: report, review and collection of a dataset folder."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession

from utterscope.operators.collect import collection_summary, prompt_evaluation
from utterscope.operators.evaluate import replayed
from utterscope.operators.review import review_queue
from utterscope.plans.report import dataset_report
from utterscope.sources.jsonl import PLACE, read_events, read_labels, read_plan


def session() -> SparkSession:
    return SparkSession.builder.appName("utterscope").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def print_rows(rows: DataFrame, limit: int | None) -> None:
    """Rows as tab-separated lines, streamed; with a limit, how many are left out."""
    print("\t".join(rows.columns))
    for row in (rows if limit is None else rows.limit(limit)).toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))
    left = 0 if limit is None else rows.count() - limit
    if left > 0:
        print(f"(and {left} more)")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="utterscope")
    parser.add_argument("--producer-version", default="app_version", help="name of the producer's version field in provenance")
    commands = parser.add_subparsers(dest="command", required=True)
    report = commands.add_parser("report", help="print the report of an event log")
    report.add_argument("events", nargs="?", default="data/events.jsonl")
    review = commands.add_parser("review", help="show the events without a label")
    review.add_argument("root", nargs="?", default="data")
    collect = commands.add_parser("collect", help="check a plan and show how far its collection has come")
    collect.add_argument("plan")
    collect.add_argument("root", nargs="?", default="data")
    for command in (report, review, collect):
        command.add_argument("--limit", type=int, default=None, help="rows that a list shows at most; all without it")
    given = parser.parse_args(arguments)
    spark = session()
    if given.command == "report":
        labels = os.path.join(os.path.dirname(given.events) or ".", "labels.jsonl")
        for line in dataset_report(spark, given.events, labels, given.producer_version, given.limit):
            print(line)
    elif given.command == "review":
        events = read_events(spark, os.path.join(given.root, "events.jsonl"), given.producer_version)
        queue = review_queue(events, read_labels(spark, os.path.join(given.root, "labels.jsonl")))
        rows = queue.orderBy(*PLACE).select("id", "shown_transcript", "shown_predicted", "shown_current", "execution_result.status", "default_speech")
        print_rows(rows, given.limit) if rows.head(1) else print("No unlabeled events.")
    else:
        plan = read_plan(spark, given.plan)
        events = read_events(spark, os.path.join(given.root, "events.jsonl"), given.producer_version)
        collection_summary(plan, events).show()
        print_rows(prompt_evaluation(replayed(events)).orderBy("prompt_id"), given.limit)


if __name__ == "__main__":
    main()
