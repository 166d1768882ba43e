"""The JSONL logs: strict readers that keep line order, appending writers, and collection plans.

A row's place is (file, line_no): the line number within its file, counted over the file's splits, so the reader scales
with the file. Blank lines are skipped but counted. Labels of later lines win over earlier ones, and later files (by path)
over earlier ones; what append_events and append_labels add comes after all that they added to the log before
(utterscope.sources.log).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from utterscope import schema as S
from utterscope.functions.text import trimmed
from utterscope.sources.log import append_lines
from utterscope.sources.scratch import new_path

PLACE = ("file", "line_no")


class InvalidLog(ValueError):
    """A line that is not a valid record."""


def numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """value, file and line_no (from 1) of every line."""
    raw = spark.read.option("recursiveFileLookup", True).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        raw.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .drop("n")
    )
    return raw.join(splits, ["file", "block"]).select("value", "file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"))


def _missing(required: Sequence[str]) -> Column:
    bad = F.lit(False)
    for name in required:
        bad = bad | F.col(f"record.{name}").isNull()
    return bad


def _parsed(lines: DataFrame, schema: T.StructType, required: Sequence[str], wrong: Column) -> DataFrame:
    wide = T.StructType([*schema.fields, T.StructField("__corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}
    parsed = lines.where(trimmed(F.col("value")) != "").withColumn("record", F.from_json("value", wide, options))
    return parsed.withColumn("invalid", F.col("record").isNull() | F.col("record.__corrupt").isNotNull() | _missing(required) | F.coalesce(wrong, F.lit(False)))


def _split(parsed: DataFrame, names: Sequence[str], copy: str | None) -> tuple[DataFrame, DataFrame]:
    """Valid records and invalid lines; with `copy`, of the parsed log as it is stored there, so that it is parsed once."""
    if copy:
        parsed.select("record", *PLACE, "invalid", F.when(F.col("invalid"), F.col("value")).alias("value")).write.parquet(copy)
        parsed = parsed.sparkSession.read.parquet(copy)
    return parsed.where("not invalid").select(*[f"record.{n}" for n in names], *PLACE), parsed.where("invalid").select(*PLACE, "value")


def split_events(
    spark: SparkSession, path: str | Sequence[str], producer_version: str = "app_version", copy: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Valid events with their place, and the place and value of invalid lines."""
    wrong = (
        ~F.col("record.execution_result.status").isin(*S.STATUSES)
        | ~F.coalesce(F.col("record.collection.source"), F.lit("prompted")).isin(*S.COLLECTION_SOURCES)
        | (F.coalesce(F.least(F.col("record.vad.speech_windows"), F.col("record.vad.silence_windows"), F.col("record.vad.duration_ms"), F.col("record.vad.trailing_silence_ms")), F.lit(0)) < 0)
        | (F.col("record.collection").isNotNull() & F.col("record.collection.source").isNull())
        | (F.col("record.prediction").isNotNull() & F.col("record.prediction.intent").isNull())
        | F.col("value").rlike(r'"ground_truth"\s*:\s*null')
    )
    schema = S.event_schema(producer_version)
    return _split(_parsed(numbered_lines(spark, path), schema, S.EVENT_REQUIRED, wrong), schema.fieldNames(), copy)


def split_labels(spark: SparkSession, path: str | Sequence[str], copy: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid labels with their place, and invalid lines; a log that is not there is empty."""
    try:
        lines = numbered_lines(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], "value string, file string, line_no bigint")
    schema = S.label_schema()
    return _split(_parsed(lines, schema, S.LABEL_REQUIRED, F.lit(False)), schema.fieldNames(), copy)


def _raise_first(bad: DataFrame, what: str) -> None:
    first = bad.orderBy(*PLACE).first()
    if first:
        raise InvalidLog(f"invalid {what} on JSONL line {first['line_no']} of {first['file']}")


def read_events(spark: SparkSession, path: str | Sequence[str], producer_version: str = "app_version") -> DataFrame:
    """All events, or InvalidLog with the first bad line; the whole log is parsed and checked before this returns.

    What was parsed is stored in the shared folder, and the events are read from there.
    """
    good, bad = split_events(spark, path, producer_version, new_path(spark, "checked-events"))
    _raise_first(bad, "dataset record")
    return good


def read_labels(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    good, bad = split_labels(spark, path, new_path(spark, "checked-labels"))
    _raise_first(bad, "dataset label")
    return good


def latest_labels(labels: DataFrame, order: Sequence[str] = PLACE) -> DataFrame:
    """The last label of each event; rows stay where their event_id was shuffled to, so a join on it needs no new one."""
    rest = [c for c in labels.columns if c != "event_id"]
    last = labels.groupBy("event_id").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return last.select(*[c if c == "event_id" else F.col(f"row.{c}").alias(c) for c in labels.columns])


def _json_line(df: DataFrame, always: Sequence[str], optional: Sequence[str]) -> Column:
    """One JSON object: `always` fields with nulls written, `optional` ones left out where null; in schema order."""

    def field(name: str) -> Column:
        whole = F.to_json(F.struct(F.col(name)), {"ignoreNullFields": "false"})
        inner = F.substring(whole, F.lit(2), F.length(whole) - 2)
        return F.when(F.col(name).isNotNull(), inner) if name in optional else inner

    return F.concat(F.lit("{"), F.concat_ws(",", *[field(c) for c in df.columns if c in {*always, *optional}]), F.lit("}"))


def append_events(events: DataFrame, path: str, token: str | None = None) -> int | None:
    """Append as JSON lines in the order of the rows; provenance, collection and ground_truth are left out where null."""
    optional = ("provenance", "collection", "ground_truth")
    fields = S.event_schema().fields
    names = [f.name for f in fields]
    df = events.select(*[F.col(f.name) if f.name in events.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    return append_lines(df.select(_json_line(df, [n for n in names if n not in optional], optional).alias("value")), path, token)


def append_labels(labels: DataFrame, path: str, token: str | None = None) -> int | None:
    """Append as JSON lines in the order of the rows, after all that the log has."""
    df = labels.select(*S.label_schema().fieldNames())
    return append_lines(df.select(_json_line(df, df.columns, ()).alias("value")), path, token)


def to_parquet(df: DataFrame, path: str, mode: str = "append") -> None:
    """The analytics copy of a log, for column pruning and pushed filters."""
    df.write.mode(mode).parquet(path)


class InvalidPlan(ValueError):
    """A collection plan that breaks a rule."""


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """campaign, place, prompt_id, transcript and intent of a plan's prompts, after checking the plan."""
    plans = spark.read.schema(S.PLAN_DDL).option("multiLine", True).option("mode", "FAILFAST").json(path)
    check_plan(plans)
    return plans.select("campaign", F.posexplode("prompts").alias("place", "prompt")).select(
        "campaign", "place", F.col("prompt.id").alias("prompt_id"), "prompt.transcript", "prompt.intent"
    )


def plan_problems(plans: DataFrame) -> DataFrame:
    """The plans with `problem`: the first rule that each breaks, in the rules' order and that of the prompts; null if none."""
    text = lambda c: F.coalesce(c, F.lit(""))
    ids = F.transform("prompts", lambda p: p["id"])

    def wrong(prompt: Column, place: Column) -> Column:
        blank = (trimmed(text(prompt["id"])) == "") | (trimmed(text(prompt["transcript"])) == "")
        return (
            F.when(blank, F.lit("collection prompt ID and transcript must not be empty"))
            .when(~text(prompt["intent"]).isin(*S.PROMPT_INTENTS), F.concat(F.lit("unsupported expected intent '"), text(prompt["intent"]), F.lit("'")))
            .when(F.array_position(ids, prompt["id"]) <= place, F.concat(F.lit("duplicate collection prompt ID '"), prompt["id"], F.lit("'")))
        )

    version = F.col("schema_version")
    unsupported = F.concat(F.lit("unsupported collection plan schema "), text(version.cast("string")), F.lit(f"; expected {S.PLAN_VERSION}"))
    problem = (
        F.when(~version.eqNullSafe(F.lit(S.PLAN_VERSION)), unsupported)
        .when(trimmed(text(F.col("campaign"))) == "", F.lit("collection campaign must not be empty"))
        .when(F.coalesce(F.size("prompts"), F.lit(0)) <= 0, F.lit("collection plan must contain at least one prompt"))
        .otherwise(F.try_element_at(F.filter(F.transform("prompts", wrong), lambda w: w.isNotNull()), F.lit(1)))
    )
    return plans.withColumn("problem", problem)


def check_plan(plans: DataFrame) -> None:
    """Raise InvalidPlan if there is no plan, or for what the plan breaks first."""
    checked = plan_problems(plans)
    first = checked.where("problem is not null").first() or (None if checked.head(1) else {"problem": "no collection plan"})
    if first:
        raise InvalidPlan(first["problem"])
