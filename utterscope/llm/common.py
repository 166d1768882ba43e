"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from utterscope.sources.scratch import new_path, shared_folder

#: Bytes of text that one numpy step works on: bounds a task's memory and keeps arrays in cache.
CHUNK_BYTES = 512 << 10
#: Bytes of text that go to Python at once.
BATCH_BYTES = 8 << 20
#: maybe_among: bits for each key, in blocks of Spark's bitmaps; so many blocks (8 MB) at most.
KEY_BITS = 32
BLOCK_BITS = 1 << 15
BLOCKS = 1 << 11


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows in as many partitions as there are cores, if they are in fewer: a file of one row group is read by one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that later jobs survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, options: Mapping[str, int | str] | None = None) -> tuple[DataFrame, str]:
    """The rows, written as Parquet (with the writer's options) under the shared checkpoint folder and read back, and the path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str, options: Mapping[str, int | str] | None = None) -> DataFrame:
    return stored(df, name, options)[0]


def remove(spark: SparkSession, paths: Sequence[str]) -> None:
    """Delete stored tables that nothing needs any more."""
    for path in map(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def maybe_among(df: DataFrame, key: str, keys: DataFrame, name: str = "__maybe") -> DataFrame:
    """The rows with a boolean: true for each key of `keys` (materialised, one column), and by chance for a few others.

    It tells rows apart where they are, as a bitmap of the keys' hashes goes to them: an exact join of those marked follows,
    and only they are shuffled. The bitmap is of BLOCKS at most; for more keys more others are marked, and none is missed.
    """
    blocks = min(BLOCKS, max(1, ceil(keys.count() * KEY_BITS / BLOCK_BITS)))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks * BLOCK_BITS))
    slots = keys.select(slot(F.col(keys.columns[0])).alias("__slot")).withColumn("__block", F.floor(F.col("__slot") / BLOCK_BITS))
    bits = slots.repartition("__block").groupBy("__block").agg(F.bitmap_construct_agg(F.col("__slot") % BLOCK_BITS).alias("__bits"))
    own = F.col("__slot") % BLOCK_BITS
    byte = F.conv(F.hex(F.substring("__bits", F.floor(own / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.getbit(byte, (own % 8).cast("int")) == 1
    rows = df.withColumn("__slot", slot(F.col(key))).withColumn("__block", F.floor(F.col("__slot") / BLOCK_BITS))
    return rows.join(F.broadcast(bits), "__block", "left").withColumn(name, F.coalesce(marked, F.lit(False))).select(*(f"`{c}`" for c in df.columns), name)


def byte_chunks(texts: Sequence[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) in runs of about `limit` bytes; a longer text is a run of its own. Null is empty."""
    start, size, run = 0, 0, []
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if run and size + len(raw) > limit:
            yield start, run
            start, size, run = i, 0, []
        run.append(raw)
        size += len(raw)
    if run:
        yield start, run


def safe_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under names that clash with nothing, and those names by the old ones, in order."""
    names = {c: f"__c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, as rows of texts may be of any length; a smaller bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).lower().removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def map_texts(
    df: DataFrame,
    text: str,
    function: Callable[[list[str | None]], dict[str, Sequence]],
    fields: Sequence[T.StructField],
    keep: Sequence[str],
) -> DataFrame:
    """Add columns that `function` makes from whole texts, in Arrow batches. Only `keep` and the text are read."""
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    schema = T.StructType([*(df.schema[k] for k in keep), *fields])
    made = to_arrow_schema(T.StructType(list(fields)))
    kept = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            got = function(batch.column(batch.num_columns - 1).to_pylist())
            columns = [batch.column(i) for i in range(len(kept))]
            columns += [pa.array(got[f.name], type=f.type) for f in made]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *made.names])

    return df.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)


def hash_part(columns: Sequence[str], digits: int) -> Column:
    """The first hexadecimal digits of a hash of the row's columns, to deal the rows of a key to parts."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.substring(F.md5(F.concat_ws("|", *texts).cast("binary")), 1, digits)


def with_slots(df: DataFrame, keys: Sequence[str], part: Column, order: Sequence[str], slot: str) -> DataFrame:
    """Gapless 0-based numbers within each key, by part and then by `order`, without bringing a whole key to one task.

    Parts are numbered on their own and shifted by the summed counts of the parts before them. The counts are (keys x
    parts) rows, made with map-side sums. `df` is used twice, so pass something materialised or cheap.
    """
    parted = df.withColumn("__part", part)
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        parted.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
        .select(*keys, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    )
    within = Window.partitionBy(*keys, "__part").orderBy(*order)
    return (
        parted.join(shift, [*keys, "__part"])
        .withColumn(slot, F.col("__shift") + F.row_number().over(within) - 1)
        .drop("__part", "__shift")
    )
