"""An appending log of lines whose order is that of its appends.

A log is a folder with a numbered folder an append. An append writes its part files to a hidden folder first and then renames
that to the next free number, which fails if another writer has taken it; that writer's append then comes first, and the next
number is tried. So appends are whole or not there, readers never see half of one, and the order of paths is the order in which
appends were committed. Within an append, lines keep the order of the rows. This needs a file system whose rename is atomic
(HDFS and others after it, a local one); a plain object store's is not.

A token makes an append happen once: what is given again with the token of an append that is there is left out. A stream's
batches have their query's and their own number as tokens, so a batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

import uuid
from functools import partial

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

DIGITS = 10
#: Part files are numbered with five digits, so their names are in order up to here.
MOST_PARTS = 99_999
TRIES = 1000


class _Folder:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway, self.root = spark.sparkContext._gateway, path.rstrip("/")
        self.fs = self.at("").getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def last(self) -> int:
        if not self.fs.exists(self.at("")):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(self.at(""))]
        return max((int(n) for n in names if len(n) == DIGITS and n.isdigit()), default=0)

    def rename(self, old: str, new: str) -> bool:
        """Whether `old` has become `new`; not if that is there."""
        none = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self.context.rename(self.at(old), self.at(new), none)
        except Py4JJavaError:
            if not self.fs.exists(self.at(new)) or not self.fs.exists(self.at(old)):
                raise
            return False
        return True

    def has_token(self, token: str) -> bool:
        return bool(self.fs.globStatus(self.at(f"{'[0-9]' * DIGITS}/_token-{token}")))


def append_lines(lines: DataFrame, path: str, token: str | None = None) -> int | None:
    """Append the rows of a one-column frame of text, in their order; the append's number, or None if its token is there."""
    spark = lines.sparkSession
    folder = _Folder(spark, path)
    if token and folder.has_token(token):
        return None
    hidden = f"_new-{uuid.uuid4().hex}"
    lines.coalesce(MOST_PARTS).write.text(f"{folder.root}/{hidden}")
    if token:
        folder.fs.create(folder.at(f"{hidden}/_token-{token}"), False).close()
    for _ in range(TRIES):
        number = folder.last() + 1
        if folder.rename(hidden, f"{number:0{DIGITS}d}"):
            return number
    raise RuntimeError(f"no free number in {path} after {TRIES} tries")


def _append_batch(batch: DataFrame, number: int, path: str, name: str) -> None:
    append_lines(batch, path, f"{name}-{number}")


def append_line_stream(lines: DataFrame, path: str, checkpoint: str, name: str, **trigger) -> StreamingQuery:
    """Append a stream's batches, each once; `name` tells this stream's tokens from others'."""
    query = lines.writeStream.foreachBatch(partial(_append_batch, path=path, name=name)).option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"availableNow": True})).start()
