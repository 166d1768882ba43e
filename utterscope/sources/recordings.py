"""Long WAV recordings in pieces, as a batch and as a stream.

A Python data source that reads the header of a 16-bit PCM file (RIFF, and RF64 beyond 4 GB) and then only the byte range of a
piece, so no task holds a recording. In a batch, files are split by bytes like other files, and a piece is read by the task in
whose split it begins; pieces are whole windows long, so levels of pieces are the levels of the recording. A task takes a run of
splits, of one file or many, as a short file costs a task more than its bytes; files are listed once, by the planner. In a stream, all
recordings play side by side: an offset is a number of frames, and a trigger takes at most so many of each recording. The
engine doesn't tell a source where a restarted query stands; with a `progress` file, which the source writes as it plans a batch, the
bound holds for the first trigger of a run, too (and a run that takes what is available takes one such step).

Options: `path` (a folder or a file; a URI of a file system that driver and tasks reach, or a shared mount), `pieceWindows`
(windows a piece), `windowSeconds`, `splitBytes` (batch), `minTasks` (short files are dealt to so many), `maxFrames` (stream, a
trigger) and `progress` (stream).
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from utterscope.functions.audio import WINDOW_SECONDS, frames_for
from utterscope.operators.levels import levels_of_recordings

NAME = "wav_pieces"
#: Bytes of a task, and bytes that opening a file is worth.
TASK_BYTES = 64 << 20
FILE_BYTES = 64 << 10
#: Samples and pieces of an Arrow batch: with the piece that reaches a bound it ends.
BATCH_SAMPLES = 1 << 20
BATCH_PIECES = 1024
PIECES = "session string, start_frame bigint, samples array<smallint>, sample_rate_hz int, channels int, session_ended boolean"


@dataclass(frozen=True)
class Header:
    rate: int
    channels: int
    data_at: int
    n_frames: int


def read_header(f, size: int) -> Header:
    """What a file's chunks say, up to its samples; lengths that are left open (0 or all ones) reach to the end of the file."""
    kind, _, form = struct.unpack("<4sI4s", f.read(12))
    if kind not in (b"RIFF", b"RF64") or form != b"WAVE":
        raise ValueError("no WAV file")
    rate = channels = long_data = None
    while True:
        head = f.read(8)
        if len(head) < 8:
            raise ValueError("a WAV file without samples")
        name, length = struct.unpack("<4sI", head)
        if name == b"data":
            break
        body = f.read(length + length % 2)
        if name == b"ds64":
            long_data = struct.unpack("<Q", body[8:16])[0]
        elif name == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if code == 0xFFFE and len(body) >= 26:
                code = struct.unpack("<H", body[24:26])[0]
            if code != 1 or bits != 16:
                raise ValueError("only 16-bit PCM is supported")
    if not rate or not channels:
        raise ValueError("a WAV file without a format")
    at = f.tell()
    there = size - at
    stated = long_data if length == 0xFFFFFFFF and long_data is not None else length
    return Header(rate, channels, at, (there if stated in (0, 0xFFFFFFFF) else min(stated, there)) // (2 * channels))


@dataclass
class Part(InputPartition):
    """Ranges of a task: (path, size, first, end), in bytes of a file's splits or in frames of a stream."""

    ranges: list[tuple[str, int, int, int]]


def dealt(files: list[tuple[str, int]], split: int, least: int) -> list[list[tuple[str, int, int, int]]]:
    """Runs of whole splits, one a task: of TASK_BYTES or, where that makes fewer than `least` tasks, of less."""
    files = [(path, size) for path, size in files if size]
    most = min(TASK_BYTES, sum(size + FILE_BYTES for _, size in files) / least)
    out: list[list] = []
    room = 0.0
    for path, size in files:
        own = min(split, size)
        cost = own * (size + FILE_BYTES) / size
        at = 0
        while at < size:
            if room <= 0:
                out.append([])
                room = most
            count = max(1, int(room // cost))
            end = min(size, at + count * own)
            out[-1].append((path, size, at, end))
            room -= cost * (end - at) / own
            at = end
    return out


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _files(path: str) -> tuple[fs.FileSystem, list[tuple[str, int]]]:
    system, base = _system(path)
    info = system.get_file_info(base)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    return system, sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and i.path.endswith(".wav"))


class _Pieces:
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.windows = int(options.get("pieceWindows", 3000))
        self.seconds = float(options.get("windowSeconds", WINDOW_SECONDS))
        self.least = int(options.get("minTasks", 64))

    def step(self, header: Header) -> int:
        return self.windows * max(1, int(header.rate * self.seconds + 0.5))

    def rows(self, part: Part, ranges) -> Iterator[pa.RecordBatch]:
        """A row for each (first, end) frame range that `ranges` makes of a header and a range of the part."""
        system, _ = _system(self.path)
        held: list[tuple] = []
        size = 0
        for path, length, first, end in part.ranges:
            session = path.rsplit("/", 1)[-1].removesuffix(".wav")
            with system.open_input_file(path) as f:
                h = read_header(f, length)
                for a, b in ranges(h, first, end):
                    f.seek(h.data_at + a * 2 * h.channels)
                    samples = np.frombuffer(f.read((b - a) * 2 * h.channels), "<i2").astype(np.int16)
                    held.append((session, a, samples, h.rate, h.channels, b == h.n_frames))
                    size += len(samples)
                    if size >= BATCH_SAMPLES or len(held) >= BATCH_PIECES:
                        yield _batch(held)
                        held, size = [], 0
        if held:
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    session, start, samples, rate, channels, ended = zip(*rows)
    places = np.cumsum([0, *map(len, samples)])
    return pa.RecordBatch.from_arrays(
        [pa.array(session, pa.string()), pa.array(start, pa.int64()), pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(np.concatenate(samples))),
         pa.array(rate, pa.int32()), pa.array(channels, pa.int32()), pa.array(ended, pa.bool_())],
        names=["session", "start_frame", "samples", "sample_rate_hz", "channels", "session_ended"],
    )


class PieceReader(DataSourceReader, _Pieces):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.split = int(options.get("splitBytes", 64 << 20))

    def partitions(self) -> list[Part]:
        return [Part(own) for own in dealt(_files(self.path)[1], self.split, self.least)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        def ranges(h: Header, first: int, end: int) -> Iterator[tuple[int, int]]:
            step = self.step(h)
            width = step * 2 * h.channels
            for k in range(max(0, -(-(first - h.data_at) // width)), max(0, -(-(end - h.data_at) // width))):
                if k * step < h.n_frames:
                    yield k * step, min((k + 1) * step, h.n_frames)

        return self.rows(part, ranges)


class PieceStream(DataSourceStreamReader, _Pieces):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.most, self.progress, self.at = int(options.get("maxFrames", 1 << 20)), options.get("progress"), None

    def initialOffset(self) -> dict:
        self.at = 0
        return {"frame": 0}

    def _reached(self) -> int | None:
        if self.at is None and self.progress:
            system, base = _system(self.progress)
            if system.get_file_info(base).type != fs.FileType.File:
                return 0
            with system.open_input_stream(base) as f:
                return json.loads(f.read())["frame"]
        return self.at

    def latestOffset(self) -> dict:
        there = max((size // 2 for _, size in _files(self.path)[1]), default=0)  # no recording has more frames
        reached = self._reached()
        return {"frame": there if reached is None else max(reached, min(there, reached + self.most))}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.at = end["frame"]
        if self.progress:  # the engine has noted the end by now: a restart plans the same batch again
            system, base = _system(self.progress)
            system.create_dir(base.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(base) as f:
                f.write(json.dumps(end).encode())
        sizes = {p: size for p, size in _files(self.path)[1] if size // 2 > start["frame"]}
        steps = [(p, min(size, 4 * (end["frame"] - start["frame"]))) for p, size in sizes.items()]
        return [Part([(p, sizes[p], start["frame"], end["frame"]) for p, *_ in own]) for own in dealt(steps, TASK_BYTES, self.least)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        def ranges(h: Header, first: int, end: int) -> Iterator[tuple[int, int]]:
            end = min(end, h.n_frames)
            for a in range(first, end, self.step(h)):
                yield a, min(a + self.step(h), end)

        return self.rows(part, ranges)


class WavPieces(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return PIECES

    def reader(self, schema) -> PieceReader:
        return PieceReader(self.options)

    def streamReader(self, schema) -> PieceStream:
        return PieceStream(self.options)


def read_pieces(spark: SparkSession, path: str, **options) -> DataFrame:
    """PIECES of the recordings under a path."""
    spark.dataSource.register(WavPieces)
    return spark.read.format(NAME).options(**options).load(path)


def stream_pieces(spark: SparkSession, path: str, **options) -> DataFrame:
    """PIECES of the recordings under a path as a stream; the last of a recording ends its session."""
    spark.dataSource.register(WavPieces)
    return spark.readStream.format(NAME).options(**options).load(path)


def levels_of_pieces(pieces: DataFrame, seconds: float = WINDOW_SECONDS) -> DataFrame:
    """session, window_idx, rms, dbfs and end_frame of the pieces of a batch, as of the whole recordings."""
    found = levels_of_recordings(pieces, ("session", "start_frame", "sample_rate_hz"), seconds)
    before = F.floor(F.col("start_frame") / frames_for(F.col("sample_rate_hz"), seconds)).cast("bigint")
    return found.select("session", (F.col("window_idx") + before).alias("window_idx"), "rms", "dbfs", (F.col("end_frame") + F.col("start_frame")).alias("end_frame"))
