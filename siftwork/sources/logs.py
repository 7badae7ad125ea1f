"""Log files as a data source, in batch and as a stream that outlives rotation, and metrics as a sink that leaves nothing behind when it fails."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Fixed format of a line: time, level, logger, message.
LINE = re.compile(r"(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d),(\d{3}) ([A-Z]+) (\S+) (.*)", re.DOTALL)
#: Bytes of a file that one task reads, about; bytes looked at at once for a line's end.
RANGE, BLOCK = 32 * 2**20, 2**16
#: A first line is known by so many of its bytes at most.
HEAD = 4096


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _listed(path: str, pattern: str) -> list[pafs.FileInfo]:
    fs, root = file_system(path)
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted((f for f in found if f.is_file and fnmatch.fnmatch(f.base_name, pattern)), key=lambda f: f.path)


@dataclass
class Span(InputPartition):
    """Lines of a file that begin in [start, end)."""

    path: str
    start: int
    end: int


def _spans(path: str, start: int, end: int) -> list[Span]:
    return [Span(path, at, min(end, at + RANGE)) for at in range(start, end, RANGE)]


class _Lines:
    """Reading what both readers share."""

    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "*.log*")

    def read(self, span: Span | None) -> Iterator[pa.RecordBatch]:
        if span is None:  # what Spark hands over where there is no file
            return
        fs, _ = file_system(self.path)
        rows: list[tuple[int, str]] = []
        with fs.open_input_file(span.path) as f:
            at = span.start
            if at:
                # the line that began before belongs to the span before
                f.seek(at - 1)
                at += len(_line(f)) - 1
            while at < span.end:
                f.seek(at)
                line = _line(f)
                if not line:
                    break
                rows.append((at, line.decode("utf-8", "replace").rstrip("\r\n")))
                at += len(line)
                if len(rows) == 5000:
                    yield _parsed(span.path, rows)
                    rows = []
        if rows:
            yield _parsed(span.path, rows)


def _line(f) -> bytes:
    """From where the file stands to the end of the line."""
    parts = []
    while block := f.read(BLOCK):
        end = block.find(b"\n")
        if end >= 0:
            return b"".join([*parts, block[: end + 1]])
        parts.append(block)
    return b"".join(parts)


SCHEMA = "file string, at long, ts timestamp, level string, logger string, message string, bad string"
_ARROW = pa.schema(
    [("file", pa.string()), ("at", pa.int64()), ("ts", pa.timestamp("us", "UTC")), ("level", pa.string()), ("logger", pa.string()), ("message", pa.string()), ("bad", pa.string())]
)


def _parsed(path: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
    out = []
    for at, line in rows:
        ts, m = None, LINE.fullmatch(line)
        if m:
            try:
                ts = datetime.fromisoformat(m[1]).replace(microsecond=1000 * int(m[2]), tzinfo=timezone.utc)
            except ValueError:
                m = None
        out.append((path, at, ts, m[3], m[4], m[5], None) if m else (path, at, None, None, None, None, line))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class LogReader(_Lines, DataSourceReader):
    """All lines that are there, an unfinished last one too."""

    def partitions(self) -> list[Span]:
        return [s for f in _listed(self.path, self.pattern) for s in _spans(f.path, 0, f.size)]


class LogStreamReader(_Lines, DataSourceStreamReader):
    """Finished lines, each once, from files that grow and are renamed when they are rotated.

    A file is known by its first line, whatever it is called; an offset holds the bytes taken of each file. The first lines of two files
    must differ, as times do; a file that is gone before its lines were taken is lost.
    """

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def _now(self) -> dict[str, tuple[str, int]]:
        """First line's digest -> (path, end of the last finished line)."""
        fs, _ = file_system(self.path)
        found = {}
        for info in _listed(self.path, self.pattern):
            with fs.open_input_file(info.path) as f:
                head = f.read(HEAD)
                cut = head.find(b"\n")
                if cut < 0 and len(head) < HEAD:
                    continue
                end, at = 0, info.size
                while at > 0 and not end:
                    lo = max(0, at - BLOCK)
                    f.seek(lo)
                    last = f.read(at - lo).rfind(b"\n")
                    end, at = (lo + last + 1 if last >= 0 else 0), lo
            if end:
                found[hashlib.sha256(head[: cut if cut >= 0 else HEAD]).hexdigest()[:16]] = info.path, end
        return found

    def latestOffset(self) -> dict:
        return {"files": json.dumps({k: end for k, (_, end) in self._now().items()}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        taken, until, where = json.loads(start["files"]), json.loads(end["files"]), self._now()
        return [s for k, stop in until.items() if k in where for s in _spans(where[k][0], taken.get(k, 0), stop)]

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    """``spark.read.format("rotated_logs").load(folder)``; option ``pattern`` narrows the file names.

    Columns: ``file``, ``at`` (byte where the line begins), ``ts`` (read as UTC), ``level``, ``logger``, ``message``; a line of another form stands in
    ``bad``, with nulls beside it.
    """

    @classmethod
    def name(cls) -> str:
        return "rotated_logs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(dict(self.options))

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(dict(self.options))


def _escaped(value: str) -> str:
    return value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")


def metric_line(name: str, labels: dict | None, value: float) -> str:
    """A line of the text format that scrapers read."""
    inside = ",".join(f'{k}="{_escaped(labels[k] or "")}"' for k in sorted(labels or {}))
    return f"{name}{{{inside}}} {value!r}" if inside else f"{name} {value!r}"


_METRIC = re.compile(r'([^\s{]+)(?:\{((?:[^"}]|"(?:[^"\\]|\\.)*")*)\})? (\S+)')
_LABEL = re.compile(r'([^=,]+)="((?:[^"\\]|\\.)*)"')
_PLAIN = {"n": "\n"}


def parse_metric(line: str) -> tuple[str, dict, float]:
    m = _METRIC.fullmatch(line)
    if not m:
        raise ValueError(f"not a metric: {line[:80]!r}")
    labels = {k: re.sub(r"\\(.)", lambda x: _PLAIN.get(x[1], x[1]), v) for k, v in _LABEL.findall(m[2] or "")}
    return m[1], labels, float(m[3])


@dataclass
class Staged(WriterCommitMessage):
    """The file that a task's successful attempt wrote, and its rows."""

    file: str
    rows: int


class MetricWriter(DataSourceWriter):
    """Tasks write into a folder that readers pass over; the commit renames it, so a run is there whole or not at all."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path.rstrip("/"), overwrite, uuid.uuid4().hex
        fs, root = file_system(self.path)
        fs.create_dir(f"{root}/_staged-{self.run}", recursive=True)

    def write(self, rows) -> Staged:
        fs, root = file_system(self.path)
        # made by the driver: a task that outlives the job's failure finds no folder to write to
        folder = f"{root}/_staged-{self.run}"
        n, file = 0, f"{uuid.uuid4().hex}.prom"
        with fs.open_output_stream(f"{folder}/{file}") as out:
            for row in rows:
                out.write((metric_line(row["name"], row["labels"], row["value"]) + "\n").encode())
                n += 1
        return Staged(file, n)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, root = file_system(self.path)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith("run-")] if self.overwrite else []
        named = {m.file for m in messages if m is not None}
        for f in fs.get_file_info(pafs.FileSelector(f"{root}/_staged-{self.run}")):
            if f.base_name not in named:
                fs.delete_file(f.path)
        fs.move(f"{root}/_staged-{self.run}", f"{root}/run-{self.run}")
        for path in old:
            fs.delete_dir(path)

    def abort(self, messages: list[Staged | None]) -> None:
        fs, root = file_system(self.path)
        if fs.get_file_info(f"{root}/_staged-{self.run}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/_staged-{self.run}")


class MetricReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Span]:
        fs, root = file_system(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        return [Span(f.path, 0, f.size) for f in found if f.is_file and "/run-" in f.path]

    def read(self, span: Span | None) -> Iterator[tuple]:
        if span is None:
            return
        fs, _ = file_system(self.path)
        at = 0
        with fs.open_input_file(span.path) as f:
            while line := _line(f):
                yield parse_metric(line.decode().rstrip("\n"))
                at += len(line)
                f.seek(at)


class MetricSource(DataSource):
    """``df.write.format("metrics").mode("append").save(folder)`` for rows of ``name``, ``labels`` and ``value``, and reading them back.

    A run of the writer is a folder of text files in the format that scrapers read. Files of attempts that failed are
    dropped before the run is committed; a run that fails leaves nothing.
    """

    @classmethod
    def name(cls) -> str:
        return "metrics"

    def schema(self) -> str:
        return "name string, labels map<string,string>, value double"

    def reader(self, schema) -> MetricReader:
        return MetricReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> MetricWriter:
        return MetricWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make both formats known to the session."""
    spark.dataSource.register(LogSource)
    spark.dataSource.register(MetricSource)
