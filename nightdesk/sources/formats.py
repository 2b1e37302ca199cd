"""Text logs as data sources: ``spark.read.format("nightdesk_access").load(folder)``, in SQL and as streams.

Each source type is a format with a fixed schema.  Files are cut into byte ranges that workers read
on their own, so one large file is many partitions; a range begins behind the first line end at or
after its first byte and ends with the line that runs over its last.  Fields are extracted from whole
Arrow batches.  A stream takes files in the order of their times.

Files are reached through Arrow's file systems (local paths and the schemes these know).  Where only
Spark can reach a store, use the readers of :mod:`nightdesk.sources.logs`, which give the same fields.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from nightdesk import vocab
from nightdesk.functions.parsing import AUDIT_LINE

RANGE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
TAIL = "_raw string, index string, sourcetype string, host string, source string"


@dataclass(frozen=True)
class Format:
    """A source type: its pattern with the names of its groups, and what is put on every row."""

    name: str
    sourcetype: str
    index: str
    host: str | None
    pattern: str | None = None
    fields: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()  # groups that a line may lack; then null

    @property
    def schema(self) -> str:
        return ", ".join([f"`{f}` string" for f in self.fields] + [TAIL])


FORMATS = (
    Format("nightdesk_access", vocab.ACCESS_SOURCETYPE, vocab.WEB_INDEX, vocab.WEB_HOST, vocab.ACCESS_LINE, tuple(vocab.ACCESS_FIELDS)),
    Format("nightdesk_error", vocab.ERROR_SOURCETYPE, vocab.WEB_INDEX, vocab.WEB_HOST),
    Format("nightdesk_syslog", vocab.SYSLOG_SOURCETYPE, vocab.WEB_INDEX, None),
    Format("nightdesk_helpdesk", "helpdesk_audit", "helpdesk", None, AUDIT_LINE, ("ts", "level", "ticket", "agent", "message"), ("ticket",)),
)


class Range(InputPartition):
    """Bytes ``first`` up to ``last`` of a file."""

    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


def _files(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The files at or below a path, hidden ones and those being written left out."""
    system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return system, [info]
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    visible = [f for f in found if f.type == fs.FileType.File and not any(p[:1] in "._" for p in f.path[len(root) :].split("/") if p)]
    return system, sorted(visible, key=lambda f: f.path)


def _ranges(files: list[fs.FileInfo], size: int) -> list[Range]:
    return [Range(f.path, a, min(a + size, f.size)) for f in files for a in range(0, f.size, size)]


def _lines(system: fs.FileSystem, part: Range) -> Iterator[list[bytes]]:
    """The lines that begin in a range, in lists of some megabytes."""
    with io.BufferedReader(system.open_input_file(part.path)) as file:
        at = part.first
        if at:  # the line that the range before it ends with
            file.seek(at - 1)
            at += len(file.readline()) - 1
        file.seek(at)
        while at < part.last:
            block = file.read(min(BATCH_BYTES, part.last - at))
            if not block.endswith(b"\n"):
                block += file.readline()
            if not block:
                return
            at += len(block)
            yield block.removesuffix(b"\n").split(b"\n")


def _extracted(form: Format, path: str, lines: list[bytes]) -> pa.RecordBatch:
    raw = pa.array([x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines], pa.string())
    columns = []
    if form.pattern is not None:
        found = pc.extract_regex(raw, _named(form.pattern, form.fields))
        columns = [pc.if_else(found.is_valid(), pc.struct_field(found, k), None) for k in range(len(form.fields))]
        columns = [pc.if_else(pc.equal(c, ""), None, c) if f in form.optional else c for f, c in zip(form.fields, columns, strict=True)]
    rest = [raw, *(pa.array([v] * len(raw), pa.string()) for v in (form.index, form.sourcetype, form.host, path))]
    names = [*form.fields, *[c.split()[0] for c in TAIL.split(", ")]]
    return pa.RecordBatch.from_arrays([*columns, *rest], names)


def _named(pattern: str, fields: tuple[str, ...]) -> str:
    """The pattern with its groups named in order, anchored as the text readers anchor it."""
    out, left, at = [], list(fields), 0
    while at < len(pattern):
        if pattern[at] == "\\":
            out.append(pattern[at : at + 2])
            at += 2
            continue
        if pattern[at] == "[":
            end = pattern.index("]", at + (2 if pattern[at + 1] != "^" else 3))
            out.append(pattern[at : end + 1])
            at = end + 1
            continue
        opens = pattern[at] == "(" and pattern[at + 1] != "?"
        out.append(f"(?P<{left.pop(0)}>" if opens else pattern[at])
        at += 1
    return "".join(out)


class _Reader(DataSourceReader):
    def __init__(self, form: Format, path: str, size: int):
        self.form, self.path, self.size = form, path, size

    def partitions(self) -> list[InputPartition]:
        return _ranges(_files(self.path)[1], self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        for lines in _lines(system, partition):
            yield _extracted(self.form, partition.path, lines)


class _StreamReader(_Reader, DataSourceStreamReader):
    """Offsets are the time and path of the newest file seen; files must not come with older times than these."""

    def _known(self) -> list[tuple[int, str, fs.FileInfo]]:
        return sorted((f.mtime_ns, f.path, f) for f in _files(self.path)[1])

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:
        known = self._known()
        return {"time": known[-1][0], "path": known[-1][1]} if known else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = ((x["time"], x["path"]) for x in (start, end))
        return _ranges([f for t, p, f in self._known() if low < (t, p) <= high], self.size)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def _source(form: Format) -> type[DataSource]:
    class LogSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return form.name

        def schema(self) -> str:
            return form.schema

        def _options(self) -> tuple[Format, str, int]:
            if not self.options.get("path"):
                raise ValueError(f"{form.name} needs a path")
            return form, self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES))

        def reader(self, schema) -> DataSourceReader:
            return _Reader(*self._options())

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _StreamReader(*self._options())

    return LogSource


def register_formats(spark: SparkSession) -> None:
    """Make all log formats known to the session; once registered, SQL can name them too."""
    for form in FORMATS:
        spark.dataSource.register(_source(form))
