"""Spark data sources ``turtle``, ``trig``, ``ntriples`` and ``nquads``: read, write and stream events.

``rdf`` reads files of all four, each by its extension. ``parse_rdf(text, syntax)`` is a table function
over documents in a column, for use with LATERAL.

Options for reading: ``path`` (file, folder or pattern, local or as a URI), ``base`` (default: the file's URI), ``mode``
(``FAILFAST``: stop with an exception at the first error; ``PERMISSIVE``, the default: errors are rows;
``DROPMALFORMED``: leave them out; ``STRICT``: an error row, then nothing more of that file),
``blankPrefix``, ``defaultGraph``, ``expand`` (default true: terms come out absolute). Streams take the same
options and give the same rows.
For writing: ``ascii``, ``fullUris``, ``base``, ``root``, ``chopPrefix``, ``mode``; rows must be sorted by doc and
seq within a partition. A statement that cannot be written stops the write (``FAILFAST``, the default); with
``DROPMALFORMED`` it is left out, and its doc, seq, status and message stand in ``_refused-…`` beside the part.

One task reads one file block by block, in memory bounded by one item. Files of the line syntaxes are
split between lines every ``splitBytes`` (default 64 MB; 0: never) unless an error has to end the file;
``seq`` then grows with the place in the file, and errors have lines of their split.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    InputPartition,
    SimpleDataSourceStreamReader,
    WriterCommitMessage,
)
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType

from termloom.plans.transcode import Options
from termloom.schema import EVENT, EXTENSIONS, syntax_of
from termloom.sources.env import Env
from termloom.sources.events import batches, event_row, row_events
from termloom.sources.files import file_blocks, line_blocks, list_files, opened
from termloom.sources.parser import Parser, parse_blocks
from termloom.sources.reading import Reading, document_events
from termloom.sources.writer import WriteFault, Writer
from termloom.util import ship


def _lower(options: dict[str, str]) -> dict[str, str]:
    return {k.lower(): v for k, v in options.items()}


@dataclass
class _File(InputPartition):
    path: str
    start: int = 0
    end: int | None = None


class _Reader(DataSourceReader):
    def __init__(self, syntax: str, options: dict[str, str]) -> None:
        self.syntax, self.options = syntax, _lower(options)

    def partitions(self) -> list[_File]:
        most = int(self.options.get("splitbytes", 1 << 26))
        files = list_files(self.options["path"])
        if self.syntax not in ("ntriples", "nquads") or most <= 0 or self.options.get("mode", "").upper() == "STRICT":
            return [_File(f) for f, _ in files]
        return [_File(f, at, min(at + most, size)) for f, size in files for at in range(0, max(size, 1), most)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        p = partition
        blocks = file_blocks(p.path) if p.end is None else line_blocks(p.path, p.start, p.end)
        events = document_events(blocks, self.syntax, p.path, self.options)
        yield from batches(event_row(p.path, p.start + n, e) for n, e in enumerate(events))


class _AnyReader(_Reader):
    """Files by their extension; TriG where it tells nothing."""

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        yield from _Reader(syntax_of(partition.path), self.options).read(partition)


# Writing


@dataclass
class _Written(WriterCommitMessage):
    staged: list[str]
    refused: int


class _Parts:
    """Part files of one job, staged below the target's ``_staged-<job>`` and moved when all tasks are done.

    Parts are named by the job, so an append never meets the parts of another. The parts that an
    overwrite replaces are deleted only when the new ones are in place.
    """

    def __init__(self, syntax: str, options: dict[str, str], job: str) -> None:
        self.syntax, self.options, self.job = syntax, _lower(options), job
        self.folder = self.options["path"].rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        extension = next(e for e, s in EXTENSIONS.items() if s == self.syntax)
        context = TaskContext.get()
        system, folder, _ = opened(self.folder)
        # tries of one task, as of a speculative run, do not share a name
        staged = f"{folder}/_staged-{self.job}/{context.taskAttemptId()}"
        system.create_dir(staged, recursive=True)
        name, refused = f"part-{self.job}-{context.partitionId():05d}{extension}", []
        with system.open_output_stream(f"{staged}/{name}") as out:
            for text in write_events(iterator, self.syntax, self.options, refused):
                out.write(text.encode("utf-8", "surrogateescape"))
        names = [name]
        if refused:
            names.append(f"_refused-{self.job}-{context.partitionId():05d}.jsonl")
            with system.open_output_stream(f"{staged}/{names[1]}") as out:
                out.write("".join(json.dumps(dict(zip(("doc", "seq", "status", "message"), r))) + "\n" for r in refused).encode())
        return _Written([f"{staged}/{n}" for n in names], len(refused))

    def commit(self, messages: list[_Written | None], replace: bool) -> None:
        from pyarrow import fs

        system, folder, _ = opened(self.folder)
        system.create_dir(folder, recursive=True)
        old = system.get_file_info(fs.FileSelector(folder)) if replace else []
        for staged in (s for m in messages if m is not None for s in m.staged):
            system.move(staged, f"{folder}/{staged.rpartition('/')[2]}")
        for f in old:
            if f.base_name.startswith(("part-", "_refused-")) and f.type == fs.FileType.File and self.job not in f.base_name:
                system.delete_file(f.path)
        self.clear()
        with system.open_output_stream(f"{folder}/_SUCCESS"):
            pass

    def clear(self) -> None:
        """Delete what is staged."""
        from pyarrow import fs

        system, folder, _ = opened(self.folder)
        staged = f"{folder}/_staged-{self.job}"
        if system.get_file_info(staged).type == fs.FileType.Directory:
            system.delete_dir(staged)


class _Writer(DataSourceArrowWriter):
    """One part per task; all of a job's parts appear, or none."""

    def __init__(self, syntax: str, options: dict[str, str], overwrite: bool) -> None:
        self.parts, self.overwrite = _Parts(syntax, options, uuid.uuid4().hex[:12]), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        return self.parts.write(iterator)

    def commit(self, messages: list[_Written | None]) -> None:
        self.parts.commit(messages, self.overwrite)

    def abort(self, messages: list[_Written | None]) -> None:
        self.parts.clear()


class _StreamWriter(DataSourceStreamArrowWriter):
    """Parts of each batch of a stream. A batch that is run again after a failure replaces its own parts."""

    def __init__(self, syntax: str, options: dict[str, str], overwrite: bool) -> None:
        self.syntax, self.options, self.overwrite, self.run = syntax, dict(options), overwrite, uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        return _Parts(self.syntax, self.options, self.run).write(iterator)

    def commit(self, messages: list[_Written | None], batchId: int) -> None:  # noqa: N803
        from pyarrow import fs

        system, folder, _ = opened(self.options["path"].rstrip("/"))
        final = f"batch{batchId:09d}"
        if not self.overwrite:
            for f in system.get_file_info(fs.FileSelector(folder)):
                if f.base_name.startswith((f"part-{final}-", f"_refused-{final}-")):
                    system.delete_file(f.path)
        for m in messages:
            for n, staged in enumerate(m.staged if m is not None else []):
                place, _, name = staged.rpartition("/")
                m.staged[n] = f"{place}/{name.replace(self.run, final)}"
                system.move(staged, m.staged[n])
        _Parts(self.syntax, self.options, final).commit(messages, self.overwrite)
        _Parts(self.syntax, self.options, self.run).clear()

    def abort(self, messages: list[_Written | None], batchId: int) -> None:  # noqa: N803
        _Parts(self.syntax, self.options, self.run).clear()


def write_events(iterator: Iterator[pa.RecordBatch], syntax: str, options: dict[str, str], refused: list[tuple] | None = None) -> Iterator[str]:
    """Text of event or statement rows in order; each document has its own scope.

    A statement that cannot be written raises, or with mode ``DROPMALFORMED`` goes to ``refused`` as
    (doc, seq, status, message).
    """
    mode = options.get("mode", "FAILFAST").upper()
    choice = Options(
        input="turtle", output=syntax, ascii=options.get("ascii", "false").lower() == "true",
        full_uris=options.get("fulluris", "false").lower() == "true", lax=mode == "DROPMALFORMED",
    )
    writer, doc = None, object()
    for batch in iterator:
        for name, seq, event in row_events(batch):
            if name != doc:
                if writer is not None:
                    writer.finish()
                    yield writer.text()
                doc = name
                writer = Writer(syntax, Env(options.get("base")), choice.style, options.get("root"), options.get("chopprefix", ""))
            try:
                writer.event(event)
            except WriteFault as fault:
                if mode != "DROPMALFORMED":
                    raise ValueError(f"{doc}, {seq}: {fault}") from None
                if refused is not None:
                    refused.append((doc, seq, fault.status, str(fault)))
        if writer is not None:
            yield writer.text()
    if writer is not None:
        writer.finish()
        yield writer.text()


# Streaming


class _Tail(SimpleDataSourceStreamReader):
    """Events of one growing file: each trigger reads the items that are complete by then.

    The offset holds the place in the file and the state of the reading, so a restarted query goes on
    where it was. A trigger reads about ``maxBytesPerTrigger`` (default 4 MiB), and more where one item
    is larger. A NUL between items is skipped.
    """

    def __init__(self, syntax: str, options: dict[str, str]) -> None:
        self.syntax, self.options = syntax, _lower(options)

    def initialOffset(self) -> dict:
        return {"at": 0, "state": Reading(self.syntax, self.options["path"], self.options).state()}

    def _events(self, start: dict, end: int | None) -> tuple[list[tuple], dict]:
        path, at = self.options["path"], start["at"]
        reading = Reading(self.syntax, path, self.options, start["state"])
        limit = int(self.options.get("maxbytespertrigger", 1 << 22))
        rows = []
        for block in file_blocks(path, at, end, min(limit, 1 << 20) if end is None else 1 << 20):
            rows += [event_row(path, n, e) for n, e in reading.feed(block)]
            at += len(block)
            done = at - len(reading.rest()) > start["at"]  # an item, or blanks between items, at least
            if end is None and done and at - start["at"] >= limit:
                break
        left = len(reading.rest())
        return rows, {"at": at - left, "state": reading.state()}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._events(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._events(start, end["at"])[0])


class _Source(DataSource):
    syntax = ""

    @classmethod
    def name(cls) -> str:
        return cls.syntax

    def schema(self) -> StructType:
        return EVENT

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.syntax, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.syntax, self.options, overwrite)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Tail(self.syntax, self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(self.syntax, self.options, overwrite)


class TurtleSource(_Source):
    """Turtle files."""

    syntax = "turtle"


class TrigSource(_Source):
    """TriG files."""

    syntax = "trig"


class NTriplesSource(_Source):
    """N-Triples files; see :mod:`termloom.sources.lines` for the way that stays in the JVM."""

    syntax = "ntriples"


class NQuadsSource(_Source):
    """N-Quads files; see :mod:`termloom.sources.lines` for the way that stays in the JVM."""

    syntax = "nquads"


class AnySource(_Source):
    """Files of any of the four syntaxes; for reading only."""

    syntax = "rdf"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _AnyReader(self.syntax, self.options)


class ParseText:
    """Table function: the events of a document given as text. Null texts have none."""

    def eval(self, text: str, syntax: str) -> Iterator[tuple]:
        if text is not None:
            for n, e in enumerate(parse_blocks(Parser(syntax or "trig", strict=False), [text])):
                yield event_row(None, n, e)


def register(spark: SparkSession) -> None:
    """Make the formats and the table function known to a session."""
    ship(spark)
    for source in (TurtleSource, TrigSource, NTriplesSource, NQuadsSource, AnySource):
        spark.dataSource.register(source)
    spark.udtf.register("parse_rdf", udtf(ParseText, returnType=EVENT))
