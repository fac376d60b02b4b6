"""Documents held in table rows: bytes to events, statements to text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from termloom.plans.transcode import Options, convert
from termloom.schema import EVENT
from termloom.sources.env import Env
from termloom.sources.events import batches, event_row, row_events
from termloom.sources.parser import Parser
from termloom.sources.reading import Reading, document_events
from termloom.sources.writer import WriteFault, Writer
from termloom.util import parallelism


def read_documents(inputs: DataFrame, expand: bool = True, **options: str) -> DataFrame:
    """Events of documents given as (doc, syntax, bytes, base_uri, strict); ``doc`` and ``seq`` order them.

    A strict document ends at its first error, others go on after the line. A null syntax reads as
    TriG, null bytes as an empty document, null ``strict`` as strict; without a base, references stay relative. Bytes that are no UTF-8 are errors
    where a term holds them.
    """
    chosen = {k.lower(): v for k, v in options.items()} | {"expand": str(expand)}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for part in parts:
                for r in part.to_pylist():
                    own = dict(chosen)
                    own["mode"] = "PERMISSIVE" if r["strict"] is False else "STRICT"
                    if r["base_uri"] is not None:
                        own["base"] = r["base_uri"]
                    events = document_events([r["bytes"] or b""], r["syntax"] or "trig", None, own)
                    for n, e in enumerate(events):
                        yield event_row(r["doc"], n, e)

        yield from batches(rows())

    return inputs.select("doc", "syntax", "bytes", "base_uri", "strict").mapInArrow(run, EVENT)


TEXT = T.StructType([T.StructField("doc", T.StringType()), T.StructField("piece", T.LongType()), T.StructField("text", T.StringType())])
#: Pieces of text, and statements that were refused with their number and why.
WRITTEN = T.StructType(
    [*TEXT.fields, T.StructField("seq", T.LongType()), T.StructField("status", T.IntegerType()), T.StructField("message", T.StringType())]
)
_WRITTEN_ARROW = to_arrow_schema(WRITTEN)
#: Pieces of text with the number of errors met on the way.
PIECES = T.StructType([*TEXT.fields, T.StructField("n_errors", T.IntegerType())])
_PIECES_ARROW = to_arrow_schema(PIECES)
#: Strings of output that make a piece.
PIECE = 2000


def document_text(events: DataFrame, syntax: str = "turtle", flat: bool = False, **options: str) -> DataFrame:
    """(doc, piece, text): documents written in a syntax, in pieces that follow each other.

    ``events`` are event rows, or statement rows alone. One shuffle by document and a sort; then each
    task folds over its rows with the open nodes as its only state, so a document of any size is
    written in constant memory. What cannot be written is in :func:`refused_statements`. The number of tasks is
    that of the session's shuffles: the fold takes its time in Python, so small partitions are not put together.

    ``flat`` says that the rows are statements without directives and nesting. Then they are parted by ranges of
    (doc, seq) of about equal size, so a document that holds a third of all rows is written by many tasks; a
    subject that goes on over a border is named again after it.
    """
    return _written(events, syntax, flat, options).where("status IS NULL").select(*TEXT.names)


def refused_statements(events: DataFrame, syntax: str = "turtle", flat: bool = False, **options: str) -> DataFrame:
    """(doc, seq, status, message) of the rows that :func:`document_text` cannot write."""
    return _written(events, syntax, flat, options).where("status IS NOT NULL").select("doc", "seq", "status", "message")


def _written(events: DataFrame, syntax: str, flat: bool, options: dict[str, str]) -> DataFrame:
    chosen = {k.lower(): v for k, v in options.items()}
    events = events.select(*[c for c in events.columns if c in EVENT.names])  # the fold sees no more than an event has
    tasks = parallelism(events.sparkSession)
    parted = events.repartitionByRange(tasks, "doc", "seq") if flat else events.repartition(tasks, "doc")
    return parted.sortWithinPartitions("doc", "seq").mapInArrow(lambda p: _fold(p, syntax, chosen), WRITTEN)


def _fold(parts: Iterator[pa.RecordBatch], syntax: str, options: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """Pieces of text of rows sorted by document, and the rows refused."""
    choice = Options(
        input="turtle", output=syntax, ascii=options.get("ascii", "false") == "true",
        full_uris=options.get("fulluris", "false") == "true", lax=True,
    )
    context = TaskContext.get()
    first = (context.partitionId() if context else 0) << 32  # pieces of a document's ranges follow each other
    writer, doc, piece, rows = None, None, first, []

    def put() -> None:
        nonlocal piece
        text = writer.text()
        if text:
            rows.append((doc, piece, text, None, None, None))
            piece += 1

    for part in parts:
        for name, seq, event in row_events(part):
            if writer is None or name != doc:
                if writer is not None:
                    writer.finish()
                    put()
                doc, piece = name, first
                writer = Writer(syntax, Env(options.get("base")), choice.style, options.get("root"), options.get("chopprefix", ""))
            try:
                writer.event(event)
            except WriteFault as fault:
                rows.append((doc, None, None, seq, fault.status, str(fault)))
                continue
            if len(writer.out) > PIECE:
                put()
        if rows:
            yield _batch(rows, _WRITTEN_ARROW)
            rows.clear()
    if writer is not None:
        writer.finish()
        put()
        if rows:
            yield _batch(rows, _WRITTEN_ARROW)


def _folded(pieces: DataFrame, open_document: Callable[[str | None], Callable[[str, bool], list[tuple]]], schema: T.StructType) -> DataFrame:
    """A fold over pieces in order: ``open_document`` gives what turns a document's pieces into rows."""
    arrow = to_arrow_schema(schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, step = object(), None
        for part in parts:
            rows = []
            for name, text in zip(part.column("doc").to_pylist(), part.column("text").to_pylist()):
                if name != doc:
                    rows += step("", True) if step is not None else []
                    doc, step = name, open_document(name)
                rows += step(text or "", False)
            if rows:
                yield _batch(rows, arrow)
        rows = step("", True) if step is not None else []
        if rows:
            yield _batch(rows, arrow)

    return pieces.select("doc", "piece", "text").mapInArrow(run, schema)


def transcode_pieces(pieces: DataFrame, source: str, target: str, **options: object) -> DataFrame:
    """(doc, piece, text, n_errors): documents given in pieces, parsed and written again piece by piece.

    ``pieces`` must be as :func:`document_text` gives them: a document, or a range of a flat one, in one partition,
    its pieces in order. Nothing is shuffled or collected; a task holds one parser, one writer and one piece. Errors
    are skipped as in lax reading, and counted.
    """
    chosen = Options(input=source, output=target, lax=True, **options)

    def open_document(doc: str | None) -> Callable[[str, bool], list[tuple]]:
        parser = Parser(source, strict=False, blank_prefix=chosen.blank_prefix)
        writer = Writer(target, Env(chosen.base), chosen.style, chosen.root, chosen.chop_prefix)
        context = TaskContext.get()
        n = (context.partitionId() if context else 0) << 32

        def step(text: str, final: bool) -> list[tuple]:
            nonlocal n
            parser.feed(text, final)
            errors = 0
            while (events := parser.step()) is not None:
                for e in events:
                    try:
                        writer.event(e)
                        errors += e[0] == "error"
                    except WriteFault:
                        errors += 1
            if final:
                writer.finish()
            n += 1
            return [(doc, n - 1, writer.text(), errors)]

        return step

    return _folded(pieces, open_document, PIECES)


def read_pieces(pieces: DataFrame, syntax: str, **options: str) -> DataFrame:
    """Events of documents given in pieces as :func:`document_text` gives them, in the order of the text.

    References stay relative without a ``base``. Numbers are those of the document, or of the range of a flat one.
    """
    chosen = {k.lower(): v for k, v in options.items()}

    def open_document(doc: str | None) -> Callable[[str, bool], list[tuple]]:
        reading = Reading(syntax, None, chosen)
        return lambda text, final: [event_row(doc, n, e) for n, e in reading.feed(text, final)]

    return _folded(pieces, open_document, EVENT)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def convert_documents(inputs: DataFrame, output: str | None = None, **options: object) -> DataFrame:
    """(doc, text, n_errors): documents given as (doc, syntax, bytes, base_uri, strict) in another syntax."""
    schema = pa.schema([("doc", pa.string()), ("text", pa.string()), ("n_errors", pa.int32())])
    out = T.StructType([T.StructField("doc", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_errors", T.IntegerType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for r in part.to_pylist():
                choice = Options(
                    input=r["syntax"] or "trig", output=output, base=r["base_uri"], lax=r["strict"] is False, **options
                )
                text, errors = convert(r["bytes"] or b"", choice)
                rows.append((r["doc"], text, len(errors)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return inputs.select("doc", "syntax", "bytes", "base_uri", "strict").mapInArrow(run, out)


def prefix_table(events: DataFrame) -> DataFrame:
    """(doc, ord, name, uri) of the prefixes that documents define, in order of first definition."""
    defined = events.where(F.col("kind") == "prefix")
    once = defined.groupBy("doc", "name").agg(F.min("seq").alias("first"), F.max_by("uri", "seq").alias("uri"))
    order = F.row_number().over(Window.partitionBy("doc").orderBy("first")) - 1
    return once.select("doc", order.alias("ord"), "name", "uri")
