"""Streams of document pieces: incremental parsing with state per stream.

Pieces of many documents arrive in any mix of sources; each stream's unfinished text, base, prefixes and
blank-node numbering are Spark state keyed by the stream, so a restarted query goes on where it was.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from termloom.functions.columns import number_datatype
from termloom.operators.documents import read_documents
from termloom.schema import EVENT
from termloom.sources.events import event_row
from termloom.sources.lines import read_lines
from termloom.sources.reading import Reading

STATE = T.StructType([T.StructField("rest", T.BinaryType()), T.StructField("next", T.LongType()), T.StructField("reading", T.StringType())])


def resume(syntax: str, stream: str | None, options: dict[str, str], state: tuple | None) -> tuple[Reading, int]:
    """A reading in the state that was kept, and the number of the piece it waits for."""
    if state is None:
        return Reading(syntax, stream, options), 0
    rest, wanted, kept = state
    reading = Reading(syntax, stream, options, json.loads(kept))
    reading.parser.text = bytes(rest).decode("utf-8", "surrogateescape")
    return reading, wanted


def suspend(reading: Reading, wanted: int = 0) -> tuple[bytes, int, str]:
    """What has to be kept of a reading between pieces."""
    kept = json.dumps(reading.state())
    return reading.rest(), wanted, kept


def parse_stream(pieces: DataFrame, syntax: str = "turtle", strict: bool = False, **options: str) -> DataFrame:
    """Events of a streaming table (stream, n, bytes, final), with the reading options of the sources.

    Pieces of one stream that arrive in one trigger are taken in order of ``n``; those that come in
    order from the next number on are read as they come, only others wait for the end of the trigger.
    A null ``final`` is false. Items come out as soon as they are complete; what is left waits in the
    state, which is one unfinished item. Null bytes add nothing. A NUL byte between items is skipped.
    Without a ``base``, references stay relative.
    """
    chosen = {"mode": "STRICT" if strict else "PERMISSIVE"} | {k.lower(): v for k, v in options.items()}

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reading, wanted = resume(syntax, None, chosen, state.get if state.exists else None)
        waiting: list[tuple[int, bytes]] = []
        final = False

        def read(data: bytes, last: bool = False) -> Iterator[pd.DataFrame]:
            rows = [event_row(key[0], n, e) for n, e in reading.feed(data, last)]
            if rows:
                yield pd.DataFrame(rows, columns=EVENT.names).astype(object)

        for frame in frames:
            final = final or bool(frame["final"].fillna(False).astype(bool).any())
            for n, data in zip(frame["n"], frame["bytes"]):
                if n == wanted and not waiting:
                    wanted += 1
                    yield from read(data or b"")
                else:
                    waiting.append((n, data or b""))
        for n, data in sorted(waiting, key=lambda x: x[0]):
            wanted = max(wanted, n + 1)
            yield from read(data)
        if final:
            yield from read(b"", True)
            state.remove()
        else:
            state.update(suspend(reading, int(wanted)))

    slim = pieces.select("stream", "n", "bytes", "final")
    return slim.groupBy("stream").applyInPandasWithState(run, EVENT, STATE, "append", GroupStateTimeout.NoTimeout)


def stream_files(spark: SparkSession, folder: str, syntax: str | None = None, pattern: str = "*", **options: str) -> DataFrame:
    """Events of the files that arrive in a folder, each a document; any file system that Spark reads."""
    files = "path string, modificationTime timestamp, length bigint, content binary"
    rows = spark.readStream.format("binaryFile").schema(files).option("pathGlobFilter", pattern).load(folder)
    documents = rows.select(
        F.col("path").alias("doc"), F.lit(syntax).cast("string").alias("syntax"), F.col("content").alias("bytes"),
        F.col("path").alias("base_uri"), F.lit(False).alias("strict"),
    )
    return read_documents(documents, **options)


def line_stream(lines: DataFrame, syntax: str = "nquads", column: str = "value") -> DataFrame:
    """Statements and errors of a streaming table of lines, without state."""
    return read_lines(lines, syntax, column=column)


def split_frames(frames: DataFrame, column: str) -> DataFrame:
    """One row per piece of NUL-delimited frames; empty pieces are dropped."""
    keys = [c for c in frames.columns if c != column]
    pieces = F.explode(F.split(F.col(column), "\\x00"))
    return frames.select(*keys, pieces.alias(column)).where(F.col(column) != "")


def typed_view(statements: DataFrame, value: str = "object", datatype: str = "o_datatype") -> DataFrame:
    """Statements with ``number``: the value of numeric literals, null for others."""
    kind = F.coalesce(F.col(datatype), number_datatype(F.col(value)))
    numeric = kind.rlike("#(integer|decimal|double|float|int|long)$")
    return statements.withColumn("number", F.when(numeric, F.col(value).try_cast("double")))
