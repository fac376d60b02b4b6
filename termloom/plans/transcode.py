"""One document from one syntax to another, with the options of a command line."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from termloom.schema import syntax_of
from termloom.sources.env import Env
from termloom.sources.parser import Parser, parse_blocks
from termloom.sources.writer import Style, WriteFault, Writer


@dataclass(frozen=True)
class Options:
    """Options of a conversion; ``output`` defaults to the line syntax of the input's kind."""

    input: str = "turtle"
    output: str | None = None
    base: str | None = None
    ascii: bool = False
    full_uris: bool = False
    lax: bool = False
    root: str | None = None
    blank_prefix: str = ""
    chop_prefix: str = ""

    @property
    def target(self) -> str:
        return self.output or ("ntriples" if self.input in ("turtle", "ntriples") else "nquads")

    @property
    def style(self) -> Style:
        ascii_only = self.ascii or self.target == "ntriples"
        curied = not ascii_only and self.target == "turtle" and not self.full_uris
        return Style(ascii_only, curied, curied or self.input in ("turtle", "trig"), not self.lax)

    @staticmethod
    def for_path(path: str, **options: object) -> Options:
        """Options with the input syntax told by the extension."""
        return Options(**{"input": syntax_of(path), **options})


@dataclass
class Outcome:
    """Errors met while converting; the text comes from the iterator."""

    errors: list[tuple[int, int, int, str]]


def transcode(blocks: Iterable[bytes | str], options: Options, outcome: Outcome | None = None) -> Iterator[str]:
    """Pieces of the output for an input given in blocks, in constant memory.

    Stops at the first error in strict mode; what was written before it stays.
    """
    errors = outcome.errors if outcome is not None else []
    parser = Parser(options.input, not options.lax, options.blank_prefix)
    writer = Writer(options.target, Env(options.base), options.style, options.root, options.chop_prefix)
    for event in parse_blocks(parser, blocks):
        if event[0] == "error":
            errors.append(event[1:])
            if not options.lax:
                break
            continue
        try:
            writer.event(event)
        except WriteFault as fault:
            errors.append((fault.status, parser.line, parser.col, str(fault)))
            if not options.lax:
                break
        if len(writer.out) > 500:
            yield writer.text()
    writer.finish()
    yield writer.text()


def convert(data: bytes | str, options: Options) -> tuple[str, list[tuple[int, int, int, str]]]:
    """(text, errors) of a whole document."""
    outcome = Outcome([])
    return "".join(transcode([data], options, outcome)), outcome.errors
