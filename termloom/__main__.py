"""Command line: read one document, write it in another syntax.

python -m termloom [OPTION]... INPUT [BASE_URI]
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Iterator

from termloom import __version__
from termloom.functions.uri import file_path, file_uri, has_scheme
from termloom.plans.transcode import Options, Outcome, transcode
from termloom.schema import SYNTAXES, syntax_of


def arguments() -> argparse.ArgumentParser:
    """Options of the command."""
    p = argparse.ArgumentParser(prog="termloom", description="Read and write RDF syntax. Use - for INPUT to read standard input.")
    p.add_argument("-a", dest="ascii", action="store_true", help="write ASCII output")
    p.add_argument("-b", dest="bulk", action="store_true", help="write in large blocks")
    p.add_argument("-c", dest="chop", default="", metavar="PREFIX", help="chop PREFIX from matching blank node IDs")
    p.add_argument("-e", dest="bytewise", action="store_true", help="read input one character at a time")
    p.add_argument("-f", dest="full", action="store_true", help="keep full URIs in input")
    p.add_argument("-i", dest="input", type=str.lower, choices=SYNTAXES, help="input syntax")
    p.add_argument("-l", dest="lax", action="store_true", help="lax (non-strict) parsing")
    p.add_argument("-o", dest="output", type=str.lower, choices=SYNTAXES, help="output syntax")
    p.add_argument("-p", dest="add", default="", metavar="PREFIX", help="add PREFIX to blank node IDs")
    p.add_argument("-q", dest="quiet", action="store_true", help="suppress all output except data")
    p.add_argument("-r", dest="root", metavar="ROOT_URI", help="keep relative URIs within ROOT_URI")
    p.add_argument("-s", dest="text", action="store_true", help="INPUT is the document itself")
    p.add_argument("-v", "--version", action="version", version=f"termloom {__version__}")
    p.add_argument("source", metavar="INPUT")
    p.add_argument("base", nargs="?", metavar="BASE_URI")
    return p


def blocks(stream: object, size: int) -> Iterator[bytes]:
    """Bytes of a stream in blocks."""
    while data := stream.read(size):
        yield data


def main(argv: list[str] | None = None) -> int:
    """Run the command; 0 if all went well, 1 after an error, 2 where the input cannot be read."""
    o = arguments().parse_args(argv)
    base, stream = o.base, None
    try:
        if o.text:
            data = iter([o.source])
        elif o.source == "-":
            data = blocks(sys.stdin.buffer, 1 if o.bytewise else 1 << 16)
        else:
            path = file_path(o.source)[0] if has_scheme(o.source) else o.source
            if path is None:
                raise OSError(f"unsupported URI {o.source}")
            stream = open(path, "rb")  # noqa: SIM115
            data = blocks(stream, 1 if o.bytewise else 1 << 16)
            base = base or file_uri(os.path.abspath(path))
    except OSError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    syntax = o.input or ("trig" if o.text or o.source == "-" else syntax_of(o.source))
    options = Options(syntax, o.output, base, o.ascii, o.full, o.lax, o.root, o.add, o.chop)
    outcome = Outcome([])
    try:
        for text in transcode(data, options, outcome):
            sys.stdout.buffer.write(text.encode("utf-8", "surrogateescape"))
        sys.stdout.buffer.flush()
    except OSError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    finally:
        if stream is not None:
            stream.close()
    if not o.quiet:
        for _, line, col, message in outcome.errors:
            print(f"error: {o.source if not o.text else '(string)'}:{line}:{col}: {message}", file=sys.stderr)
    return 1 if outcome.errors and not o.lax else 0


if __name__ == "__main__":
    sys.exit(main())
