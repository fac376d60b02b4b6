"""Files of any file system that Arrow opens: local and shared folders, HDFS and object stores.

A path is a local path or a URI (``file:``, ``hdfs:``, ``s3:``, ``gs:``, ``abfs:``); the driver and the workers open
it alike, so nothing depends on a disk of one machine unless the path is one.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

from pyarrow import fs

BLOCK = 1 << 18
_REMOTE = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]+://")


def local_path(path: str) -> str:
    """Path of a local file given as a path or file URI."""
    return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")


def opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what a path in it has before it) of a path or URI."""
    if not _REMOTE.match(path) or path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(local_path(path)), ""
    scheme = path.partition("://")[0]
    uri = re.sub("^s3[an]:", "s3:", path)
    system, inside = fs.FileSystem.from_uri(re.sub(r"[*?\[].*$", "", uri))  # a pattern is no part of a URI
    before = path[: path.index(inside)] if inside in path else scheme + "://"
    return system, path[len(before) :], before


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a path, folder or pattern in order of name; hidden ones are left out."""
    system, inside, before = opened(path)
    info = system.get_file_info(inside) if not re.search(r"[*?\[]", inside) else None
    if info is not None and info.type == fs.FileType.File:
        return [(before + inside, info.size)]
    if info is not None and info.type == fs.FileType.Directory:
        found = [f for f in system.get_file_info(fs.FileSelector(inside)) if not f.base_name.startswith(("_", "."))]
    else:
        folder = re.sub(r"/[^/]*$", "", re.split(r"[*?\[]", inside, maxsplit=1)[0]) or "/"
        deep = "/" in inside[len(folder) + 1 :]
        try:
            inner = system.get_file_info(fs.FileSelector(folder, recursive=deep))
        except FileNotFoundError:
            inner = []
        parts = inside.split("/")
        same = lambda p: len(p) == len(parts) and all(map(fnmatch.fnmatchcase, p, parts))
        found = [f for f in inner if same(f.path.split("/"))]
    files = sorted((before + f.path, f.size) for f in found if f.type == fs.FileType.File)
    if not files and (info is None or info.type == fs.FileType.NotFound):
        raise FileNotFoundError(path)
    return files


def file_blocks(path: str, start: int = 0, end: int | None = None, size: int = BLOCK) -> Iterator[bytes]:
    """Contents of a file, or of a range of its bytes, in blocks."""
    system, inside, _ = opened(path)
    with system.open_input_file(inside) as f:
        f.seek(start)
        while (left := size if end is None else min(size, end - start)) > 0 and (block := f.read(left)):
            start += len(block)
            yield block


def line_blocks(path: str, start: int, end: int, size: int = BLOCK) -> Iterator[bytes]:
    """Whole lines of a file that begin in a range of bytes, in blocks."""
    skipping, last = start > 0, b"\n"
    for block in file_blocks(path, start - 1 if skipping else 0, end, size):
        last = block[-1:]
        if skipping:  # what the range before holds
            at = block.find(b"\n") + 1
            if not at:
                continue
            block, skipping = block[at:], False
        if block:
            yield block
    if skipping:
        return
    if last != b"\n" and end > start:
        for block in file_blocks(path, end, None, 1 << 12):
            at = block.find(b"\n") + 1
            yield block[:at] if at else block
            if at:
                return
