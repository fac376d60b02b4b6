"""URI references in plain Python: parse, resolve, make relative, file paths."""

from __future__ import annotations

import re
from typing import NamedTuple

SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
_PARTS = re.compile(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(#.*)?", re.DOTALL)


class Parts(NamedTuple):
    """Components of a reference; absent ones are None, the fragment has its ``#``."""

    scheme: str | None
    authority: str | None
    path: str
    query: str | None
    fragment: str | None


NOTHING = Parts(None, None, "", None, None)


def has_scheme(uri: str | None) -> bool:
    """Whether the text starts with a scheme."""
    return uri is not None and SCHEME.match(uri) is not None


def parse(uri: str) -> Parts:
    """Components of a URI reference."""
    m = _PARTS.fullmatch(uri)
    return Parts(m[1], m[2], m[3], m[4], m[5])


def serialise(u: Parts) -> str:
    """A reference from its components, with a slash between an authority and a path without one."""
    out = [f"{u.scheme}:"] if u.scheme is not None else []
    if u.authority is not None:
        out.append(f"//{u.authority}")
        if u.path and u.path[0] != "/" and not u.authority.endswith("/"):
            out.append("/")
    out.append(u.path)
    if u.query is not None:
        out.append(f"?{u.query}")
    return "".join([*out, u.fragment or ""])


def _leading_dots(path: str) -> tuple[int, str]:
    """Levels up that a path starts with, and the path after its leading dot segments."""
    up = 0
    while path:
        if path.startswith(("../", "/../")) or path == "..":
            up += 1
            path = path[2 if path == ".." else 3 :]
        elif path.startswith(("./", "/./")) or path == ".":
            path = path[1 if path == "." else 2 :]
        else:
            break
    return up, path


def _directory(path: str, up: int) -> str:
    """``path`` up to its last slash, or one further up for each level, at most to its start."""
    at = len(path)
    for _ in range(up + 1):
        at = path.rfind("/", 0, at)
        if at < 0:
            return "/" if path.startswith("/") else ""
    return path[: at + 1]


def resolve(r: Parts, base: Parts) -> Parts:
    """The reference against a base (RFC 3986, 5.2.2); unchanged if the base has no scheme.

    Dot segments are removed at the start of the reference's path only.
    """
    if not base.scheme or r.scheme:
        return r
    if r.authority:
        return r._replace(scheme=base.scheme)
    if not r.path:
        query = r.query if r.query else base.query
        return Parts(base.scheme, base.authority, base.path, query, r.fragment)
    up, rest = _leading_dots(r.path)
    prefix = "" if r.path[0] == "/" else _directory(base.path, up)
    return Parts(base.scheme, base.authority, prefix + rest, r.query, r.fragment)


def resolve_text(uri: str, base: str | None) -> str:
    """A reference as absolute text, as far as the base allows."""
    if base is None or has_scheme(uri):
        return uri
    return serialise(resolve(parse(uri), parse(base)))


def _shared_slashes(uri: Parts, root: Parts) -> tuple[int, int] | None:
    """Index of the last slash shared with the root, and of the root's own next one after it."""
    if not root.scheme or root.scheme != uri.scheme or (root.authority or "") != (uri.authority or ""):
        return None
    n = next((i for i, (a, b) in enumerate(zip(uri.path, root.path)) if a != b), min(len(uri.path), len(root.path)))
    shared = uri.path.rfind("/", 0, n)
    own = shared
    if n < len(uri.path) and n < len(root.path):
        later = root.path.find("/", n)
        own = later if later >= 0 else shared
    return shared, own


def is_related(uri: Parts, root: Parts | None) -> bool:
    """Whether the URIs share a place and a leading slash."""
    found = root is not None and _shared_slashes(uri, root)
    return bool(found) and found[0] >= 0


def is_under(uri: Parts, root: Parts | None) -> bool:
    """Whether the URI lies in the root's folder, which is not the top one."""
    found = root is not None and _shared_slashes(uri, root)
    return bool(found) and found[0] > 0 and found[0] == found[1]


def relative(uri: Parts, base: Parts, root: Parts | None = None) -> str:
    """The URI as seen from the base where it is under the root (or related to the base), else in full."""
    near = is_under(uri, root) if root is not None else is_related(uri, base)
    path = ""
    if near and uri.path != base.path:
        n = next(
            (i for i, (a, b) in enumerate(zip(uri.path, base.path)) if a != b), min(len(uri.path), len(base.path))
        )
        start = max(uri.path.rfind("/", 0, n), 0) + 1
        path = "../" * base.path.count("/", start) + uri.path[start:]
    if not near or (not path and base.query is not None):
        return serialise(uri)
    tail = "" if uri.query is None else f"?{uri.query}"
    return path + tail + (uri.fragment or "")


_HEX = re.compile(r"%([0-9A-F]{2})")


def file_path(uri: str) -> tuple[str | None, str | None]:
    """(path, host) of a file URI; a path that is no URI stands for itself; else (None, None).

    ``%%`` is a percent sign; ``%`` before two upper-case hex digits is that byte; any other ``%``
    goes with the two characters after it.
    """
    rest, host = uri, None
    if has_scheme(uri):
        if not uri.startswith("file:"):
            return None, None
        rest = uri[5:]
        if rest.startswith("//"):
            end = rest.find("/", 2)
            if end < 0:
                return None, None
            host, rest = rest[2:end] or None, rest[end:]
    if re.match(r"/[A-Za-z][:|]", rest):
        rest = rest[1:]
    out, at, raw = bytearray(), 0, rest.encode("utf-8", "surrogateescape")
    while at < len(raw):
        if raw[at] != 0x25:
            out.append(raw[at])
            at += 1
        elif raw[at + 1 : at + 2] == b"%":
            out.append(0x25)
            at += 2
        else:
            m = _HEX.match(raw[at : at + 3].decode("latin-1"))
            if m:
                out.append(int(m[1], 16))
            at += 3
    return out.decode("utf-8", "surrogateescape"), host


_PLAIN_PATH = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~:/?#[]@!$&'()*+,;=")


def file_uri(path: str, host: str | None = None, escape: bool = True) -> str:
    """File URI of a path; a relative path stays one. ``%`` is doubled, other odd bytes are escaped."""
    drive = re.match(r"[A-Za-z][:|]", path) is not None
    start = f"file://{host or ''}{'/' if drive else ''}" if path.startswith("/") or drive else ""
    out = []
    for b in path.encode("utf-8", "surrogateescape"):
        if drive and b == 0x5C:
            out.append("/")
        elif b == 0x25:
            out.append("%%")
        elif not escape or b in _PLAIN_PATH:
            out.append(chr(b) if b < 0x80 else bytes([b]).decode("latin-1"))
        else:
            out.append(f"%{b:02X}")
    text = "".join(out)
    return start + (text if escape else text.encode("latin-1").decode("utf-8", "surrogateescape"))
