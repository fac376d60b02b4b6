"""Lexical forms: character classes, escapes, numbers, base64, in plain Python."""

from __future__ import annotations

import base64 as _b64
import math
import re
from decimal import ROUND_HALF_UP, Decimal

# Character classes of the grammars, as published with them (fixed values).
CHARS_BASE = (
    "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02ff\u0370-\u037d\u037f-\u1fff\u200c-\u200d\u2070-\u218f\u2c00-\u2fef"
    "\u3001-\ud7ff\uf900-\ufdcf\ufdf0-\ufffd\U00010000-\U000effff"
)
CHARS_U = CHARS_BASE + "_"
CHARS = CHARS_U + "0-9\\-\u00b7\u0300-\u036f\u203f-\u2040"
LOCAL_ESCAPABLE = "_~.\\-!$&'()*+,;=/?#@%"

_ESCAPE = re.compile(r"\\(?:([tbnrf\"'\\])|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|)")
_SIMPLE = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class BadEscape(ValueError):
    """An escape that stands for no character; ``at`` is its offset."""

    def __init__(self, message: str, at: int) -> None:
        super().__init__(message)
        self.at = at


def code_point(digits: str, at: int, lax: bool) -> str:
    """Character of an escape's hex digits; U+FFFD for impossible ones in lax mode."""
    code = int(digits, 16)
    if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF:
        if lax:
            return "\ufffd"
        raise BadEscape(f"unicode character 0x{code:X} out of range", at)
    return chr(code)


def unescape(text: str, lax: bool = False) -> str:
    """Text of a literal's body. Raises BadEscape at the first bad escape."""
    if "\\" not in text:
        return text

    def one(m: re.Match) -> str:
        if m[1]:
            return _SIMPLE[m[1]]
        if m[2] or m[3]:
            return code_point(m[2] or m[3], m.start(), lax)
        raise BadEscape("bad escape", m.start() + 1)

    return _ESCAPE.sub(one, text)


_UCHAR = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|)")


def unescape_iri(text: str, lax: bool = False) -> str:
    """Text of an IRI's body, which has numeric escapes only."""
    if "\\" not in text:
        return text

    def one(m: re.Match) -> str:
        if not (m[1] or m[2]):
            raise BadEscape("bad IRI escape", m.start())
        c = code_point(m[1] or m[2], m.start(), lax)
        if c in " <>":
            raise BadEscape(f"invalid escaped IRI character U+{ord(c):04X}", m.start())
        return c

    return _UCHAR.sub(one, text)


def u_escape(code: int) -> str:
    """Numeric escape of a character."""
    return f"\\u{code:04X}" if code <= 0xFFFF else f"\\U{code:08X}"


def local_name(text: str, ascii_only: bool = False) -> str:
    """A prefix or local name as written: escaped with a backslash where that exists, else by percent."""
    del ascii_only
    out = []
    for i, c in enumerate(text):
        first, last = i == 0, i == len(text) - 1
        if c == ":" or _is(c, _U) or ("0" <= c <= "9"):
            out.append(c)
        elif not first and (_is(c, _MIDDLE) or (c == "." and not last)):
            out.append(c)
        elif c in _LOCAL_ESC:
            out.append("\\" + c)
        else:
            out.append("".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogateescape")))
    return "".join(out)


_U, _MIDDLE = re.compile(f"[{CHARS_U}]"), re.compile(f"[{CHARS}]")
_LOCAL_ESC = frozenset(LOCAL_ESCAPABLE.replace("\\", ""))


def _is(c: str, pattern: re.Pattern) -> bool:
    return pattern.match(c) is not None


def new_decimal(value: float, frac_digits: int = 8) -> str | None:
    """Decimal text with at most ``frac_digits`` places, at least one kept; None for NaN and infinity."""
    if math.isnan(value) or math.isinf(value):
        return None
    exact = Decimal(repr(value)) if isinstance(value, float) else Decimal(value)
    text = f"{exact.quantize(Decimal(1).scaleb(-frac_digits), rounding=ROUND_HALF_UP):f}"
    whole, _, frac = text.partition(".")
    return f"{whole}.{frac.rstrip('0') or '0'}"


_NUMBER = re.compile(r"\s*([+-]?)([0-9]*)(?:(\.)([0-9]*))?(?:[eE]([+-]?[0-9]+))?")


def strtod(text: str) -> tuple[float, int]:
    """(value, characters read) of the number at the start of a text; (0.0, 0) if there is none."""
    m = _NUMBER.match(text)
    if not m or not (m[2] or m[4]):
        return 0.0, 0
    number = f"{m[1]}{m[2] or '0'}.{m[4] or '0'}e{m[5] or '0'}"
    return float(number), m.end()


def base64_text(data: bytes, wrap: bool = False) -> str:
    """Base64 of bytes; with ``wrap`` a newline after every 76 characters."""
    text = _b64.b64encode(data).decode("ascii")
    return "\n".join(text[i : i + 76] for i in range(0, len(text), 76)) if wrap else text


def base64_bytes(text: str) -> bytes:
    """Bytes of base64 text; characters outside the alphabet are skipped, a cut last unit gives what it has."""
    letters = re.sub(r"[^A-Za-z0-9+/]", "", text)
    letters = letters[: len(letters) - 1] if len(letters) % 4 == 1 else letters
    return _b64.b64decode(letters + "=" * (-len(letters) % 4))
