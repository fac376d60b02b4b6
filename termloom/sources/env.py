"""Base URI and prefixes of a document, in the order of their definition."""

from __future__ import annotations

from termloom.functions.uri import has_scheme, resolve_text
from termloom.schema import CURIE, URI


class UnknownPrefix(KeyError):
    """A prefixed name whose prefix is not defined."""


class Env:
    """Lexical scope: relative references and prefixes mean something only within it."""

    def __init__(self, base: str | None = None) -> None:
        self.base = base
        self.prefixes: dict[str, str] = {}

    def set_base(self, uri: str | None) -> None:
        """New base, itself resolved against the old one; None clears it."""
        self.base = None if uri is None else resolve_text(uri, self.base)

    def set_prefix(self, name: str, uri: str) -> None:
        """Define a prefix; a later definition keeps the place of the first."""
        self.prefixes[name] = uri if has_scheme(uri) else resolve_text(uri, self.base)

    def split(self, curie: str) -> tuple[str, str]:
        """(namespace, rest) of a prefixed name."""
        name, colon, rest = curie.partition(":")
        if not colon or name not in self.prefixes:
            raise UnknownPrefix(curie)
        return self.prefixes[name], rest

    def expand(self, curie: str) -> str:
        """Full URI of a prefixed name."""
        return "".join(self.split(curie))

    def qualify(self, uri: str) -> tuple[str, str] | None:
        """(prefix, rest) by the first prefix defined whose namespace the URI starts with."""
        for name, namespace in self.prefixes.items():
            if uri.startswith(namespace):
                return name, uri[len(namespace) :]
        return None

    def expand_node(self, node: tuple[str, str] | None) -> tuple[str, str] | None:
        """Absolute URI node of a URI or prefixed name; None for other nodes and unknown prefixes."""
        if node is None:
            return None
        if node[0] == URI:
            return URI, resolve_text(node[1], self.base)
        if node[0] == CURIE:
            try:
                return URI, self.expand(node[1])
            except UnknownPrefix:
                return None
        return None
