"""Tokens of GQL text."""

from __future__ import annotations

import re
from dataclasses import dataclass


class GqlError(ValueError):
    """A query that can't be parsed, fails the checks or can't be carried out."""


@dataclass(frozen=True)
class Token:
    kind: str  # name, int, float, str, sym, end
    text: str
    at: int

    def is_word(self, word: str) -> bool:
        return self.kind == "name" and self.text == word


_TOKEN = re.compile(
    r"""
    (?P<space>\s+|/\*.*?\*/|--(?!>)[^\n]*)
  | (?P<float>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)
  | (?P<int>\d+)
  | '(?P<str>[^']*)'
  | `(?P<quoted>[^`]*)`
  | (?P<name>[A-Za-z_][A-Za-z0-9_]*)
  | (?P<sym><--|-->|<=|>=|<>|!=|[-+*/=<>()\[\]{},.:|&!?~;%])
    """,
    re.VERBOSE | re.DOTALL,
)


def tokenize(text: str) -> list[Token]:
    """All tokens and an end token; ``<--`` is the arrow, ``--`` anywhere else begins a comment."""
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            if text[at] == "'":
                raise GqlError(f"string that begins at {at} is not closed")
            raise GqlError(f"unexpected character {text[at]!r} at {at}")
        kind = m.lastgroup
        if kind == "quoted":
            out.append(Token("name", m["quoted"], at))
        elif kind != "space":
            out.append(Token(kind, m[kind], at))
        at = m.end()
    return [*out, Token("end", "", at)]
