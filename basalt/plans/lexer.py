"""One tokenizer for all statements."""

from __future__ import annotations

import re
from typing import NamedTuple

from basalt.errors import SYNTAX, SqlError


class Token(NamedTuple):
    kind: str  # name, quoted, number, string, arg, op, end
    text: str
    at: int

    def word(self) -> str:
        return self.text.upper() if self.kind == "name" else self.text if self.kind == "op" else ""


_shape = re.compile(
    r"""(?P<space>\s+|--[^\n]*)|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|\$(?P<arg>[1-9]\d*)
    |'(?P<string>(?:[^']|'')*)'|"(?P<quoted>(?:[^"]|"")*)"|(?P<op><=|>=|<>|!=|==|::|[-+*/=<>(),;.])""",
    re.X,
)


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _shape.match(sql, at)
        if not m:
            raise SqlError(SYNTAX, f"cannot read {sql[at : at + 20]!r}")
        kind = m.lastgroup
        if kind == "string":
            out.append(Token("string", m[kind].replace("''", "'"), at))
        elif kind == "quoted":
            out.append(Token("quoted", m[kind].replace('""', '"'), at))
        elif kind != "space":
            out.append(Token(kind, m[kind], at))
        at = m.end()
    return [*out, Token("end", "", len(sql))]


def statements(sql: str) -> list[list[Token]]:
    """The token lists of the statements that ``;`` separates outside of quotes."""
    out, now = [], []
    for t in tokens(sql):
        if t.word() == ";" or t.kind == "end":
            if now:
                out.append([*now, Token("end", "", t.at)])
            now = []
        else:
            now.append(t)
    return out
