"""Facts that one parse yields about one file, as plain rows.

Parsers work on the file's bytes decoded as Latin-1, so every index is a byte offset; names
are decoded as UTF-8 at the end.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

# The kinds of declarations.
KINDS = (
    "function", "method", "struct", "class", "enum", "variant", "trait", "interface", "type-alias", "const", "static", "variable",
    "field", "module", "macro", "impl", "type-parameter", "parameter",
)

SYMBOL = "kind string, name string, name_start int, name_end int, start int, end int, ext_start int, ext_end int, modifier string, depth int, ord int, container string"
TOKEN = "ord int, name string, node_kind string, start int, end int, line int, col int"
IMPORT = "ord int, start int, end int, syntax string, head string, ups int, segments array<string>, raw string, glob boolean, declares boolean, reexport boolean, alias string, binding string, stmt_start int, stmt_end int, grouped boolean, top_level boolean, is_prefix boolean, visibility string"
CALL = "start int, end int, callee_start int, callee_end int, callee string, kind string, owner_start int, owner_end int"
LEXICAL = "name string, kind string, name_start int, name_end int, scope_start int, scope_end int, visible_from int, namespace string"
SPAN = "start int, end int"
PATTERN = "pattern int, start int, end int, name string, segments array<string>, role string, shape string, bare boolean, explicit boolean, by_ref boolean, mutable boolean, branches array<struct<alt:int,branch:int,of:int>>"
FACTS = {
    "symbols": SYMBOL, "tokens": TOKEN, "imports": IMPORT, "calls": CALL, "lexical": LEXICAL,
    "highlights": SPAN + ", kind string", "signatures": SPAN + ", name_start int", "modules": SPAN + ", name string, modifier string", "uncertain": SPAN + ", name string",
    "patterns": PATTERN, "constructors": "name_start int, name string, owner string, shape string",
    "members": "object string, object_start int, name string, start int, end int, nested boolean",
    "named_imports": "local string, imported string, module string, name_start int, name_end int, reexport boolean, type_only boolean",
}


@dataclass
class Facts:
    """Lists of rows, one list a family; a row is a dict with the columns of its schema."""

    symbols: list[dict] = field(default_factory=list)
    tokens: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    lexical: list[dict] = field(default_factory=list)
    highlights: list[dict] = field(default_factory=list)
    signatures: list[dict] = field(default_factory=list)
    modules: list[dict] = field(default_factory=list)
    uncertain: list[dict] = field(default_factory=list)
    patterns: list[dict] = field(default_factory=list)
    constructors: list[dict] = field(default_factory=list)
    members: list[dict] = field(default_factory=list)
    named_imports: list[dict] = field(default_factory=list)


_item = list.__getitem__


class Lexeme(NamedTuple):
    kind: str  # word, number, string, life, mark, comment
    text: str
    start: int
    end: int


class Lexemes(list):
    """The lexemes of a file; a place beyond the last is an empty one at the file's end, so cut-off sources need no care."""

    def __init__(self, items: list[Lexeme], size: int) -> None:
        super().__init__(items)
        self.end = Lexeme("end", "", size, size)

    def __getitem__(self, i):  # noqa: ANN001, ANN204
        try:
            return _item(self, i)
        except IndexError:
            if i < 0:
                raise
            return self.end


class Partners(list):
    """Partners of brackets; a place beyond the last has none."""

    def __getitem__(self, i):  # noqa: ANN001, ANN204
        try:
            return _item(self, i)
        except IndexError:
            if i < 0:
                raise
            return -1


def named(raw: str) -> str:
    """A name cut from Latin-1 text as the UTF-8 it stands for."""
    if raw.isascii():
        return raw
    try:
        return raw.encode("latin-1").decode("utf-8", "replace")
    except UnicodeEncodeError:  # no Latin-1: decoded before
        return raw


def brackets(lexemes: list[Lexeme]) -> Partners:
    """For every bracket the index of its partner, else -1; unbalanced ones pair with the end."""
    pairs, out, stack = {")": "(", "]": "[", "}": "{"}, [-1] * len(lexemes), []
    for i, x in enumerate(lexemes):
        if x.kind != "mark":
            continue
        if x.text in "([{":
            stack.append(i)
        elif x.text in pairs:
            while stack and lexemes[stack[-1]].text != pairs[x.text]:
                out[stack.pop()] = i
            if stack:
                out[stack[-1]], out[i] = i, stack[-1]
                stack.pop()
    for i in stack:
        out[i] = len(lexemes) - 1
    return Partners(out)


class Lines:
    """Line and column of byte offsets: both from 0, columns in characters."""

    def __init__(self, raw: str) -> None:
        self.raw, self.starts = raw, [0]
        self.starts += [i + 1 for i, c in enumerate(raw) if c == "\n"]
        self.plain = raw.isascii()

    def at(self, offset: int) -> tuple[int, int]:
        from bisect import bisect_right

        line = bisect_right(self.starts, offset) - 1
        head = self.raw[self.starts[line] : offset]
        return line, len(head) if self.plain else sum(not 0x80 <= ord(c) < 0xC0 for c in head)
