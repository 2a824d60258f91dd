"""Facts of a Rust file from its lexemes and balanced brackets.

Items are read by keyword, bodies by brackets; no full syntax tree is made. What the lexemes
cannot decide (names made by macros, receivers of method calls) is left undecided for the
queries to report as such.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from treeline.lang.model import Facts, Lexeme, Lexemes, Lines, brackets, named
from treeline.lang.patterns import references

_LEX = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*)|(?P<string>b?r(?P<hash>\#*)".*?"(?P=hash)|[bc]?"(?:\\.|[^"\\])*")|(?P<char>b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\])')"""
    r"""|(?P<life>'[A-Za-z_]\w*)|(?P<word>(?:r\#)?[A-Za-z_\x80-\xff][\w\x80-\xff]*)|(?P<number>[0-9][\w.]*?(?=\.\.|\.[A-Za-z_]|[^\w.]|\Z))|(?P<mark>::|->|=>|\.\.=?|&&|\|\||.)""",
    re.DOTALL | re.VERBOSE,
)
# Words of the language.
KEYWORDS = frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type union unsafe use where while".split()) - {"union"}
_QUALIFIERS = frozenset("async unsafe default const extern".split())
_LOCAL = frozenset("function struct enum trait type-alias const static".split())
_BLOCKS = frozenset(("{", "if", "match", "loop", "while", "for", "unsafe"))
_HEADS = {"crate": "crate", "self": "self", "super": "super", "Self": "Self"}


def lex(raw: str) -> list[Lexeme]:
    out, at = [], 0
    while at < len(raw):
        m = _LEX.match(raw, at)
        if m is None:
            at += 1
            continue
        kind, end = m.lastgroup, m.end()
        if kind == "hash":
            kind = "string"
        if kind == "comment" and m[0] == "/*":  # block comments nest
            depth, end = 1, m.end()
            while depth and end < len(raw):
                x = re.compile(r"/\*|\*/").search(raw, end)
                if x is None:
                    end = len(raw)
                    break
                depth += 1 if x[0] == "/*" else -1
                end = x.end()
        if kind != "space":
            out.append(Lexeme("string" if kind == "char" else kind, raw[at:end], at, end))
        at = max(end, at + 1)
    return out


class Parser:
    def __init__(self, raw: str) -> None:
        self.raw, self.out = raw, Facts()
        everything = lex(raw)
        self.comments = [x for x in everything if x.kind == "comment"]
        self.comment_ends = [c.end for c in self.comments]
        self.t = Lexemes([x for x in everything if x.kind != "comment"], len(raw))
        self.texts, self.size = [x.text for x in self.t], len(self.t)
        self.pair = brackets(self.t)
        self.lines = Lines(raw)
        self.statements: list[tuple[int, int]] = []
        self.work: list[tuple] = []
        self.count = 0  # of patterns
        self.arms: dict[int, tuple[int, int, int]] = {}
        self.visibility: str | None = None

    def later(self, step, *args) -> None:  # noqa: ANN001, ANN002
        self.work.append((step, args))

    # Small helpers over lexemes

    def text(self, i: int) -> str:
        return self.texts[i] if 0 <= i < self.size else ""

    def is_word(self, i: int) -> bool:
        return 0 <= i < self.size and self.t[i].kind == "word"

    def over_angles(self, i: int) -> int:
        """Index after a generic list that opens at i."""
        depth = 0
        while i < len(self.t):
            x = self.text(i)
            if x == "<":
                depth += 1
            elif x == ">":
                depth -= 1
                if not depth:
                    return i + 1
            elif x in ("(", "[", "{"):
                i = self.pair[i] if self.pair[i] > i else i
            elif x == ";":
                return i
            i += 1
        return i

    def upto(self, i: int, stops: str, end: int) -> int:
        """Index of the first stop outside brackets."""
        while i < end:
            x = self.text(i)
            if x in stops and self.t[i].kind == "mark":
                return i
            if x in ("(", "[", "{") and self.pair[i] > i:
                i = self.pair[i]
            i += 1
        return min(i, len(self.t) - 1)

    def parse(self) -> Facts:
        self.items(0, len(self.t), "", 0, True)
        while self.work:  # what lies inside is read after what is around it, so no depth of nesting is a depth of calls
            step, args = self.work.pop()
            step(*args)
        self.paths(0, len(self.t))
        self.tokens()
        self.colours()
        self.out.symbols.sort(key=lambda s: (s["start"], s["name_start"]))
        for k, s in enumerate(self.out.symbols):
            s["ord"] = k
        self.out.imports.sort(key=lambda x: (x["start"], x["end"]))
        for k, x in enumerate(self.out.imports):
            x["ord"] = k
        self.out.patterns.sort(key=lambda x: x["start"])
        self.out.calls.sort(key=lambda c: (c["callee_start"], c["start"]))
        return self.out

    def leading(self, first: int) -> int:
        """Start of the docs and attributes that belong to an item whose first lexeme is given; a blank line parts them."""
        at = self.t[first].start
        for k in range(bisect_right(self.comment_ends, at) - 1, -1, -1):
            c = self.comments[k]
            between = self.raw[c.end : at]
            if between.strip() or between.count("\n") > 1 or c.text.startswith(("//!", "/*!")):
                break
            line = self.raw[self.raw.rfind("\n", 0, c.start) + 1 : c.start]
            if line.strip():
                break
            at = c.start
        return at

    def symbol(self, kind: str, name: int, start: int, last: int, first: int, modifier: str, depth: int, container: str) -> None:
        n, end = self.t[name], self.t[min(last, len(self.t) - 1)].end
        self.out.symbols.append(
            {"kind": kind, "name": named(n.text.removeprefix("r#")), "name_start": n.start, "name_end": n.end, "start": self.t[start].start, "end": end, "ext_start": self.leading(first), "ext_end": end, "modifier": modifier or None, "depth": depth, "ord": 0, "container": container or None}
        )

    # Items

    def items(self, i: int, end: int, container: str, depth: int, top: bool) -> None:
        while i < end:
            i = max(self.item(i, end, container, depth, top), i + 1)

    def item(self, i: int, end: int, container: str, depth: int, top: bool) -> int:
        first = i
        while self.text(i) == "#" and self.text(i + 1 + (self.text(i + 1) == "!")) == "[":
            inner = self.text(i + 1) == "!"
            i = self.pair[i + 1 + inner] + 1
            if inner:
                first = i
        start, modifier = i, ""
        if self.text(i) == "pub":
            i += 1
            if self.text(i) == "(" and self.text(i + 1) in ("crate", "super", "self", "in"):
                close = self.pair[i]
                modifier = re.sub(r"\s+", " ", self.raw[self.t[start].start : self.t[close].end])
                i = close + 1
            else:
                modifier = "pub"
        while self.text(i) in _QUALIFIERS or self.is_word(i) is False and 0 <= i < end and self.t[i].kind == "string":
            if self.text(i) == "const" and self.text(i + 1) not in ("fn", "unsafe", "async", "extern"):
                break
            if self.text(i) == "extern" and self.text(i + 1) == "crate":
                break
            i += 1
        word = self.text(i)
        if i >= end:
            return end
        if word == "fn" and self.is_word(i + 1):
            stop = self.upto(i + 2, "{;", end)
            last = self.pair[stop] if self.text(stop) == "{" else stop
            kind = "method" if container else "function"
            self.symbol(kind, i + 1, start, last, first, modifier, depth, container)
            self.out.signatures.append({"start": self.t[start].start, "end": self.t[stop - 1].end, "name_start": self.t[i + 1].start})
            self.parameters(i + 2, stop, last)
            if self.text(stop) == "{":
                self.body(stop, last, i + 1, depth + 1)
            return last + 1
        if word in ("struct", "union", "enum", "trait") and self.is_word(i + 1):
            stop = self.upto(i + 2, "{;", end)
            last = self.pair[stop] if self.text(stop) == "{" else stop
            self.symbol({"union": "struct"}.get(word, word), i + 1, start, last, first, modifier, depth, container)
            self.out.signatures.append({"start": self.t[start].start, "end": self.t[stop - 1].end, "name_start": self.t[i + 1].start})
            if self.text(i + 2) == "<":
                self.generics(i + 2, last)
            name = named(self.text(i + 1))
            if word in ("struct", "union"):
                after = self.over_angles(i + 2) if self.text(i + 2) == "<" else i + 2
                self.out.constructors.append({"name_start": self.t[i + 1].start, "name": name, "owner": None, "shape": "record" if self.text(stop) == "{" else "tuple" if self.text(after) == "(" else "unit"})
            if self.text(stop) == "{":
                if word == "trait":
                    self.later(self.items, stop + 1, last, name, depth + 1, False)
                else:
                    self.later(self.members, "variant" if word == "enum" else "field", stop + 1, last, depth + 1, name)
            return last + 1
        if word == "impl":
            stop = self.upto(i + 1, "{;", end)
            last = self.pair[stop] if self.text(stop) == "{" else stop
            at = self.over_angles(i + 1) if self.text(i + 1) == "<" else i + 1
            fors = [k for k in range(at, stop) if self.text(k) == "for" and self.text(k + 1) != "<"]
            at = fors[-1] + 1 if fors else at
            name = None
            while at < stop and self.text(at) not in ("<", "where", "{"):
                if self.is_word(at) and self.text(at) not in ("dyn", "mut"):
                    name = at
                at += 1
            if name is not None:
                self.symbol("impl", name, start, last, first, modifier, depth, container)
            if self.text(i + 1) == "<":
                self.generics(i + 1, last)
            if self.text(stop) == "{":
                self.later(self.items, stop + 1, last, named(self.text(name)) if name is not None else "?", depth + 1, False)
            return last + 1
        if word == "mod" and self.is_word(i + 1):
            stop = i + 2
            last = self.pair[stop] if self.text(stop) == "{" else stop
            self.symbol("module", i + 1, start, last, first, modifier, depth, container)
            if self.text(stop) == "{":
                self.out.modules.append({"start": self.t[stop].start, "end": self.t[last].end, "name": named(self.text(i + 1)), "modifier": modifier or None})
                self.later(self.items, stop + 1, last, "", depth + 1, False)
            return last + 1
        if word in ("const", "static", "type"):
            at = i + 1 + (self.text(i + 1) == "mut")
            stop = self.upto(at, ";", end)
            if self.is_word(at):
                self.symbol({"type": "type-alias"}.get(word, word), at, start, stop, first, modifier, depth, container)
                self.calls(at, stop, None)
            return stop + 1
        if word == "use":
            stop = self.upto(i + 1, ";", end)
            self.statements.append((self.t[start].start, self.t[stop].end))
            self.visibility = modifier or None
            self.use_tree(i + 1, stop, [], (self.t[start].start, self.t[stop].end), bool(modifier), top, False)
            return stop + 1
        if word == "extern" and self.text(i + 1) == "crate":
            stop = self.upto(i + 1, ";", end)
            self.statements.append((self.t[start].start, self.t[stop].end))
            alias = named(self.text(i + 4)) if self.text(i + 3) == "as" else None
            self.visibility = modifier or None
            self.add_import(i + 2, i + 2, [named(self.text(i + 2))], (self.t[start].start, self.t[stop].end), bool(modifier), top, False, False, alias, True)
            return stop + 1
        if word == "macro_rules" and self.text(i + 1) == "!" and self.is_word(i + 2):
            last = self.pair[i + 3] if self.pair[i + 3] > 0 else i + 3
            self.symbol("macro", i + 2, start, last, first, modifier, depth, container)
            self.out.uncertain.append({"start": self.t[i + 3].start, "end": self.t[last].end, "name": named(self.text(i + 2))})
            return last + 1 + (self.text(last + 1) == ";")
        if word in ("(", "[", "{") and self.pair[i] > i:
            return self.pair[i] + 1
        if self.is_word(i) and self.text(i + 1) == "!" and self.pair[i + 2] > i:  # a macro at item level may make any names
            self.out.uncertain.append({"start": self.t[i + 2].start, "end": self.t[self.pair[i + 2]].end, "name": named(word)})
            return self.pair[i + 2] + 1
        return max(i, first) + 1

    def members(self, kind: str, i: int, end: int, depth: int, container: str) -> None:
        while i < end:
            first = i
            while self.text(i) == "#":
                i = self.pair[i + 1] + 1
            start, modifier = i, ""
            if self.text(i) == "pub":
                i += 1
                if self.text(i) == "(":
                    modifier = self.raw[self.t[start].start : self.t[self.pair[i]].end]
                    i = self.pair[i] + 1
                else:
                    modifier = "pub"
            stop = i
            while stop < end and self.text(stop) != ",":
                stop = (self.over_angles(stop) if self.text(stop) == "<" else self.pair[stop] + 1 if self.text(stop) in ("(", "[", "{") and self.pair[stop] > stop else stop + 1)
            if self.is_word(i) and (kind == "variant" or self.text(i + 1) == ":"):
                self.symbol(kind, i, start, stop - 1, first, modifier, depth, container)
                if kind == "variant":
                    self.out.constructors.append({"name_start": self.t[i].start, "name": named(self.text(i)), "owner": container, "shape": {"(": "tuple", "{": "record"}.get(self.text(i + 1), "unit")})
                if kind == "variant" and self.text(i + 1) == "{":
                    self.later(self.members, "field", i + 2, self.pair[i + 1], depth + 1, named(self.text(i)))
            i = stop + 1

    def use_tree(self, i: int, end: int, prefix: list[str], stmt: tuple[int, int], reexport: bool, top: bool, grouped: bool) -> None:
        """i..end is one use tree."""
        first, segments = i, list(prefix)
        if self.text(i) == "::":
            segments.append("::")
            i += 1
        while i < end:
            x = self.text(i)
            if x == "{":
                if len(segments) > len(prefix):
                    self.add_import(first, i - 2, segments, stmt, reexport, top, False, grouped, None, True, True)
                at, close = i + 1, self.pair[i]
                while at < close:
                    stop = self.upto(at, ",", close)
                    stop = min(stop, close)
                    if stop > at:
                        self.later(self.use_group, self.visibility, at, stop, list(segments), stmt, reexport, top)
                    at = stop + 1
                return
            if x == "*":
                self.add_import(first, i - 2 if i - 2 >= first else i, segments, stmt, reexport, top, True, grouped, None, True)
                return
            if self.is_word(i) and x != "as":
                segments.append(named(x.removeprefix("r#")))
            if x == "as":
                self.add_import(first, i - 1, segments, stmt, reexport, top, False, grouped, named(self.text(i + 1)), True)
                return
            i += 1
        if len(segments) > len(prefix):
            if grouped and segments[-1] == "self" and len(segments) > 1:
                segments.pop()
            self.add_import(first, end - 1, segments, stmt, reexport, top, False, grouped, None, True)

    def use_group(self, visibility: str | None, i: int, end: int, prefix: list[str], stmt: tuple[int, int], reexport: bool, top: bool) -> None:
        self.visibility = visibility
        self.use_tree(i, end, prefix, stmt, reexport, top, True)

    def add_import(self, first: int, last: int, segments: list[str], stmt, reexport: bool, top: bool, glob: bool, grouped: bool, alias, declares: bool, is_prefix: bool = False) -> None:  # noqa: ANN001
        head, ups, rest = "named", 0, list(segments)
        if rest and rest[0] == "::":
            head, rest = "root", rest[1:]
        elif rest and rest[0] in _HEADS:
            head = _HEADS[rest[0]]
            if head == "self":
                rest = rest[1:]
            while head in ("super", "self") and rest and rest[0] == "super":
                head, ups, rest = "super", ups + 1, rest[1:]
            if head in ("crate", "Self"):
                rest = rest[1:]
        last = max(first, last)
        span = (self.t[first].start, self.t[last].end)
        self.out.imports.append(
            {"ord": 0, "start": span[0], "end": span[1], "syntax": "scoped", "head": head, "ups": ups, "segments": rest, "raw": named("::".join(segments).replace("::::", "::")), "glob": glob, "declares": declares, "reexport": reexport, "alias": alias,
             "binding": None if glob or is_prefix else alias or (segments[-1] if segments else None), "stmt_start": stmt[0] if stmt else None, "stmt_end": stmt[1] if stmt else None, "grouped": grouped, "top_level": top, "is_prefix": is_prefix, "visibility": self.visibility if declares else None}
        )

    def paths(self, i: int, end: int) -> None:
        """Qualified paths outside import statements: the outermost of each."""
        spans = sorted(self.statements)
        begins = [a for a, _ in spans]
        while i < end:
            x = self.t[i]
            if x.kind == "word" and self.text(i + 1) == "::" and self.text(i - 1) != "::" and (x.text not in KEYWORDS or x.text in _HEADS):
                k = bisect_right(begins, x.start) - 1
                if k >= 0 and x.start < spans[k][1]:
                    i += 1
                    continue
                j, segments = i, [named(x.text)]
                while self.text(j + 1) == "::" and self.is_word(j + 2):
                    segments.append(named(self.text(j + 2)))
                    j += 2
                if len(segments) > 1:
                    self.add_import(i, j, segments, None, False, False, False, False, None, False)
                    self.out.imports[-1]["binding"] = None
                i = j
            i += 1

    # Bodies

    def generics(self, i: int, last: int) -> None:
        end, at = self.over_angles(i), i + 1
        depth = 0
        while at < end - 1:
            x = self.text(at)
            if depth == 0 and self.is_word(at) and self.text(at - 1) in ("<", ",") and x != "const":
                n = self.t[at]
                self.out.lexical.append({"name": named(x), "kind": "type-parameter", "name_start": n.start, "name_end": n.end, "scope_start": self.t[i].start, "scope_end": self.t[last].end, "visible_from": self.t[i].start, "namespace": "type"})
            depth += (x == "<") - (x == ">")
            at += 1

    def bind(self, i: int, end: int, scope: tuple[int, int], visible: int, kind: str) -> None:
        """Sites of a pattern; those that may bind are bindings, until tables find a constant or a constructor of that name."""
        number, self.count = self.count, self.count + 1
        for site in references(self, i, end):
            self.out.patterns.append({"pattern": number} | site)
            if site["bare"] and site["role"] == "identifier":
                self.out.lexical.append({"name": site["name"], "kind": kind, "name_start": site["start"], "name_end": site["end"], "scope_start": scope[0], "scope_end": scope[1], "visible_from": visible, "namespace": "value"})

    def parameters(self, i: int, stop: int, last: int) -> None:
        if self.text(i) == "<":
            self.generics(i, last)
            i = self.over_angles(i)
        if self.text(i) != "(":
            return
        at, close = i + 1, self.pair[i]
        scope = (self.t[stop].start, self.t[last].end) if self.text(stop) == "{" else (self.t[i].start, self.t[close].end)
        while at < close:
            end = at
            while end < close and self.text(end) != ",":
                end = self.over_angles(end) if self.text(end) == "<" else self.pair[end] + 1 if self.text(end) in ("(", "[", "{") and self.pair[end] > end else end + 1
            colon = next((k for k in range(at, min(end, close)) if self.text(k) == ":"), None)
            if colon is not None:
                self.bind(at, colon, scope, scope[0], "parameter")
            at = end + 1

    def body(self, open_: int, close: int, owner: int | None, depth: int) -> None:
        self.calls(open_ + 1, close, owner)
        self.later(self.block, open_, close, depth)

    def block(self, open_: int, close: int, depth: int) -> None:
        """Bindings and items of a block and of the blocks inside."""
        scope, i = (self.t[open_].start, self.t[close].end), open_ + 1
        while i < close:
            x = self.text(i)
            if x in ("fn", "struct", "enum", "trait", "impl", "mod", "use", "static", "type", "macro_rules") and self.text(i - 1) in ("{", "}", ";", "]", "pub", ")", "unsafe", "async") or x == "const" and self.text(i - 1) in ("{", "}", ";"):
                known = len(self.out.symbols)
                i = max(self.item(i, close, "", depth, False), i + 1)
                for item in self.out.symbols[known:]:  # items of a block are seen in all of it
                    if item["depth"] == depth and item["container"] is None and item["kind"] in _LOCAL:
                        spaces = ("value", "type") if item["kind"] == "struct" else ("type",) if item["kind"] in ("enum", "trait", "type-alias") else ("value",)
                        for space in spaces:
                            self.out.lexical.append({"name": item["name"], "kind": item["kind"], "name_start": item["name_start"], "name_end": item["name_end"], "scope_start": scope[0], "scope_end": scope[1], "visible_from": scope[0], "namespace": space})
                continue
            if x == "let":
                stop = self.upto(i + 1, "=;:{", close)
                after = self.upto(i + 1, ";", close)
                if self.text(i - 1) in ("if", "while", "&&"):
                    stop = self.upto(i + 1, "=", close)
                    brace = self.upto(stop, "{", close)
                    last = self.pair[brace] if self.pair[brace] > 0 else close
                    self.bind(i + 1, stop, (self.t[brace].start, self.t[last].end), self.t[brace].start, "variable")
                    i = stop
                else:
                    stop = next((k for k in range(i + 1, after) if self.text(k) in ("=", ":") and self.t[k].kind == "mark"), after)
                    self.bind(i + 1, stop, scope, self.t[after].end, "variable")
                    i = stop
            elif x == "for" and self.text(i + 1) != "<":
                into = next((k for k in range(i + 1, close) if self.text(k) in ("in", "{")), close)
                if self.text(into) == "in":
                    brace = self.upto(into, "{", close)
                    last = self.pair[brace] if self.pair[brace] > 0 else close
                    self.bind(i + 1, into, (self.t[brace].start, self.t[last].end), self.t[brace].start, "variable")
                    i = into
            elif x == "match":
                brace = self.upto(i + 1, "{", close)
                if self.text(brace) == "{" and self.pair[brace] > brace:
                    self.match_arms(brace, self.pair[brace])
            elif x == "=>" and i in self.arms:
                first, guard, stop = self.arms[i]
                self.bind(first, guard, (self.t[first - 1].end, self.t[stop].end), self.t[guard].start, "variable")
            elif x == "{" and self.pair[i] > i:
                self.later(self.block, i, self.pair[i], depth + 1)
                i = self.pair[i]
            elif x == "!" and self.is_word(i - 1) and self.text(i + 1) in ("(", "[", "{") and self.pair[i + 1] > i:
                self.out.uncertain.append({"start": self.t[i + 1].start, "end": self.t[self.pair[i + 1]].end, "name": named(self.text(i - 1))})
            i += 1

    def match_arms(self, open_: int, close: int) -> None:
        """For the arrow of every arm: first lexeme of the pattern, its guard or the arrow, last lexeme of the body."""
        at = open_ + 1
        while at < close:
            arrow = at
            while arrow < close and self.text(arrow) != "=>":
                arrow = self.pair[arrow] + 1 if self.text(arrow) in ("(", "[", "{") and self.pair[arrow] > arrow else arrow + 1
            if arrow >= close:
                return
            while self.text(at) == "#" and self.pair[at + 1] > at:  # attributes of the arm
                at = self.pair[at + 1] + 1
            guard = at
            while guard < arrow and self.text(guard) != "if":
                guard = self.pair[guard] + 1 if self.text(guard) in ("(", "[", "{") and self.pair[guard] > guard else guard + 1
            stop, blocks = arrow + 1, self.text(arrow + 1) in _BLOCKS
            while stop < close and self.text(stop) != ",":
                if self.text(stop) in ("(", "[", "{") and self.pair[stop] > stop:
                    stop = self.pair[stop]
                    # A body that is a block needs no comma after it.
                    if blocks and self.text(stop) == "}" and (self.text(stop + 1) not in ("else", ".", "?", ",", "as") or stop + 1 >= close):
                        break
                stop += 1
            self.arms[arrow] = (at, min(guard, arrow), min(stop, close))
            at = stop + 1 + (self.text(stop) == "}" and self.text(stop + 1) == ",")

    def calls(self, i: int, end: int, owner: int | None) -> None:
        o = self.t[owner] if owner is not None else None
        k = i
        while k < end:
            if self.text(k) == "fn" and self.is_word(k + 1):  # its own calls are its own
                stop = self.upto(k + 2, "{;", end)
                k = (self.pair[stop] if self.text(stop) == "{" else stop) + 1
                continue
            if self.text(k) == "(" and k > i and self.pair[k] > k:
                callee = k - 1
                if self.text(callee) == ">":
                    back = callee
                    while back > i and self.text(back) != "<":
                        back -= 1
                    callee = back - 2 if self.text(back - 1) == "::" else back - 1
                x = self.t[callee] if callee >= 0 else None
                kind = None
                if x is not None and x.kind == "word" and x.text not in KEYWORDS:
                    kind = "member" if self.text(callee - 1) == "." else "direct"
                elif x is not None and x.text in (")", "]") and callee == k - 1:
                    kind = "indirect"
                if kind:
                    first = callee
                    while self.text(first - 1) == "::" and self.is_word(first - 2):
                        first -= 2
                    self.out.calls.append(
                        {"start": self.t[first].start, "end": self.t[self.pair[k]].end, "callee_start": x.start, "callee_end": x.end, "callee": named(x.text) if kind != "indirect" else None, "kind": kind, "owner_start": o.start if o else None, "owner_end": o.end if o else None}
                    )
            k += 1

    # Lists over all lexemes

    def tokens(self) -> None:
        kept = [x for x in self.t if x.kind == "word" and x.text not in KEYWORDS]
        for k, x in enumerate(kept):
            line, col = self.lines.at(x.start)
            name = named(x.text.removeprefix("r#"))
            kind = "type_identifier" if name[:1].isupper() and not name.isupper() else "identifier"
            self.out.tokens.append({"ord": k, "name": name, "node_kind": kind, "start": x.start, "end": x.end, "line": line, "col": col})

    def colours(self) -> None:
        kinds = {"string": "string", "number": "number", "life": "type"}
        for x in sorted([*self.t, *self.comments], key=lambda x: x.start):
            kind = "comment" if x.kind == "comment" else kinds.get(x.kind) or ("keyword" if x.text in KEYWORDS else None)
            if kind:
                self.out.highlights.append({"start": x.start, "end": x.end, "kind": kind})


def facts(text: str) -> Facts:
    """All facts of a file's text."""
    return Parser(text.encode().decode("latin-1")).parse()
