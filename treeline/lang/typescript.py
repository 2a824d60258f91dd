"""Facts of a TypeScript file (also its JSX form) from lexemes and balanced brackets."""

from __future__ import annotations

import re

from treeline.lang.model import Facts, Lexeme, Lexemes, Lines, brackets, named

_LEX = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<tick>`)|(?P<word>[A-Za-z_$\x80-\xff\#][\w$\x80-\xff]*)|(?P<number>[0-9][\w.]*)|(?P<mark>=>|\.\.\.|===?|!==?|&&|\|\||\?\.|\?\?|.)""",
    re.DOTALL | re.VERBOSE,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
# Words of the language, and its module file extensions in probing order.
KEYWORDS = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield let static implements interface package private protected public async await of".split()
)
EXTENSIONS = ("ts", "tsx", "d.ts", "js", "jsx", "mts", "cts")
_MEMBER_WORDS = frozenset("public private protected static readonly abstract override async get set declare".split())


def lex(raw: str) -> list[Lexeme]:
    out, at = [], 0
    while at < len(raw):
        m = _LEX.match(raw, at)
        if m is None:
            at += 1
            continue
        kind, end = m.lastgroup, m.end()
        if kind == "tick":  # a template with its inserts is one lexeme
            kind, depth = "string", 0
            while end < len(raw):
                c = raw[end]
                end += 2 if c == "\\" else 1
                if c == "$" and raw[end : end + 1] == "{":
                    depth, end = depth + 1, end + 1
                elif c == "}" and depth:
                    depth -= 1
                elif c == "`" and not depth:
                    break
        elif m[0] == "/" and (not out or out[-1].kind == "mark" and out[-1].text not in ")]}" or out[-1].text in ("return", "typeof", "case")):
            if r := _REGEX.match(raw, at):
                kind, end = "string", r.end()
        if kind != "space":
            out.append(Lexeme(kind, raw[at:end], at, end))
        at = end
    return out


class Parser:
    def __init__(self, raw: str) -> None:
        self.raw, self.out = raw, Facts()
        everything = lex(raw)
        self.comments = [x for x in everything if x.kind == "comment"]
        self.t = Lexemes([x for x in everything if x.kind != "comment"], len(raw))
        self.texts, self.size = [x.text for x in self.t], len(self.t)
        self.pair = [*brackets(self.t), -1, -1, -1, -1]
        self.lines = Lines(raw)
        self.work: list[tuple] = []

    def text(self, i: int) -> str:
        return self.texts[i] if 0 <= i < self.size else ""

    def is_word(self, i: int) -> bool:
        return 0 <= i < self.size and self.t[i].kind == "word"

    def upto(self, i: int, stops: tuple[str, ...], end: int) -> int:
        while i < end:
            if self.text(i) in stops and self.t[i].kind != "string":
                return i
            i = self.pair[i] + 1 if self.text(i) in ("(", "[", "{") and self.pair[i] > i else i + 1
        return min(i, max(0, len(self.t) - 1))

    def statement_end(self, i: int, end: int) -> int:
        """Index of the last lexeme of a statement: a semicolon, or the lexeme before a line that begins a new one."""
        while i < end:
            if self.text(i) == ";":
                return i
            if self.text(i) in ("(", "[", "{") and self.pair[i] > i:
                i = self.pair[i]
            nxt = i + 1
            if nxt >= end:
                return i
            if "\n" in self.raw[self.t[i].end : self.t[nxt].start] and self.text(i) not in ("=", ",", "=>", "(", "|", "&", "+", ".", "?", ":") and self.text(nxt) not in (".", "=", "?", ":", ")", "]", "}", "|", "&", "+", "=>", "?.", ",", "&&", "||", "??"):
                return i
            i = nxt
        return min(i, len(self.t) - 1)

    def parse(self) -> Facts:
        self.block(0, len(self.t), "", 0, True, (0, len(self.raw)), None)
        while self.work:  # blocks inside are read after those around them, so no depth of nesting is a depth of calls
            step, args = self.work.pop()
            step(*args)
        self.dynamic_imports()
        self.member_names()
        kept = [x for x in self.t if x.kind == "word" and x.text not in KEYWORDS]
        for k, x in enumerate(kept):
            line, col = self.lines.at(x.start)
            self.out.tokens.append({"ord": k, "name": named(x.text), "node_kind": "type_identifier" if x.text[:1].isupper() else "identifier", "start": x.start, "end": x.end, "line": line, "col": col})
        kinds = {"string": "string", "number": "number", "comment": "comment"}
        for x in sorted([*self.t, *self.comments], key=lambda x: x.start):
            if kind := kinds.get(x.kind) or ("keyword" if x.text in KEYWORDS else None):
                self.out.highlights.append({"start": x.start, "end": x.end, "kind": kind})
        for name, key in (("symbols", lambda s: (s["start"], s["name_start"])), ("imports", lambda s: (s["start"], s["end"]))):
            rows = getattr(self.out, name)
            rows.sort(key=key)
            for k, s in enumerate(rows):
                s["ord"] = k
        self.out.calls.sort(key=lambda c: (c["callee_start"], c["start"]))
        return self.out

    def leading(self, first: int) -> int:
        at = self.t[first].start
        for c in reversed([c for c in self.comments if c.end <= at]):
            between = self.raw[c.end : at]
            if between.strip() or between.count("\n") > 1 or self.raw[self.raw.rfind("\n", 0, c.start) + 1 : c.start].strip():
                break
            at = c.start
        return at

    def symbol(self, kind: str, name: int, start: int, last: int, first: int, modifier: str, depth: int, container: str) -> None:
        n, end = self.t[name], self.t[min(last, len(self.t) - 1)].end
        text = n.text.strip("\"'") if n.kind == "string" else n.text
        self.out.symbols.append(
            {"kind": kind, "name": named(text), "name_start": n.start, "name_end": n.end, "start": self.t[start].start, "end": end, "ext_start": self.leading(first), "ext_end": end, "modifier": modifier or None, "depth": depth, "ord": 0, "container": container or None}
        )

    def lexical(self, i: int, kind: str, scope: tuple[int, int], visible: int, space: str = "value") -> None:
        n = self.t[i]
        self.out.lexical.append({"name": named(n.text), "kind": kind, "name_start": n.start, "name_end": n.end, "scope_start": scope[0], "scope_end": scope[1], "visible_from": visible, "namespace": space})

    def pattern(self, i: int, end: int, kind: str, scope: tuple[int, int], visible: int) -> list[int]:
        """Names that a binding pattern i..end binds."""
        out = []
        if self.text(i) in ("{", "["):
            at, close = i + 1, self.pair[i]
            while at < close:
                stop = self.upto(at, (",",), close)
                stop = min(stop, close)
                at += self.text(at) == "..."
                if self.text(i) == "{" and self.text(at + 1) == ":":
                    out += self.pattern(at + 2, stop, kind, scope, visible)
                elif at < stop:
                    out += self.pattern(at, stop, kind, scope, visible)
                at = stop + 1
        elif self.is_word(i) and self.text(i) not in KEYWORDS:
            self.lexical(i, kind, scope, visible)
            out.append(i)
        return out

    # Statements

    def block(self, i: int, end: int, container: str, depth: int, top: bool, scope: tuple[int, int], owner: int | None) -> None:
        while i < end:
            i = max(self.statement(i, end, container, depth, top, scope, owner), i + 1)

    def statement(self, i: int, end: int, container: str, depth: int, top: bool, scope: tuple[int, int], owner: int | None) -> int:
        first, modifier = i, ""
        while self.text(i) == "@" and self.is_word(i + 1):
            i += 2
            if self.text(i) == "(":
                i = self.pair[i] + 1
        if self.text(i) == "import" and self.text(i + 1) != "(":
            return self.import_(i, end, top)
        if self.text(i) == "export":
            if self.text(i + 1) in ("{", "*") or self.text(i + 1) == "type" and self.text(i + 2) in ("{", "*"):
                return self.reexport(i, end, top)
            modifier = "export default" if self.text(i + 1) == "default" else "export"
            i += 1 + (modifier == "export default")
        start = first if modifier else i
        while self.text(i) in ("declare", "abstract") and self.is_word(i + 1) or self.text(i) == "async" and self.text(i + 1) == "function":
            i += 1
        word = self.text(i)
        if word == "function":
            name = i + 1 + (self.text(i + 1) == "*")
            return self.function(name, start, end, first, "function", modifier, depth, container, scope)
        if word == "class" or word == "interface" and self.is_word(i + 1):
            brace = self.upto(i + 1, ("{",), end)
            last = self.pair[brace] if self.pair[brace] > 0 else brace
            name = named(self.text(i + 1)) if self.is_word(i + 1) and self.text(i + 1) not in ("extends", "implements") else ""
            if name:
                self.symbol(word, i + 1, start, last, first, modifier, depth, container)
                self.out.signatures.append({"start": self.t[start].start, "end": self.t[brace - 1].end, "name_start": self.t[i + 1].start})
                if not top:
                    self.lexical(i + 1, word, scope, scope[0], "type" if word == "interface" else "value")
            if self.text(i + 2) == "<":
                self.generics(i + 2, last)
            self.work.append((self.members, (brace + 1, last, depth + 1, name)))
            return last + 1
        if word == "enum" and self.is_word(i + 1) or word == "const" and self.text(i + 1) == "enum":
            i += word == "const"
            last = self.pair[i + 2] if self.pair[i + 2] > 0 else i + 2
            self.symbol("enum", i + 1, start, last, first, modifier, depth, container)
            at = i + 3
            while at < last:
                stop = min(self.upto(at, (",",), last), last)
                if self.is_word(at) or 0 <= at < last and self.t[at].kind == "string":
                    self.symbol("variant", at, at, stop - 1, at, "", depth + 1, named(self.text(i + 1)))
                at = stop + 1
            return last + 1
        if word == "type" and self.is_word(i + 1) and self.text(i + 2) in ("=", "<"):
            last = self.statement_end(i, end)
            self.symbol("type-alias", i + 1, start, last, first, modifier, depth, container)
            if self.text(i + 2) == "<":
                self.generics(i + 2, last)
            return last + 1
        if word in ("const", "let", "var"):
            last = self.statement_end(i, end)
            at = i + 1
            while at <= last and self.text(at) != ";":
                stop = min(self.upto(at, (",", ";"), last + 1), last + 1)
                equals = next((k for k in range(at, stop) if self.text(k) in ("=", ":") and not (self.pair[at] > k > at)), stop)
                visible = scope[0] if word == "var" else self.t[min(stop, last)].end
                names = self.pattern(at, equals, "variable", scope, visible)
                if top:
                    del self.out.lexical[len(self.out.lexical) - len(names) :]
                    for n in names:
                        self.symbol("variable", n, at, stop - 1 if stop <= last else last, first if modifier else at, modifier, depth, container)
                self.expression(equals, stop, scope, names[0] if names and self.has_function(equals, stop) else owner)
                at = stop + 1
            return last + 1
        if word == "for" and self.text(i + 1 + (self.text(i + 1) == "await")) == "(":
            open_ = i + 1 + (self.text(i + 1) == "await")
            close = self.pair[open_]
            brace = close + 1
            last = self.pair[brace] if self.text(brace) == "{" and self.pair[brace] > 0 else self.statement_end(brace, end)
            inner = (self.t[open_].start, self.t[min(last, len(self.t) - 1)].end)
            if self.text(open_ + 1) in ("const", "let", "var"):
                stop = next((k for k in range(open_ + 2, close) if self.text(k) in ("of", "in", "=")), close)
                self.pattern(open_ + 2, stop, "variable", scope if self.text(open_ + 1) == "var" else inner, inner[0])
            self.expression(open_ + 1, close, inner, owner)
            self.statement(brace, end, "", depth + 1, False, inner, owner) if brace < end else None
            return last + 1
        if word == "catch" and self.text(i + 1) == "(":
            brace = self.pair[i + 1] + 1
            last = self.pair[brace] if self.pair[brace] > 0 else brace
            self.pattern(i + 2, self.pair[i + 1], "variable", (self.t[brace].start, self.t[last].end), self.t[brace].start)
            self.work.append((self.block, (brace + 1, last, "", depth + 1, False, (self.t[brace].start, self.t[last].end), owner)))
            return last + 1
        if word == "{" and self.pair[i] > i:
            self.work.append((self.block, (i + 1, self.pair[i], container if top else "", depth + 1, False, (self.t[i].start, self.t[self.pair[i]].end), owner)))
            return self.pair[i] + 1
        if word in ("if", "while", "switch", "with") and self.text(i + 1) == "(":
            self.expression(i + 1, self.pair[i + 1] + 1, scope, owner)
            return self.pair[i + 1] + 1
        if word in ("else", "try", "finally", "do", ";", "return", "throw"):
            if word in ("return", "throw"):
                last = self.statement_end(i, end)
                self.expression(i + 1, last + 1, scope, owner)
                return last + 1
            return i + 1
        last = self.statement_end(i, end)
        self.expression(i, last + 1, scope, owner)
        return max(last, first) + 1

    def function(self, name: int, start: int, end: int, first: int, kind: str, modifier: str, depth: int, container: str, scope: tuple[int, int]) -> int:
        """A function from its name, or from its parameters if it has none."""
        has = self.is_word(name)
        at = name + has
        if self.text(at) == "<":
            at = next((k for k in range(at, end) if self.text(k) == "("), at)
        close = self.pair[at] if self.text(at) == "(" else at
        stop = close + 1
        if self.text(stop) == ":":
            stop = self.upto(stop + 1, ("{", ";"), end) if self.text(stop + 1) != "{" else self.pair[stop + 1] + 1
        body = self.text(stop) == "{"
        last = self.pair[stop] if body and self.pair[stop] > 0 else min(stop, len(self.t) - 1) if self.text(stop) == ";" else max(close, stop - 1)
        if has:
            self.symbol(kind, name, start, last, first, modifier, depth, container)
            self.out.signatures.append({"start": self.t[start].start, "end": self.t[(stop if body else last + 1) - 1].end, "name_start": self.t[name].start})
            if depth and kind == "function":
                self.lexical(name, "function", scope, scope[0])
            if self.text(name + 1) == "<":
                self.generics(name + 1, last)
        inner = (self.t[stop].start, self.t[last].end) if body else (self.t[at].start, self.t[min(last, len(self.t) - 1)].end)
        self.parameters(at, close, inner)
        if body:
            self.work.append((self.block, (stop + 1, last, "", depth + 1, False, inner, name if has else None)))
        return last + 1

    def generics(self, i: int, last: int) -> None:
        depth, at = 0, i
        while at < last:
            x = self.text(at)
            depth += (x == "<") - (x == ">")
            if not depth:
                return
            if depth == 1 and self.is_word(at) and self.text(at - 1) in ("<", ","):
                self.lexical(at, "type-parameter", (self.t[i].start, self.t[min(last, len(self.t) - 1)].end), self.t[i].start, "type")
            at += 1

    def parameters(self, open_: int, close: int, scope: tuple[int, int]) -> None:
        at = open_ + 1
        while at < close:
            stop = min(self.upto(at, (",",), close), close)
            while self.text(at) in _MEMBER_WORDS or self.text(at) == "...":
                at += 1
            colon = next((k for k in range(at, stop) if self.text(k) in (":", "=", "?") and not (self.pair[at] > k)), stop)
            self.pattern(at, colon, "parameter", scope, scope[0])
            at = stop + 1

    def members(self, i: int, end: int, depth: int, container: str) -> None:
        while i < end:
            first = i
            while self.text(i) == "@" and self.is_word(i + 1):
                i += 2
                if self.text(i) == "(":
                    i = self.pair[i] + 1
            start = i
            while self.text(i) in _MEMBER_WORDS and (self.is_word(i + 1) or self.text(i + 1) in ("*", "[")):
                i += 1
            i += self.text(i) == "*"
            if self.is_word(i):
                after = i + 1 + (self.text(i + 1) in ("?", "!"))
                if self.text(after) in ("(", "<"):
                    i = self.function(i, start, end, first, "method", "", depth, container, (0, 0)) if after == i + 1 else self.statement_end(i, end) + 1
                    continue
                last = min(self.statement_end(i, end), end - 1)
                self.symbol("field", i, start, last - (self.text(last) == ";"), first, "", depth, container)
                self.expression(after, last + 1, (0, len(self.raw)), i if self.has_function(after, last) else None)
                i = last + 1
            elif self.text(i) in ("(", "[", "{") and self.pair[i] > i:
                i = self.pair[i] + 1
            else:
                i += 1

    # Expressions

    def has_function(self, i: int, end: int) -> bool:
        return any(self.text(k) in ("=>", "function") for k in range(i, min(end, i + 60)))

    def expression(self, i: int, end: int, scope: tuple[int, int], owner: int | None) -> None:
        o = self.t[owner] if owner is not None else None
        k = i
        while k < end:
            x = self.text(k)
            if x == "function":
                k = self.function(k + 1, k, end, k, "function", "", 1, "", scope) if not self.is_word(k + 1) else k + 1
                continue
            if x == "=>":
                inner_end = end
                if self.text(k + 1) == "{" and self.pair[k + 1] > k:
                    inner = (self.t[k + 1].start, self.t[self.pair[k + 1]].end)
                else:
                    inner_end = min(self.upto(k + 1, (",", ")", "]", ";"), end), end)
                    inner = (self.t[k].end, self.t[min(inner_end, len(self.t) - 1)].start)
                if self.text(k - 1) == ")":
                    self.parameters(self.pair[k - 1], k - 1, inner)
                elif self.is_word(k - 1):
                    self.lexical(k - 1, "parameter", inner, inner[0])
                if self.text(k + 1) == "{" and self.pair[k + 1] > k:
                    self.work.append((self.block, (k + 2, self.pair[k + 1], "", 1, False, inner, owner)))
                    k = self.pair[k + 1] + 1
                    continue
            if x == "(" and self.pair[k] > k and k > 0:
                c = self.t[k - 1]
                kind = None
                if c.kind == "word" and c.text not in KEYWORDS:
                    kind = "member" if self.text(k - 2) in (".", "?.") else "direct"
                elif c.text in (")", "]"):
                    kind = "indirect"
                if kind:
                    self.out.calls.append({"start": c.start, "end": self.t[self.pair[k]].end, "callee_start": c.start, "callee_end": c.end, "callee": named(c.text) if kind != "indirect" else None, "kind": kind, "owner_start": o.start if o else None, "owner_end": o.end if o else None})
            k += 1

    # Imports

    def add(self, at: int, span: tuple[int, int], reexport: bool, top: bool, glob: bool, alias: str | None, binding: str | None, declares: bool = True) -> None:
        x = self.t[at]
        raw = named(x.text[1:-1])
        parts = [p for p in raw.split("/") if p]
        head, ups = ("here", 0) if raw.startswith("./") or raw == "." else ("up", 0) if raw.startswith("..") else ("package", 0) if raw.startswith("@") else ("root", 0) if raw.startswith("/") else ("named", 0)
        while parts and parts[0] in (".", ".."):
            ups += parts[0] == ".."
            parts.pop(0)
        self.out.imports.append(
            {"ord": 0, "start": x.start + 1, "end": x.end - 1, "syntax": "posix", "head": head, "ups": ups, "segments": parts, "raw": raw, "glob": glob, "declares": declares, "reexport": reexport, "alias": alias, "binding": binding, "stmt_start": span[0], "stmt_end": span[1], "grouped": False, "top_level": top, "is_prefix": False, "visibility": "export" if reexport else None}
        )

    def import_(self, i: int, end: int, top: bool) -> int:
        last = self.statement_end(i, end)
        at = next((k for k in range(i + 1, last + 1) if self.t[k].kind == "string"), None)
        if at is not None:
            span = (self.t[i].start, self.t[last].end)
            self.add(at, span, False, top, False, None, None)
            self.names(i + 1, at, at, False)
        return last + 1

    def names(self, i: int, end: int, source: int, reexport: bool) -> None:
        """Rows of the local names that a clause takes from a module: default, namespace and named ones."""
        only, k = self.text(i) == "type", i
        module = named(self.t[source].text[1:-1])
        while k < end:
            x = self.text(k)
            taken = None
            if x == "*":
                taken = (self.text(k + 2) if self.text(k + 1) == "as" else None, "*", k + 2)
                k += 2 * (self.text(k + 1) == "as")
            elif self.is_word(k) and x not in ("type", "from", "as"):
                inside = any(self.text(b) == "{" and b < k < self.pair[b] for b in range(i, k))
                renamed = self.text(k + 1) == "as"
                at = k + 2 if renamed else k
                taken = (self.text(at), x if inside else "default", at)
                k = at
            if taken and taken[0]:
                n = self.t[taken[2]]
                self.out.named_imports.append({"local": named(taken[0]), "imported": named(taken[1]), "module": module, "name_start": n.start, "name_end": n.end, "reexport": reexport, "type_only": only})
            k += 1

    def reexport(self, i: int, end: int, top: bool) -> int:
        last = self.statement_end(i, end)
        at = next((k for k in range(i + 1, last + 1) if self.t[k].kind == "string"), None)
        if at is not None:
            under = named(self.text(i + 3)) if self.text(i + 1) == "*" and self.text(i + 2) == "as" else None  # the module under a name, not what it offers
            self.add(at, (self.t[i].start, self.t[last].end), True, top, self.text(i + 1) == "*" and under is None, under, under)
            self.names(i + 1, at, at, True)
        return last + 1

    def member_names(self) -> None:
        """Members of plain names and of other members: `a.b` and the `c` of `a.b.c`."""
        for k in range(len(self.t) - 2):
            if self.is_word(k) and self.text(k + 1) in (".", "?.") and self.is_word(k + 2):
                nested = self.text(k - 1) in (".", "?.") if k else False
                a, b = self.t[k], self.t[k + 2]
                if not nested or self.is_word(k - 2):
                    self.out.members.append({"object": named(a.text), "object_start": a.start, "name": named(b.text), "start": b.start, "end": b.end, "nested": nested})

    def dynamic_imports(self) -> None:
        for k in range(len(self.t) - 3):
            if self.text(k) in ("import", "require") and self.text(k + 1) == "(" and self.t[k + 2].kind == "string" and self.text(k + 3) == ")":
                self.add(k + 2, (self.t[k].start, self.t[k + 3].end), False, False, False, None, None, False)


def facts(text: str) -> Facts:
    """All facts of a file's text."""
    return Parser(text.encode().decode("latin-1")).parse()
