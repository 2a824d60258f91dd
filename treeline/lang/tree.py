"""A syntax tree of a file as rows: nodes with kinds, numbered before and after what they hold.

Brackets are grouped first; then the stretches between them are read one by one from a list of work, operators
by precedence, so no depth of nesting is a depth of calls. What no rule takes stays a leaf beside its neighbours,
so every text has a tree. Patterns are read by the same rules.
"""

from __future__ import annotations

from treeline.lang import rust, typescript
from treeline.lang.model import Lexemes, brackets, named

# Operators by precedence, the loosest first; those that assign bind to the right.
_LEVELS = (
    ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="), ("..", "..="), ("||", "??"), ("&&",), ("==", "!=", "===", "!==", "<", ">", "<=", ">="),
    ("|",), ("^",), ("&",), ("<<", ">>"), ("+", "-"), ("*", "/", "%"), ("as",),
)
_RANK = {op: k for k, ops in enumerate(_LEVELS) for op in ops}
_PAIRS = frozenset(("==", "!=", "<=", ">=", "<<", ">>", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "??"))
_PREFIX = {"-": "unary_expression", "!": "unary_expression", "*": "unary_expression", "&": "reference_expression", "&&": "reference_expression", "...": "spread_element", "typeof": "unary_expression", "new": "new_expression", "await": "await_expression"}
# Names of kinds by the word that begins them, and of their bodies.
ITEMS = {
    "rust": {"fn": "function_item", "struct": "struct_item", "enum": "enum_item", "union": "union_item", "trait": "trait_item", "impl": "impl_item", "mod": "mod_item", "use": "use_declaration", "const": "const_item", "static": "static_item", "type": "type_item", "macro_rules": "macro_definition", "extern": "extern_crate_declaration"},
    "script": {"function": "function_declaration", "class": "class_declaration", "interface": "interface_declaration", "enum": "enum_declaration", "namespace": "internal_module", "import": "import_statement", "type": "type_alias_declaration", "const": "lexical_declaration", "let": "lexical_declaration", "var": "variable_declaration"},
}
BODIES = {"struct_item": "field_declaration_list", "union_item": "field_declaration_list", "enum_item": "enum_variant_list", "trait_item": "declaration_list", "impl_item": "declaration_list", "mod_item": "declaration_list", "class_declaration": "class_body", "interface_declaration": "interface_body", "enum_declaration": "enum_body"}
BLOCKS = {
    "rust": {"if": "if_expression", "match": "match_expression", "while": "while_expression", "for": "for_expression", "loop": "loop_expression", "unsafe": "unsafe_block", "async": "async_block"},
    "script": {"if": "if_statement", "switch": "switch_statement", "while": "while_statement", "for": "for_statement", "do": "do_statement", "try": "try_statement"},
}
JUMPS = {"rust": {"return": "return_expression", "break": "break_expression", "continue": "continue_expression"}, "script": {"return": "return_statement", "throw": "throw_statement", "break": "break_statement", "continue": "continue_statement"}}
#: Begins the words that stand for runs in patterns.
RUN = "__run_"
_STARTS = frozenset((*_PREFIX, "(", "[", "{", "|", "||", "..", "..=", "<"))
_BEFORE_ITEMS = frozenset("pub async unsafe default const extern export declare abstract".split())


class Tree:
    def __init__(self, raw: str, language: str) -> None:
        self.side = "rust" if language == "rust" else "script"
        self.t = Lexemes([x for x in (rust if self.side == "rust" else typescript).lex(raw) if x.kind != "comment"], len(raw))
        self.pair = brackets(self.t)
        self.made: list[tuple[int, int, str]] = []  # first and last lexeme, kind; the outer of equals first
        self.work: list[tuple[int, int, str]] = [(0, len(self.t), "statements")]
        while self.work:
            lo, hi, what = self.work.pop()
            if what == "list":
                for a, b in self._cut(lo, hi):
                    self._expressions(a, b)
            elif what in ("parameter", "field_declaration", "enum_variant", "match_arm"):
                for a, b in self._cut(lo, hi, arms=what == "match_arm"):
                    if b - a > 1:
                        self.made.append((a, b - 1, what))
                    self._split(a, b, *(("if", "=>") if what == "match_arm" and "=>" in map(self.text, self._tops(a, b)) else ()))
            else:
                self._statements(lo, hi)

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def after(self, i: int) -> int:
        """The place after a lexeme, or after the group it opens."""
        return self.pair[i] + 1 if self.t[i].kind == "mark" and self.text(i) in ("(", "[", "{") and self.pair[i] > i else i + 1

    def _cut(self, lo: int, hi: int, arms: bool = False) -> list[tuple[int, int]]:
        """The stretches between commas; an arm whose body is a block needs none."""
        out, a, i = [], lo, lo
        while i < hi:
            if self.text(i) == ",":
                out += [(a, i)] if i > a else []
                a = i + 1
            n = self.after(i)
            if arms and self.text(i) == "{" and self.text(i - 1) == "=>" and self.text(n) != ",":
                out.append((a, n))
                a = n
            i = n
        return out + ([(a, hi)] if hi > a else [])

    def _statements(self, lo: int, hi: int) -> None:
        i = lo
        while i < hi:
            if self.text(i) == "#" and self.text(i + 1) == "[":
                self.made.append((i, self.after(i + 1) - 1, "attribute_item"))
                i = self.after(i + 1)
                continue
            if self.text(i).startswith(RUN):  # a pattern's run stands for whole statements
                i += 1
                continue
            end = self._item(i, hi)
            if end is None:
                block = BLOCKS[self.side].get(self.text(i)) and not (self.text(i) in ("unsafe", "async") and self.text(i + 1) != "{")
                end = i
                while end < hi and self.text(end) != ";":
                    end = self.after(end)
                    if self.text(end - 1) == "}" and (block or self.text(i) == "{") and self.text(end) not in ("else", "catch", "finally", ".", "?", "while" if self.text(i) == "do" else ""):
                        break
                closed = end < hi and self.text(end) == ";"
                if closed and end > i:
                    jump = JUMPS["script"].get(self.text(i)) if self.side == "script" else None
                    self.made.append((i, end, "let_declaration" if self.text(i) == "let" else jump or "expression_statement"))
                self._split(i, end, *(("let", "=") if self.text(i) == "let" else ()))
                end += closed
            i = max(end, i + 1)

    def _item(self, i: int, hi: int) -> int | None:
        """The end of the item that begins here, none if none does."""
        k = i
        while k < hi and self.text(k) in _BEFORE_ITEMS and not (self.text(k) == "const" and self.text(k + 1) not in ("fn", "unsafe", "async", "extern", "enum")):
            if self.text(k) == "extern" and self.text(k + 1) == "crate" or self.text(k) in ("unsafe", "async") and self.text(k + 1) == "{":
                break
            if self.text(k) == "pub" and self.text(k + 1) == "(":
                self.made.append((k, self.after(k + 1) - 1, "visibility_modifier"))
                k = self.after(k + 1) - 1
            k += 1
            if self.t[k].kind == "string" and self.text(k - 1) == "extern":
                k += 1
        kind = ITEMS[self.side].get(self.text(k))
        if kind is None or self.side == "script" and self.text(k) == "type" and self.t[k + 1].kind != "word" or self.side == "script" and self.text(k) == "import" and self.text(k + 1) == "(":
            return None
        plain = kind in ("use_declaration", "const_item", "static_item", "type_item", "extern_crate_declaration", "import_statement", "type_alias_declaration", "lexical_declaration", "variable_declaration")
        j, body = k + 1, None
        while j < hi and self.text(j) != ";":
            if self.text(j) == "{" and not plain:
                body = j
                break
            if self.side == "script" and plain and j > k + 1 and ITEMS["script"].get(self.text(j)) and self.text(j - 1) not in (",", "=", ":"):
                j -= 1
                break
            j = self.after(j)
        end = self.after(body) if body is not None else min(j + 1, hi)
        self.made.append((i, end - 1, kind))
        if body is not None:
            self._group(body, BODIES.get(kind, "block" if self.side == "rust" else "statement_block"))
        self._head(k, body if body is not None else end, kind)
        return end

    def _head(self, k: int, end: int, kind: str) -> None:
        i = k + 1
        while i < end:
            if self.text(i) == "(" and self.pair[i] > i:
                self._group(i, "parameters" if self.side == "rust" else "formal_parameters")
                i = self.after(i)
            elif self.text(i) == "=" and kind in ("const_item", "static_item", "lexical_declaration", "variable_declaration"):
                stop = end - (self.text(end - 1) == ";")
                self._expressions(i + 1, stop)
                return
            elif self.text(i) in ("{", "[") and self.pair[i] > i:
                self._group(i, "use_list" if kind == "use_declaration" else "named_imports" if kind == "import_statement" else "object_pattern")
                i = self.after(i)
            else:
                i += 1

    def _group(self, i: int, kind: str) -> None:
        """A group with its kind; what stands inside is work for later."""
        close = self.pair[i]
        self.made.append((i, close, kind))
        inner = {"parameters": "parameter", "formal_parameters": "parameter", "field_declaration_list": "field_declaration", "enum_variant_list": "enum_variant", "match_block": "match_arm"}
        listed = kind in ("arguments", "tuple_expression", "parenthesized_expression", "array_expression", "array", "object", "field_initializer_list", "index_list", "use_list", "named_imports", "object_pattern", "token_tree", "enum_body")
        self.work.append((i + 1, close, inner.get(kind) or ("list" if listed else "statements")))

    def _operator(self, i: int, hi: int) -> tuple[str, int]:
        """The operator at a place and its lexemes, joined where they touch."""
        x = self.text(i)
        if i + 1 < hi and self.t[i].kind == "mark" and self.t[i].end == self.t[i + 1].start and x + self.text(i + 1) in _PAIRS and x not in ("(", "[", "{"):
            return x + self.text(i + 1), 2
        return x, 1

    def _expressions(self, lo: int, hi: int) -> None:
        """All expressions of a stretch without separators, one after another."""
        i = lo
        while i < hi:
            if self.t[i].kind == "mark" and self.text(i) not in _STARTS:
                i += 1
            else:
                i = max(self._expression(i, hi), i + 1)

    def _split(self, lo: int, hi: int, *marks: str) -> None:
        """Expressions between marks that are looked for in turn."""
        for mark in marks:
            at = next((k for k in self._tops(lo, hi) if self.text(k) == mark), None)
            if at is not None:
                self._expressions(lo, at)
                lo = at + 1
        self._expressions(lo, hi)

    def _expression(self, i: int, hi: int) -> int:
        """One expression by precedence; its end."""
        waiting: list[tuple[int, int, str]] = []  # rank, first lexeme of the left side or of the sign, kind of a sign
        first = i
        while i < hi:
            op, n = self._operator(i, hi)
            if op in _PREFIX and (self.t[i].kind == "mark" or self.side == "script"):
                waiting.append((len(_LEVELS), i, _PREFIX[op]))
                i += n
                if op == "&" and self.text(i) == "mut":
                    i += 1
                continue
            if self.text(i) in ("mut", "ref", "move", "box", "else", "let") and self.t[i].kind == "word":
                i += 1  # words that stand before what they tell of
                if self.text(i - 1) == "let":
                    return i
                continue
            first = i
            i = self._operand(i, hi)
            op, n = self._operator(i, hi) if i < hi else ("", 0)
            rank = _RANK.get(op, -1)
            if op in ("|", "||") and self.text(i - 1) in (",", "("):
                rank = -1
            # What binds tighter ends here.
            while waiting and (waiting[-1][0] > rank or waiting[-1][0] == rank and rank > 0):
                _, first, kind = waiting.pop()
                if i - first > 1:
                    self.made.append((first, i - 1, kind))
            if rank < 0:
                return i
            name = "assignment_expression" if rank == 0 and n == 1 else "compound_assignment_expr" if rank == 0 else "range_expression" if rank == 1 else "type_cast_expression" if op == "as" else "binary_expression"
            waiting.append((rank, first, name))
            i += n
        while waiting:
            _, first, kind = waiting.pop()
            if i - first > 1:
                self.made.append((first, i - 1, kind))
        return i

    def _operand(self, i: int, hi: int) -> int:
        first, x, kind = i, self.text(i), self.t[i].kind
        if kind == "word" and x in BLOCKS[self.side] and not (x in ("unsafe", "async") and self.text(i + 1) != "{"):
            return self._block(i, hi)
        if kind == "word" and x in JUMPS[self.side]:
            if self.side == "rust" and hi - i > 1:
                self.made.append((i, hi - 1, JUMPS["rust"][x]))
            self._expressions(i + 1, hi)
            return hi
        if x in ("|", "||") and self.side == "rust":  # a closure takes what follows
            k = i + 1
            while x == "|" and k < hi and self.text(k) != "|":
                k = self.after(k)
            self.made.append((i, hi - 1, "closure_expression"))
            if k > i:
                self.made.append((i, min(k, hi - 1), "closure_parameters"))
            self._expressions(min(k + 1, hi), hi)
            return hi
        if x in ("(", "[", "{") and kind == "mark" and self.pair[i] > i:
            if x == "(":
                arrow = self.side == "script" and self.text(self.after(i)) == "=>"
                comma = any(self.text(k) == "," for k in self._tops(i + 1, self.pair[i]))
                self._group(i, "formal_parameters" if arrow else "tuple_expression" if comma and self.side == "rust" else "parenthesized_expression")
            else:
                self._group(i, {"[": "array_expression" if self.side == "rust" else "array", "{": "block" if self.side == "rust" else "object"}[x])
        i = self.after(i)
        if self.side == "script" and self.text(i) == "=>" and i < hi:
            self.made.append((first, hi - 1, "arrow_function"))
            if self.text(i + 1) == "{":
                self._group(i + 1, "statement_block")
                return max(self.after(i + 1), hi)
            self._expressions(i + 1, hi)
            return hi
        while i < hi:
            y = self.text(i)
            if y == "::":
                i += 1
                if self.text(i) == "<":
                    i = self._angles(i, hi)
                elif i < hi:
                    i += 1
                self.made.append((first, i - 1, "scoped_identifier" if self.text(i - 1) != ">" else "generic_function"))
            elif y in (".", "?.") and i + 1 < hi:
                i += 2
                self.made.append((first, i - 1, "field_expression" if self.side == "rust" else "member_expression"))
            elif y == "(" and self.pair[i] > i:
                self._group(i, "arguments")
                i = self.after(i)
                self.made.append((first, i - 1, "call_expression"))
            elif y == "[" and self.pair[i] > i:
                self._group(i, "index_list")
                i = self.after(i)
                self.made.append((first, i - 1, "index_expression" if self.side == "rust" else "subscript_expression"))
            elif y == "?" and self.side == "rust":
                i += 1
                self.made.append((first, i - 1, "try_expression"))
            elif y == "!" and self.side == "rust" and self.text(i + 1) in ("(", "[", "{") and self.pair[i + 1] > i:
                self._group(i + 1, "token_tree")
                i = self.after(i + 1)
                self.made.append((first, i - 1, "macro_invocation"))
            elif y == "{" and self.side == "rust" and kind == "word" and (x[:1].isupper() or self.text(i - 2) == "::") and self.pair[i] > i and self.pair[i] < hi:
                self._group(i, "field_initializer_list")
                i = self.after(i)
                self.made.append((first, i - 1, "struct_expression"))
            else:
                break
        return i

    def _tops(self, lo: int, hi: int) -> list[int]:
        out = []
        while lo < hi:
            out.append(lo)
            lo = self.after(lo)
        return out

    def _angles(self, i: int, hi: int) -> int:
        depth, first = 0, i
        while i < hi:
            depth += (self.text(i) == "<") - (self.text(i) == ">")
            i = self.after(i)
            if not depth:
                break
        self.made.append((first, i - 1, "type_arguments"))
        return i

    def _block(self, i: int, hi: int) -> int:
        """if, match, loops and the like: heads as expressions, bodies as groups, up to the last body."""
        first, kind, head = i, BLOCKS[self.side][self.text(i)], i + 1
        inner = "match_block" if self.text(i) in ("match", "switch") else "block" if self.side == "rust" else "statement_block"
        k = i + 1
        while k < hi:
            if self.text(k) == "{" and self.pair[k] > k:
                if k > head:
                    self._expressions(head, k)
                self._group(k, inner if self.text(first) != "switch" else "switch_body")
                k = self.after(k)
                if self.text(k) not in ("else", "catch", "finally") and not (self.text(first) == "do" and self.text(k) == "while") or k >= hi:
                    break
                head = k = k + 1
                if self.text(k) in ("if", "while"):
                    head = k = k + 1
            else:
                k = self.after(k)
        self.made.append((first, min(k, hi) - 1, kind))
        return min(k, hi)

    def rows(self) -> list[dict]:
        """pre, post, parent (-1: none), ord, rord, n (children), kind, text (of leaves), start, end, first, last: nodes in order of pre; the file is node 0."""
        leaves = [(k, k, None) for k in range(len(self.t))]
        spans = sorted({(a, -b): (a, b, kind) for a, b, kind in reversed([s for s in self.made if s[1] > s[0]])}.values(), key=lambda s: (s[0], -s[1]))
        size = self.t.end.end
        out = [{"pre": 0, "post": 0, "parent": -1, "ord": 0, "kind": "source_file" if self.side == "rust" else "program", "text": None, "start": 0, "end": size, "first": 0, "last": len(self.t) - 1}]
        open_, counts, k, closed = [0], {0: 0}, 0, 0
        for a, b, kind in sorted([*spans, *leaves], key=lambda s: (s[0], -s[1], s[2] is None)):
            while len(open_) > 1 and out[open_[-1]]["last"] < a:
                out[open_.pop()]["post"] = closed
                closed += 1
            if out[open_[-1]]["last"] < b:  # a node never leaves the one around it
                if kind is None:
                    continue
                b = out[open_[-1]]["last"]
            up, k = open_[-1], k + 1
            x = self.t[a]
            out.append({"pre": k, "post": 0, "parent": up, "ord": counts[up], "kind": kind or self._leaf(a), "text": None if kind else named(x.text), "start": x.start, "end": self.t[b].end, "first": a, "last": b})
            counts[up] += 1
            counts[k] = 0
            if kind:
                open_.append(k)
            else:
                out[k]["post"] = closed
                closed += 1
        while open_:
            out[open_.pop()]["post"] = closed
            closed += 1
        for r in out:
            r["n"], r["rord"] = counts[r["pre"]], (counts[r["parent"]] - 1 - r["ord"]) if r["parent"] >= 0 else 0
            r["above"] = out[r["parent"]]["kind"] if r["parent"] >= 0 else None
        return out

    def _leaf(self, k: int) -> str:
        x = self.t[k]
        if x.kind == "word":
            words = rust.KEYWORDS if self.side == "rust" else typescript.KEYWORDS
            if x.text in words:
                return x.text
            if self.text(k - 1) in (".", "?.") and k:
                return "field_identifier" if self.side == "rust" else "property_identifier"
            return "type_identifier" if self.side == "rust" and x.text[:1].isupper() and not x.text.isupper() else "identifier"
        return {"string": "string_literal" if self.side == "rust" else "string", "number": "integer_literal" if self.side == "rust" else "number", "life": "lifetime"}.get(x.kind, x.text)


def nodes(text: str, language: str) -> list[dict]:
    """All nodes of a file's text; offsets are bytes."""
    return Tree(text.encode("utf-8", "replace").decode("latin-1"), language).rows()
