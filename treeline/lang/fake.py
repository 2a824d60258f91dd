"""A language of two statements for tests of the operators: `def name` and `use path/Name`.

`use {path}` is an entry of a group, `use path/*` takes all names; every whole word is an
identifier.
"""

from __future__ import annotations

import re

from treeline.lang.model import Facts, Lines

_WORD = re.compile(r"[A-Za-z_]\w*", re.ASCII)
_LINE = re.compile(r"^(def|use)[ ]+(\S+)[^\n]*", re.MULTILINE)


def facts(text: str) -> Facts:
    raw = text.encode().decode("latin-1")
    lines, out = Lines(raw), Facts()
    skip: set[int] = set()
    for m in _LINE.finditer(raw):
        skip.add(m.start())
        if m[1] == "def" and (n := _WORD.match(raw, m.start(2))):
            out.symbols.append({"kind": "function", "name": n[0], "name_start": n.start(), "name_end": n.end(), "start": m.start(), "end": m.end(), "ext_start": m.start(), "ext_end": m.end(), "modifier": "export", "depth": 0, "ord": len(out.symbols), "container": None})
        elif m[1] == "use":
            grouped, glob = m[2].startswith("{"), m[2].rstrip("}").endswith("/*")
            path = m[2].strip("{}").removesuffix("/*")
            parts = path.split("/")
            start = m.start(2) + grouped
            out.imports.append({"ord": len(out.imports), "start": start, "end": start + len(path), "syntax": "posix", "head": "named", "ups": 0, "segments": parts, "raw": path, "glob": glob, "declares": True, "reexport": False, "alias": None, "binding": None if glob else parts[-1], "stmt_start": m.start(), "stmt_end": m.end(), "grouped": grouped, "top_level": True, "is_prefix": False, "visibility": None})
    for m in _WORD.finditer(raw):
        if m.start() in skip:
            continue
        line, col = lines.at(m.start())
        out.tokens.append({"ord": len(out.tokens), "name": m[0], "node_kind": "identifier", "start": m.start(), "end": m.end(), "line": line, "col": col})
    return out
