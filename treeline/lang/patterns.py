"""What a Rust pattern names, read in one pass over its lexemes: sites that may bind, constants, constructors, and alternatives.

Whether a bare name binds or refers to a constant or a constructor is left open here; tables decide it.
"""

from __future__ import annotations

from treeline.lang.model import named

_MODES = ("ref", "mut")


def references(p, i: int, end: int) -> list[dict]:  # noqa: ANN001 - p: the file's parser
    """Sites of the pattern in lexemes i..end, each with the branches of alternatives around it.

    A slot is what stands between brackets and commas; bars cut it into branches.
    """
    out: list[dict] = []
    slots: list[list] = [[0, 0, i]]  # number of the slot, branch, first lexeme of the branch
    braces: list[bool] = [False]
    made, many = 1, {}  # bars of each slot
    while i < end:
        x, k = p.text(i), p.t[i].kind
        if x in ("(", "[", "{") and k == "mark":
            slots.append([made, 0, i + 1])
            braces.append(x == "{")
            made += 1
        elif x in (")", "]", "}") and k == "mark":
            if len(slots) > 1:
                slots.pop()
                braces.pop()
        elif x == "," and k == "mark":
            slots[-1] = [made, 0, i + 1]
            made += 1
        elif x == "|" and k == "mark":
            if i > slots[-1][2]:  # a bar before the first branch means nothing
                slots[-1][1] += 1
                many[slots[-1][0]] = slots[-1][1]
            slots[-1][2] = i + 1
        elif k == "word" and x not in ("ref", "mut", "box", "true", "false", "const", "dyn", "_"):
            first, segments = i, [named(x.removeprefix("r#"))]
            while p.text(i + 1) == "::":
                if p.is_word(i + 2):
                    segments.append(named(p.text(i + 2).removeprefix("r#")))
                    i += 2
                elif p.text(i + 2) == "<":
                    i = p.over_angles(i + 2) - 1
                else:
                    break
            follows, before = p.text(i + 1) if i + 1 < end else "", p.text(first - 1)
            if follows == "!":  # a macro makes the pattern
                i = p.pair[i + 2] if p.pair[i + 2] > i else i + 1
            elif follows == ":" and braces[-1] and len(segments) == 1:
                pass  # the name of a field
            elif k == "word" and (len(segments) > 1 or segments[0] not in ("self", "crate", "super")):
                modes = {p.text(n) for n in (first - 1, first - 2) if p.text(n) in _MODES and (n == first - 1 or p.text(first - 1) in _MODES)}
                shorthand = braces[-1] and len(segments) == 1
                shape = {"(": "tuple", "{": "record"}.get(follows)
                ranged = follows in ("..=", "..") or before == "..=" or before == ".." and p.text(first - 2) not in (",", "(", "[", "{")
                role = "constructor" if shape else "constant" if ranged else "identifier"
                site = {"start": p.t[first].start, "end": p.t[i].end, "name": segments[-1], "segments": segments, "role": role, "shape": shape}
                site |= {"bare": len(segments) == 1, "explicit": bool(modes) or follows == "@" or shorthand and not shape, "by_ref": "ref" in modes, "mutable": "mut" in modes}
                out.append(site | {"branches": [(s, b) for s, b, _ in slots]})
        elif k == "word" and x == "const" and p.text(i + 1) == "{" and p.pair[i + 1] > i:
            i = p.pair[i + 1]
        i += 1
    for site in out:
        site["branches"] = [{"alt": s, "branch": b, "of": many[s] + 1} for s, b in site["branches"] if s in many]
    return out
