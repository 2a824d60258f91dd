"""Members of script namespaces, on modules checked by hand."""

import pytest

from treeline.engine import Workspace
from treeline.sources import workspace

TREE = {
    "a.ts": "export const one = 1;\nexport interface Two {}\nexport default class Deep {}\nconst hidden = 3;\n",
    "b.ts": 'export * from "./a";\nexport const one = 2;\nexport { default as Deep, Two as Three } from "./a";\n',
    "c.ts": 'export * from "./d";\nexport * as inner from "./b";\n',
    "d.ts": 'export * from "./c";\nexport const ring = 1;\n',
    "use.ts": 'import * as b from "./b";\nimport * as c from "./c";\nimport { inner } from "./c";\nimport * as out from "out";\nb.one; b.Two; b.Three; b.Deep; b.hidden; b.default;\nc.ring; c.inner.one; c.inner.Three; inner.Two; out.x;\nfunction f(b) { b.one; }\n',
}


@pytest.fixture(scope="module")
def ws(spark):
    return Workspace(workspace.memory_tree(spark, TREE))


def test_members(ws):
    text = TREE["use.ts"]
    found = {r["start"]: (r["outcome"], r["targets"] or r["why"]) for r in ws.members.collect()}
    want = {
        "b.one": ("resolved", ["b.ts::one"]), "b.Two": ("resolved", ["a.ts::Two"]), "b.Three": ("resolved", ["a.ts::Two"]), "b.Deep": ("resolved", ["a.ts::Deep"]), "b.hidden": ("unavailable", "unknown-name"), "b.default": ("unavailable", "unknown-name"),
        "c.ring": ("resolved", ["d.ts::ring"]), "c.inner": ("resolved", ["b.ts"]), "inner.one": ("resolved", ["b.ts::one"]), "inner.Three": ("resolved", ["a.ts::Two"]), "inner.Two": ("resolved", ["a.ts::Two"]), "out.x": ("unavailable", "external"),
    }
    assert found == {text.index(k) + k.index(".") + 1: v for k, v in want.items()} | {text.index("c.inner.Three") + 2: ("resolved", ["b.ts"])}
    assert ws.navigate("use.ts", text.index("ring")).first()["tier"] == "member"


def test_exports(ws):
    table = {(r["file"], r["name"], r["target"], r["space"]) for r in ws.exports.filter("file in ('b.ts', 'c.ts')").collect()}
    assert table == {("b.ts", "one", "b.ts::one", "value"), ("b.ts", "Two", "a.ts::Two", "type"), ("b.ts", "Three", "a.ts::Two", "type"), ("b.ts", "Deep", "a.ts::Deep", "both"), ("c.ts", "inner", "b.ts", "both"), ("c.ts", "ring", "d.ts::ring", "value")}
