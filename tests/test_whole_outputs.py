"""Queries that return an operator's whole output, against brute force on plain rows."""

import re
from pathlib import Path

import pytest

from pyspark.sql import functions as F

from treeline import queries
from treeline.engine import Workspace
from treeline.operators import graph
from treeline.sources import workspace

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


def rows(spark, name):
    return queries.QUERIES[name](spark, str(DATA)).collect()


def test_excerpts_of_all_lines(spark):
    want = {}
    for f in queries._files(spark, str(DATA)).collect():
        for k, line in enumerate((f["text"] or "").split("\n")):
            if m := re.match("[A-Z][A-Za-z0-9_]*", line):
                want[f["path"], k] = line.encode()[: len(m[0]) + 1].decode("utf-8", "ignore")
    got = {(r["path"], r["ord"]): r["head"] for r in rows(spark, "e14_excerpt")}
    assert got == want and len(got) == len(rows(spark, "e14_expand"))


def test_whole_outputs_of_the_tree(spark):
    files = {r["path"]: r["text"] for r in queries._tree(spark, str(DATA)).collect()}
    sources = {p: t for p, t in files.items() if p.endswith(".rs")}
    found = rows(spark, "w_context_all")
    name = found[0]["name"]
    users = sorted((p, m[0]) for p, t in sources.items() if (m := re.search(r"^fn [^}]*\n}", t, re.MULTILINE)) and re.search(rf"\b{name}\(\);", m[0]))
    assert [r["rank"] for r in found] == list(range(1, len(found) + 1)) and (found[0]["relation"], found[0]["text"]) == ("definition", f"pub fn {name}() {{}}")
    assert users and [(r["relation"], r["path"], r["text"]) for r in found[1:]] == [("incoming", *u) for u in users[:11]]
    headers = sorted((p, h) for p, t in sources.items() for h in re.findall(r"(?:pub )?(?:fn \w+\([^)]*\)|struct \w+|mod \w+)", t))
    functions = [(r["path"], r["header"]) for r in rows(spark, "w_signatures_all") if "fn " in r["header"]]
    assert sorted(functions) == [h for h in headers if "fn " in h[1]]
    assert {r["path"] for r in rows(spark, "w_modules_all")} == set(sources)
    assert len(rows(spark, "w_outline_all")) == len(headers)
    assert sum(r["declares"] for r in rows(spark, "w_imports_all")) == sum(len(re.findall(r"^(?:pub )?use ", t, re.MULTILINE)) for t in sources.values())


def test_long_chains_of_re_exports_are_followed_to_the_end(spark):
    n = 40
    chain = spark.createDataFrame([(f"g::m{k}", False, "X", f"g::m{k - 1}::X", True, False) for k in range(1, n + 1)], "from_addr string, glob boolean, binding string, addr string, reexport boolean, is_prefix boolean")
    everyone = graph.reach(F.lit("pub"), F.lit("g"), F.expr("cast(array() as array<string>)"), F.lit("rust"))
    targets = spark.createDataFrame([("g::m0::X",)], "addr string").withColumn("reach", everyone)
    assert {(r["alias"], r["step"]) for r in graph.alias_closure(targets, chain).collect()} == {(f"g::m{k}::X", k) for k in range(n + 1)}


def test_relationships_are_not_cut(spark, monkeypatch):
    files = {"p/Cargo.toml": '[package]\nname = "p"\n', "p/src/lib.rs": "pub mod n4;\n", "p/src/n4.rs": "pub struct Nation4;\n"}
    files |= {f"p/src/c{i}.rs": "use crate::n4::Nation4;\n" + "".join(f"fn f{k}(_: Nation4) {{}}\n" for k in range(8)) for i in range(70)}
    ws = Workspace(workspace.memory_tree(spark, files))
    monkeypatch.setattr(queries, "_workspace", lambda *_: ws)
    want = sorted((p, m.start()) for p, t in files.items() if "/c" in p for m in re.finditer("Nation4", t))
    assert len(want) == 630  # in 70 files: more than 64 files and 512 rows
    assert [(r["path"], r["start"]) for r in queries.w_relationships(spark, "").collect()] == want
    assert tuple(ws.relationships("Nation4")[1].first()) == (70, 0, 630, 0, None)
    rows, told = ws.relationships("Nation4", max_files=65, max_items=600)
    assert rows.count() == 585 and tuple(told.first()) == (65, 5, 585, 45, "files")
