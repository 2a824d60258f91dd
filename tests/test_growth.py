"""What a step reads, makes and sends grows with its input, not with products of it."""

import numpy as np
from pyspark.sql import functions as F

from treeline import queries
from treeline.engine import Workspace
from treeline.operators import graph, search
from treeline.sources import workspace

SMALL = "/root/testdata/sf0.001"


def _most_joined(df):
    """The most rows that a join of the plan made, after running it."""
    df._jdf.count()
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        below = node.children()
        todo += [below.apply(i) for i in range(below.size())]
    return most


def test_opened_modules_are_not_multiplied_with_their_names(spark, monkeypatch):
    files = {"p/Cargo.toml": '[package]\nname = "p"\n', "p/src/lib.rs": "pub mod big;\n", "p/src/big.rs": "".join(f"pub fn s{i}() {{}}\n" for i in range(60))}
    files |= {f"p/src/c{i}.rs": f"use crate::big::*;\nfn go{i}() {{ s{i}(); }}\n" for i in range(50)}
    ws, most, real = Workspace(workspace.memory_tree(spark, files)), [], graph.settle
    tables = ws.family("tokens"), ws.declared, ws.edges, ws.aliases, ws.modules
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        monkeypatch.setattr(graph, "settle", lambda df: most.append(_most_joined(df)) or real(df))
        defaults, hits = graph.scoped(*tables)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert 0 < max(most) < 50 * 60 / 2  # 50 files that open a module of 60 names
    assert hits.filter("reason = 'opened'").count() == 50 and defaults.filter("name = 's7'").agg(F.countDistinct("path")).first()[0] == 2


def test_kinds_of_parents_need_no_join(spark):
    plan = queries.w_tree_kinds(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_patterns_over_trees_send_no_guessed_table(spark):
    assert "BroadcastHashJoin" not in queries.w_tree_functions(spark, SMALL)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_parts_and_relationships_read_the_files_that_matter(spark, monkeypatch):
    files = {"p/Cargo.toml": '[package]\nname = "p"\n', "p/src/lib.rs": "pub mod a;\nmod b;\nmod c;\n", "p/src/a.rs": "pub struct X;\n", "p/src/b.rs": "use crate::a::X as Y;\nfn f(_: Y) {}\n", "p/src/c.rs": "fn g() { h(); }\n"}
    ws, read, real = Workspace(workspace.memory_tree(spark, files)), [], graph.scoped
    part = ws.over(["p/src/b.rs"])
    assert set(part.facts.inputFiles()).isdisjoint(ws.facts.inputFiles()) and part.facts.count() == 1
    monkeypatch.setattr(graph, "scoped", lambda tokens, *rest: read.append({r[0] for r in tokens.select("path").distinct().collect()}) or real(tokens, *rest))
    rows, coverage = ws.relationships("X")
    assert "p/src/c.rs" not in set().union(*read)
    want = ws._sites(ws.declared.filter("name = 'X'")).select("path", "start").collect()
    assert {tuple(r) for r in rows.select("path", "start").collect()} == {tuple(r) for r in want} and coverage.first()["files_remaining"] == 0


def test_words_of_one_text_are_not_shuffled_by_name(spark):
    rows = [("a", "x y x é_z 9 x1"), ("a", "y q"), ("b", "one two one"), ("c", None), ("d", ""), ("e", "1 2")]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {r["path"]: tuple(r)[1:] for r in search.word_counts(files).collect()}
    plain = search.identifiers(files).groupBy("path").agg(F.count("*"), F.sum("start"), F.sum("end"), F.countDistinct("name"))
    assert got == {r["path"]: tuple(r)[1:] for r in plain.collect()} and got["a"][3] == 5
    once = files.filter("path <> 'a'")
    plan = search.word_counts(once)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(path" in plan and search.identifiers(once, fresh=True).filter("fresh").count() == 2


def test_identifiers_make_no_object_of_a_text(spark):
    texts = [None, "", "é a_1 bb", "x\ny", "a" * 5000]
    files = spark.createDataFrame(list(enumerate(texts)), "path int, text string").coalesce(1)
    rows = {(r["path"], r["ord"]): (r["name"], r["start"], r["end"], r["line"], r["col"]) for r in search.identifiers(files).collect()}
    assert rows[("2", 0)] == ("a_1", 3, 6, 0, 2) and rows[("3", 1)] == ("y", 2, 3, 1, 0) and rows[("4", 0)][2] == 5000 and len(rows) == 5


def test_importers_are_counted_by_one_join_of_uses(spark):
    decls = spark.createDataFrame([("t", "h1"), ("t", "h2"), ("u", "h1")], "addr string, path string")
    aliases = spark.createDataFrame([("t", "t"), ("t", "v"), ("u", "u")], "target string, alias string")
    edge = spark.createDataFrame([(p, a, True, False) for p, a in (("h1", "t"), ("x", "t"), ("x", "v"), ("x", "t"), ("h1", "u"), ("y", None))], "path string, addr string, declares boolean, is_prefix boolean")
    found = graph.imported_by(decls, aliases, edge)
    assert {tuple(r) for r in found.collect()} == {("t", 2)}  # h1 is another file than h2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and plan.count("LogicalRDD") == 3 and "Aggregate [user" not in plan


def test_facts_go_from_lists_to_arrow_without_frames(spark):
    texts = {"a.rs": "use x::{y, z as w};\nfn f(a: u8) { match a { K | (L, 1) => g(), _ => {} } }\n", "b.ts": 'import { a as b } from "./x";\nb.c;\n', "c.fake": "def E\n", "d.rs": "", "e.rs": "struct É;\n"}
    files = workspace.memory_tree(spark, texts)
    found = workspace.facts(files)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    rows = {r["path"]: r for r in found.collect()}
    for path, row in rows.items():
        plain = workspace.PARSERS[row["language"]](texts[path])
        assert all([x.asDict(True) for x in row[k]] == [{c: x.get(c) for c in found.schema[k].dataType.elementType.names} for x in getattr(plain, k)] for k in workspace.FACTS)
    assert rows["a.rs"]["patterns"][1]["branches"][0]["of"] == 2 and rows["d.rs"]["tokens"] == [] and rows["e.rs"]["symbols"][0]["name"] == "É"
