"""Commands on a small tree of three packages and a few script modules. Expected rows were checked against the sources by hand."""

import pytest
from pyspark.sql import functions as F

from tests.workspaces import TREE
from treeline.engine import Workspace
from treeline.plans import edits
from treeline.plans.ledger import Ledger, Plan, Retained, Stale
from treeline.sources import requests, workspace


@pytest.fixture(scope="module")
def ws(spark):
    return Workspace(workspace.memory_tree(spark, TREE))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_impact_goes_through_all_names_of_a_declaration(ws):
    found = rows(ws.impact("Level").select("addr", "depth"))
    assert sorted(a for a, d in found if d == 1) == ["berth_plan", "desk", "desk::board", "tide", "tide::gauge"]
    assert sorted(a for a, d in found if d == 2) == ["berth_plan::east", "berth_plan::quay", "berth_plan::west"]


def test_dead(ws):
    assert rows(ws.dead().select("name", "unsure")) == [("sunrise", 0), ("main", 0), ("first", 0), ("LEAP", 0)]


def test_aliases_follow_chains_and_end_in_cycles(ws):
    found = set(rows(ws.aliases.filter("step > 0 and alias like '%::%' and target not like 'site%'").select("target", "alias", "step")))
    level = "tide::gauge::level::Level"
    chain = {(level, "tide::gauge::Level", 1), (level, "tide::Level", 2), (level, "berth_plan::Water", 3)}
    ring = {("berth_plan::east::sunrise", "berth_plan::west::sunrise", 1), ("berth_plan::west::sunset", "berth_plan::east::sunset", 1)}
    assert found == chain | ring


def test_surface(ws):
    found = {r["addr"]: (r["aliases"], r["imported_by"]) for r in ws.surface("tide").collect()}
    assert found["tide::gauge::level::Level"] == (["berth_plan::Water", "tide::Level", "tide::gauge::Level"], 5)
    assert found["tide::gauge::clock::turns"] == ([], 1) and "tide::gauge::clock::half" not in found


def test_references(ws):
    found = [(r["path"], r["reason"]) for r in ws.references("Level").collect()]
    assert sorted(found) == sorted([
        ("tide/src/gauge/level.rs", "declaring"), ("tide/src/gauge/level.rs", "declaring"), ("tide/src/gauge/mod.rs", "imported"), ("tide/src/gauge/mod.rs", "imported"),
        ("tide/src/gauge/mod.rs", "imported"), ("berth/src/quay/mod.rs", "path"), ("tide/src/lib.rs", "re-export"), ("berth/src/lib.rs", "re-export"),
    ])
    assert ws.references("Level").filter("confidence <> 'resolved'").count() == 0


def test_segments_of_one_name_are_told_by_their_place(ws):
    text = TREE["desk/src/board.rs"]
    path = text.index("quay::quay::quay")
    found = {r["start"]: r["confidence"] for r in ws.references("quay", "berth/src/quay/quay.rs").filter("path = 'desk/src/board.rs'").collect()}
    assert found == {text.index("quay"): "other", path: "other", path + 6: "other", path + 12: "resolved", text.index("quay()"): "resolved"}


def test_import_problems(ws):
    assert rows(ws.imports().select("path", "raw", "problem")) == [("berth/src/quay/mod.rs", "std::fmt::Debug", "unused")]


def test_search_order_and_roles(ws):
    found = rows(ws.search("quay").orderBy("ordinal").select("ordinal", "role", "line", "col", "line_text"))
    assert [n for n, *_ in found] == list(range(1, 10)) and [r for _, r, *_ in found] == ["declaration"] * 3 + ["import"] * 4 + ["use", "import"]
    assert found[7][2:] == (5, 35, "    let held = Slot::Taken { ship: quay() };")
    with pytest.raises(ValueError):
        ws.search()


def test_targets(ws):
    with pytest.raises(LookupError):
        ws.target("nowhere")
    with pytest.raises(LookupError, match="ambiguous"):
        ws.target("quay")
    assert ws.target("Level") == "tide::gauge::level::Level"


def test_callers_and_bindings(ws):
    assert {r[2] for r in rows(ws.callers("turns"))} == {"read", "deepest"}
    held = {(r["path"], r["name"], r["b_kind"]) for r in ws.bindings().collect()}
    assert {("tide/src/gauge/clock.rs", "at", "parameter"), ("desk/src/main.rs", "w", "variable"), ("desk/src/board.rs", "held", "variable"), ("site/chart/plot.ts", "x", "parameter")} <= held


def test_facts_are_spans_of_their_files(ws):
    assert workspace.invalid_facts(ws.files, ws.facts).count() == 0


def test_rename_preview_apply_undo(ws, tmp_path):
    for path, text in TREE.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    plan_edits = edits.rename(ws.references("Level"), "Height", False)
    assert edits.conflicts(plan_edits).count() == 0
    after = edits.after(ws.files, plan_edits)
    diffs = edits.preview(ws.files.select("path", "text"), after)
    assert diffs.count() == 5 and "+pub struct Height {" in diffs.filter("path like '%level.rs'").first()["diff"]
    ledger = Ledger(str(tmp_path))
    plan = Plan.of("rename", ws.files.select("path", "text"), after)
    ledger.apply(plan)
    assert "pub use tide::Height as Water;" in (tmp_path / "berth/src/lib.rs").read_text()
    with pytest.raises(Stale):
        ledger.apply(plan)
    ledger.undo()
    assert {p: (tmp_path / p).read_text() for p in TREE} == TREE and ledger.history() == []


def test_rewrite(ws):
    hits = edits.pattern_matches(ws.files, "Slot::Taken { ship: $N($$$REST) }")
    changed = edits.splice(ws.files, edits.rewrite(hits, "Slot::taken_by($N($REST))"))
    assert [(r["path"], "Slot::taken_by(quay())" in r["text"]) for r in changed.collect()] == [("desk/src/board.rs", True)]
    with pytest.raises(Exception, match="captures no"):
        edits.splice(ws.files, edits.rewrite(hits, "$NONE")).collect()


def test_scan_ignores_and_overlay(spark, tmp_path):
    for p in ("a/x.rs", "a/b/y.ts", "target/z.rs", ".git/k.rs", "keep/target/n.rs"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("fn f() {}")
    files = workspace.scan_tree(spark, str(tmp_path), ["/target", "*.ts"])
    assert sorted(r["path"] for r in files.collect()) == ["a/x.rs", "keep/target/n.rs"]
    staged = spark.createDataFrame([("a/x.rs", "new"), ("n.rs", "made")], "path string, text string")
    seen = dict(rows(workspace.overlay(files, staged, spark.createDataFrame([("keep/target/n.rs",)], "path string"))))
    assert seen == {"a/x.rs": "new", "n.rs": "made"}


def test_serve(ws):
    lines = ['{"id":7,"command":"where","name":"Slot"}', "no json", '{"id":8,"command":"bogus"}', '{"id":9,"command":"impact","name":"nowhere"}']
    import json

    out = [json.loads(x) for x in requests.serve(lines, {"where": ws.where, "impact": ws.impact})]
    assert [(o["id"], o["status"]) for o in out] == [(7, "ok"), (None, "error"), (8, "error"), (9, "error")]
    assert out[0]["result"][0]["statement"] == "use crate::quay::Slot;"


def test_retention():
    now = [0.0]
    kept = Retained(2, 10, clock=lambda: now[0])
    kept.put("a", 1)
    now[0] = 1
    kept.put("b", 2)
    now[0] = 2
    kept.get("a")
    kept.put("c", 3)
    with pytest.raises(LookupError):
        kept.get("b")
    now[0] = 20
    with pytest.raises(LookupError):
        kept.get("a")


def test_stream_refresh(spark, tmp_path):
    from treeline.streaming import refresh

    source = f"{tmp_path}/in"
    extract = lambda df: df.withColumn("n", F.length("text"))
    for part in ([("a", "one", 1), ("b", "two", 1)], [("a", "three", 2), ("b", None, 2)]):
        spark.createDataFrame(part, "path string, text string, version long").write.mode("append").parquet(source)
        refresh.stream_facts(spark, source, f"{tmp_path}/out", f"{tmp_path}/ck", extract).awaitTermination()
    facts = refresh.newest_only(spark.read.parquet(f"{tmp_path}/out"))
    assert {(r["path"], r["n"]) for r in facts.collect()} == {("a", 5), ("b", 3)}


def test_symbol_move(ws):
    from treeline.plans import symbols

    changes, notices = symbols.move_symbol(ws, "half", "tide/src/gauge/clock.rs", "tide/src/gauge/level.rs")
    assert edits.conflicts(changes).count() == 0 and notices.count() == 0
    after = dict(rows(edits.after(ws.files, changes)))
    assert after["tide/src/gauge/level.rs"].endswith("}\n\nfn half() -> u16 {\n    372\n}\n")
    assert after["tide/src/gauge/clock.rs"] == "use crate::gauge::level::half;\n" + TREE["tide/src/gauge/clock.rs"].replace("fn half() -> u16 {\n    372\n}\n", "")
    level, _ = symbols.move_symbol(ws, "Level", "tide/src/gauge/level.rs", "tide/src/gauge/clock.rs")
    moved = dict(rows(edits.after(ws.files, level)))
    assert "impl Level" in moved["tide/src/gauge/clock.rs"] and "pub use crate::gauge::clock::Level;" in moved["tide/src/gauge/mod.rs"] and moved["tide/src/gauge/level.rs"].strip() == ""
    assert symbols.candidates(ws.family("symbols"), "tide/src/gauge/level.rs", "ebb").first()["refusal"] == "not movable"


def test_context(ws):
    from treeline.operators import context

    found = [(r["relation"], r["name"]) for r in context.assemble(ws, "turns").collect()]
    assert found == [("definition", "turns"), ("outgoing", "half"), ("incoming", "deepest"), ("incoming", "read")]
    assert context.assemble(ws, "turns", max_items=1).count() == 1
    assert context.definition_at(ws.occurrences, "tide/src/gauge/clock.rs", TREE["tide/src/gauge/clock.rs"].index("half")).first()["targets"] == ["tide::gauge::clock::half"]
    bound = {(r["local"], r["target"]) for r in context.named_bindings(ws.family("named_imports"), ws.edges, ws.declared).collect()}
    assert bound == {("plot", "site/chart/plot.ts::plot"), ("Mark", "site/chart/plot.ts::Mark"), ("units", "site/units.ts"), ("meter", "site/units.ts::metre")}


def test_excerpts_end_between_characters(spark):
    from treeline.operators import context

    text = "aé日😀b"
    df = spark.createDataFrame([(text,)], "t string")
    for n in range(1, 12):
        got = df.select(context.excerpt(F.col("t"), F.lit(0), F.lit(len(text.encode())), n)).first()[0]
        assert text.startswith(got) and len(got.encode()) <= n and len(got.encode()) > n - 4


def _meaning(ws, path, word, nth=0):
    at = -1
    for _ in range(nth + 1):
        at = TREE[path].index(word, at + 1)
    found = ws.navigate(path, at).collect()
    return [(r["outcome"], r["tier"], r["targets"] or r["why"]) for r in found]


def test_navigation_by_tiers(ws):
    board, main = "desk/src/board.rs", "desk/src/main.rs"
    assert _meaning(ws, board, "held", 1) == [("resolved", "local", [f"{board}@{TREE[board].index('held')}"])]
    assert _meaning(ws, board, "quay()") == [("resolved", "direct", ["berth_plan::quay::quay::quay"])]
    assert _meaning(ws, board, "Sea", 1) == _meaning(ws, board, "Water") == [("resolved", "direct", ["tide::gauge::level::Level"])]
    assert _meaning(ws, main, "deepest") == [("resolved", "opened", ["berth_plan::quay::deepest"])]
    assert _meaning(ws, main, "sunset") == [("resolved", "direct", ["berth_plan::west::sunset"])]
    assert _meaning(ws, board, "drop") == [("unavailable", None, "unknown-name")] and ws.navigate(board, TREE[board].index(";")).count() == 0


def test_addresses_are_followed_to_their_declaration(ws):
    walk = lambda addr, viewer: tuple(ws.normalise(addr, viewer).select("addr", F.size("trail"), "cycle").first())
    assert walk("berth_plan::Water", "desk") == ("tide::gauge::level::Level", 4, False)
    assert walk("desk::board::Sea::cm", "desk::board") == ("tide::gauge::level::Level::cm", 5, False)
    assert walk("desk::board::Sea", "tide") == ("desk::board::Sea", 1, False)  # an import is for its own module


def test_cycles_of_names_end(spark):
    from treeline.operators import navigation

    edge = spark.createDataFrame([("g::a", "X", "g::b::X", True), ("g::b", "X", "g::a::X", True)], "from_addr string, binding string, addr string, reexport boolean").withColumns({"declares": F.lit(True), "is_prefix": F.lit(False)})
    asked = spark.createDataFrame([(1, "g::a::X", "g"), (2, "g::c", "g")], "id long, addr string, viewer string")
    found = {r["id"]: (r["addr"], r["cycle"]) for r in navigation.normalised(asked, edge, spark.createDataFrame([("g::c",)], "addr string")).collect()}
    assert found == {1: ("g::b::X", True), 2: ("g::c", False)}


def test_relationships_under_all_names_within_a_budget(ws):
    sites, coverage = ws.relationships("Level")
    found = sorted((r["path"], r["name"]) for r in sites.collect())
    assert found == sorted([("berth/src/lib.rs", "Level"), ("berth/src/lib.rs", "Water"), ("berth/src/quay/mod.rs", "Level"), ("desk/src/board.rs", "Sea"), ("desk/src/board.rs", "Sea"), ("desk/src/board.rs", "Water"),
                            ("desk/src/main.rs", "Water"), ("desk/src/main.rs", "Water"), ("tide/src/gauge/level.rs", "Level"), ("tide/src/gauge/mod.rs", "Level"), ("tide/src/gauge/mod.rs", "Level"), ("tide/src/gauge/mod.rs", "Level"), ("tide/src/lib.rs", "Level")])
    assert tuple(coverage.first()) == (7, 0, 13, 0, None)
    assert tuple(ws.relationships("Level", max_files=2)[1].first()) == (2, 5, 3, 10, "files")
    assert tuple(ws.relationships("Level", max_items=4)[1].first()) == (7, 0, 4, 9, "items")


def _moved(ws, source, target):
    changes, moves, notices = edits.move_file(ws, source, target)
    assert edits.conflicts(changes).count() == 0
    return dict(rows(edits.after(ws.files, changes, moves))), rows(notices.select("kind"))


def test_moved_files_take_their_mod_line_and_leave_groups(ws):
    after, notices = _moved(ws, "tide/src/gauge/clock.rs", "tide/src/clock.rs")
    want = dict(TREE)
    want["tide/src/clock.rs"] = want.pop("tide/src/gauge/clock.rs")
    want["tide/src/gauge/mod.rs"] = want["tide/src/gauge/mod.rs"].replace("pub mod clock;\n", "").replace("clock::turns(at)", "crate::clock::turns(at)")
    want["tide/src/lib.rs"] = "pub mod gauge;\npub mod clock;\npub use gauge::Level;\n"
    want["berth/src/quay/mod.rs"] = want["berth/src/quay/mod.rs"].replace("{clock::turns, level};", "{level};\nuse tide::clock::turns;")
    assert after == want and notices == []


def test_moved_folders_go_as_a_whole(ws):
    after, notices = _moved(ws, "berth/src/quay/mod.rs", "berth/src/dock/mod.rs")
    assert {"berth/src/dock/mod.rs", "berth/src/dock/quay.rs"} <= set(after) and not any(p.startswith("berth/src/quay") for p in after) and notices == []
    assert after["berth/src/lib.rs"].startswith("pub mod dock;\n")
    assert after["desk/src/main.rs"].startswith("mod board;\n\nuse plan::{Water};\nuse plan::dock::*;\n")
    assert after["desk/src/board.rs"].startswith("use plan::dock::Slot;\nuse plan::dock::quay::quay;\n")


def test_moves_that_cannot_be_made(ws):
    assert _moved(ws, "tide/src/gauge/clock.rs", "tide/src/no/clock.rs")[1] == [("no parent module",)]
    with pytest.raises(ValueError, match="taken"):
        edits.move_file(ws, "tide/src/gauge/clock.rs", "tide/src/gauge/level.rs")
    with pytest.raises(ValueError, match="root"):
        edits.move_file(ws, "tide/src/lib.rs", "tide/src/x.rs")


def test_scopes_say_what_the_judge_says(ws):
    from treeline.operators import graph

    assert rows(graph.dead(ws.occurrences, ws.declared)) == rows(ws.dead())
    defaults, hits = ws.scoped
    sure = ws.occurrences.filter("confidence = 'resolved'").select("target", "path", "start", "reason")
    assert sorted(rows(sure.distinct())) == sorted(rows(hits.select("target", "path", "start", "reason")))
    rest = ws.occurrences.join(hits, ["target", "path", "start"], "left_anti").select("path", "start", "confidence").distinct()
    told = {(r["path"], r["start"]): r["confidence"] for r in defaults.collect()}
    assert all(told[r["path"], r["start"]] == r["confidence"] for r in rest.collect()) and rest.count() > 0


def test_narrow_paths_say_what_the_judge_says(ws):
    from treeline.operators import navigation

    for name, where in (("quay", "berth/src/quay/quay.rs"), ("Level", None)):
        want = ws.occurrences.filter(F.col("target") == ws.target(name, where))
        found = ws.references(name, where)
        assert want.count() > 5 and sorted(rows(found.select(want.columns))) == sorted(rows(want))
    judged = navigation.resolved(ws.family("tokens"), ws.bindings(), ws.occurrences, ws._sites(ws.declared), ws.family("uncertain"), ws.patterns, ws.members)
    assert sorted(map(str, judged.collect())) == sorted(map(str, ws.resolutions.select(judged.columns).collect()))
