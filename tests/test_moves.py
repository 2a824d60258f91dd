"""Moves of script files, moves that are refused, walks without an end, spans inside characters."""

import pytest
from pyspark.sql import functions as F

from treeline.engine import Workspace
from treeline.plans import edits
from treeline.sources import workspace

SCRIPTS = {
    "s/m.ts": 'import { k } from "./lib/k.js";\nimport { top } from "..";\nimport("./lib/data.json");\nexport const m = k + top;\n',
    "s/u.ts": 'import { m } from "./m";\nimport { m as n } from "./m.ts";\nimport { m as o } from "./m.js";\nexport { i } from "./sub";\nimport * as all from "./sub/index";\n',
    "s/lib/k.ts": "export const k = 1;\n",
    "s/sub/index.ts": 'import { m } from "../m";\nexport const i = m;\n',
    "index.ts": 'export const top = 1;\nexport * from "./s/m";\n',
    "p/Cargo.toml": '[package]\nname = "p"\n', "q/Cargo.toml": '[package]\nname = "q"\n[dependencies]\np = "1"\n',
    "p/src/lib.rs": "pub mod a;\npub use x::x;\n", "p/src/a.rs": "pub struct Alpha;\n", "q/src/lib.rs": "use p::a::Alpha;\n",
}


@pytest.fixture(scope="module")
def ws(spark):
    return Workspace(workspace.memory_tree(spark, SCRIPTS))


def after(ws, changes, moves):
    return {r["path"]: r["text"] for r in edits.after(ws.files, changes, moves).collect()}


def test_a_script_moves_with_all_its_specifiers(ws):
    changes, moves, notices = edits.move_file(ws, "s/m.ts", "t/deep/w.ts")
    now = after(ws, changes, moves)
    assert now["t/deep/w.ts"] == 'import { k } from "../../s/lib/k.js";\nimport { top } from "../..";\nimport("../../s/lib/data.json");\nexport const m = k + top;\n'
    assert now["s/u.ts"].splitlines()[:3] == ['import { m } from "../t/deep/w";', 'import { m as n } from "../t/deep/w.ts";', 'import { m as o } from "../t/deep/w.js";']
    assert now["s/sub/index.ts"].startswith('import { m } from "../../t/deep/w";') and now["index.ts"].endswith('export * from "./t/deep/w";\n') and notices.count() == 0


def test_an_index_is_named_by_its_folder(ws):
    changes, moves, _ = edits.move_file(ws, "s/sub/index.ts", "s/other/index.ts")
    now = after(ws, changes, moves)
    assert now["s/u.ts"].splitlines()[3:] == ['export { i } from "./other";', 'import * as all from "./other/index";']
    changes, moves, _ = edits.move_file(ws, "s/sub/index.ts", "s/index.ts")
    now = after(ws, changes, moves)
    assert now["s/u.ts"].splitlines()[3:] == ['export { i } from ".";', 'import * as all from "./index";'] and now["s/index.ts"].startswith('import { m } from "./m";')


def test_scripts_move_as_a_set(spark, ws):
    moves = spark.createDataFrame([("s/m.ts", "z/m.ts"), ("s/u.ts", "z/u.ts"), ("s/sub/index.ts", "z/sub/index.ts"), ("s/lib/k.ts", "z/lib/k.ts")], "source string, target string")
    now = after(ws, *edits.move_scripts(ws, moves)[:2])
    assert now["z/u.ts"] == SCRIPTS["s/u.ts"] and now["z/sub/index.ts"] == SCRIPTS["s/sub/index.ts"]
    assert now["z/m.ts"] == SCRIPTS["s/m.ts"].replace("./lib/data.json", "../s/lib/data.json") and now["index.ts"].endswith('"./z/m";\n')


@pytest.mark.parametrize(("source", "target"), [("p/src/a.rs", "q/src/a.rs"), ("p/src/a.rs", "p/a.rs"), ("p/src/a.rs", "p/src/a.ts"), ("s/m.ts", "s/m.rs"), ("s/m.ts", "s/m.tsx"), ("s/m.ts", "s/u.ts")])
def test_other_moves_are_refused(ws, source, target):
    with pytest.raises(ValueError, match="module|taken|package"):
        edits.move_file(ws, source, target)


def test_a_binding_that_names_what_is_below_itself_ends(spark):
    tree = {"c/Cargo.toml": '[package]\nname = "c"\n', "c/src/lib.rs": "pub use self::x::x;\npub mod m;\n", "c/src/m.rs": "pub(in crate::m) use crate::k as y;\nuse crate::k as z;\npub(crate) use crate::k as w;\n", "c/src/k.rs": "", "c/src/o.rs": ""}
    ws = Workspace(workspace.memory_tree(spark, tree))
    row = ws.normalise("c::x", "c").first()
    assert row["outcome"] == "growth" and not row["cycle"]
    lead = {(a, v): ws.normalise(f"c::m::{a}", v).first()["addr"] for a in "yzw" for v in ("c::m", "c::o")}
    assert lead == {("y", "c::m"): "c::k", ("y", "c::o"): "c::m::y", ("z", "c::m"): "c::k", ("z", "c::o"): "c::m::z", ("w", "c::m"): "c::k", ("w", "c::o"): "c::k"}


def test_spans_inside_characters_are_reported(spark):
    ws = Workspace(workspace.memory_tree(spark, {"a/é.rs": "fn é() {}\n", "b.rs": "fn b() {}\n"}))
    assert workspace.invalid_facts(ws.files, ws.facts).count() == 0
    torn = ws.facts.withColumn("tokens", F.transform("tokens", lambda t: t.withField("end", t["end"] - 1).withField("start", t["start"] - 1)))
    found = [tuple(r) for r in workspace.invalid_facts(ws.files, torn).collect()]
    assert found == [("a/é.rs", "tokens", 2, 4, "inside a character")]


def test_a_symbol_moves_out_of_groups_and_stays_in_sight(spark):
    from treeline.plans import symbols

    tree = {
        "c/Cargo.toml": '[package]\nname = "c"\n', "c/src/lib.rs": "pub mod a;\npub mod b;\npub mod u;\n", "c/src/b.rs": "",
        "c/src/a.rs": "fn helper() {}\n\n/// Told.\nstruct Alpha;\n\nimpl Alpha {\n    fn go(&self) { helper(); }\n}\n\npub struct Keep(Alpha);\npub struct Shown;\n",
        "c/src/u.rs": "use crate::a::{Keep, Shown as S};\npub use crate::a::{Shown};\n",
    }
    ws = Workspace(workspace.memory_tree(spark, tree))
    changes, notices = symbols.move_symbol(ws, "Shown", "c/src/a.rs", "c/src/b.rs")
    now = {r["path"]: r["text"] for r in edits.splice(ws.files, changes).collect()}
    assert now["c/src/u.rs"] == "use crate::a::{Keep, };\nuse crate::b::Shown as S;\npub use crate::a::{};\npub use crate::b::Shown;\n" and notices.count() == 0
    changes, _ = symbols.move_symbol(ws, "Alpha", "c/src/a.rs", "c/src/b.rs", widen=True)
    now = {r["path"]: r["text"] for r in edits.splice(ws.files, changes).collect()}
    assert now["c/src/b.rs"].replace("\n\n", "\n").strip() == "use crate::a::helper;\n\n/// Told.\npub(super) struct Alpha;\nimpl Alpha {\n    fn go(&self) { helper(); }\n}"
    assert now["c/src/a.rs"].startswith("use crate::b::Alpha;\npub(super) fn helper() {}\n") and "struct Alpha" not in now["c/src/a.rs"]
