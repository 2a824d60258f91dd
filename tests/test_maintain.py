"""A workspace after change sets is the workspace that a new scan would make, with less work."""

from tests.workspaces import TREE
from treeline.engine import Workspace
from treeline.sources import workspace
from treeline.streaming import maintain

SETS = [
    # A body alone; a text that is the same; a file that no import speaks of goes.
    ({"tide/src/gauge/clock.rs": TREE["tide/src/gauge/clock.rs"].replace("372", "373"), "tide/src/lib.rs": TREE["tide/src/lib.rs"], "notes/ships.txt": None}, (2, 1, 1)),
    # A module goes that others import, a script's target gives way to an index file, a module comes.
    ({"berth/src/quay/quay.rs": None, "site/units.ts": None, "site/units/index.ts": "export const metre = 2;\n", "berth/src/east/isle.rs": "use super::super::west::sunset;\n"}, (4, 2, None)),
    # A dependency gets another name: every import is resolved again.
    ({"desk/Cargo.toml": '[package]\nname = "desk"\n[dependencies]\nscheme = { package = "berth-plan" }\n', "desk/src/main.rs": "use scheme::quay::*;\nfn main() { deepest(1); }\n"}, (2, 1, None)),
]


def _edges(ws):
    return sorted(map(str, ws.edges.select(sorted(ws.edges.columns)).collect()))


def _declared(ws):
    return sorted(map(str, ws.declared.select(sorted(ws.declared.columns)).collect()))


def _built(spark, tree):
    return Workspace(workspace.memory_tree(spark, tree))


def test_change_sets_lead_where_a_rebuild_leads(spark, monkeypatch):
    monkeypatch.setattr(maintain, "LAYERS", 2)
    tree, held = dict(TREE), maintain.Maintained(workspace.memory_tree(spark, TREE))
    assert _edges(held.workspace)
    for changes, (changed, parsed, resolved) in SETS:
        told = held.apply(spark.createDataFrame(list(changes.items()), "path string, text string")).first()
        tree = {p: t for p, t in (tree | changes).items() if t is not None}
        want = _built(spark, tree)
        assert (told["changed"], told["parsed"], told["held"]) == (changed, parsed, len(tree))
        assert resolved is None or told["resolved"] == resolved
        assert _edges(held.workspace) == _edges(want)
        assert _declared(held.workspace) == _declared(want)
        assert {tuple(r) for r in held.workspace.files.select("path", "text").collect()} == set(tree.items())


def test_a_stream_of_snapshots_keeps_a_workspace(spark, tmp_path):
    held = maintain.Maintained(workspace.memory_tree(spark, {p: t for p, t in TREE.items() if p.startswith("site/")}))
    for part in ([("site/units.ts", "export const metre = 3;\n", 1), ("site/units.ts", None, 2)], [("site/units.ts", "export const yard = 4;\n", 3)], []):
        if part:
            spark.createDataFrame(part, "path string, text string, version long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        maintain.follow(spark, held, f"{tmp_path}/in", f"{tmp_path}/ck").awaitTermination()
        names = {r["name"] for r in held.workspace.declared.filter("path = 'site/units.ts'").collect()}
        gone = [r["raw"] for r in held.workspace.edges.filter("addr is null").collect()]
        assert (names, gone) == ((set(), ["./units", "./units"]) if held.workspace.files.filter("path = 'site/units.ts'").isEmpty() else ({"yard"}, []))
