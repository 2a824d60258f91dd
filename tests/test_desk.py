"""Plans on the desk, reports, the command table, snapshots, ignore files, providers and bounds."""

import json
import sys
import threading
import time

import pytest
from pyspark.sql import functions as F

from tests.workspaces import TREE
from treeline import report, session
from treeline.engine import Workspace
from treeline.functions import text as T
from treeline.operators import navigation, search
from treeline.plans import desk, edits
from treeline.sources import requests, workspace


@pytest.fixture(scope="module")
def ws(spark):
    return Workspace(workspace.memory_tree(spark, TREE))


def test_a_plan_from_preparation_to_receipt(ws, tmp_path):
    for path, text in TREE.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    table = desk.Desk(str(tmp_path), most=2)
    key = table.prepare("rename", ws.files, edits.rename(ws.references("Level"), "Height", False))
    told = table.inspect(key).first()
    assert (told["title"], told["edits"], told["files"], told["removed"], told["added"]) == ("rename", 8, 5, 40, 48)
    first = table.review(key, max_items=2).collect()
    rest = table.review(key, after=first[-1]["ordinal"]).collect()
    assert [r["ordinal"] for r in first + rest] == [1, 2, 3, 4, 5] and [r["path"] for r in first + rest] == sorted(r["path"] for r in first + rest)
    assert all("Height" in r["diff"] for r in first + rest)
    parts = table.chunks(key, "tide/src/gauge/level.rs", size=50).collect()
    assert {r["pointer"] for r in parts} == {"/files/tide~1src~1gauge~1level.rs/diff"} and "".join(r["text"] for r in parts) == next(r["diff"] for r in first + rest if r["path"].endswith("level.rs"))
    receipt = table.apply(key)
    assert table.apply(key) == receipt and "struct Height" in (tmp_path / "tide/src/gauge/level.rs").read_text()
    other = table.prepare("again", ws.files, edits.rename(ws.references("Slot"), "Place", False))
    table.discard(other)
    with pytest.raises(LookupError):
        table.inspect(other)
    twice = edits.rename(ws.references("Slot"), "Place", False)
    with pytest.raises(ValueError, match="conflict"):
        table.prepare("bad", ws.files, twice.unionByName(twice))


def test_checks_of_a_tree(tmp_path):
    (tmp_path / "a").write_text("1")
    mark = lambda: desk.tree_mark(str(tmp_path))
    ok, bad, slow, gone = desk.validate(str(tmp_path), [[sys.executable, "-c", "print('x' * 50)"], [sys.executable, "-c", "open('a', 'w').write('2'); raise SystemExit(3)"], [sys.executable, "-c", "import time; time.sleep(9)"], ["no-such-program"]], mark, seconds=2, most_bytes=10)
    assert (ok["status"], ok["cut"], len(ok["output"]), ok["stale"]) == ("passed", True, 10, False)
    assert (bad["status"], bad["code"], bad["stale"]) == ("failed", 3, True) and slow["status"] == "timeout" and gone["status"] == "missing"
    with pytest.raises(ValueError):
        desk.validate(str(tmp_path), [], mark)


def test_every_command_of_the_catalogue_is_answered(ws):
    handlers = ws.commands()
    assert set(handlers) == set(requests.COMMANDS)
    asked = [{"command": "search", "pattern": "turns($A)"}, {"command": "search_page", "name": "quay", "max_items": 3}, {"command": "navigate", "path": "desk/src/main.rs", "offset": 64}, {"command": "explain", "path": "tide/src/gauge/level.rs", "offset": 45}]
    lines = [json.dumps({"id": i, **a}) for i, a in enumerate(asked)]
    out = [json.loads(x) for x in requests.serve(lines, handlers)]
    assert [o["status"] for o in out] == ["ok"] * 4 and len(out[0]["result"]) == 2 and [r["ordinal"] for r in out[1]["result"]] == [1, 2, 3]
    assert out[2]["result"][0]["targets"] == ["tide::gauge::level::Level"]
    told = out[3]["result"][0]
    assert (told["declared_addr"], told["reach"], told["imported_by"], len(told["aliases"])) == ("tide::gauge::level::Level", "everyone", 5, 3)
    assert "unsure" in ws.schema("dead").first()["schema"] and "ordinal" in ws.schema("search").first()["schema"]


def test_structure_and_symbols_together(ws):
    pattern = "pub fn $N($$$A) -> u16 { $$$B }"
    assert {r["path"] for r in ws.search(pattern=pattern).collect()} == {"tide/src/gauge/clock.rs", "tide/src/gauge/level.rs", "berth/src/quay/quay.rs", "desk/src/board.rs"}
    assert {r["path"] for r in ws.search(pattern=pattern, kind="method").collect()} == {"tide/src/gauge/level.rs"}
    assert {r["path"] for r in ws.search(pattern=pattern, name="quay").collect()} == {"berth/src/quay/quay.rs"}
    assert ws.search(name="Mark", language="rust").count() == 0 and ws.search(name="Mark", language="typescript").count() == 4
    assert {(r["language"], r["files"]) for r in ws.skipped().collect()} == {(None, 5)}


def test_reports(ws):
    lines = [r["value"] for r in report.as_lines(ws.dead().select("path", "name", "unsure"), "dead", group="path").collect()]
    assert lines[0] == "dead: 4" and lines[1:3] == ["berth/src/east.rs (1)", "  sunrise  0"] and len(lines) == 9
    assert json.loads(report.as_json(ws.dead().select("name"), "dead").first()["value"])["report"] == "dead"


def test_bounds_and_slices(spark, ws):
    assert search.bounded(ws.dead()).count() == 4
    with pytest.raises(OverflowError):
        search.bounded(ws.dead(), 10)
    one = spark.createDataFrame([("aé日b",)], "t string")
    cut = lambda a, n: one.select(T.checked_slice(F.col("t"), F.lit(a), F.lit(n))).first()[0]
    assert (cut(0, 3), cut(3, 4), cut(7, 0)) == ("aé", "日b", "")
    for a, n in ((2, 1), (0, 2), (0, 9)):
        with pytest.raises(Exception, match="range"):
            cut(a, n)


def test_snapshots_and_ignore_files(spark, tmp_path):
    for path, text in {"a.rs": "fn a() {}", "out/b.rs": "", "sub/.gitignore": "*.gen.rs\n/only.rs\n!keep.gen.rs\n", "sub/x.gen.rs": "", "sub/deep/y.gen.rs": "", "sub/keep.gen.rs": "", "sub/only.rs": "", "sub/deep/only.rs": "", "z.gen.rs": "", ".gitignore": "out/\n# remark\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    files = workspace.scan_tree(spark, str(tmp_path))
    assert sorted(r["path"] for r in files.collect()) == ["a.rs", "sub/deep/only.rs", "sub/keep.gen.rs", "z.gen.rs"]
    held = workspace.captured(files)
    assert workspace.revalidated(held, workspace.scan_tree(spark, str(tmp_path))).count() == 0
    (tmp_path / "a.rs").write_text("fn b() {}")
    assert [tuple(r) for r in workspace.revalidated(held, workspace.scan_tree(spark, str(tmp_path))).collect()] == [("a.rs", "changed")]


def test_answers_of_a_provider(spark, ws):
    board, text = "desk/src/board.rs", TREE["desk/src/board.rs"]
    mark = ws.files.filter(F.col("path") == board).first()["content_id"]
    at, slot = text.index("drop"), "berth_plan::quay::Slot"
    rows = [(board, at, slot, "lsp", 2, mark), (board, at, "tide::gauge::read", "lsp", 1, mark), (board, text.index("ship"), slot, "lsp", 2, "old content"), (board, text.index("u16"), "nowhere", "lsp", 2, mark)]
    answers = spark.createDataFrame(rows, "path string, start int, target string, provider string, version int, content_id string")
    out = {r["start"]: (r["outcome"], r["tier"], r["targets"]) for r in navigation.provided(ws.resolutions, answers, ws.files, ws.declared).filter(F.col("path") == board).collect()}
    assert out[at] == ("resolved", "provided", [slot]) and out[text.index("ship")][0] == out[text.index("u16")][0] == "unavailable"


def test_jobs_can_be_stopped(spark):
    ended = []

    def work():
        with session.cancellable(spark, "slow-one"):
            try:
                spark.range(4).repartition(2).mapInPandas(lambda frames: (time.sleep(60) or f for f in frames), "id long").collect()
                ended.append("done")
            except Exception:  # noqa: BLE001 - Spark's own error
                ended.append("stopped")

    thread = threading.Thread(target=work)
    began = time.perf_counter()
    thread.start()
    while thread.is_alive() and time.perf_counter() - began < 40:
        time.sleep(1)
        session.cancel(spark, "slow-one")
    thread.join(60)
    assert ended == ["stopped"]
