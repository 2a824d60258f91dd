"""Relationships and navigation read the files they need and no others."""

import pytest

from tests.workspaces import TREE
from treeline.engine import Workspace
from treeline.operators import navigation
from treeline.sources import workspace


@pytest.fixture(scope="module")
def ws(spark):
    return Workspace(workspace.memory_tree(spark, TREE))


def _rows(df):
    return [tuple(r) for r in df.collect()]


def test_every_site_lies_in_a_candidate_and_the_stages_find_all(ws):
    whole = ws._sites(ws.declared).select("target", "path", "start", "name", "via").collect()
    assert len(whole) > 20
    for name in ("Level", "metre"):
        at = ws.target(name)
        want = sorted((r["path"], r["start"], r["name"], r["via"]) for r in whole if r["target"] == at)
        sites, coverage = ws.related(name)
        assert [tuple(r) for r in sites.select("path", "start", "name", "via").collect()] == want
        told = coverage.first()
        assert (told["files_remaining"], told["items"], told["items_omitted"], told["limit_hit"]) == (0, len(want), 0, None) and told["files_scanned"] == told["lookups"]


def test_a_spent_budget_leaves_files_unread(ws, monkeypatch):
    monkeypatch.setattr(navigation, "FIRST_FILES", 1)
    whole = sorted((r["path"], r["start"]) for r in ws.related("Level", max_items=1024)[0].collect())
    wanted = ws.declared.filter("name = 'Level'")
    paths = sorted(r["path"] for r in navigation.candidate_files(ws.edges, ws.aliases, wanted, ws.modules).collect())
    read = []

    def spy(some):
        read.extend(some)
        return ws.over(some)._sites(wanted)

    rows, told = navigation.staged(spy, ws.modules.select("path").filter(navigation.F.col("path").isin(*paths)), max_files=3)
    inside = [w for w in whole if w[0] in paths[:3]]
    assert read == paths[:3] and sorted((r["path"], r["start"]) for r in rows.collect()) == inside
    assert _rows(told) == [(3, len(paths) - 3, len(paths), len(inside), 0, "files")]
    read.clear()
    rows, told = navigation.staged(spy, ws.modules.select("path").filter(navigation.F.col("path").isin(*paths)), max_items=1)
    assert len(read) < len(paths) and [(r["path"], r["start"]) for r in rows.collect()] == whole[:1] and told.first()["limit_hit"] == "items"
    told = ws.related("Level", max_lookups=2)[1].first()
    assert (told["lookups"], told["files_scanned"], told["limit_hit"]) == (2, 2, "lookups")
    for bad in ({"max_files": 0}, {"max_items": 1025}, {"max_lookups": 0}):
        with pytest.raises(ValueError, match=next(iter(bad))):
            ws.related("Level", **bad)


def test_parts_say_what_the_whole_says(ws):
    cells = ["path", "start", "name", "outcome", "tier", "targets", "why"]
    paths = ["berth/src/quay/mod.rs", "desk/src/board.rs", "site/index.ts", "site/main.ts"]
    want = sorted(_rows(ws.resolutions.filter(navigation.F.col("path").isin(paths)).select(cells)), key=str)
    assert len(want) > 30 and sorted(_rows(ws.over(paths).resolutions.select(cells)), key=str) == want
