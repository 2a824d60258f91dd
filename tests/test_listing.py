"""Trees are listed in tasks, folder by folder, and ignored folders are never opened."""

import os

import pytest

from treeline.sources import listing, workspace


def _put(root, files):
    for path, text in files.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text if isinstance(text, bytes) else text.encode())


def _paths(df):
    return sorted(r["path"] for r in df.collect())


def test_rules_travel_down_and_folders_are_pruned(spark, tmp_path):
    _put(tmp_path, {
        ".gitignore": "*.log\nbuild/\n/top.rs\n", "top.rs": "", "sub/top.rs": "", "a.log": "", "keep/.gitignore": "!*.log\n", "keep/b.log": "", "keep/deep/c.log": "",
        "build/x.rs": "", "build/.gitignore": "!x.rs\n", "sub/build": "a file of that name stays", ".hidden/h.rs": "", ".github/w.rs": "", ".ignore": "!.github\n*.tmp\n", "q.tmp": "",
        "keep/.ignore": "deep\n",
    })
    assert _paths(listing.listed(spark, str(tmp_path))) == [".github/w.rs", "keep/b.log", "sub/build", "sub/top.rs"]
    # What the caller gives comes before all files of rules, but a folder that it leaves out hides what is in it.
    assert _paths(listing.listed(spark, str(tmp_path), ["!*.tmp", "# remark", "", "sub", "!sub/top.rs"])) == [".github/w.rs", "keep/b.log", "q.tmp"]


def test_every_round_hands_on_what_it_did_not_list(spark, tmp_path):
    files = {f"{a}/{b}/{c}/f{k}.rs": f"{a}{b}{c}{k}" for a in "abc" for b in "xyz" for c in "pqr" for k in range(2)}
    files |= {"/".join(["deep"] * n) + "/end.rs": str(n) for n in (1, 20, 40)}
    _put(tmp_path, files)
    for burst in (1, 3, 1000):
        assert _paths(listing.listed(spark, str(tmp_path), burst=burst)) == sorted(files)
    scanned = workspace.scan_tree(spark, str(tmp_path))
    assert {r["path"]: r["text"] for r in scanned.collect()} == files
    assert all(r["n_bytes"] == len(files[r["path"]]) and r["stamp_ms"] > 0 for r in scanned.collect())


def test_odd_names_links_and_bytes(spark, tmp_path):
    files = {"a b/ü %41#?.rs": "fn ü() {}", "empty.rs": "", "日本/x.ts": "let 日 = 1;", "raw.bin": b"\xff\xfe\x00", "long.rs": "x" * 3_000_000}
    _put(tmp_path, files)
    os.symlink(tmp_path, tmp_path / "a b" / "ring")
    os.symlink(tmp_path / "empty.rs", tmp_path / "link.rs")
    (tmp_path / "no files").mkdir()
    found = {r["path"]: r for r in workspace.scan_tree(spark, f"file://{tmp_path}").collect()}
    assert sorted(found) == sorted(files) and {p for p, r in found.items() if r["text"] is None} == {"raw.bin"}
    assert all(found[p]["text"] == t for p, t in files.items() if p != "raw.bin") and found["raw.bin"]["content_id"].startswith("stamp-")
    assert found["empty.rs"]["text"] == "" and found["empty.rs"]["content_id"] is not None


def test_empty_and_missing_roots(spark, tmp_path):
    assert listing.listed(spark, str(tmp_path)).count() == 0 and workspace.scan_tree(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="none"):
        listing.listed(spark, f"{tmp_path}/none").count()
