"""Listing a source tree in tasks: folders are a table, and each round lists the folders that the round before left.

Rules of ignore files travel with the folders below them, so an ignored folder is never opened. The driver holds neither names
nor rules; a task holds the entries of one folder and the folders that it has still to list.
"""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.session import settle

#: Folders that one row of a round may list before it hands the rest to the next round, so that other tasks share them.
BURST = 64
#: Rows, and bytes of content, in a batch that a task hands on.
ROWS, BYTES = 4096, 32 << 20
# Ignore files, the later one before the earlier wherever both say something.
IGNORE_FILES = (".gitignore", ".ignore")

_ENTRY = "folder boolean, path string, n_bytes long, stamp_ms long, rules array<struct<line:string,own:boolean>>"
_ARROW = pa.schema([
    ("folder", pa.bool_()), ("path", pa.string()), ("n_bytes", pa.int64()), ("stamp_ms", pa.int64()),
    ("rules", pa.list_(pa.struct([("line", pa.string()), ("own", pa.bool_())]))),
])


def pattern_body(pattern: str) -> tuple[str, bool]:
    """A line of an ignore file as a regular expression without its end, and whether it names folders only."""
    body = pattern.strip()
    folders = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body[i : i + 3] == "**/":
            out, i = out + "(.*/)?", i + 3
            continue
        if body[i : i + 2] == "**":
            out, i = out + ".*", i + 2
            continue
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in ".+()[]{}^$|\\" else c
        i += 1
    return ("^" if anchored else "(^|/)") + out, folders


@lru_cache(maxsize=4096)
def _compiled(line: str) -> tuple[re.Pattern, bool, bool]:
    back = line.startswith("!")
    body, folders = pattern_body(line[1:] if back else line)
    return re.compile(body + "$", re.DOTALL), folders, back


def _said(lines: list[str], path: str, folder: bool) -> bool | None:
    """Whether the last line that speaks of an entry ignores it; None where none does."""
    for line in reversed(lines):
        found, folders, back = _compiled(line)
        if (folder or not folders) and found.search(path):
            return not back
    return None


def ignored(rules: list[tuple[str, bool]], given: list[str], path: str, folder: bool) -> bool:
    """What is given decides first, then `.ignore` files, then `.gitignore` files; a hidden name is ignored unless a line takes it back."""
    groups = (given, [line for line, own in rules if own], [line for line, own in rules if not own])
    for lines in groups:
        verdict = _said(lines, path, folder)
        if verdict is not None:
            return verdict
    return path.rpartition("/")[2].startswith(".")


def from_root(folder: str, line: str) -> str | None:
    """A line of the ignore file of a folder as a pattern from the root; None for blank lines and remarks."""
    line = line.rstrip()
    if not line or line.startswith("#"):
        return None
    sign, body = ("!", line[1:]) if line.startswith("!") else ("", line)
    if not folder:
        return sign + body
    anchored = "/" in body.rstrip("/")
    return f"{sign}/{folder}/{body.lstrip('/')}" if anchored else f"{sign}/{folder}/**/{body}"


def _opened(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a root and its path there. Roots are local paths or addresses that pyarrow opens (file, hdfs, s3, gs, abfs)."""
    if "://" in root or root.startswith("file:"):
        return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", root).replace("s3a://", "s3://"))
    return pafs.LocalFileSystem(), os.path.abspath(root)


def _text(fs: pafs.FileSystem, path: str) -> bytes:
    with fs.open_input_stream(path) as stream:
        return stream.read()


def _list(fs: pafs.FileSystem, base: str, folder: str, rules: list, given: list[str]) -> tuple[list, list, list]:
    """(files, folders, rules): what a folder holds that is not ignored, and the rules that hold below it."""
    at = f"{base}/{folder}" if folder else base
    found = fs.get_file_info(pafs.FileSelector(at, recursive=False, allow_not_found=bool(folder)))
    local = isinstance(fs, pafs.LocalFileSystem)
    held = {i.base_name: i for i in found}
    for name in IGNORE_FILES:
        if name in held and held[name].is_file:
            lines = _text(fs, held[name].path).decode("utf-8", "replace").splitlines()
            rules = rules + [(p, name == IGNORE_FILES[1]) for line in lines if (p := from_root(folder, line))]
    files, folders = [], []
    for name in sorted(held):
        info, path = held[name], f"{folder}/{name}" if folder else name
        if local and os.path.islink(info.path):  # links could lead round in a ring
            continue
        is_folder = info.type == pafs.FileType.Directory
        if not (is_folder or info.is_file) or ignored(rules, given, path, is_folder):
            continue
        if is_folder:
            folders.append(path)
        else:
            files.append((path, info.size or 0, info.mtime_ns // 1_000_000 if info.mtime_ns is not None else None))
    return files, folders, rules


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cells = list(zip(*rows, strict=True))
    rules = [None if r is None else [{"line": line, "own": own} for line, own in r] for r in cells[4]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*cells[:4], rules], _ARROW, strict=True)], schema=_ARROW)


def listed(spark: SparkSession, root: str, given: list[str] | None = None, burst: int = BURST) -> DataFrame:
    """path, n_bytes, stamp_ms of the files under a root, without what the tree's ignore files or the given lines leave out.

    Nothing below an ignored folder comes back, as that folder is not opened. Links are passed over, files without bytes are not.
    A folder that is gone when it is to be listed counts as empty, a missing root is an error. Rounds go on until no folder is left.
    """
    given = [line for line in (given or []) if line.strip() and not line.startswith("#")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _opened(root)
        base, rows = base.rstrip("/"), []
        for batch in batches:
            for one in batch.to_pylist():
                open_ = deque([(one["path"], [(r["line"], r["own"]) for r in one["rules"]])])
                for _ in range(burst):
                    if not open_:
                        break
                    folder, rules = open_.popleft()
                    files, folders, below = _list(fs, base, folder, rules, given)
                    open_.extend((f, below) for f in folders)
                    for file in files:
                        rows.append((False, *file, None))
                        if len(rows) >= ROWS:
                            yield _batch(rows)
                            rows = []
                for folder, rules in open_:
                    rows.append((True, folder, None, None, rules))
                    if len(rows) >= ROWS:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)

    front = spark.createDataFrame([("", [])], "path string, rules array<struct<line:string,own:boolean>>")
    parts = spark.sparkContext.defaultParallelism
    out = None
    while True:
        found = settle(front.mapInArrow(run, _ENTRY))
        files = found.filter("not folder").select("path", "n_bytes", "stamp_ms")
        out = files if out is None else out.unionByName(files)
        front = found.filter("folder").select("path", "rules")
        if front.isEmpty():
            return out
        front = front.repartition(parts)


def contents(files: DataFrame, root: str, size: int = 64 << 20) -> DataFrame:
    """files with text: each is read in a task, tasks of about `size` bytes. Text is null where a file is not UTF-8 or is gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _opened(root)
        base = base.rstrip("/")
        for batch in batches:
            at, texts, n = 0, [], 0
            for k, path in enumerate(batch.column("path").to_pylist()):
                try:
                    text = _text(fs, f"{base}/{path}").decode("utf-8")
                except (UnicodeDecodeError, FileNotFoundError):
                    text = None
                texts.append(text)
                n += len(text or "")
                if n >= BYTES or k + 1 == batch.num_rows:
                    part = batch.slice(at, k + 1 - at)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "text"])
                    at, texts, n = k + 1, [], 0

    total = files.agg(F.coalesce(F.sum(F.col("n_bytes") + 256), F.lit(0)).alias("n")).first()["n"]
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(max(min(cores, total >> 20), -(-total // size), 1)).mapInArrow(run, "path string, n_bytes long, stamp_ms long, text string")
