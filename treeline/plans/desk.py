"""Plans that are prepared, looked at, reviewed page by page, applied or discarded, and checks of an applied plan."""

from __future__ import annotations

import hashlib
import subprocess
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.functions import text as T
from treeline.operators import search
from treeline.plans import edits
from treeline.plans.ledger import Ledger, Plan, Retained
from treeline.session import settle

#: Commands of one validation, seconds for each, and bytes of its output that are kept.
MOST_COMMANDS, DEADLINE, OUTPUT = 4, 60.0, 16384


@dataclass
class Prepared:
    """A plan's tables, written once: what a review shows is what is applied."""

    title: str
    before: DataFrame
    changes: DataFrame
    after: DataFrame
    moves: DataFrame | None
    notices: DataFrame | None


class Desk:
    """Plans over one tree of files. An applied plan leaves a receipt, and applying it again returns that receipt."""

    def __init__(self, root: str, most: int = 16, seconds: float = 600) -> None:
        self.ledger, self.held, self.receipts = Ledger(root), Retained(most, seconds, evict=False), {}

    def prepare(self, title: str, files: DataFrame, changes: DataFrame, moves: DataFrame | None = None, notices: DataFrame | None = None) -> str:
        """An id for the plan; changes that overlap, or moves that collide, are an error."""
        if not edits.conflicts(changes).isEmpty() or (moves is not None and not edits.move_conflicts(moves, files).isEmpty()):
            raise ValueError("the plan's changes are in conflict")
        changes = settle(changes)
        touched = files.select("path", "text").join(changes.select("path").distinct(), "path", "left_semi")
        key = uuid.uuid4().hex[:12]
        self.held.put(key, Prepared(title, touched, changes, settle(edits.splice(touched, changes)), moves, notices))
        return key

    def inspect(self, key: str) -> DataFrame:
        """One row: title, edits, files, bytes removed and added, notices."""
        plan = self.held.get(key)
        return edits.review(plan.changes, plan.notices).withColumn("title", F.lit(plan.title))

    def review(self, key: str, after: int = 0, max_items: int = 20, max_bytes: int = 16384) -> DataFrame:
        """A page of the plan's files in order: ordinal, path, diff; a diff that no page holds is read by chunks()."""
        plan = self.held.get(key)
        diffs = edits.preview(plan.before, plan.after).select("path", "diff", F.lit("use").alias("role"), F.lit(0).alias("start"), F.lit(0).alias("end"))
        rows = search.numbered(diffs).select("ordinal", "path", "diff")
        short = rows.withColumn("diff", F.when(F.octet_length("diff") <= max_bytes // 2, F.col("diff")))
        return search.page(short, after, max_items, max_bytes).drop("page_bytes")

    def chunks(self, key: str, path: str, size: int = 4096) -> DataFrame:
        """One file's diff in parts that a JSON pointer names."""
        plan = self.held.get(key)
        one = edits.preview(plan.before.filter(F.col("path") == path), plan.after)
        pointer = F.concat(F.lit("/files/"), F.replace(F.replace(F.col("path"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")), F.lit("/diff"))
        return one.select(F.posexplode(T.chunks(F.col("diff"), size)).alias("part", "text"), pointer.alias("pointer")).select("pointer", "part", "text").orderBy("part")

    def apply(self, key: str) -> dict:
        if key in self.receipts:
            return self.receipts[key]
        plan = self.held.get(key)
        self.receipts[key] = self.ledger.apply(Plan.of(plan.title, plan.before, plan.after, plan.moves))
        self.held.discard(key)
        return self.receipts[key]

    def discard(self, key: str) -> None:
        self.held.get(key)
        self.held.discard(key)


def validate(root: str, commands: list[list[str]], inputs: Callable[[], str], seconds: float = DEADLINE, most_bytes: int = OUTPUT) -> list[dict]:
    """Run check commands in a tree, one after another: command, status (passed, failed, timeout, missing), code, output, and stale: whether the inputs changed meanwhile."""
    if not 0 < len(commands) <= MOST_COMMANDS:
        raise ValueError(f"between 1 and {MOST_COMMANDS} commands")
    out = []
    for command in commands:
        before = inputs()
        try:
            done = subprocess.run(command, cwd=root, capture_output=True, timeout=seconds, stdin=subprocess.DEVNULL, check=False)
            status, code, text = ("passed" if done.returncode == 0 else "failed"), done.returncode, done.stdout + done.stderr
        except subprocess.TimeoutExpired as e:
            status, code, text = "timeout", None, (e.stdout or b"") + (e.stderr or b"")
        except FileNotFoundError:
            status, code, text = "missing", None, b""
        out.append({"command": command, "status": status, "code": code, "output": text[-most_bytes:].decode("utf-8", "replace"), "cut": len(text) > most_bytes, "stale": inputs() != before})
    return out


def tree_mark(root: str) -> str:
    """A mark of a small tree's files for validate(): paths and contents."""
    digest = hashlib.sha256()
    for p in sorted(Path(root).rglob("*")):
        if p.is_file() and not any(part.startswith(".") for part in p.relative_to(root).parts):
            digest.update(str(p.relative_to(root)).encode() + b"\0" + hashlib.sha256(p.read_bytes()).digest())
    return digest.hexdigest()
