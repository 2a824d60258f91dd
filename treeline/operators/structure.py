"""Structural search: files as tables of tree nodes, patterns as joins over them.

A pattern is a construct of its own, read into a tree by the rules of its language. `$X` stands for one node, `$$$X` for
any run of neighbours, `$_` and `$$$` for the same without a capture. Inner nodes of the pattern are matched from the
leaves up: a node matches if its kind does, it has as many children as needed, and its fixed children stand where they
must. Between runs the leftmost place counts, found by a minimum, so no way is tried twice and the work is a join for
each node of the pattern, however many runs it has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions import text as T
from treeline.lang import tree
from treeline.session import settle

NODE = "pre int, post int, parent int, ord int, rord int, n int, kind string, text string, start int, end int, above string"
#: Characters of text whose nodes make one batch of rows.
NODES_OF = 1 << 16
_HOLE = re.compile(r"\$\$\$(\w*)|\$(\w+)")
_ONE, _RUN = re.compile(r"__one_(\w+)"), re.compile(r"__run_(\w+)")
_KEY = ["path", "pre"]


def tree_nodes(files: DataFrame) -> DataFrame:
    """path, language and the nodes of every file, one task a file; pre and post number a node before and after what it holds, above is the kind of its parent."""
    fields = [("path", pa.string()), ("language", pa.string()), *((c.split()[0], pa.int32() if c.split()[1] == "int" else pa.string()) for c in NODE.split(", "))]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str, list[dict]]] = []
        size = 0

        def out() -> pa.RecordBatch:
            spread = pa.array(np.repeat(np.arange(len(held)), [len(rows) for _, _, rows in held]))
            columns = [pa.array([x[k] for x in held], pa.string()).take(spread) for k in (0, 1)]
            columns += [pa.array([r[f.name] for _, _, rows in held for r in rows], f.type) for f in list(schema)[2:]]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for path, language, text in zip(*(batch.column(c) for c in ("path", "language", "text")), strict=True):
                source = text.as_py() or ""
                held.append((path.as_py(), language.as_py(), tree.nodes(source, language.as_py())))
                size += len(source)
                if size >= NODES_OF:
                    yield out()
                    size = 0
        if held:
            yield out()

    return files.filter("language in ('rust', 'typescript', 'tsx')").select(F.col("path").cast("string").alias("path"), "language", "text").mapInArrow(run, f"path string, language string, {NODE}")


def inside(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """nodes below a node of outer(path, pre, post), which `within` names: an interval that holds an interval."""
    around = outer.select("path", F.col("pre").alias("within"), F.col("post").alias("within_post"))
    return nodes.join(around, "path").filter("within < pre and post < within_post").drop("within_post")


def parse_pattern(pattern: str, language: str) -> dict:
    """The pattern's tree: kind, text of leaves, children; holes are {"one": name} and {"run": name}."""
    runs = iter(range(len(pattern)))
    plain = _HOLE.sub(lambda m: f" __one_{m[2]} " if m[2] else f" __run_{m[1] or next(runs)} ", pattern)
    rows = tree.nodes(plain.strip(), language)
    children: dict[int, list[dict]] = {}
    made = {}
    for r in reversed(rows):
        kids = children.get(r["pre"], [])[::-1]
        one, run = (_ONE.fullmatch(r["text"]), _RUN.fullmatch(r["text"])) if r["text"] else (None, None)
        made[r["pre"]] = {"one": one[1]} if one else {"run": run[1]} if run else {"kind": r["kind"], "text": r["text"], "children": kids}
        children.setdefault(r["parent"], []).append(made[r["pre"]])
    top = made[0]["children"]
    while len(top) == 1 and top[0].get("kind") == "expression_statement" and not pattern.rstrip().endswith(";"):
        top = top[0]["children"]
    if len(top) != 1 or "kind" not in top[0]:
        raise ValueError("a pattern is one whole construct")
    return top[0]


def _at(nodes: DataFrame, place: str, *columns: str) -> DataFrame:
    """Children by parent and place, with their columns prefixed."""
    return nodes.select("path", F.col("parent").alias("pre"), F.col("ord").alias(place), *[F.col(c).alias(f"{place}_{c}") for c in columns])


def _matched(nodes: DataFrame, node: dict) -> DataFrame:
    """path, pre, parent, ord, rord of nodes that match, and start and end of every capture."""
    base = nodes.select(*_KEY, "parent", "ord", "rord", "kind", "text", "n")
    if node["text"] is not None:
        return base.filter((F.col("text") == node["text"]) & F.col("text").isNotNull()).drop("kind", "text", "n")
    parts: list[list[dict]] = [[]]
    runs: list[str] = []
    for c in node["children"]:
        if "run" in c:
            runs.append(c["run"])
            parts.append([])
        else:
            parts[-1].append(c)
    fixed = sum(map(len, parts))
    found = base.filter((F.col("kind") == node["kind"]) & ((F.col("n") >= fixed) if runs else (F.col("n") == fixed))).drop("kind", "text")
    # Leaves at fixed places, before the first run and after the last, are told in one pass.
    ends = [(c, "ord", i) for i, c in enumerate(parts[0])] + ([(c, "rord", i) for i, c in enumerate(reversed(parts[-1]))] if runs else [])
    leaves = [(c, side, i) for c, side, i in ends if c.get("text") is not None]
    if leaves:
        told = F.lit(False)
        for c, side, i in leaves:
            told = told | ((F.col(side) == i) & (F.col("text") == c["text"]))
        counted = nodes.filter(told).groupBy("path", F.col("parent").alias("pre")).agg(F.count("*").alias("leaves"))
        found = found.join(counted.filter(F.col("leaves") == len(leaves)).drop("leaves"), _KEY, "left_semi")
    for c, side, i in ends:
        if c.get("text") is not None:
            continue
        if "one" in c:
            if c["one"] != "_":
                place = F.lit(i) if side == "ord" else F.col("n") - 1 - i
                found = _captured_one(found.withColumn("__at", place.cast("int")), nodes, c["one"])
            continue
        inner = _matched(nodes, c).filter(F.col(side) == i).drop("pre", "ord", "rord").withColumnRenamed("parent", "pre")
        found = found.join(inner, _KEY)
    if not runs:
        return found.drop("n")
    low: Column = F.lit(len(parts[0]))
    high = F.col("n") - len(parts[-1])
    for name, part in zip(runs, parts[1:], strict=True):
        last = part is parts[-1]
        found = found.withColumn("__low", low.cast("int"))
        if last:
            found = found.withColumn("__from", high.cast("int"))
        else:
            found = _leftmost(found, nodes, part, high)
        if not name.isdigit():
            found = _captured_run(found, nodes, name)
        found = found.drop("__low")
        low = F.col("__next")
        if not last:
            found = found.withColumn("__next", F.col("__from") + len(part))
        found = found.drop("__from")
    return found.drop("n", "__next")


def _leftmost(found: DataFrame, nodes: DataFrame, part: list[dict], high: Column) -> DataFrame:
    """Adds __from, the first place from __low on where the children of part stand one after another before `high`, and their captures."""
    rows = None
    for k, c in enumerate(part):
        if "one" in c:
            here = nodes.select("path", F.col("parent").alias("pre"), (F.col("ord") - k).alias("__from"), *([F.col(x).alias(f"{c['one']}_{x}") for x in ("start", "end")] if c["one"] != "_" else []))
        else:
            here = _matched(nodes, c).drop("pre", "rord").withColumnRenamed("parent", "pre").withColumn("__from", F.col("ord") - k).drop("ord")
        rows = here if rows is None else rows.join(here, [*_KEY, "__from"])
    held = [x for x in rows.columns if x not in (*_KEY, "__from")]
    fits = found.select(*_KEY, "__low", high.alias("__high")).join(rows, _KEY).filter((F.col("__from") >= F.col("__low")) & (F.col("__from") + len(part) <= F.col("__high")))
    first = fits.groupBy(*_KEY, "__low").agg(F.min(F.struct("__from", *held)).alias("s")).select(*_KEY, "__low", "s.*")
    return found.join(first, [*_KEY, "__low"])


def _captured_one(found: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    at = _at(nodes, "__at", "start", "end")
    out = found.join(at, [*_KEY, "__at"])
    return _kept(out, name, F.col("__at_start"), F.col("__at_end")).drop("__at", "__at_start", "__at_end")


def _captured_run(found: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """The bytes from the child at __low to the one before __from; an empty run is an empty span before the child at __from."""
    first, last = _at(nodes, "__low", "start"), _at(nodes, "__last", "end")
    out = found.withColumn("__last", F.col("__from") - 1).join(first, [*_KEY, "__low"], "left").join(last, [*_KEY, "__last"], "left")
    some = F.col("__from") > F.col("__low")
    start = F.coalesce(F.col("__low_start"), F.lit(0))
    return _kept(out, name, start, F.when(some, F.col("__last_end")).otherwise(start)).drop("__last", "__low_start", "__last_end")


def _kept(found: DataFrame, name: str, start: Column, end: Column) -> DataFrame:
    return found.withColumn(f"{name}_start", start).withColumn(f"{name}_end", end)


def structural(files: DataFrame, nodes: DataFrame, pattern: str, language: str = "rust", kind: str | None = None) -> DataFrame:
    """path, start, end, kind, captures (by name, as text) of all nodes that match, nested ones too; of one kind if one is given.

    A name that stands twice in a pattern matches the same text twice. Files without the pattern's words are left out before any join.
    """
    asked = parse_pattern(pattern, language)
    asked, places = _numbered(asked)
    near = files.filter((F.col("language") == language) if language == "rust" else F.col("language").isin("typescript", "tsx"))
    for w in T.pattern_words(pattern):
        near = near.filter(T.whole_word(F.col("text"), w))
    near = near.select("path", "text")
    some = settle(nodes.join(near.select("path"), "path", "left_semi"))  # every node of the pattern reads it
    hits = _matched(some, asked).drop("parent", "ord", "rord").join(some.select(*_KEY, "start", "end", "kind"), _KEY)
    hits = hits.filter(F.col("kind") == kind) if kind else hits
    hits = hits.join(near, "path")
    cut = lambda n: T.byte_slice(F.col("text"), F.col(f"{n}_start"), F.col(f"{n}_end") - F.col(f"{n}_start"))
    for same in places.values():
        for other in same[1:]:
            hits = hits.filter(cut(same[0]) == cut(other))
    pairs = [x for n, same in places.items() for x in (F.lit(n), cut(same[0]))]
    return hits.select("path", "start", "end", "kind", (F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")).alias("captures"))


def _numbered(node: dict) -> tuple[dict, dict[str, list[str]]]:
    """The pattern with a name for each place of a capture, and the places of each name."""
    places: dict[str, list[str]] = {}

    def walk(x: dict) -> dict:
        for hole in ("one", "run"):
            if hole in x and x[hole] != "_" and not (hole == "run" and x[hole].isdigit()):
                at = places.setdefault(x[hole], [])
                at.append(f"{x[hole]}__{len(at)}")
                return {hole: at[-1]}
        return x if "children" not in x else x | {"children": [walk(c) for c in x["children"]]}

    return walk(node), places
