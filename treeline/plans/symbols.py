"""Moving one declaration to another module: what travels, why it may not, and the edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators.graph import ADDRESSABLE
from treeline.plans.edits import ungrouped


def companions(symbols: DataFrame) -> DataFrame:
    """`impl` blocks of a type: path, name, ext_start, ext_end, standing (same-scope, ambiguous)."""
    types = symbols.filter(F.col("kind").isin("struct", "enum", "type-alias") & (F.col("depth") == 0))
    count = types.groupBy("path", "name").agg(F.count("*").alias("owners"))
    blocks = symbols.filter("kind = 'impl' and depth = 0").select("path", "name", "ext_start", "ext_end")
    return blocks.join(count, ["path", "name"]).withColumn("standing", F.when(F.col("owners") == 1, "same-scope").otherwise("ambiguous"))


def candidates(symbols: DataFrame, path: str, name: str) -> DataFrame:
    """Declarations of the name in a file with the first reason, if any, that forbids a move."""
    here = symbols.filter((F.col("path") == path) & (F.col("name") == name) & (F.col("kind") != "impl"))
    peers = here.filter("depth = 0").groupBy("path").agg(F.count("*").alias("peers"))
    pieces = companions(symbols).filter((F.col("path") == path) & (F.col("name") == name)).groupBy("path").agg(F.count("*").alias("pieces"), F.bool_or(F.col("standing") != "same-scope").alias("unclear"))
    refusal = (
        F.when(~F.col("kind").isin(*ADDRESSABLE) | F.col("container").isNotNull(), "not movable")
        .when(F.col("depth") > 0, "nested")
        .when(F.col("kind") == "module", "module")
        .when(F.col("peers") > 1, "competing declaration")
        .when(F.col("unclear"), "ambiguous companion")
    )
    return here.join(peers, "path", "left").join(pieces, "path", "left").select("path", "kind", "name", "name_start", "ext_start", "ext_end", F.coalesce("pieces", F.lit(0)).alias("pieces"), refusal.alias("refusal")).orderBy("name_start")


def cuts(symbols: DataFrame, files: DataFrame, path: str, name: str) -> DataFrame:
    """Byte ranges that leave with a declaration: its extent and its companions', each with the line end after it."""
    own = symbols.filter((F.col("path") == path) & (F.col("name") == name) & (F.col("depth") == 0) & (F.col("kind") != "impl")).select("path", F.col("ext_start").alias("start"), F.col("ext_end").alias("end"))
    more = companions(symbols).filter((F.col("path") == path) & (F.col("name") == name)).select("path", F.col("ext_start").alias("start"), F.col("ext_end").alias("end"))
    at = own.unionByName(more).join(files.select("path", "text"), "path")
    rest = F.decode(F.substring(F.encode("text", "UTF-8"), F.col("end") + 1, F.lit(2)), "UTF-8")
    return at.select("path", "start", (F.col("end") + F.when(rest.startswith("\n"), 1).otherwise(0)).alias("end")).orderBy("start")


def move_symbol(ws, name: str, source: str, target: str, widen: bool = False) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001 - a Workspace
    """(edits, notices) for moving a top-level declaration of a Rust file to another module of its package.

    In this order: imports that the moved text needs are added at the target; every import of the
    old address is respelled, an entry of a group is taken out of it and stands as a statement of its own after it; the old file
    imports the new address if it still uses the name; the pieces are cut and pasted at the target's end. With `widen`, what was private
    and is used from another module afterwards is widened as far as it must be, to the parent or to the package: the declaration, and those of the old file that it needs.
    """
    symbols = ws.family("symbols")
    found = candidates(symbols, source, name).collect()
    if not found:
        raise LookupError(f"{source} does not declare {name}")
    if found[0]["refusal"]:
        raise ValueError(f"{name} cannot be moved: {found[0]['refusal']}")
    if source == target:
        raise ValueError("source and target are one file")
    if ws.declared.filter((F.col("path") == target) & (F.col("name") == name)).count():
        raise ValueError(f"{target} declares {name} already")
    modules = {r["path"]: r for r in ws.modules.filter(F.col("path").isin(source, target)).collect()}
    if len(modules) < 2 or modules[source]["package"] != modules[target]["package"]:
        raise ValueError("both files must be modules of one package")
    package, new = modules[source]["package"], "::".join(["crate", *modules[target]["mpath"], name])
    texts = {r["path"]: r["text"] for r in ws.files.filter(F.col("path").isin(source, target)).select("path", "text").collect()}
    pieces = [(r["start"], r["end"]) for r in cuts(symbols, ws.files, source, name).collect()]
    inside = lambda column: F.greatest(*[F.when((F.col(column) >= a) & (F.col(column) < b), 1).otherwise(0) for a, b in pieces], F.lit(0)) == 1

    spark, raw = ws.files.sparkSession, texts[source].encode()
    moved = "".join(raw[a:b].decode() for a, b in pieces)
    tokens = ws.family("tokens").filter(F.col("path") == source)
    within = {r[0] for r in tokens.filter(inside("start")).select("name").distinct().collect()}
    outside = tokens.filter(~inside("start")).filter(F.col("name") == name).count()
    imports = ws.edges.filter((F.col("path") == source) & F.col("declares") & F.col("binding").isNotNull() & F.col("addr").isNotNull()).select("binding", "package", "apath", "alias").collect()
    spelled = lambda p, a: "::".join(["crate" if p == package else p, *a])
    lines = [f"use {spelled(r['package'], r['apath'])}{' as ' + r['alias'] if r['alias'] else ''};\n" for r in imports if r["binding"] in within and r["binding"] != name]
    siblings = ws.declared.filter((F.col("path") == source) & F.col("name").isin(*within) & (F.col("name") != name)).select("name", "apath", "modifier", "start").collect()
    below = list(modules[target]["mpath"])[: len(modules[source]["mpath"])] == list(modules[source]["mpath"])  # private names are seen there
    lines += [f"use {spelled(package, r['apath'])};\n" for r in siblings]
    known = {r[0] for r in ws.edges.filter((F.col("path") == target) & F.col("declares") & F.col("binding").isNotNull()).select("binding").collect()}
    lines = sorted(set(x for x in lines if x.rstrip(";\n").rpartition("::")[2] not in known))

    old = f"{modules[source]['addr']}::{name}"
    users = ws.edges.filter("declares or head <> 'named' or size(segments) > 1").filter((F.col("addr") == old) | F.col("addr").startswith(old + "::"))
    other = F.col("package") != F.element_at(F.split("from_addr", "::"), 1)
    tail = F.expr(f"substring(addr, {len(old) + 1})")
    respelled = users.filter(~((F.col("path") == source) & inside("start"))).withColumn("replacement", F.concat(F.when(other, F.lit(package + new.removeprefix("crate"))).otherwise(F.lit(new)), tail))
    respelled = respelled.filter(F.element_at("segments", 1) != name)  # paths that begin with the name follow its import
    edits = respelled.filter("not grouped").select("path", "start", "end", "replacement", F.col("ord").alias("seq"))
    entries = respelled.filter("grouped").select("path", "ord", "start", "end", "glob", "alias", F.col("replacement").alias("now"))
    edits = edits.unionByName(ungrouped(entries, ws.edges, ws.files.select("path", "text")))
    notices = respelled.filter("grouped and addr is null").select("path", "start", F.lit("unrewritable import").alias("kind"), "raw")
    extra = [(source, a, b, "", 100 + k) for k, (a, b) in enumerate(pieces)]
    homes = {p: list(m["mpath"]) for p, m in modules.items()}
    seen_from = lambda home, user: "pub(super) " if user[: len(home) - 1] == home[:-1] else "pub(crate) "
    if widen and not below:
        extra += [(source, r["start"], r["start"], seen_from(homes[source], homes[target]), 50) for r in siblings if r["modifier"] is None]
    own = symbols.filter((F.col("path") == source) & (F.col("name") == name) & (F.col("depth") == 0) & (F.col("kind") != "impl")).select("start", "ext_start", "modifier").first()
    up = homes[source][: len(homes[target])] == homes[target]
    if widen and own["modifier"] is None and outside and not up:
        at = sum(b - a for a, b in pieces if a < own["ext_start"]) + own["start"] - own["ext_start"]
        told = moved.encode()
        moved = (told[:at] + seen_from(homes[target], homes[source]).encode() + told[at:]).decode()
    end = len(texts[target].encode())
    after_imports = max([r["stmt_end"] for r in ws.edges.filter((F.col("path") == target) & F.col("top_level")).select("stmt_end").collect()], default=0)
    after_imports += bool(after_imports) and texts[target].encode()[after_imports : after_imports + 1] == b"\n"
    if lines:
        extra.append((target, after_imports, after_imports, "".join(lines), 200))
    extra.append((target, end, end, ("" if texts[target].endswith("\n") else "\n") + "\n" + moved, 300))
    if outside:
        extra.append((source, 0, 0, f"use {new};\n", 0))
    return edits.unionByName(spark.createDataFrame(extra, "path string, start int, end int, replacement string, seq int")), notices
