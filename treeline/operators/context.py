"""Context of a declaration within budgets: its text, what holds it, what it names, who names it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions import text as T
from treeline.operators.search import once


def excerpt(text, start, end, most: int):  # noqa: ANN001, ANN201 - columns
    """Text of a byte range of at most `most` bytes, cut back to the end of a character."""
    raw = F.substring(F.encode(text, "UTF-8"), start + 1, F.least(end - start, F.lit(most)))
    tail = lambda k: F.conv(F.hex(F.substring(raw, F.length(raw) - k, F.lit(1))), 16, 10).cast("int")
    follows = lambda k: (tail(k) >= 128) & (tail(k) < 192)
    whole = end - start <= most
    # Bytes of a character that was cut: its leading byte is among the last three.
    cut = F.when(whole, 0).when(tail(0) >= 192, 1).when(follows(0) & (tail(1) >= 224), 2).when(follows(0) & follows(1) & (tail(2) >= 240), 3).otherwise(0)
    return F.decode(F.substring(raw, 1, F.length(raw) - cut), "UTF-8")


def is_test_path(path):  # noqa: ANN001, ANN201 - columns
    """Whether a folder of the path, or the file, is named as one of tests."""
    return F.arrays_overlap(F.split(path, "/"), F.array(F.lit("test"), F.lit("tests")))


def assemble(ws, name: str, declared_in: str | None = None, max_items: int = 12, max_bytes: int = 16384) -> DataFrame:  # noqa: ANN001 - a Workspace
    """rank, relation, path, name, text: definition, enclosing declaration, definitions it names, places that name it.

    A target comes once, under its first relation; an excerpt takes half of the bytes at most, and
    the last rows go until the rest fits. References under test folders are marked.
    """
    at = ws.target(name, declared_in)
    symbols = ws.family("symbols")
    decls = ws.declared.select("path", "name", "ext_start", "ext_end", "addr")
    one = decls.filter(F.col("addr") == at)
    home = one.first()
    rows = one.select(F.lit(0).alias("order"), F.lit("definition").alias("relation"), "path", "name", "ext_start", "ext_end")
    around = symbols.filter((F.col("path") == home["path"]) & (F.col("ext_start") <= home["ext_start"]) & (F.col("ext_end") >= home["ext_end"]) & ~((F.col("ext_start") == home["ext_start"]) & (F.col("ext_end") == home["ext_end"])))
    rows = rows.unionByName(around.select(F.lit(1).alias("order"), F.lit("enclosing").alias("relation"), "path", "name", "ext_start", "ext_end"))
    sure = ws.scoped[1]
    named = sure.filter((F.col("path") == home["path"]) & (F.col("start") >= home["ext_start"]) & (F.col("end") <= home["ext_end"]) & (F.col("target") != at)).select(F.col("target").alias("addr")).distinct()
    rows = rows.unionByName(decls.join(named, "addr").select(F.lit(2).alias("order"), F.lit("outgoing").alias("relation"), "path", "name", "ext_start", "ext_end"))
    tests = is_test_path(F.col("path"))
    users = sure.filter((F.col("target") == at) & ~((F.col("path") == home["path"]) & (F.col("start") >= home["ext_start"]) & (F.col("end") <= home["ext_end"])))
    held = users.select("path", "start").join(symbols.filter("depth = 0").select("path", "name", "ext_start", "ext_end"), "path").filter("ext_start <= start and start < ext_end").drop("start").distinct()
    rows = rows.unionByName(held.select(F.when(tests, 4).otherwise(3).alias("order"), F.when(tests, "reference-in-test").otherwise("incoming").alias("relation"), "path", "name", "ext_start", "ext_end"))
    first = once(rows, ["path", "name", "ext_start", "ext_end"], ["order"]).orderBy("order", "path", "ext_start").limit(max_items)  # the budget of items bounds what follows
    w = Window.orderBy("order", "path", "ext_start")
    with_text = first.join(ws.files.select("path", F.col("text").alias("full")), "path").withColumn("text", excerpt(F.col("full"), F.col("ext_start"), F.col("ext_end"), max_bytes // 2)).drop("full")
    size = F.octet_length(F.to_json(F.struct("relation", "path", "name", "text")))
    out = with_text.withColumns({"rank": F.row_number().over(w), "bytes": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return out.filter((F.col("bytes") <= max_bytes) | (F.col("rank") == 1)).select("rank", "relation", "path", "name", "text", T.content_id(F.col("text")).alias("content_id")).orderBy("rank")


def named_bindings(named: DataFrame, edge: DataFrame, decls: DataFrame) -> DataFrame:
    """Script names taken from modules, with the declaration they mean: path, local, imported, target. `*` means the module."""
    at = edge.filter("language <> 'rust' and addr is not null").select("path", F.col("raw").alias("module"), F.col("addr").alias("file")).distinct()
    default = decls.filter("modifier = 'export default'").select(F.col("path").alias("file"), F.lit("default").alias("imported"), F.col("addr").alias("target"))
    plain = decls.filter("modifier is not null").select(F.col("path").alias("file"), F.col("name").alias("imported"), F.col("addr").alias("target"))
    found = named.join(at, ["path", "module"], "left").join(plain.unionByName(default), ["file", "imported"], "left")
    return found.select("path", "local", "imported", F.when(F.col("imported") == "*", F.col("file")).otherwise(F.col("target")).alias("target"), "type_only")


def definition_at(occurrences: DataFrame, path: str, offset: int) -> DataFrame:
    """The outcome for the token at an offset: resolved if exactly one declaration claims it."""
    token = occurrences.filter((F.col("path") == path) & (F.col("start") <= offset) & (F.col("end") > offset))
    claimed = token.filter("confidence = 'resolved'").agg(F.sort_array(F.collect_set("target")).alias("targets"))
    return claimed.select("targets", F.when(F.size("targets") == 1, "resolved").when(F.size("targets") > 1, "ambiguous").otherwise("unavailable").alias("outcome"))
