"""Members of script namespaces: what `ns.member` means, through the export tables of modules.

An export table says which declaration, or which whole module, a module offers under a name: its own exports, names it
takes from other modules, and all of what it opens, to the fixed point. A member is looked up in the table of the
module that its object stands for; a member that is a module itself leads on, so chains resolve link by link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators.search import except_known
from treeline.session import settle

# Kinds that live among types alone, and among both types and values.
TYPES, BOTH = ("interface", "type-alias"), ("class", "enum")


def _sources(named: DataFrame, edge: DataFrame) -> DataFrame:
    """Names that a file takes from modules, with the module's file: null if it is none of the workspace."""
    at = edge.filter("language <> 'rust'").select("path", F.col("raw").alias("module"), F.col("addr").alias("file")).distinct()
    return named.join(at, ["path", "module"], "left").select("path", "local", "imported", "file", "reexport")


def exports(decls: DataFrame, named: DataFrame, edge: DataFrame) -> DataFrame:
    """(file, name, target, space) of all that script modules offer. The target is a declaration, or a module's file where a name stands for a whole module.

    A module's own exports hide those it opens; `default` is never opened. Two opened modules that offer a name unlike leave both.
    """
    space = F.when(F.col("kind").isin(*TYPES), "type").when(F.col("kind").isin(*BOTH), "both").otherwise("value")
    own = decls.filter("language <> 'rust' and modifier like 'export%'")
    name = F.when(F.col("modifier") == "export default", "default").otherwise(F.col("name"))
    taken = _sources(named.filter("reexport"), edge).filter("file is not null")
    whole = taken.filter("imported = '*'").select(F.col("path").alias("file"), F.col("local").alias("name"), F.col("file").alias("target"), F.lit("both").alias("space"))
    seen = settle(own.select(F.col("path").alias("file"), name.alias("name"), F.col("addr").alias("target"), space.alias("space")).unionByName(whole).distinct())
    renames = taken.filter("imported <> '*'").select("file", F.col("imported").alias("name"), "path", "local")
    opens = edge.filter("language <> 'rust' and reexport and glob and addr is not null").select(F.col("addr").alias("file"), "path").distinct()
    # Names that a module exports itself, which nothing opened replaces.
    fixed = settle(seen.select("file", "name").unionByName(taken.select(F.col("path").alias("file"), F.col("local").alias("name"))).distinct())
    front = seen
    while True:
        by_name = front.join(renames, ["file", "name"]).select(F.col("path").alias("file"), F.col("local").alias("name"), "target", "space")
        opened = except_known(front.filter("name <> 'default'").join(opens, "file").select(F.col("path").alias("file"), "name", "target", "space"), fixed, ["file", "name"])
        front = settle(except_known(by_name.unionByName(opened).distinct(), seen, ["file", "name", "target"]))
        if front.isEmpty():
            return seen
        seen = settle(seen.unionByName(front))


def member_targets(members: DataFrame, named: DataFrame, edge: DataFrame, table: DataFrame, claimed: DataFrame) -> DataFrame:
    """path, start, end, name, outcome, targets, why of members whose object is a module: resolved, ambiguous, or unavailable and why.

    claimed(path, start): objects that a local binding holds; they are no modules.
    """
    taken = _sources(named.filter("not reexport"), edge)
    spaces = taken.filter("imported = '*'").select("path", F.col("local").alias("object"), "file")
    lent = taken.filter("imported <> '*'").join(table.select("file", F.col("name").alias("imported"), "target"), ["file", "imported"]).select("path", F.col("local").alias("object"), F.col("target").alias("file"))
    modules = edge.filter("language <> 'rust'").select(F.col("addr").alias("file")).filter("file is not null").distinct()
    local = spaces.unionByName(lent.join(modules, "file", "left_semi"))
    free = except_known(members.filter("not nested"), claimed.withColumnRenamed("start", "object_start"), ["path", "object_start"])
    front = settle(free.join(local, ["path", "object"]).select("path", "start", "end", "name", "file"))
    deeper = members.filter("nested").select("path", "object_start", F.col("start").alias("next"), F.col("end").alias("next_end"), F.col("name").alias("next_name"))
    done = None
    while True:
        met = settle(front.join(table, ["file", "name"], "left").select("path", "start", "end", "name", "target", (F.col("file").isNull()).alias("external")))
        done = met if done is None else settle(done.unionByName(met))
        found = met.join(modules.withColumnRenamed("file", "target"), "target").select("path", F.col("start").alias("object_start"), F.col("target").alias("file"))
        front = settle(found.join(deeper, ["path", "object_start"]).select("path", F.col("next").alias("start"), F.col("next_end").alias("end"), F.col("next_name").alias("name"), "file"))
        if front.isEmpty():
            break
    out = done.groupBy("path", "start", "end", "name").agg(F.sort_array(F.collect_set("target")).alias("targets"), F.bool_or("external").alias("external"))
    n = F.size("targets")
    why = F.when(n == 0, F.when(F.col("external"), "external").otherwise("unknown-name"))
    return out.select("path", "start", "end", "name", F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unavailable").alias("outcome"), F.when(n > 0, F.col("targets")).alias("targets"), why.alias("why"))
