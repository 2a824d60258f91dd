"""What the names of a pattern mean: bindings, constants or constructors, decided together for the whole pattern.

A bare name binds unless a constant or a constructor of that name is in sight: an item of an enclosing block,
of the module, imported by name, or opened by a glob. A path leads where its import edge leads. Constants do not
take arguments, a constructor is named with the shape it was declared with; anything else that is found makes
the name unavailable, never a silent binding. Alternatives must bind the same names in the same way.

All references of all files are decided in one set of joins by module and name; no pattern meets another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.operators.graph import addr, admits, reach

# Kinds that a pattern can name, and those that it can name only in the right shape.
NAMED_KINDS, SHAPED_KINDS = ("const", "static", "struct", "variant", "type-alias"), ("static", "struct", "variant", "type-alias")
UNSUPPORTED = "unsupported-context"


def pattern_targets(symbols: DataFrame, constructors: DataFrame, mods: DataFrame) -> DataFrame:
    """addr, module_addr, kind, shape, reach of the constants, statics, structs, aliases and variants that an address names."""
    at = mods.select("path", "package", "mpath", F.col("addr").alias("module_addr"))
    top = symbols.filter("language = 'rust' and depth = 0 and container is null")
    own = top.filter(F.col("kind").isin(*NAMED_KINDS)).select("path", "language", "kind", "name", "name_start", "modifier", F.array("name").alias("tail"))
    enums = top.filter("kind = 'enum'").select("path", F.col("name").alias("container"), "modifier")
    variants = symbols.filter("kind = 'variant' and depth = 1").select("path", "language", "kind", "name", "name_start", "container").join(enums, ["path", "container"])
    both = own.unionByName(variants.select("path", "language", "kind", "name", "name_start", "modifier", F.array("container", "name").alias("tail")))
    shaped = both.join(constructors.select("path", "name_start", "shape"), ["path", "name_start"], "left").join(at, "path")
    place = addr(F.col("package"), F.concat("mpath", "tail"))
    return shaped.select(place.alias("addr"), "module_addr", "kind", "shape", reach(F.col("modifier"), F.col("package"), F.col("mpath"), F.col("language")).alias("reach")).distinct()


def fits(kind: Column, shape: Column, role: Column, asked: Column) -> Column:
    """Whether a reference of a role, with the shape it was written in, may name a declaration."""
    constructor = F.when(role == "identifier", F.coalesce(shape == "unit", F.lit(False))).when(role == "constant", F.lit(False)).otherwise(F.coalesce(shape == asked, F.lit(False)))
    return F.when(kind == "const", role != "constructor").when(kind.isin("struct", "variant"), constructor).otherwise(F.lit(False))


def _addresses(refs: DataFrame, edge: DataFrame, mods: DataFrame) -> DataFrame:
    """path, start, rank, addr (null: an import outside the workspace or of unknown target), external: where each reference may lead, the nearest rank first."""
    at = mods.select("path", F.col("addr").alias("m"))
    bare = refs.filter("bare and not explicit").select("path", "start", "name")
    own = bare.join(at, "path").select("path", "start", F.lit(0).alias("rank"), F.concat_ws("::", "m", "name").alias("addr"), F.lit(False).alias("external"))
    known = F.when(F.col("addr").isNotNull() & ~F.coalesce(F.col("external"), F.lit(False)), F.col("addr"))
    opened = edge.filter("declares and language = 'rust' and not is_prefix")
    by_name = bare.join(opened.filter("binding is not null").select("path", F.col("binding").alias("name"), known.alias("to"), "external"), ["path", "name"])
    globs = bare.join(opened.filter("glob").select("path", known.alias("to"), "external").distinct(), "path")
    spelled = edge.filter("not declares and language = 'rust'").select("path", "start", "end", known.alias("to"), "external")
    paths = refs.filter("not bare").select("path", "start", "end").join(spelled, ["path", "start", "end"])
    return (
        own.unionByName(by_name.select("path", "start", F.lit(0).alias("rank"), F.col("to").alias("addr"), "external"))
        .unionByName(globs.select("path", "start", F.lit(1).alias("rank"), F.when(F.col("to").isNotNull(), F.concat_ws("::", "to", "name")).alias("addr"), "external"))
        .unionByName(paths.select("path", "start", F.lit(0).alias("rank"), F.col("to").alias("addr"), "external"))
    )


def _found(places: DataFrame, aliases: DataFrame, targets: DataFrame, mods: DataFrame) -> DataFrame:
    """path, start, rank, target, kind, shape: the declarations behind the addresses, through re-exports of them or of what holds them, in reach of the file."""
    offered = aliases.select(F.col("alias").alias("addr"), F.col("target").alias("behind")).distinct()
    last = F.element_at(F.split("addr", "::"), -1)
    whole = places.join(offered, "addr").select("path", "start", "rank", F.col("behind").alias("addr"))
    held = places.withColumn("last", last).withColumn("addr", F.expr("substring(addr, 1, length(addr) - length(last) - 2)"))
    inside = held.join(offered, "addr").select("path", "start", "rank", F.concat_ws("::", "behind", "last").alias("addr"))
    both = whole.unionByName(inside).distinct().join(targets, "addr")
    seen = both.join(mods.select("path", F.col("package").alias("from_package"), F.col("mpath").alias("from_path")), "path").filter(admits(F.col("reach"), F.col("from_package"), F.col("from_path")))
    return seen.select("path", "start", "rank", F.col("addr").alias("target"), "kind", "shape")


def outcomes(patterns: DataFrame, lexical: DataFrame, constructors: DataFrame, edge: DataFrame, aliases: DataFrame, targets: DataFrame, mods: DataFrame) -> DataFrame:
    """path, start, end, name, pattern, outcome, targets, why of every reference: binding, resolved, ambiguous, or unavailable and why."""
    refs = patterns.filter("language = 'rust'").drop("language")
    key = ["path", "start"]
    # Items of enclosing blocks come before the module's; the innermost block decides.
    items = lexical.filter("kind in ('const', 'static', 'struct') and namespace = 'value'").select("path", "name", "name_start", "kind", "scope_start", "scope_end").join(constructors.select("path", "name_start", "shape"), ["path", "name_start"], "left")
    near = refs.filter("bare and not explicit").select("path", "start", "name").join(items, ["path", "name"]).filter("scope_start <= start and start < scope_end")
    inner = F.rank().over(Window.partitionBy(*key).orderBy(F.col("scope_end") - F.col("scope_start")))
    local = near.withColumn("r", inner).filter("r = 1").select(*key, F.lit(-1).alias("rank"), F.concat_ws("@", "path", F.col("name_start").cast("string")).alias("target"), "kind", "shape")
    places = _addresses(refs, edge, mods)
    found = local.unionByName(_found(places.filter("addr is not null"), aliases, targets, mods))
    first = F.min("rank").over(Window.partitionBy(*key))
    found = found.withColumn("first", first).filter("rank = first").drop("first").join(refs.select(*key, "role", F.col("shape").alias("asked")), key)
    ok = fits(F.col("kind"), F.col("shape"), F.col("role"), F.col("asked"))
    judged = found.groupBy(*key).agg(F.sort_array(F.collect_set(F.when(ok, F.col("target")))).alias("targets"), F.bool_or(~ok & F.col("kind").isin(*SHAPED_KINDS)).alias("wrong"))
    outside = places.filter("addr is null").groupBy(*key).agg(F.bool_or(F.coalesce("external", F.lit(False))).alias("far")).withColumn("outside", F.lit(True))
    out = refs.join(judged, key, "left").join(outside, key, "left")
    n, wrong, site = F.coalesce(F.size("targets"), F.lit(0)), F.coalesce("wrong", F.lit(False)), F.col("bare") & (F.col("role") == "identifier")
    outcome = (
        F.when(F.col("explicit"), "binding").when(wrong, "unavailable").when(n == 1, "resolved").when(n > 1, "ambiguous")
        .when(~site | F.col("outside"), "unavailable").otherwise("binding")
    )
    why = F.when(wrong | site, UNSUPPORTED).when(F.col("far"), "external").otherwise("unresolved")
    out = out.withColumn("outcome", outcome).withColumn("why", F.when(F.col("outcome") == "unavailable", why)).withColumn("site", site)
    return _agreed(out)


def _agreed(refs: DataFrame) -> DataFrame:
    """The outcomes after alternatives: a pattern whose branches bind unlike, or hold a name that is unavailable, is unavailable as a whole."""
    spread = refs.filter("site").select("path", "pattern", "start", "name", "by_ref", "mutable", "outcome", F.explode("branches").alias("b")).select("*", "b.*").drop("b")
    # Branches without a site that may bind come in by their numbers.
    groups = refs.select("path", "pattern", F.explode("branches").alias("b")).select("path", "pattern", "b.alt", "b.of").distinct()
    mode = F.when(F.col("outcome") == "binding", F.concat_ws(" ", "name", F.col("by_ref").cast("string"), F.col("mutable").cast("string")))
    branches = spread.groupBy("path", "pattern", "alt", "branch").agg(F.array_join(F.sort_array(F.collect_set(mode)), ",").alias("bound"), F.bool_or(F.col("outcome") == "unavailable").alias("unknown"))
    told = branches.groupBy("path", "pattern", "alt").agg(F.min("bound").alias("low"), F.max("bound").alias("high"), F.count("*").alias("n"), F.bool_or("unknown").alias("unknown"))
    bad = groups.join(told, ["path", "pattern", "alt"]).filter("unknown or low <> high or (n < of and high <> '')").select("path", "pattern").distinct().withColumn("torn", F.lit(True))
    out = refs.join(bad, ["path", "pattern"], "left")
    torn = F.coalesce("torn", F.lit(False))
    return out.select(
        "path", "start", "end", "name", "pattern", F.when(torn, "unavailable").otherwise(F.col("outcome")).alias("outcome"),
        F.when(~torn & F.col("outcome").isin("resolved", "ambiguous"), F.col("targets")).alias("targets"), F.when(torn, UNSUPPORTED).otherwise(F.col("why")).alias("why"),
    )


def without_references(lexical: DataFrame, decided: DataFrame) -> DataFrame:
    """Lexical rows without the names that turned out to be constants or constructors."""
    named = decided.filter("outcome in ('resolved', 'ambiguous')").select("path", F.col("start").alias("name_start"))
    return lexical.join(named, ["path", "name_start"], "left_anti")
