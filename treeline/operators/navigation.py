"""Navigation: what a token means, where an address leads, who refers to a declaration under any name, within budgets.

All tokens are resolved in one set of joins. Candidates come in tiers: local bindings before
what a path or an import names, that before what a glob opens; the first tier with a candidate decides.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions import paths as P
from treeline.operators.graph import addr as address
from treeline.operators.graph import admits, reach
from treeline.operators.search import except_known
from treeline.session import few, settle

# Tiers in order, and why a token has no target.
TIERS = ("local", "direct", "opened")
UNAVAILABLE = ("macro", "unresolved", "external", "other-declaration", "unknown-name")
#: Tiers of a name in a pattern that is a constant or a constructor, and of a member of a namespace.
PATTERN, MEMBER = "pattern", "member"


def candidates(lexical: DataFrame, occurrences: DataFrame, sites: DataFrame) -> DataFrame:
    """(path, start, tier, target): every binding or declaration that a token may mean. lexical: rows of visible_bindings; sites: rows of reference_sites."""
    local = lexical.select("path", "start", F.lit(0).alias("tier"), F.concat_ws("@", "path", F.col("b_start").cast("string")).alias("target"))
    tier = F.when(F.col("reason") == "opened", 2).otherwise(1)
    renamed = sites.filter("via <> 'own-name'").select("path", "start", F.lit(1).alias("tier"), "target")
    return local.unionByName(occurrences.filter("confidence = 'resolved'").select("path", "start", tier.alias("tier"), "target")).unionByName(renamed)


def resolved(tokens: DataFrame, lexical: DataFrame, occurrences: DataFrame, sites: DataFrame, uncertain: DataFrame | None = None, patterns: DataFrame | None = None, members: DataFrame | None = None, defaults: DataFrame | None = None) -> DataFrame:
    """path, name, start, outcome, tier, targets, why of every token: resolved, ambiguous, or unavailable and why.

    occurrences: pairs of judge(), or those of scoped() with its defaults, which say why a token without candidates has none. A name in a pattern is what its pattern makes it; those that bind are local. A member of a namespace is what the module exports.
    """
    found = candidates(lexical, occurrences, sites)
    first = found.groupBy("path", "start").agg(F.min("tier").alias("tier"))
    kept = found.join(first, ["path", "start", "tier"]).groupBy("path", "start", "tier").agg(F.sort_array(F.collect_set("target")).alias("targets"))
    seen = (occurrences if defaults is None else defaults).groupBy("path", "start").agg(*[F.bool_or(F.col("reason") == r).alias(r) for r in ("unresolved", "external", "other-declaration")])
    out = tokens.select("path", "name", "start", "end").join(kept, ["path", "start"], "left").join(seen, ["path", "start"], "left")
    if uncertain is not None:  # the running end of the regions before a token tells whether one holds it
        regions = uncertain.select("path", F.col("start"), F.col("end").alias("__end")).withColumn("__token", F.lit(0))
        both = out.withColumn("__token", F.lit(1)).unionByName(regions, allowMissingColumns=True)
        end = F.max("__end").over(Window.partitionBy("path").orderBy("start", "__token").rowsBetween(Window.unboundedPreceding, 0))
        out = both.withColumn("macro", end > F.col("start")).filter("__token = 1").drop("__end", "__token")
    else:
        out = out.withColumn("macro", F.lit(False))
    n = F.coalesce(F.size("targets"), F.lit(0))
    why = F.lit(UNAVAILABLE[-1])
    for reason in reversed(UNAVAILABLE[:-1]):
        why = F.when(F.col(reason), reason).otherwise(why)
    tier = F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.col("tier") + 1)
    out = out.select("path", "name", "start", "end", F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unavailable").alias("outcome"), F.when(n > 0, tier).alias("tier"), "targets", F.when(n < 1, why).alias("why"))
    # A path in a pattern ends with its name, so the ends tell the token.
    for said, tier_of in ((patterns, PATTERN), (members, MEMBER)):
        if said is not None:
            said = said.filter("outcome <> 'binding'").select("path", "end", "name", F.col("outcome").alias("p_outcome"), F.col("targets").alias("p_targets"), F.col("why").alias("p_why"))
            took = F.col("p_outcome").isNotNull()
            pick = lambda p, own, took=took: F.when(took, F.col(p)).otherwise(F.col(own)).alias(own)
            tier = F.when(took, F.when(F.col("p_targets").isNotNull(), tier_of)).otherwise(F.col("tier")).alias("tier")
            out = out.join(said, ["path", "end", "name"], "left").select("path", "name", "start", "end", pick("p_outcome", "outcome"), tier, pick("p_targets", "targets"), pick("p_why", "why"))
    return out.select("path", "name", "start", "outcome", "tier", "targets", "why")


def provided(resolutions: DataFrame, answers: DataFrame, files: DataFrame, decls: DataFrame) -> DataFrame:
    """resolutions, completed by a semantic provider's answers(path, start, target, provider, version, content_id).

    An answer counts only for the content it was made for and if its target is declared; of one provider the
    newest version counts, with all its candidates. Tokens that are resolved already keep their targets.
    """
    fresh = answers.join(files.select("path", "content_id"), ["path", "content_id"], "left_semi").join(decls.select(F.col("addr").alias("target")).distinct(), "target", "left_semi")
    newest = fresh.groupBy("provider", "path", "start").agg(F.max("version").alias("version"))
    said = fresh.join(newest, ["provider", "path", "start", "version"]).groupBy("path", "start").agg(F.sort_array(F.collect_set("target")).alias("said"))
    take = (F.col("outcome") != "resolved") & F.col("said").isNotNull()
    out = resolutions.join(said, ["path", "start"], "left")
    found = F.when(take, F.col("said")).otherwise(F.col("targets"))
    outcome = F.when(take, F.when(F.size("said") == 1, "resolved").otherwise("ambiguous")).otherwise(F.col("outcome"))
    return out.select("path", "name", "start", outcome.alias("outcome"), F.when(take, "provided").otherwise(F.col("tier")).alias("tier"), found.alias("targets"), F.when(~take, F.col("why")).alias("why"))


#: Steps that a walk over re-bindings may take; one that takes them all ends with the outcome `limit`.
MOST_STEPS = 1024


def normalised(asked: DataFrame, edge: DataFrame, decls: DataFrame, most: int = MOST_STEPS) -> DataFrame:
    """id, addr, trail, cycle, outcome for asked(id, addr, viewer): where an address leads when re-bindings on its way are followed.

    The longest prefix that an import binds, and whose visibility admits the viewer, is replaced by what it names, until nothing
    changes (`settled`). A declared prefix is left as it is. A walk ends as a `cycle` when an address comes again, and as `growth`
    when a binding comes again after what stood behind it was never touched: it would come for ever, longer each time.
    One of the two comes to every walk without an end. `limit` says that a walk took `most` steps. The address is the last one.
    """
    bound = edge.filter("declares and addr is not null and from_addr is not null and binding is not null and not is_prefix")
    place = F.split("from_addr", "::")
    # Edges of a caller's own may say no more than that they re-export.
    visible = F.col("visibility") if "visibility" in edge.columns else F.when(F.col("reexport"), "pub")
    seen_by = reach(visible, F.element_at(place, 1), F.slice(place, 2, F.size(place)), F.col("language") if "language" in edge.columns else F.lit("rust"))
    binds = bound.select(F.concat_ws("::", "from_addr", "binding").alias("prefix"), seen_by.alias("reach"), F.col("addr").alias("to")).filter("prefix <> to").distinct()
    binds = settle(except_known(binds, decls.select(F.col("addr").alias("prefix")).distinct(), ["prefix"]))
    # Of each step the prefix that was replaced, and the length of what stood behind it.
    state = settle(asked.select("id", "addr", "viewer", F.array("addr").alias("trail"), F.expr("cast(array() as array<struct<prefix:string,rest:int>>)").alias("steps")))
    done = None
    for k in count(1):
        parts = F.split("addr", "::")
        met = state.withColumn("prefix", F.explode(F.transform(P.prefixes(parts), lambda p: F.array_join(p, "::")))).join(binds, "prefix")
        viewer = F.split("viewer", "::")
        usable = met.filter(admits(F.col("reach"), F.element_at(viewer, 1), F.slice(viewer, 2, F.size(viewer))))
        best = usable.groupBy("id").agg(F.max_by(F.struct("prefix", "to"), F.struct(F.length("prefix"), "to")).alias("s"))
        moved = state.join(best, "id", "left").withColumn("rest", F.expr("length(addr) - length(s.prefix)")).withColumn("next", F.concat(F.col("s.to"), F.expr("substring(addr, length(s.prefix) + 1)")))
        untouched = lambda x, i: (x["prefix"] == F.col("s.prefix")) & (x["rest"] <= F.col("rest")) & F.forall(F.slice("steps", i + 1, F.size("steps")), lambda y: y["rest"] >= x["rest"])
        grows = F.exists(F.transform("steps", lambda x, i: F.coalesce(untouched(x, i), F.lit(False))), lambda x: x)
        outcome = F.when(F.col("next").isNull(), "settled").when(F.array_contains("trail", F.col("next")), "cycle").when(grows, "growth").when(F.lit(k > most), "limit")
        moved = settle(moved.withColumn("outcome", outcome))
        ended = moved.filter("outcome is not null").select("id", "addr", "trail", (F.col("outcome") == "cycle").alias("cycle"), "outcome")
        done = ended if done is None else done.unionByName(ended)
        step = F.struct(F.col("s.prefix").alias("prefix"), F.col("rest").cast("int").alias("rest"))
        state = settle(moved.filter("outcome is null").select("id", F.col("next").alias("addr"), "viewer", F.concat("trail", F.array("next")).alias("trail"), F.concat("steps", F.array(step)).alias("steps")))
        if state.isEmpty():
            return done


def incoming_names(edge: DataFrame, aliases: DataFrame, decls: DataFrame) -> DataFrame:
    """(target, path, name): the names under which a file may speak of a declaration: those that its imports bind to it or one of its aliases, and in its own file its own."""
    own = decls.select(F.col("addr").alias("target"), "path", "name")
    bound = edge.filter("declares and addr is not null and binding is not null and not is_prefix").select("path", F.col("binding").alias("name"), F.col("addr").alias("alias"))
    return own.unionByName(bound.join(aliases.select("alias", "target"), "alias").select("target", "path", "name")).distinct()


def reference_sites(tokens: DataFrame, names: DataFrame, occurrences: DataFrame, lexical: DataFrame, decls: DataFrame, edge: DataFrame, aliases: DataFrame) -> DataFrame:
    """(target, path, start, name, via): tokens that refer to a declaration: by its own name, by a name that an import gives it, or by one that a re-export gives it at the end of a path.

    The declaration's own name is left out, and so is a token that a local binding claims.
    """
    own = occurrences.filter("confidence = 'resolved'").select("target", "path", "start", "name", F.lit("own-name").alias("via"))
    other = names.join(decls.select(F.col("addr").alias("target"), F.col("name").alias("declared")).distinct(), "target").filter("name <> declared").drop("declared")
    claimed = lexical.select("path", "start").distinct()
    renamed = except_known(tokens.select("path", "name", "start").join(other, ["path", "name"]), claimed, ["path", "start"]).select("target", "path", "start", "name", F.lit("import-name").alias("via"))
    last = F.element_at("segments", -1)
    ends = edge.filter("addr is not null and language = 'rust' and not glob and not is_prefix and size(segments) > 0").select("path", F.col("addr").alias("alias"), (F.col("end") - F.octet_length(last)).alias("start"), last.alias("name"))
    spelled = ends.join(aliases.filter("alias <> target").select("alias", "target"), "alias").join(decls.select(F.col("addr").alias("target"), F.col("name").alias("declared")).distinct(), "target").filter("name <> declared")
    renamed = renamed.unionByName(spelled.select("target", "path", "start", "name", F.lit("path-name").alias("via")))
    sites = own.unionByName(renamed).dropDuplicates(["target", "path", "start"])
    return except_known(sites, decls.select(F.col("addr").alias("target"), "path", F.col("name_start").alias("start")), ["target", "path", "start"])


def within_budget(rows: DataFrame, max_files: int | None = None, max_items: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, coverage): rows by path and start, and one row that says what was left out. All rows stay, unless a budget is given: then those of the first max_files files by path, max_items of them at most.

    Files are numbered over one row a file, taken from a top-k of max_files, so a budget bounds the work.
    """
    files = rows.groupBy("path").agg(F.count("*").alias("n"))
    taken, kept = files, rows.select("path", *[c for c in rows.columns if c != "path"])
    if max_files is not None:
        taken = files.orderBy("path").limit(max_files)
        kept = kept.join(F.broadcast(taken.select("path")), "path")  # max_files rows at most
    kept = kept.orderBy("path", "start")
    kept = kept if max_items is None else kept.limit(max_items)
    whole = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("items"))
    part = taken.agg(F.count("*").alias("files_scanned"), F.coalesce(F.sum("n"), F.lit(0)).alias("found"))
    shown = F.col("found") if max_items is None else F.least("found", F.lit(max_items))
    limit = F.when(F.col("found") > shown, "items").when(F.col("files") > F.col("files_scanned"), "files")
    both = whole.withColumn("k", F.lit(0)).join(part.withColumn("k", F.lit(0)), "k")  # one row each
    return kept, both.select("files_scanned", (F.col("files") - F.col("files_scanned")).alias("files_remaining"), shown.alias("items"), (F.col("items") - shown).alias("items_omitted"), limit.alias("limit_hit"))


def candidate_files(edge: DataFrame, aliases: DataFrame, decls: DataFrame, mods: DataFrame) -> DataFrame:
    """path: files that may speak of decls at all: their own, those of their module, those with a path through one of their addresses, and those
    that open what holds one. It is told from the graph, so no token is read; every site of reference_sites() lies in one of them."""
    mine = decls.select(F.col("addr").alias("target"), "path", "module_addr")
    offered = few(aliases.join(few(mine.select("target").distinct()), "target").select("alias").distinct())
    known = edge.filter("addr is not null")
    through = known.select("path", "addr", F.explode(F.transform(P.prefixes(F.col("apath")), lambda p: address(F.col("package"), p))).alias("alias"))
    holders = offered.select(F.expr("substring(alias, 1, length(alias) - length(element_at(split(alias, '::'), -1)) - 2)").alias("addr")).unionByName(mine.select(F.col("module_addr").alias("addr"))).distinct()
    openers = known.filter("declares and (glob or language <> 'rust')").select("path", "addr").join(few(holders), "addr")
    homes = mods.select("path", "addr").join(few(mine.select(F.col("module_addr").alias("addr")).distinct()), "addr")
    return mine.select("path").unionByName(through.join(offered, "alias").select("path")).unionByName(openers.select("path")).unionByName(homes.select("path")).distinct()


#: Files of the first stage; each stage reads four times as many as the one before, so stages stay few.
FIRST_FILES = 32
# Budgets and the range of each.
BUDGETS = {"max_files": (1, 4096), "max_items": (1, 1024), "max_lookups": (1, 16384)}


def staged(read: Callable[[list[str]], DataFrame], candidates: DataFrame, max_files: int = 128, max_items: int = 64, max_lookups: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(rows, coverage): read(paths) over candidates(path) by path, stage after stage, until a budget is spent; files beyond it are never read.

    A lookup asks one candidate; candidates beyond max_lookups are not even counted. coverage: files_scanned, files_remaining among the candidates looked
    up, lookups, items, items_omitted among those found in the files scanned, limit_hit (items, files, lookups, or null where all was read).
    """
    for name, value in (("max_files", max_files), ("max_items", max_items), ("max_lookups", max_lookups)):
        low, high = BUDGETS[name]
        if not low <= value <= high:
            raise ValueError(f"{name} goes from {low} to {high}")
    paths = [r["path"] for r in candidates.select("path").orderBy("path").limit(max_lookups + 1).collect()]  # bounded by the budget
    more, paths = len(paths) > max_lookups, paths[:max_lookups]
    out, found, at, size = None, 0, 0, FIRST_FILES
    while out is None or (at < min(len(paths), max_files) and found < max_items):
        stage = paths[at : min(at + size, max_files)]
        part = settle(read(stage))
        found += part.count()
        out = part if out is None else out.unionByName(part)
        at, size = at + len(stage), 4 * size
    left, shown = len(paths) - at, min(found, max_items)
    limit = "items" if found > max_items or (found == max_items and (left or more)) else "files" if left else "lookups" if more else None
    told = out.sparkSession.createDataFrame([(at, left, len(paths), shown, found - shown, limit)], "files_scanned int, files_remaining int, lookups int, items int, items_omitted int, limit_hit string")
    return out.orderBy("path", "start").limit(max_items), told
