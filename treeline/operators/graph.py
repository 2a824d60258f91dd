"""The module graph: addresses, import edges, aliases, reach, references, impact, surface, dead code, import checks.

An address is a package and an array of segments; `addr` is its text form and the key of
equi-joins. TypeScript modules have the empty package and their path as the only segment.
Prefix tests are equi-joins on exploded prefixes, ranges are joined by path first.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions import paths as P
from treeline.functions import text as T
from treeline.operators.search import except_known
from treeline.session import few, settle

# Kinds that an address can name, packages outside every workspace, the visibility words, the order of reasons.
ADDRESSABLE = ("function", "struct", "enum", "trait", "type-alias", "const", "static", "module", "macro", "class", "interface", "variable")
SYSTEM_PACKAGES = ("std", "core", "alloc")
REASONS = {
    "declaring": (0, "resolved"), "imported": (1, "resolved"), "path": (2, "resolved"), "re-export": (3, "resolved"), "opened": (4, "resolved"), "oracle": (5, "resolved"),
    "unresolved": (6, "unresolved"), "by-name": (7, "unresolved"), "other-declaration": (8, "other"), "external": (9, "other"),
}


def addr(package: Column, apath: Column) -> Column:
    """Text form of an address."""
    return F.when(package == "", F.array_join(apath, "/")).otherwise(F.concat_ws("::", F.array(package), apath))


def containing_package(files: DataFrame, packages: DataFrame) -> DataFrame:
    """path and the package (name, root) with the deepest root above it."""
    parts = F.split("path", "/")
    above = files.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("root"))
    return above.join(few(packages.select("root", "name")), "root").groupBy("path").agg(F.max_by(F.struct("name", "root"), F.length("root")).alias("p")).select("path", "p.name", "p.root")


def modules(files: DataFrame, packages: DataFrame) -> DataFrame:
    """path, language, package, mpath, addr of the files that are modules."""
    rust = files.filter("language = 'rust'").select("path", "language").join(containing_package(files.filter("language = 'rust'"), packages), "path")
    inside = F.when(F.col("root") == "", F.col("path")).otherwise(F.expr("substring(path, length(root) + 2)"))
    parts = F.split(F.regexp_replace(inside, r"\.rs$", ""), "/")
    body = F.slice(parts, 2, F.size(parts))
    last = F.element_at(body, -1)
    mpath = F.when((F.size(body) == 1) & last.isin("lib", "main"), F.expr("cast(array() as array<string>)")).when(last == "mod", F.slice(body, 1, F.size(body) - 1)).otherwise(body)
    rust = rust.filter((F.element_at(parts, 1) == "src") & (F.size(parts) > 1)).withColumn("mpath", mpath).filter(~((F.size("mpath") > 1) & (F.element_at(F.col("mpath"), 1) == "bin")))
    rust = rust.select("path", "language", F.col("name").alias("package"), "mpath")
    other = files.filter("language <> 'rust'").select("path", "language", F.lit("").alias("package"), F.array("path").alias("mpath"))
    return rust.unionByName(other).withColumn("addr", addr(F.col("package"), F.col("mpath")))


def reach(modifier: Column, package: Column, mpath: Column, language: Column) -> Column:
    """struct(kind, package, path): who may name a declaration. kind: everyone, package or within."""
    inside = F.split(F.regexp_extract(modifier, r"pub\(in (?:crate::)?(.*)\)", 1), "::")
    within = F.when(modifier == "pub(super)", P.parent(mpath)).when(modifier.startswith("pub(in"), inside).otherwise(mpath)
    kind = F.when((language == "rust") & (modifier == "pub") | (language != "rust") & modifier.startswith("export"), "everyone").when(modifier == "pub(crate)", "package").otherwise("within")
    return F.struct(F.coalesce(kind, F.lit("within")).alias("kind"), package.alias("package"), F.coalesce(within, mpath).alias("path"))


def admits(r: Column, package: Column, apath: Column) -> Column:
    """Whether a reach lets a module see the declaration."""
    return (r["kind"] == "everyone") | (r["package"] == package) & ((r["kind"] == "package") | P.starts_with(apath, r["path"]))


def narrowest(consumers: DataFrame) -> DataFrame:
    """For each target the least reach that admits all consumers(target, package, apath): within an ancestor, or everyone across packages.

    The common ancestor of a set of paths is that of the least and the greatest of them, so nothing is gathered.
    """
    folded = consumers.groupBy("target").agg(F.min("apath").alias("low"), F.max("apath").alias("high"), F.min("package").alias("a"), F.max("package").alias("b"))
    one = F.col("a") == F.col("b")
    return folded.select("target", F.when(one, "within").otherwise("everyone").alias("kind"), F.when(one, P.common_ancestor(F.col("low"), F.col("high"))).alias("path"))


def declared(symbols: DataFrame, mods: DataFrame) -> DataFrame:
    """Declarations that an address names, with it: module_addr, addr, package, apath, reach. Nested ones and members have none."""
    top = symbols.filter(F.col("kind").isin(*ADDRESSABLE) & F.col("container").isNull() & (F.col("depth") == 0))
    out = top.join(mods.select("path", "package", "mpath", F.col("addr").alias("module_addr")), "path")
    apath = F.concat("mpath", F.array("name"))
    return out.withColumns({"apath": apath, "addr": F.when(F.col("package") == "", F.concat_ws("::", "module_addr", "name")).otherwise(addr(F.col("package"), apath)), "reach": reach(F.col("modifier"), F.col("package"), F.col("mpath"), F.col("language"))})


def package_referent(rows: DataFrame, packages: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Adds referent: the package that the first segment `first` means inside the package `own`: a dependency under the name it is used by, another member, a system package, or null."""
    known = packages.select(F.col("name").alias("first"), F.col("name").alias("member")).distinct()
    deps = dependencies.select(F.col("package").alias("own"), F.col("used_as").alias("first"), "dep_name").distinct()
    meant = F.coalesce("dep_name", F.when(F.col("member") != F.col("own"), F.col("member")), F.when(F.col("first").isin(*SYSTEM_PACKAGES), F.col("first")))
    return rows.join(few(deps), ["own", "first"], "left").join(few(known), "first", "left").withColumn("referent", meant).drop("dep_name", "member")


def edges(imports: DataFrame, mods: DataFrame, packages: DataFrame, dependencies: DataFrame, decls: DataFrame, files: DataFrame) -> DataFrame:
    """Imports with the address they resolve to: package, apath, addr (null if unresolved or ambiguous), external, n_targets.

    Heads that another import of the file binds are substituted until nothing changes; each round resolves an import or is the last.
    """
    base = imports.withColumn("first", F.element_at("segments", F.when(F.size("segments") > 0, 1))).join(mods.select("path", F.col("package").alias("own"), "mpath", F.col("addr").alias("from_addr")), "path", "left")
    rest = F.slice("segments", 2, F.size("segments"))
    child = mods.filter("language = 'rust'").select(F.col("addr").alias("child"))
    here = decls.filter("language = 'rust'").select("path", F.col("name").alias("first"), F.lit(True).alias("is_here")).distinct()
    r = base.filter("language = 'rust'").withColumn("child", addr(F.col("own"), F.concat("mpath", F.array(F.coalesce("first", F.lit("")))))).join(child.distinct().withColumn("is_child", F.lit(True)), "child", "left")
    r = package_referent(r, packages, dependencies).join(here, ["path", "first"], "left")
    outside = F.col("referent")
    is_own = F.col("is_child") | (F.col("is_here") & ~F.col("declares"))

    def place(package: Column, apath: Column) -> Column:
        return F.struct(package.alias("package"), apath.alias("apath"))

    own = F.col("own")
    target = (
        F.when(F.col("head") == "crate", place(own, F.col("segments")))
        .when(F.col("head") == "self", place(own, F.concat("mpath", "segments")))
        .when((F.col("head") == "super") & (F.col("ups") <= F.size("mpath")), place(own, F.concat(F.slice("mpath", 1, F.size("mpath") - F.col("ups")), "segments")))
        .when((F.col("head") == "named") & is_own, place(own, F.concat("mpath", "segments")))
        .when((F.col("head") == "named") & outside.isNotNull(), place(outside, rest))
    )
    r = r.withColumn("target", target).drop("child", "is_child", "referent", "is_here")
    r = settle(r)
    while True:
        bound = r.filter("target is not null and binding is not null and declares").groupBy("path", F.col("binding").alias("first")).agg(F.collect_set("target").alias("via"))
        more = r.filter("target is null and head = 'named'").select("path", "ord", "first", "binding", "declares", "segments").join(bound, ["path", "first"]).filter(F.size("via") == 1)
        # An import that would bind its own head is no evidence for itself.
        more = more.filter("not (declares and binding = first and size(segments) = 1)")
        found = settle(more.select("path", "ord", F.struct(F.col("via")[0]["package"].alias("package"), F.concat(F.col("via")[0]["apath"], rest).alias("apath")).alias("got")))
        if found.isEmpty():
            break
        r = settle(r.join(found, ["path", "ord"], "left").withColumn("target", F.coalesce("target", "got")).drop("got"))
    rust = r.select(*imports.columns, "from_addr", F.col("target.package").alias("package"), F.col("target.apath").alias("apath"))
    rust = rust.withColumn("addr", F.when(F.col("package").isNotNull(), addr(F.col("package"), F.col("apath"))))

    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    asked = F.when(F.col("head").isin("here", "up"), P.normalise(F.concat_ws("/", folder, F.col("raw"))))
    ts = base.filter("language in ('typescript', 'tsx')").withColumn("asked", asked)
    tries = ts.select("path", "ord", F.posexplode(P.probe_candidates(F.col("asked"))).alias("try", "file")).join(files.select(F.col("path").alias("file")), "file")
    hit = tries.groupBy("path", "ord").agg(F.min_by("file", "try").alias("file"))
    ts = ts.join(hit, ["path", "ord"], "left").select(*imports.columns, "from_addr", F.when(F.col("file").isNotNull(), F.lit("")).alias("package"), F.when(F.col("file").isNotNull(), F.array("file")).alias("apath"), F.col("file").alias("addr"))
    fake = base.filter("language = 'fake'").select(*imports.columns, "from_addr", F.lit("fake").alias("package"), F.col("segments").alias("apath"), F.concat_ws("::", F.lit("fake"), F.array_join("segments", "::")).alias("addr"))
    members = packages.select(F.col("name").alias("package")).distinct().withColumn("inside", F.lit(True))
    return rust.unionByName(ts).unionByName(fake).join(few(members), "package", "left").withColumn("external", F.col("inside").isNull() & (F.col("package") != "") & (F.col("package") != "fake")).drop("inside")


def alias_closure(targets: DataFrame, edge: DataFrame) -> DataFrame:
    """(target, alias, step): all addresses under which re-exports offer each target(addr, package, apath, reach).

    A named re-export of an alias offers its binding; a glob re-export of an alias's parent offers the
    alias's last name, the target itself only where its reach admits the re-exporting module. Rounds go on until one finds nothing
    new; aliases are made of the modules and names that there are, so one does.
    """
    out = edge.filter("reexport and addr is not null and from_addr is not null and not is_prefix").select("from_addr", "glob", "binding", F.col("addr").alias("r"))
    seen = settle(targets.select(F.col("addr").alias("target"), F.col("addr").alias("alias"), "reach", F.lit(0).alias("step")).distinct())
    front = seen
    for k in count(1):
        named = front.join(out.filter("not glob").select(F.col("r").alias("alias"), "from_addr", "binding"), "alias").select("target", F.concat_ws("::", "from_addr", "binding").alias("next"), "reach")
        name = F.element_at(F.split("alias", "::"), -1)
        above = front.withColumns({"up": F.expr("substring(alias, 1, length(alias) - length(element_at(split(alias, '::'), -1)) - 2)"), "name": name})
        globbed = above.join(out.filter("glob").select(F.col("r").alias("up"), "from_addr"), "up")
        place = F.split("from_addr", "::")
        globbed = globbed.filter((F.col("alias") != F.col("target")) | admits(F.col("reach"), F.element_at(place, 1), F.slice(place, 2, F.size(place)))).select("target", F.concat_ws("::", "from_addr", "name").alias("next"), "reach")
        new = named.unionByName(globbed).select("target", F.col("next").alias("alias"), "reach").dropDuplicates(["target", "alias"])
        new = except_known(new, seen, ["target", "alias"])
        front = settle(new.select("target", "alias", "reach", F.lit(k).alias("step")))
        if front.isEmpty():
            break
        seen = settle(seen.unionByName(front))
    return seen.select("target", "alias", "step")


def origins(aliases: DataFrame) -> DataFrame:
    """(alias, target): the declaration behind an address, the nearest first."""
    return aliases.groupBy("alias").agg(F.min_by("target", F.struct("step", "target")).alias("target"))


def _under(edge: DataFrame) -> DataFrame:
    """Edges of import statements with every prefix of their address as `prefix`."""
    declares = edge.filter("declares and addr is not null and from_addr is not null and not is_prefix")
    return declares.withColumn("prefix", F.explode(F.transform(P.prefixes(F.col("apath")), lambda p: addr(F.col("package"), p))))


def importers(edge: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, path): files with an import at or below a target(addr)."""
    return _under(edge).select("path", F.col("prefix").alias("addr")).join(targets.select("addr"), "addr").select(F.col("addr").alias("target"), "path").distinct()


def impact(edge: DataFrame, mods: DataFrame, starts: DataFrame, declaring: str, most: int = 8) -> DataFrame:
    """addr, path, depth, through: modules that import one of starts(addr) or below, then their importers, each once."""
    arcs = _under(edge).join(mods.select("path", F.col("addr").alias("m")), "path").select("m", "path", "prefix", "ord").filter(F.col("m") != declaring)
    arcs = settle(arcs)
    front = starts.select(F.col("addr").alias("prefix"), F.lit("").alias("fpath")).distinct()
    seen = None
    for depth in range(1, most + 1):
        hit = arcs.join(front, "prefix").groupBy("m").agg(F.min_by(F.struct("path", "prefix"), F.struct("path", "ord", "fpath", "prefix")).alias("h"))
        new = hit.select("m", F.col("h.path").alias("path"), F.lit(depth).alias("depth"), (F.lit(declaring) if depth == 1 else F.col("h.prefix")).alias("through"))
        if seen is not None:
            new = except_known(new, seen, ["m"])
        new = settle(new)
        if new.isEmpty():
            break
        seen = new if seen is None else settle(seen.unionByName(new))
        front = new.select(F.col("m").alias("prefix"), F.col("path").alias("fpath"))
    empty = arcs.select("m", "path", F.lit(0).alias("depth"), F.col("prefix").alias("through")).limit(0)
    return (empty if seen is None else seen).withColumnRenamed("m", "addr").orderBy("depth", "path")


def imported_by(decls: DataFrame, aliases: DataFrame, edge: DataFrame) -> DataFrame:
    """addr, imported_by: the number of other files that import a declaration under any of its aliases."""
    uses = edge.filter("declares and addr is not null and not is_prefix").select(F.col("path").alias("user"), F.col("addr").alias("alias"))
    # A file is another one if it is not the least or not the greatest home. Homes meet the aliases first, so that uses are sorted for one join alone.
    homes = decls.groupBy(F.col("addr").alias("target")).agg(F.min("path").alias("low"), F.max("path").alias("high"))
    known = aliases.select("target", "alias").join(homes, "target")
    return uses.join(known, "alias").filter("user <> low or user <> high").groupBy(F.col("target").alias("addr")).agg(F.countDistinct("user").alias("imported_by"))


def surface(decls: DataFrame, aliases: DataFrame, edge: DataFrame, package: str | None = None) -> DataFrame:
    """Public declarations with the addresses that offer them and the number of other files that import one."""
    public = decls.filter("reach.kind = 'everyone'")
    public = public.filter(F.col("package") == package) if package else public
    offered = aliases.withColumnRenamed("target", "addr").groupBy("addr").agg(F.sort_array(F.collect_set(F.when(F.col("alias") != F.col("addr"), F.col("alias")))).alias("aliases"))
    used = imported_by(decls, aliases, edge)
    return public.join(offered, "addr", "left").join(used, "addr", "left").select("addr", "path", "kind", "name", "aliases", F.coalesce("imported_by", F.lit(0)).alias("imported_by")).orderBy("addr")


def surface_summary(rows: DataFrame) -> DataFrame:
    """One row for a surface: its items, and the imports that reach them."""
    return rows.agg(F.count("*").alias("items"), F.coalesce(F.sum("imported_by"), F.lit(0)).alias("importers"))


def impact_summary(rows: DataFrame) -> DataFrame:
    """Modules and files of an impact at each depth."""
    return rows.groupBy("depth").agg(F.countDistinct("addr").alias("modules"), F.countDistinct("path").alias("files")).orderBy("depth")


def verdict_counts(occurrences: DataFrame) -> DataFrame:
    """Tokens of each file by confidence: path, confidence, n."""
    return occurrences.groupBy("path", "confidence").agg(F.count("*").alias("n"))


def importer_statements(edge: DataFrame, files: DataFrame, targets: DataFrame) -> DataFrame:
    """target, path, statement: the text of each import statement at or below a target(addr)."""
    hit = _under(edge).select(F.col("prefix").alias("addr"), "path", "stmt_start", "stmt_end").join(targets.select("addr"), "addr").filter("stmt_start is not null").distinct()
    text = T.byte_slice(F.col("text"), F.col("stmt_start"), F.col("stmt_end") - F.col("stmt_start"))
    return hit.join(files.select("path", "text"), "path").select(F.col("addr").alias("target"), "path", text.alias("statement"))


def same_target(edge: DataFrame) -> DataFrame:
    """Adds nth: the place of an import among those of its file with its address; none without address."""
    nth = F.row_number().over(Window.partitionBy("path", "addr", "glob").orderBy("ord"))
    return edge.withColumn("nth", F.when(F.col("addr").isNotNull(), nth))


def import_problems(edge: DataFrame, tokens: DataFrame, mods: DataFrame) -> DataFrame:
    """path, ord, raw, problem: unresolved, redundant or unused imports; `unplaced` for files that are no module."""
    mine = edge.filter("declares and not is_prefix")
    placed = mine.join(mods.select("path"), "path", "left_semi")
    judged = same_target(placed).withColumn("again", F.coalesce(F.col("nth") > 1, F.lit(False))).drop("nth")
    spoken = tokens.select("path", F.col("name").alias("binding"), F.col("start").alias("at"))
    used = judged.join(spoken, ["path", "binding"]).filter("at < stmt_start or at >= stmt_end").select("path", "ord").distinct().withColumn("used", F.lit(True))
    problem = F.when(F.col("addr").isNull(), "unresolved").when(F.col("again"), "redundant").when(F.col("reexport") | (F.col("language") != "rust") | F.col("binding").isNull(), None).when(F.col("used").isNull(), "unused")
    out = judged.join(used, ["path", "ord"], "left").withColumn("problem", problem).filter("problem is not null").select("path", "ord", "raw", "problem")
    unplaced = mine.join(mods.select("path"), "path", "left_anti").select("path", F.lit(-1).alias("ord"), F.lit(None).cast("string").alias("raw"), F.lit("unplaced").alias("problem")).distinct()
    return out.unionByName(unplaced).orderBy("path", "ord")


def _declared_in_opened(tokens: DataFrame, opens: DataFrame, names: DataFrame) -> DataFrame:
    """(path, name) of tokens that share their name with a declaration(m, name) of a module that their file opens. It starts from the tokens, as files times declarations of a module are many."""
    asked = tokens.select("path", "name").distinct().join(opens, "path")
    return asked.join(names.select(F.col("m").alias("opened"), "name"), ["opened", "name"], "left_semi").select("path", "name").distinct()


def judge(tokens: DataFrame, decls: DataFrame, edge: DataFrame, aliases: DataFrame, mods: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Every token against every declaration of its name and language group, or those in `of` alone: target, path, start, reason, reason_ord, confidence.

    All declarations are judged in one set of joins; the first rule that applies decides:
    qualified path, declaring module, other declaration in the module, imported name, opened
    module, unresolved.
    """
    group = F.when(F.col("language") == "rust", "rust").otherwise("script")
    target = (decls if of is None else of).select("name", F.col("addr").alias("target"), F.col("module_addr").alias("home"), group.alias("grp")).distinct()
    t = tokens.withColumn("grp", group).select("path", "name", "grp", "start", "end").join(mods.select("path", F.col("addr").alias("m")), "path", "left").join(target, ["name", "grp"])
    t = settle(t)
    # Addresses of tokens inside paths: the path's address cut after the token's segment.
    spelled = edge.filter("addr is not null and language = 'rust'").select("path", F.col("start").alias("a"), F.col("end").alias("b"), "segments", "raw", "package", "apath", "declares", "head")
    inside = t.select("path", "name", "start", "end").distinct().join(spelled, "path").filter((F.col("a") <= F.col("start")) & (F.col("end") <= F.col("b")))
    # The span is the tail of the path as written, so the token's place in it tells the segment, also where names repeat.
    parts = F.split("raw", "::")
    number = P.segment_at(parts, F.octet_length("raw") - (F.col("b") - F.col("start")))
    after = F.when(F.try_element_at(parts, number + 1) == F.col("name"), F.size(parts) - number - 1)
    place = F.array_position("segments", F.col("name"))
    after = F.coalesce(after, F.when(place > 0, F.size("segments") - place.cast("int")))  # a path written with blanks or raw names
    cut = F.slice("apath", 1, F.greatest(F.size("apath") - after, F.lit(0)))
    members = mods.select(F.col("package").alias("of")).distinct().withColumn("member", F.lit(True))

    def known(found: DataFrame, column: str) -> DataFrame:
        """Adds whether the first of the addresses lies in a package of the workspace."""
        return found.withColumn("of", F.substring_index(F.col(column)[0], "::", 1)).join(members, "of", "left").withColumnRenamed("member", f"{column}_member").drop("of")

    at = known(inside.filter(after.isNotNull()).groupBy("path", "start").agg(F.collect_set(addr(F.col("package"), cut)).alias("at"), F.max("declares").alias("in_import")), "at")
    loose = edge.filter("addr is null and language = 'rust' and not declares and head <> 'Self'").select("path", F.col("start").alias("a"), F.col("end").alias("b"))
    tail = t.select("path", "start", "end").distinct().join(loose, "path").filter("a < start and end <= b").select("path", "start").distinct().withColumn("tail", F.lit(True))
    names = decls.select(F.col("module_addr").alias("m"), "name").distinct().withColumn("homonym", F.lit(True))
    bound = known(edge.filter("declares and addr is not null and binding is not null and not is_prefix").groupBy("path", F.col("binding").alias("name")).agg(F.collect_set("addr").alias("bound")), "bound")
    opens = edge.filter("declares and addr is not null").filter("glob or language <> 'rust'").select("path", F.col("addr").alias("opened")).distinct()
    offers = aliases.filter("alias <> target").select("target", F.expr("substring(alias, 1, length(alias) - length(element_at(split(alias, '::'), -1)) - 2)").alias("opened")).distinct()
    open_home = opens.withColumnRenamed("opened", "home").withColumn("opens_home", F.lit(True))
    open_offer = t.select("target", "path").distinct().join(opens, "path").join(offers, ["target", "opened"], "left_semi").select("target", "path").distinct().withColumn("opens_offer", F.lit(True))
    open_other = _declared_in_opened(t, opens, names).withColumn("opens_other", F.lit(True))
    mine = aliases.groupBy("target").agg(F.collect_set("alias").alias("offered"))
    j = t.join(at, ["path", "start"], "left").join(tail, ["path", "start"], "left").join(names, ["m", "name"], "left").join(bound, ["path", "name"], "left").join(open_home, ["path", "home"], "left").join(open_offer, ["path", "target"], "left").join(open_other, ["path", "name"], "left").join(mine, "target", "left")

    def compare(column: str, base: str) -> Column:
        found, one = F.col(column), F.col(column)[0]
        return F.when(F.size(found) > 1, "unresolved").when(one == F.col("target"), base).when(F.array_contains("offered", one), "re-export").when(F.col(f"{column}_member"), "other-declaration").otherwise("external")

    reason = (
        F.when(F.size("at") > 0, F.when(F.col("in_import"), compare("at", "imported")).otherwise(compare("at", "path")))
        .when(F.col("tail"), "unresolved")
        .when(F.col("m") == F.col("home"), "declaring")
        .when(F.col("homonym"), "other-declaration")
        .when(F.size("bound") > 0, compare("bound", "imported"))
        .when(F.col("opens_home"), "opened")
        .when(F.col("opens_offer"), "re-export")
        .when(F.col("opens_other"), "other-declaration")
        .otherwise("unresolved")
    )
    out = j.withColumn("reason", reason)
    rank = F.create_map(*[F.lit(x) for k, (o, _) in REASONS.items() for x in (k, o)])
    sure = F.create_map(*[F.lit(x) for k, (_, c) in REASONS.items() for x in (k, c)])
    return out.select("target", "name", "path", "start", "end", "reason", rank[F.col("reason")].alias("reason_ord"), sure[F.col("reason")].alias("confidence"))


def scoped(tokens: DataFrame, decls: DataFrame, edge: DataFrame, aliases: DataFrame, mods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(defaults, hits): what judge() says, without a row for each token and declaration of one name.

    defaults: path, name, grp, start, reason, confidence of every token that some declaration shares its name with: what it is to a declaration that its scope does not lead to.
    hits: target, name, path, start, end, reason, reason_ord, confidence of the pairs where it does lead there: by the address of its path, the module it
    stands in, the import that binds it, or a module that the file opens. All joins are by module or file and name.
    """
    group = F.when(F.col("language") == "rust", "rust").otherwise("script")
    named = decls.select("name", F.col("addr").alias("target"), F.col("module_addr").alias("home"), group.alias("grp")).distinct()
    known = named.select("name", "grp").distinct()
    t = tokens.withColumn("grp", group).select("path", "name", "grp", "start", "end").join(known, ["name", "grp"], "left_semi").join(mods.select("path", F.col("addr").alias("m")), "path", "left")
    t = settle(t)
    spelled = edge.filter("addr is not null and language = 'rust'").select("path", F.col("start").alias("a"), F.col("end").alias("b"), "segments", "raw", "package", "apath", "declares")
    inside = t.select("path", "name", "start", "end").join(spelled, "path").filter((F.col("a") <= F.col("start")) & (F.col("end") <= F.col("b")))
    parts = F.split("raw", "::")
    number = P.segment_at(parts, F.octet_length("raw") - (F.col("b") - F.col("start")))
    after = F.when(F.try_element_at(parts, number + 1) == F.col("name"), F.size(parts) - number - 1)
    place = F.array_position("segments", F.col("name"))
    after = F.coalesce(after, F.when(place > 0, F.size("segments") - place.cast("int")))
    cut = addr(F.col("package"), F.slice("apath", 1, F.greatest(F.size("apath") - after, F.lit(0))))
    key = ["path", "start"]
    at = inside.filter(after.isNotNull()).groupBy(*key).agg(F.min(cut).alias("at"), F.max(cut).alias("at_too"), F.max("declares").alias("in_import"))
    loose = edge.filter("addr is null and language = 'rust' and not declares and head <> 'Self'").select("path", F.col("start").alias("a"), F.col("end").alias("b"))
    tail = t.select("path", "start", "end").join(loose, "path").filter("a < start and end <= b").select(*key).distinct().withColumn("tail", F.lit(True))
    names = decls.select(F.col("module_addr").alias("m"), "name").distinct()
    bound = edge.filter("declares and addr is not null and binding is not null and not is_prefix").groupBy("path", F.col("binding").alias("name")).agg(F.min("addr").alias("bound"), F.max("addr").alias("bound_too"))
    opens = edge.filter("declares and addr is not null").filter("glob or language <> 'rust'").select("path", F.col("addr").alias("opened")).distinct()
    other = _declared_in_opened(t, opens, names).withColumn("opens_other", F.lit(True))
    j = t.join(at, key, "left").join(tail, key, "left").join(names.withColumn("homonym", F.lit(True)), ["m", "name"], "left").join(bound, ["path", "name"], "left").join(other, ["path", "name"], "left")
    members = mods.select(F.col("package").alias("of")).distinct().withColumn("member", F.lit(True))
    j = settle(j.withColumn("of", F.substring_index(F.coalesce("at", "bound"), "::", 1)).join(few(members), "of", "left").drop("of"))

    def elsewhere(column: str) -> Column:
        """What an address says that is not the declaration's: nothing where there are several, else another declaration, in the workspace or not."""
        return F.when(F.col(column) != F.col(f"{column}_too"), "unresolved").when(F.col("member"), "other-declaration").otherwise("external")

    default = (
        F.when(F.col("at").isNotNull(), elsewhere("at")).when(F.col("tail"), "unresolved").when(F.col("homonym"), "other-declaration")
        .when(F.col("bound").isNotNull(), elsewhere("bound")).when(F.col("opens_other"), "other-declaration").otherwise("unresolved")
    )
    sure = F.create_map(*[F.lit(x) for k, (_, c) in REASONS.items() for x in (k, c)])
    defaults = j.select("path", "name", "grp", "start", default.alias("reason"), sure[default].alias("confidence"))

    token = ["name", *key, "end"]
    named_as = aliases.select("alias", "target").join(named, "target")

    def led(rows: DataFrame, column: str, base: Column) -> DataFrame:
        """Rows whose one address is a declaration of the token's name, or an alias of one."""
        found = rows.select(*token, "grp", F.col(column).alias("alias"), base.alias("base")).join(named_as, ["alias", "name", "grp"])
        return found.select("target", *token, F.when(F.col("alias") == F.col("target"), F.col("base")).otherwise("re-export").alias("reason"))

    free = j.filter("at is null and tail is null")
    imported = free.filter("homonym is null and bound is not null")
    open_ = free.filter("homonym is null and bound is null").join(opens, "path")
    offers = aliases.filter("alias <> target").select("target", F.expr("substring(alias, 1, length(alias) - length(element_at(split(alias, '::'), -1)) - 2)").alias("opened")).distinct().join(named, "target")
    by_home = open_.join(named.withColumnRenamed("home", "opened"), ["opened", "name", "grp"]).select("target", *token, F.lit("opened").alias("reason"))
    by_offer = open_.join(offers, ["opened", "name", "grp"]).select("target", *token, F.lit("re-export").alias("reason"))
    hits = (
        led(j.filter("at = at_too"), "at", F.when(F.col("in_import"), "imported").otherwise("path"))
        .unionByName(free.join(named.withColumnRenamed("home", "m"), ["m", "name", "grp"]).select("target", *token, F.lit("declaring").alias("reason")))
        .unionByName(led(imported.filter("bound = bound_too"), "bound", F.lit("imported"))).unionByName(by_home).unionByName(by_offer)
    )
    rank = F.create_map(*[F.lit(x) for k, (o, _) in REASONS.items() for x in (k, o)])
    # A module that is opened comes before what another opened one offers again.
    first = F.when(F.col("reason") == "opened", 0).otherwise(rank[F.col("reason")])
    best = hits.groupBy("target", *token).agg(F.min_by("reason", first).alias("reason"))
    return defaults, best.select("target", *token, "reason", rank[F.col("reason")].alias("reason_ord"), F.lit("resolved").alias("confidence"))


def dead_scoped(defaults: DataFrame, hits: DataFrame, decls: DataFrame) -> DataFrame:
    """dead(), from scoped(): a token is unsure to all declarations of its name, less those that its scope leads to."""
    group = F.when(F.col("language") == "rust", "rust").otherwise("script")
    own = decls.select(F.col("addr").alias("target"), "path", F.col("name_start").alias("start")).withColumn("own", F.lit(True))
    used = hits.join(own, ["target", "path", "start"], "left").groupBy("target").agg(F.bool_or(F.col("own").isNull()).alias("used"))
    open_ = defaults.filter("confidence = 'unresolved'")
    all_unsure = open_.groupBy("name", "grp").agg(F.count("*").alias("all_unsure"))
    sure = hits.join(open_.select("path", "start"), ["path", "start"]).groupBy("target").agg(F.count("*").alias("sure"))
    rows = decls.select("path", "name", "kind", F.col("name_start").alias("start"), F.col("addr").alias("target"), group.alias("grp")).join(used, "target", "left").filter("used is null or not used")
    rows = rows.join(all_unsure, ["name", "grp"], "left").join(sure, "target", "left")
    return rows.select("path", "name", "kind", "start", (F.coalesce("all_unsure", F.lit(0)) - F.coalesce("sure", F.lit(0))).alias("unsure")).orderBy("path", "start")


def targets(decls: DataFrame) -> DataFrame:
    """name, declarations, ambiguous: how many addresses a bare name may mean."""
    return decls.groupBy("name").agg(F.countDistinct("addr").alias("declarations")).withColumn("ambiguous", F.col("declarations") > 1)


def by_name(tokens: DataFrame, name: str) -> DataFrame:
    """Without an addressable declaration every spelling is unresolved."""
    return tokens.filter(F.col("name") == name).select("path", "start", "end", F.lit("by-name").alias("reason"), F.lit(REASONS["by-name"][0]).alias("reason_ord"), F.lit("unresolved").alias("confidence"))


def consult(occurrences: DataFrame, oracle: DataFrame, decls: DataFrame) -> DataFrame:
    """A second opinion oracle(path, start, addr) for unresolved tokens; it counts only if it names a known declaration."""
    said = oracle.join(decls.select("addr").distinct(), "addr", "left_semi").select("path", "start", F.col("addr").alias("said"))
    better = F.when(F.col("confidence") != "unresolved", F.col("reason")).when(F.col("said") == F.col("target"), "oracle").when(F.col("said").isNotNull(), "other-declaration").otherwise(F.col("reason"))
    sure = F.create_map(*[F.lit(x) for k, (_, c) in REASONS.items() for x in (k, c)])
    return occurrences.join(said, ["path", "start"], "left").withColumn("reason", better).withColumn("confidence", sure[F.col("reason")]).drop("said")


def dead(occurrences: DataFrame, decls: DataFrame) -> DataFrame:
    """Declarations no resolved token but their own name refers to, with the number of unsure tokens. One pass over all names."""
    own = decls.select(F.col("addr").alias("target"), "path", F.col("name_start").alias("start")).withColumn("own", F.lit(True))
    verdict = occurrences.join(own, ["target", "path", "start"], "left").groupBy("target").agg(F.bool_or((F.col("confidence") == "resolved") & F.col("own").isNull()).alias("used"), F.count_if(F.col("confidence") == "unresolved").alias("unsure"))
    return decls.select("path", "name", "kind", F.col("name_start").alias("start"), F.col("addr").alias("target")).join(verdict, "target", "left").filter("used is null or not used").select("path", "name", "kind", "start", F.coalesce("unsure", F.lit(0)).alias("unsure")).orderBy("path", "start")


def visible_bindings(tokens: DataFrame, lexical: DataFrame, uncertain: DataFrame | None = None) -> DataFrame:
    """The local bindings a token may mean: innermost scope, then latest; equal ones all stay. Tokens inside an unexpanded macro have none."""
    b = lexical.select("path", "name", F.col("name_start").alias("b_start"), "scope_start", "scope_end", "visible_from", F.col("kind").alias("b_kind"))
    pairs = tokens.select("path", "name", "start", "end").join(b, ["path", "name"]).filter((F.col("scope_start") <= F.col("start")) & (F.col("end") <= F.col("scope_end")) & (F.col("visible_from") <= F.col("start")) | (F.col("b_start") == F.col("start")))
    rank = F.rank().over(Window.partitionBy("path", "start").orderBy((F.col("b_start") != F.col("start")), F.col("scope_end") - F.col("scope_start"), -F.col("visible_from")))
    out = pairs.withColumn("r", rank).filter("r = 1").select("path", "name", "start", "b_start", "b_kind")
    if uncertain is not None:
        veto = out.join(uncertain.select("path", F.col("start").alias("u"), F.col("end").alias("v")), "path").filter("u <= start and start < v and not (u <= b_start and b_start < v)").select("path", "start").distinct()
        out = out.join(veto, ["path", "start"], "left_anti")
    return out


def outcome(candidates: DataFrame, keys: list[str], target: str) -> DataFrame:
    """resolved, ambiguous or unavailable for each key, with all candidates in order."""
    found = candidates.groupBy(*keys).agg(F.sort_array(F.collect_set(target)).alias("targets"))
    return found.withColumn("outcome", F.when(F.size("targets") == 1, "resolved").when(F.size("targets") > 1, "ambiguous").otherwise("unavailable"))


def callees(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls with the declaration that makes them: path, caller, callee, kind, callee_start."""
    owner = symbols.select("path", F.col("name_start").alias("owner_start"), F.col("name").alias("caller"))
    return calls.join(owner, ["path", "owner_start"], "left").select("path", "caller", "callee", "kind", "callee_start", "owner_start")


def callers(calls: DataFrame, symbols: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Calls whose callee token resolves to a function: target, path, caller, callee_start."""
    sure = occurrences.filter("confidence = 'resolved'").select("target", "path", F.col("start").alias("callee_start"))
    return callees(calls, symbols).filter("kind = 'direct'").join(sure, ["path", "callee_start"]).select("target", "path", "caller", "callee_start").distinct()


def outline(symbols: DataFrame, mods: DataFrame) -> DataFrame:
    """A file's declarations in source order with address and reach."""
    at = mods.select("path", "package", "mpath", F.col("addr").alias("module_addr"))
    named = F.when(F.col("kind").isin(*ADDRESSABLE) & F.col("container").isNull() & (F.col("depth") == 0), F.concat_ws("::", "module_addr", "name"))
    return symbols.join(at, "path", "left").select("path", "ord", "kind", "name", "start", "depth", named.alias("addr"), reach(F.col("modifier"), F.col("package"), F.col("mpath"), F.col("language"))["kind"].alias("reach")).orderBy("path", "ord")


def where(decls: DataFrame, name: str) -> DataFrame:
    """Where a name is declared, and the statement that would import it."""
    inside = F.when(F.col("language") == "rust", F.concat(F.lit("use "), F.concat_ws("::", F.lit("crate"), "apath"), F.lit(";"))).otherwise(F.concat(F.lit("import { "), F.col("name"), F.lit(' } from "./'), F.regexp_replace("path", r"\.[a-z]+$", ""), F.lit('";')))
    return decls.filter(F.col("name") == name).select("path", "kind", "addr", inside.alias("statement")).orderBy("path")


def outgoing(edge: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each import statement's entries with the declaration behind them."""
    return edge.filter("declares and not is_prefix").join(origins(aliases).withColumnRenamed("alias", "addr"), "addr", "left").select("path", "ord", "raw", "addr", F.coalesce("target", "addr").alias("origin"), "external")


def dependency_groups(edge: DataFrame, mods: DataFrame) -> DataFrame:
    """Imports of each file by package: own first, unresolved last; entries of one statement on one line."""
    own = mods.select("path", F.col("package").alias("own"))
    rows = edge.filter("declares and not is_prefix").join(own, "path", "left")
    group = F.when(F.col("package") == F.col("own"), 0).when(F.col("package").isNull(), 2).otherwise(1)
    return rows.groupBy("path", group.alias("rank"), F.coalesce("package", F.lit("?")).alias("package"), "stmt_start").agg(F.array_join(F.sort_array(F.collect_list("raw")), ", ").alias("entries")).orderBy("path", "rank", "package", "stmt_start")


def unreachable(chains: DataFrame, decls: DataFrame) -> DataFrame:
    """Consumers(target, package, apath) that a declaration's reach does not admit, with the reach it would need."""
    r = decls.select(F.col("addr").alias("target"), "reach")
    bad = chains.join(r, "target").filter(~admits(F.col("reach"), F.col("package"), F.col("apath")))
    return bad.groupBy("target").agg(F.count("*").alias("consumers")).join(narrowest(bad), "target")
