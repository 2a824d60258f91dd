"""A workspace whose tables are computed once and shared by all commands."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators import context, graph, namespaces, navigation, patterns, search, structure
from treeline.plans import edits
from treeline.session import few, settle
from treeline.sources import requests, workspace


class Workspace:
    """files(path, text, language, ...) and, on demand, the tables derived from them. Every table is written once."""

    def __init__(self, files: DataFrame) -> None:
        self.files = files

    @cached_property
    def facts(self) -> DataFrame:
        return settle(workspace.facts(self.files))

    def family(self, name: str) -> DataFrame:
        return workspace.family(self.facts, name)

    @cached_property
    def manifests(self) -> DataFrame:
        return settle(workspace.manifests(self.files)).filter("name is not null")

    @property
    def packages(self) -> DataFrame:
        return self.manifests.select("root", "name")

    @property
    def dependencies(self) -> DataFrame:
        return self.manifests.select(F.col("name").alias("package"), F.explode("dependencies").alias("d")).select("package", "d.*")

    @cached_property
    def modules(self) -> DataFrame:
        return settle(graph.modules(self.files.filter("language is not null"), self.packages))

    @cached_property
    def declared(self) -> DataFrame:
        return settle(graph.declared(self.family("symbols"), self.modules))

    @cached_property
    def edges(self) -> DataFrame:
        return settle(graph.edges(self.family("imports"), self.modules, self.packages, self.dependencies, self.declared, self.files))

    @cached_property
    def aliases(self) -> DataFrame:
        return graph.alias_closure(self.declared, self.edges)

    @cached_property
    def occurrences(self) -> DataFrame:
        """Every token judged against every declaration of its name."""
        return settle(graph.judge(self.family("tokens"), self.declared, self.edges, self.aliases, self.modules))

    @cached_property
    def scoped(self) -> tuple[DataFrame, DataFrame]:
        """What tokens are by themselves, and the declarations that their scopes lead to."""
        defaults, hits = graph.scoped(self.family("tokens"), self.declared, self.edges, self.aliases, self.modules)
        return defaults, settle(hits)

    # Commands

    def target(self, name: str, declared_in: str | None = None) -> str:
        """The one address that a name means; several need the file."""
        found = self.declared.filter(F.col("name") == name)
        found = found.filter(F.col("path") == declared_in) if declared_in else found
        rows = found.select("addr").distinct().limit(2).collect()  # two are enough to call it ambiguous
        if not rows:
            raise LookupError(f"no such symbol: {name}")
        if len(rows) > 1:
            raise LookupError(f"ambiguous symbol, say the file that declares it: {name}")
        return rows[0][0]

    def search(self, name: str | None = None, kind: str | None = None, pattern: str | None = None, language: str | None = None) -> DataFrame:
        """Numbered, located hits. A pattern is matched by structure; with a name or kind as well, matches that hold such a declaration's name stay."""
        if not name and not kind and not pattern:
            raise ValueError("an empty query finds nothing")
        symbols = self.family("symbols")
        if pattern:
            files = self.files if language is None else self.files.filter(F.col("language") == language)
            hits = edits.pattern_matches(files, pattern)
            hits = search.holding(hits, symbols, kind, name) if name or kind else hits
            hits = hits.select("path", "start", "end", F.lit(pattern).alias("name"), F.lit(None).cast("string").alias("symbol_kind"))
        elif name and not kind:
            hits = search.attach(search.named(self.family("tokens"), name), symbols)
        else:
            found = search.declarations(symbols, kind, name)
            hits = found.select("path", F.col("name_start").alias("start"), F.col("name_end").alias("end"), "name", F.col("kind").alias("symbol_kind"))
        if language and not pattern:
            hits = hits.join(self.files.filter(F.col("language") == language).select("path"), "path", "left_semi")
        judged = search.roles(hits, self.family("imports"))
        return search.numbered(search.locate(judged, self.files))

    def skipped(self, language: str | None = None) -> DataFrame:
        """Files that a search leaves out, by language: those that no parser reads, and other languages than the one asked for."""
        known = list(workspace.PARSERS) if language is None else [language]
        return search.language_report(self.files, known).filter("skipped")

    def workspace_files(self) -> DataFrame:
        return workspace.inventory(self.files)

    def file(self, path: str) -> DataFrame:
        return workspace.preview(self.files, self.facts, path)

    def context(self, name: str, declared_in: str | None = None, max_items: int = 12, max_bytes: int = 16384) -> DataFrame:
        return context.assemble(self, name, declared_in, max_items, max_bytes)

    def search_page(self, name: str, after: int = 0, max_items: int = 20, max_bytes: int = 16384) -> DataFrame:
        return search.page(self.search(name), after, max_items, max_bytes)

    def commands(self) -> dict:
        """What serve() answers by: the reading commands of the catalogue."""
        related = lambda name, declared_in=None, **budget: self.related(name, declared_in, **budget)[0]
        names = ("search", "search_page", "outline", "references", "where", "deps", "explain", "surface", "impact", "dead", "imports", "navigate", "resolve", "context", "workspace_files", "file", "skipped")
        discover = lambda: requests.catalogue(self.files.sparkSession)
        return {n: getattr(self, n) for n in names} | {"relationships": related, "discover": discover, "schema": self.schema}

    def schema(self, command: str) -> DataFrame:
        """The columns of a command's answer as JSON, from a plan that is not run beyond what the tables need."""
        sample = {"name": "x", "path": "x", "offset": 0}
        if command not in requests.COMMANDS or command in ("schema", "discover"):
            raise LookupError(f"no schema of {command}")
        wanted = {p: sample[p] for p in requests.COMMANDS[command][1].split() if p in sample}
        try:
            found = self.commands()[command](**wanted).schema.json()
        except LookupError:  # the command needs a declaration that there is
            one = self.declared.groupBy("name").agg(F.count("*").alias("n")).filter("n = 1").first()
            found = self.commands()[command](**(wanted | ({"name": one["name"]} if one else {}))).schema.json()
        return self.files.sparkSession.createDataFrame([(command, found)], "command string, schema string")

    def outline(self, path: str) -> DataFrame:
        return graph.outline(self.family("symbols").filter(F.col("path") == path), self.modules)

    def where(self, name: str) -> DataFrame:
        return graph.where(self.declared, name)

    def references(self, name: str, declared_in: str | None = None) -> DataFrame:
        """Every token of the name, judged against the one declaration: a row a token, whatever else has the name."""
        one, named = F.col("addr") == self.target(name, declared_in), F.col("name") == name
        mine = self.aliases.join(self.declared.filter(one).select(F.col("addr").alias("target")).distinct(), "target", "left_semi")
        found = graph.judge(self.family("tokens").filter(named), self.declared.filter(named), self.edges, mine, self.modules, self.declared.filter(one))
        return found.orderBy("reason_ord", "path", "start")

    def impact(self, name: str, declared_in: str | None = None) -> DataFrame:
        at = self.target(name, declared_in)
        starts = self.aliases.filter(F.col("target") == at).select(F.col("alias").alias("addr"))
        return graph.impact(self.edges, self.modules, starts, at.rpartition("::")[0])

    def dead(self) -> DataFrame:
        return graph.dead_scoped(*self.scoped, self.declared)

    def surface(self, package: str | None = None) -> DataFrame:
        return graph.surface(self.declared, self.aliases, self.edges, package)

    def imports(self) -> DataFrame:
        return graph.import_problems(self.edges, self.family("tokens"), self.modules)

    def deps(self, path: str) -> DataFrame:
        return graph.outgoing(self.edges.filter(F.col("path") == path), self.aliases).orderBy("ord")

    def importers(self, addr: str) -> DataFrame:
        one = self.files.sparkSession.createDataFrame([(addr,)], "addr string")
        return graph.importers(self.edges, one)

    def callers(self, name: str, declared_in: str | None = None) -> DataFrame:
        at = self.target(name, declared_in)
        return graph.callers(self.family("calls"), self.family("symbols"), self.scoped[1].filter(F.col("target") == at))

    def callees(self, name: str) -> DataFrame:
        return graph.callees(self.family("calls"), self.family("symbols")).filter(F.col("caller") == name)

    def explain(self, path: str, offset: int) -> DataFrame:
        """The innermost declaration around an offset, its address, reach, aliases and importers, the import there, and the module's address."""
        one = self.files.sparkSession.createDataFrame([(path, offset)], "path string, start int")
        inside = search.enclosing(one, self.family("symbols"))
        at = self.edges.filter((F.col("start") <= offset) & (F.col("end") > offset)).select("path", F.col("raw").alias("import"), F.col("addr").alias("import_addr"))
        decl = self.declared.filter(F.col("path") == path).select("path", F.col("ext_start").alias("in_start"), F.col("addr").alias("declared_addr"), F.col("reach.kind").alias("reach"))
        offered = self.aliases.groupBy(F.col("target").alias("declared_addr")).agg(F.sort_array(F.collect_set(F.when(F.col("alias") != F.col("target"), F.col("alias")))).alias("aliases"))
        used = graph.imported_by(self.declared, self.aliases, self.edges).withColumnRenamed("addr", "declared_addr")
        out = inside.join(decl, ["path", "in_start"], "left").join(offered, "declared_addr", "left").join(used, "declared_addr", "left")
        return out.join(at, "path", "left").join(self.modules.select("path", F.col("addr").alias("module_addr")), "path", "left")

    @cached_property
    def resolutions(self) -> DataFrame:
        """Every token with what it means."""
        defaults, hits = self.scoped
        return settle(navigation.resolved(self.family("tokens"), self.bindings(), hits, self._sites(self.declared), self.family("uncertain"), self.patterns, self.members, defaults))

    def _sites(self, of: DataFrame) -> DataFrame:
        wanted = few(of.select(F.col("addr").alias("target")).distinct())
        mine = self.aliases.join(wanted, "target")
        names = navigation.incoming_names(self.edges, mine, self.declared.join(wanted.withColumnRenamed("target", "addr"), "addr", "left_semi"))
        return navigation.reference_sites(self.family("tokens"), names, self.scoped[1].join(wanted, "target"), self.bindings(), of, self.edges, mine)

    def navigate(self, path: str, offset: int) -> DataFrame:
        """What the token at an offset means: outcome, tier, targets, why. No row where no token is. Only tokens of the file are judged."""
        part = self.over([path])
        token = part.family("tokens").filter((F.col("start") <= offset) & (F.col("end") > offset)).select("path", "start")
        return part.resolutions.join(token, ["path", "start"], "left_semi")

    resolve = navigate

    def relationships(self, name: str, declared_in: str | None = None, max_files: int | None = None, max_items: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(sites, coverage): all references to a declaration under its own name and under names that imports give it, unless a budget is given. All sites are counted; tokens of files that cannot speak of it are not read."""
        wanted = self.declared.filter(F.col("addr") == self.target(name, declared_in))
        paths = settle(navigation.candidate_files(self.edges, self.aliases, wanted, self.modules))
        return navigation.within_budget(settle(self.over(paths)._sites(wanted)), max_files, max_items)

    def related(self, name: str, declared_in: str | None = None, max_files: int = 128, max_items: int = 64, max_lookups: int = 1024) -> tuple[DataFrame, DataFrame]:
        """relationships() in stages: tokens of files that may speak of the declaration are judged by path until a budget is spent, those of no other file."""
        wanted = self.declared.filter(F.col("addr") == self.target(name, declared_in))
        candidates = navigation.candidate_files(self.edges, self.aliases, wanted, self.modules)
        return navigation.staged(lambda paths: self.over(paths)._sites(wanted), candidates, max_files, max_items, max_lookups)

    def over(self, paths: list[str] | DataFrame) -> Part:
        """The workspace as some files of it see it."""
        return Part(self, paths)

    def normalise(self, addr: str, viewer: str) -> DataFrame:
        """Where an address leads, seen from a module."""
        one = self.files.sparkSession.createDataFrame([(0, addr, viewer)], "id long, addr string, viewer string")
        return navigation.normalised(one, self.edges, self.declared)

    @cached_property
    def tree(self) -> DataFrame:
        """The nodes of all files."""
        return settle(structure.tree_nodes(self.files))

    def structural(self, pattern: str, kind: str | None = None, language: str = "rust") -> DataFrame:
        """Nodes that match a pattern, of one kind if one is given."""
        return structure.structural(self.files, self.tree, pattern, language, kind)

    @cached_property
    def patterns(self) -> DataFrame:
        """Every name in a pattern with what it means."""
        return settle(patterns.outcomes(self.family("patterns"), self.family("lexical"), self.family("constructors"), self.edges, self.aliases, self.pattern_targets, self.modules))

    @cached_property
    def pattern_targets(self) -> DataFrame:
        """What a name in a pattern may mean."""
        return settle(patterns.pattern_targets(self.family("symbols"), self.family("constructors"), self.modules))

    @cached_property
    def exports(self) -> DataFrame:
        """What script modules offer, by name."""
        return namespaces.exports(self.declared, self.family("named_imports"), self.edges)

    @cached_property
    def members(self) -> DataFrame:
        """Members of script namespaces with what they mean."""
        return settle(namespaces.member_targets(self.family("members"), self.family("named_imports"), self.edges, self.exports, self.bindings().select("path", "start").distinct()))

    def bindings(self) -> DataFrame:
        lexical = patterns.without_references(self.family("lexical"), self.patterns)
        return graph.visible_bindings(self.family("tokens"), lexical, self.family("uncertain"))


#: Families that are read of all files, as names of any of them may lead there.
SHARED = ("symbols", "constructors")


class Part(Workspace):
    """Some files of a workspace: only their tokens, and what hangs on tokens, are read; the graph is that of the whole."""

    def __init__(self, whole: Workspace, paths: list[str] | DataFrame) -> None:
        super().__init__(whole.files)
        self.whole, self.paths = whole, few(paths.select("path")) if isinstance(paths, DataFrame) else paths

    manifests = property(lambda self: self.whole.manifests)
    modules = property(lambda self: self.whole.modules)
    declared = property(lambda self: self.whole.declared)
    aliases = property(lambda self: self.whole.aliases)
    exports = property(lambda self: self.whole.exports)
    pattern_targets = property(lambda self: self.whole.pattern_targets)

    @cached_property
    def facts(self) -> DataFrame:
        # The files' facts are taken out once, so that the whole is not read again for each family.
        return settle(self._mine(self.whole.facts))

    def family(self, name: str) -> DataFrame:
        return self.whole.family(name) if name in SHARED else super().family(name)

    def _mine(self, rows: DataFrame) -> DataFrame:
        if isinstance(self.paths, DataFrame):
            return rows.join(self.paths, "path", "left_semi")
        return rows.filter(F.col("path").isin(*self.paths))

    @cached_property
    def edges(self) -> DataFrame:
        return settle(self._mine(self.whole.edges))

    @cached_property
    def members(self) -> DataFrame:
        # Whether a name stands for a module is told by the imports of all files.
        return settle(namespaces.member_targets(self.family("members"), self.family("named_imports"), self.whole.edges, self.exports, self.bindings().select("path", "start").distinct()))
