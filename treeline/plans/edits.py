"""Change plans as tables: edits(path, start, end, replacement, seq) and moves(source, target)."""

from __future__ import annotations

import difflib
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions import paths as P
from treeline.functions import text as T
from treeline.operators import graph
from treeline.session import settle

_NAME = re.compile(r"(\$\$\$|\$)([A-Z_][A-Z0-9_]*)")


def conflicts(edits: DataFrame) -> DataFrame:
    """Edits that overlap an earlier one of their file, or whose span is unordered. Touching spans are no conflict.

    The largest end so far is compared, so an edit inside an earlier long one is found too.
    """
    order = Window.partitionBy("path").orderBy("start", "end", "seq").rowsBetween(Window.unboundedPreceding, -1)
    before = edits.withColumn("before", F.max(F.when(F.col("end") > F.col("start"), F.col("end"))).over(order))
    problem = F.when(F.col("start") > F.col("end"), "unordered").when(F.col("before") > F.col("start"), "overlap")
    return before.withColumn("problem", problem).filter("problem is not null").select("path", "start", "end", "seq", "problem")


def move_conflicts(moves: DataFrame, files: DataFrame) -> DataFrame:
    """Moves of one source twice, to one target twice, or onto a file that stays."""
    twice = moves.groupBy("source").count().filter("count > 1").select(F.col("source").alias("path"), F.lit("moved twice").alias("problem"))
    taken = moves.groupBy("target").count().filter("count > 1").select(F.col("target").alias("path"), F.lit("target twice").alias("problem"))
    stays = files.select("path").join(moves.select(F.col("source").alias("path")), "path", "left_anti")
    onto = moves.select(F.col("target").alias("path")).join(stays, "path", "left_semi").withColumn("problem", F.lit("target exists"))
    return twice.unionByName(taken).unionByName(onto)


def splice(files: DataFrame, edits: DataFrame) -> DataFrame:
    """path and text of every edited file: kept slices and replacements put together in order. JVM only.

    Edits of equal spans keep their seq.
    """
    listed = edits.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "end", "seq", "replacement"))).alias("list"))
    raw = F.encode(F.col("text"), "UTF-8")
    put = F.aggregate(
        "list",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("parts")),
        lambda acc, e: F.struct(e["end"].alias("at"), F.concat(acc["parts"], F.array(F.decode(F.substring(raw, acc["at"] + 1, e["start"] - acc["at"]), "UTF-8"), e["replacement"])).alias("parts")),
    )
    done = files.select("path", "text").join(listed, "path").withColumn("put", put)
    tail = F.decode(F.substring(raw, F.col("put.at") + 1, F.octet_length("text")), "UTF-8")
    return done.select("path", F.array_join(F.concat("put.parts", F.array(tail)), "").alias("text"))


def after(files: DataFrame, edits: DataFrame, moves: DataFrame | None = None) -> DataFrame:
    """The tree after a plan: edited texts, moved paths."""
    changed = files.select("path", "text").join(splice(files, edits).withColumnRenamed("text", "new"), "path", "left").select("path", F.coalesce("new", "text").alias("text"))
    if moves is None:
        return changed
    return changed.join(moves.withColumnRenamed("source", "path"), "path", "left").select(F.coalesce("target", "path").alias("path"), "text")


def preview(before: DataFrame, changed: DataFrame, context: int = 3) -> DataFrame:
    """path and unified diff of every file that differs."""

    def diff(path: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["".join(difflib.unified_diff((x or "").splitlines(True), (y or "").splitlines(True), f"a/{p}", f"b/{p}", n=context)) for p, x, y in zip(path, a, b, strict=True)])

    both = before.select("path", F.col("text").alias("a")).join(changed.select("path", F.col("text").alias("b")), "path").filter("a <> b")
    return both.select("path", F.pandas_udf(diff, "string")("path", "a", "b").alias("diff")).orderBy("path")


def rename(occurrences: DataFrame, new_name: str, ambiguous: bool, chosen: DataFrame | None = None) -> DataFrame:
    """Edits of a rename. By default resolved tokens, and unresolved ones if no other declaration could be meant."""
    picked = occurrences.join(chosen, ["path", "start"], "left_semi") if chosen is not None else occurrences.filter((F.col("confidence") == "resolved") | (F.lit(not ambiguous) & (F.col("confidence") == "unresolved")))
    return picked.select("path", "start", "end", F.lit(new_name).alias("replacement"), F.lit(0).alias("seq"))


def template_names(template: str) -> list[str]:
    return sorted({m[2] for m in _NAME.finditer(template)})


def captured(captures: Column, name: str) -> Column:
    """What a match captured under a name, null if nothing."""
    return F.try_element_at(captures, F.lit(name))


def expand(template: str, captures: Column) -> Column:
    """The template with $NAME and $$$NAME replaced from a map of captures, as JVM expressions."""
    parts, at = [], 0
    for m in _NAME.finditer(template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(captured(captures, m[2]), F.raise_error(F.lit(f"the pattern captures no {m[2]}")))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def rewrite(matches: DataFrame, template: str) -> DataFrame:
    """Edits of a rewrite: matches(path, start, end, captures) with their template filled in."""
    return matches.select("path", "start", "end", expand(template, F.col("captures")).alias("replacement"), F.lit(0).alias("seq"))


def pattern_matches(files: DataFrame, pattern: str) -> DataFrame:
    """Structural matches of a token pattern: path, start, end, captures.

    $X stands for one lexeme or one bracketed group, $$$X for any run inside the same brackets,
    $_ for anything without capture; all else must be equal lexeme by lexeme.
    """
    from treeline.lang import rust, typescript

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        want = {"rust": _pattern(rust.lex, pattern), "typescript": _pattern(typescript.lex, pattern)}
        for frame in frames:
            rows = []
            for path, language, text in zip(frame["path"], frame["language"], frame["text"], strict=True):
                kind = "rust" if language == "rust" else "typescript"
                lex = rust.lex if kind == "rust" else typescript.lex
                raw = text.encode().decode("latin-1")
                rows += [(path, a, b, c) for a, b, c in _matches(raw, [x for x in lex(raw) if x.kind != "comment"], want[kind])]
            yield pd.DataFrame(rows, columns=["path", "start", "end", "captures"])

    literal = files
    for w in T.pattern_words(pattern):
        literal = literal.filter(T.whole_word(F.col("text"), w))
    return literal.filter("language is not null").select("path", "language", "text").mapInPandas(run, "path string, start int, end int, captures map<string,string>")


def _pattern(lex, pattern: str) -> list[str]:  # noqa: ANN001
    out: list[str] = []
    at = 0
    for m in _NAME.finditer(pattern):
        out += [x.text for x in lex(pattern[at : m.start()])] + [m[0]]
        at = m.end()
    return out + [x.text for x in lex(pattern[at:])]


def _matches(raw: str, lexemes: list, want: list[str]) -> Iterator[tuple[int, int, dict[str, str]]]:
    from treeline.lang.model import brackets, named

    pair = brackets(lexemes)

    def fit(i: int, k: int, got: dict[str, str], limit: int) -> tuple[int, dict[str, str]] | None:
        if k == len(want):
            return i, got
        w = want[k]
        if m := _NAME.fullmatch(w):
            if m[1] == "$$$":
                stop = i
                while True:
                    text = named(raw[lexemes[i].start : lexemes[stop - 1].end]) if stop > i else ""
                    if got.get(m[2], text) == text and (done := fit(stop, k + 1, got | {m[2]: text}, limit)):
                        return done
                    if stop >= limit or lexemes[stop].text in (")", "]", "}"):
                        return None
                    stop = pair[stop] + 1 if lexemes[stop].text in ("(", "[", "{") and pair[stop] > stop else stop + 1
            if i >= limit or lexemes[i].text in (")", "]", "}"):
                return None
            end = pair[i] if lexemes[i].text in ("(", "[", "{") and pair[i] > i else i
            text = named(raw[lexemes[i].start : lexemes[end].end])
            if m[2] != "_" and got.get(m[2], text) != text:
                return None
            return fit(end + 1, k + 1, got if m[2] == "_" else got | {m[2]: text}, limit)
        return fit(i + 1, k + 1, got, limit) if i < limit and lexemes[i].text == w else None

    i = 0
    while i < len(lexemes):
        found = fit(i, 0, {}, len(lexemes))
        if found and found[0] > i:
            yield lexemes[i].start, lexemes[found[0] - 1].end, found[1]
            i = found[0]
        else:
            i += 1


def rebased(edge: DataFrame, old: list[str], new: list[str], package: str) -> DataFrame:
    """Imports below an old address with their new address: path, ord, start, end, raw, apath."""
    arr = lambda x: F.array(*[F.lit(s) for s in x]) if x else F.expr("cast(array() as array<string>)")
    moved = P.rebase(F.col("apath"), arr(old), arr(new))
    return edge.filter(F.col("package") == package).withColumn("to", moved).filter("to is not null").select("path", "ord", "start", "end", "raw", "head", "ups", "from_addr", "glob", "alias", "grouped", F.col("to").alias("apath"))


def render(head: Column, package: Column, apath: Column, own_package: Column, mpath: Column, known_as: Column | None = None) -> Column:
    """A Rust path for an address in the style it had: super and self where they still reach, crate inside the package, else the package as the importer knows it."""
    ups = F.size(mpath) - F.size(P.common_ancestor(apath, mpath))
    within = own_package == package
    by_super = F.when(within & (head == "super") & (ups >= 1) & (F.size(P.common_ancestor(apath, mpath)) + ups == F.size(mpath)), F.concat(F.repeat(F.lit("super::"), ups), F.array_join(F.slice(apath, F.size(mpath) - ups + 1, F.size(apath)), "::")))
    by_self = F.when(within & (head == "self") & P.starts_with(apath, mpath), F.concat(F.lit("self::"), F.array_join(P.strip_prefix(apath, mpath), "::")))
    return F.coalesce(by_super, by_self, F.when(within, F.concat_ws("::", F.lit("crate"), apath)), F.concat_ws("::", package if known_as is None else known_as, apath))


def move_module(edge: DataFrame, mods: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edits, moves, notices) for moving a module file: imports below it are respelled; entries of groups become notices."""
    old, new, package = _addresses(mods, source, target)
    hit = rebased(edge.filter("not is_prefix"), old, new, package).join(mods.select("path", F.col("package").alias("own"), "mpath"), "path")
    edits, notices = respelled(hit, package)
    return edits, edge.sparkSession.createDataFrame([(source, target)], "source string, target string"), notices


def _addresses(mods: DataFrame, source: str, target: str) -> tuple[list[str], list[str], str]:
    """The module paths of a file before and after a move, and its package."""
    at = mods.filter((F.col("path") == source) & (F.col("language") == "rust")).select("package", "mpath").first()
    if at is None:
        raise LookupError(f"not a module: {source}")
    inside = re.sub(r"^.*?/?src/|\.rs$", "", target).split("/")
    return list(at["mpath"]), inside[:-1] if inside[-1] == "mod" else inside, at["package"]


def specifier(raw: str, file: str, target: str) -> str:
    """How a script file names another one, relative, in the style of `raw`: an extension stays as it was written, a folder stays for its index."""
    ending, own = (next((e for e in ("d.ts", *P.PROBES) if name.endswith(f".{e}")), None) for name in (raw, target))
    stem = target.removesuffix(f".{own}") if own else target
    if own and ending:
        stem += f".{ending}"
    elif own and posixpath.basename(stem) == "index" and posixpath.basename(raw) != "index":
        stem = posixpath.dirname(stem)
    found = posixpath.relpath(f"/{stem}", f"/{posixpath.dirname(file)}")
    return found if found.startswith(".") and (found in (".", "..") or found.startswith(("../", "./"))) else f"./{found}"


def _respecified(raw: Column, file: Column, target: Column) -> Column:
    """specifier() for the few imports that a move touches."""
    def run(raws: pd.Series, files: pd.Series, targets: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or f is None else specifier(r, f, t) for r, f, t in zip(raws, files, targets, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(raw, file, target)


def move_scripts(ws, moves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: ANN001 - a Workspace
    """(edits, moves, notices) for moving script files as a set, moves(source, target): every relative specifier of a moved file or to one is written anew, in its style.

    Specifiers that name no file of the workspace keep the place they point at; paths by alias or package are left, with a
    notice if a moved file is named so. A taken target or a change of language is an error.
    """
    files = ws.files.select("path", "language", "text")
    if not move_conflicts(moves, files.select("path", "text")).isEmpty():
        raise ValueError("the target is taken")
    moved = moves.withColumns({"from_ext": P.known_extension(F.col("source")), "to_ext": P.known_extension(F.col("target"))})
    if not moved.filter("to_ext is null or from_ext <> to_ext").isEmpty():
        raise ValueError("a script module stays a script of its kind")
    edge = ws.edges.filter("language in ('typescript', 'tsx')")
    own = moves.select(F.col("source").alias("path"), F.col("target").alias("now_at"))
    there = moves.select(F.col("source").alias("addr"), F.col("target").alias("now_named"))
    hit = edge.join(own, "path", "left").join(there, "addr", "left").filter("now_at is not null or now_named is not null")
    relative = hit.filter("head in ('here', 'up')")
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    loose = P.normalise(F.concat_ws("/", folder, F.col("raw")))  # what is no file of the workspace
    named = F.coalesce("now_named", "addr")
    relative = settle(relative.withColumn("now", _respecified(F.col("raw"), F.coalesce("now_at", "path"), F.coalesce(named, loose))))
    edits = relative.withColumnRenamed("now", "replacement").filter("replacement <> raw").groupBy("path", "start", "end", "replacement").agg(F.min("ord").alias("seq"))
    left = relative.filter("now is null").unionByName(hit.filter("head not in ('here', 'up') and now_named is not null").withColumn("now", F.lit(None).cast("string")))
    return edits.select("path", "start", "end", "replacement", "seq"), moves, left.select("path", "start", F.lit("unrewritable import").alias("kind"), "raw").distinct()


def move_file(ws, source: str, target: str) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: ANN001 - a Workspace
    """(edits, moves, notices) for moving a module so that the tree still builds: a script file, or a Rust module with its folder.

    A Rust module moves inside its package; another package, a target that is no module or another language is an error.

    Every import and path below the old address is respelled, an entry of a group is taken out of it and
    stands as a statement of its own after it; what the moved files reach by `super` outside them is
    spelled from the crate; the `mod` line goes from the old parent to the new one, in place if they are one, and
    is widened if a user lies outside the new parent. Without a new parent the line stays and a notice says so.
    """
    mods, files, edge = ws.modules, ws.files.select("path", "text"), ws.edges
    spark = files.sparkSession
    language = ws.files.filter(F.col("path") == source).select("language").first()
    if language and language["language"] in ("typescript", "tsx"):
        return move_scripts(ws, spark.createDataFrame([(source, target)], "source string, target string"))
    old, new, package = _addresses(mods, source, target)
    at = graph.modules(spark.createDataFrame([(target, "rust")], "path string, language string"), ws.packages).select("package").first() if target.endswith(".rs") else None
    if at is None:
        raise ValueError("the target is no module of a package")
    if at["package"] != package:
        raise ValueError("a module moves inside its package")
    if not old or not new:
        raise ValueError("the root of a package cannot be moved")
    folder = lambda p: re.sub(r"/mod\.rs$|\.rs$", "", p) + "/"
    below = files.filter(F.col("path").startswith(folder(source)) & (F.col("path") != source)).select("path")
    inside = F.concat(F.lit(folder(target)), F.expr(f"substring(path, {len(folder(source)) + 1})"))
    moves = spark.createDataFrame([(source, target)], "source string, target string").unionByName(below.select(F.col("path").alias("source"), inside.alias("target")))
    if not move_conflicts(moves, files).isEmpty():
        raise ValueError("the target is taken")

    hit = rebased(edge.filter("not is_prefix"), old, new, package).join(mods.select("path", F.col("package").alias("own"), "mpath"), "path")
    known = ws.dependencies.filter(F.col("dep_name") == package).groupBy(F.col("package").alias("own")).agg(F.min("used_as").alias("known_as"))
    hit = hit.join(known, "own", "left").withColumn("known_as", F.coalesce("known_as", F.lit(package)))
    changes, _ = respelled(hit, package)
    out = _regrouped(hit, edge, files, package)
    own = edge.filter("head = 'super' and not is_prefix and not grouped and addr is not null").join(moves.select(F.col("source").alias("path")), "path", "left_semi")
    outside = own.filter(~P.starts_with(F.col("apath"), F.array(*[F.lit(x) for x in old])))
    changes = changes.unionByName(out).unionByName(outside.select("path", "start", "end", F.concat_ws("::", F.lit("crate"), "apath").alias("replacement"), F.col("ord").alias("seq")))

    parents = {tuple(r["mpath"]): r["path"] for r in mods.filter((F.col("package") == package) & F.array_join("mpath", "::").isin("::".join(old[:-1]), "::".join(new[:-1]))).select("mpath", "path").collect()}
    line = ws.family("symbols").filter((F.col("path") == parents.get(tuple(old[:-1]))) & (F.col("kind") == "module") & (F.col("name") == old[-1]) & (F.col("depth") == 0)).select("name_start", "name_end", "start", "ext_start", "ext_end", "modifier").first()
    lines: list[tuple] = []
    notices: list[tuple] = []
    if tuple(new[:-1]) not in parents or line is None:
        notices.append((target, 0, "no parent module" if line else "no mod line", "::".join(["crate", *new])))
    elif old[:-1] == new[:-1]:
        lines.append((parents[tuple(old[:-1])], line["name_start"], line["name_end"], new[-1], 0))
    else:
        home, away = parents[tuple(old[:-1])], parents[tuple(new[:-1])]
        texts = {r["path"]: r["text"].encode() for r in files.filter(F.col("path").isin(home, away)).collect()}
        end = line["ext_end"] + texts[home][line["ext_end"] : line["ext_end"] + 1].count(b"\n")
        lines.append((home, line["ext_start"], end, "", 0))
        modifier = line["modifier"]
        if modifier != "pub":
            far = hit.filter(~P.starts_with(F.col("mpath"), F.array(*[F.lit(x) for x in new[:-1]]) if new[:-1] else F.expr("cast(array() as array<string>)")))
            modifier = modifier if far.isEmpty() else "pub(crate)"
        last = ws.family("symbols").filter((F.col("path") == away) & (F.col("kind") == "module") & (F.col("depth") == 0) & (F.col("name") != old[-1])).agg(F.max("ext_end")).first()[0] or 0
        last += texts[away][last : last + 1].count(b"\n") if last else 0
        lines.append((away, last, last, f"{modifier + ' ' if modifier else ''}mod {new[-1]};\n", 1))
    changes = changes.unionByName(spark.createDataFrame(lines, "path string, start int, end int, replacement string, seq int"))
    return changes, moves, spark.createDataFrame(notices, "path string, start int, kind string, raw string")


def _regrouped(hit: DataFrame, edge: DataFrame, files: DataFrame, package: str) -> DataFrame:
    """Edits that take entries out of their groups: the entry goes with its alias and the comma after it, a statement with its new path comes after the group's."""
    return ungrouped(hit.withColumn("now", render(F.col("head"), F.lit(package), F.col("apath"), F.col("own"), F.col("mpath"), F.col("known_as"))).filter("grouped"), edge, files)


def ungrouped(spelled: DataFrame, edge: DataFrame, files: DataFrame) -> DataFrame:
    """The same for entries(path, ord, start, end, glob, alias, now) whose new path is known."""
    whole = edge.select("path", "ord", "stmt_start", "stmt_end")
    at = spelled.join(whole, ["path", "ord"]).join(files, "path").withColumn("raw_text", F.encode("text", "UTF-8"))
    rest = T.byte_slice(F.col("text"), F.col("end"), F.col("stmt_end") - F.col("end"))
    tail = F.regexp_extract(rest, r"^(?:\s*::\s*\*)?(?:\s+as\s+[A-Za-z_][A-Za-z0-9_]*)?\s*(?:,\s*)?", 0)
    head = F.regexp_extract(T.byte_slice(F.col("text"), F.col("stmt_start"), F.col("stmt_end") - F.col("stmt_start")), r"^(?:pub(?:\([^)]*\))?\s+)?use", 0)
    line = F.concat(F.lit("\n"), head, F.lit(" "), F.col("now"), F.when(F.col("glob"), F.lit("::*")).otherwise(""), F.coalesce(F.concat(F.lit(" as "), F.col("alias")), F.lit("")), F.lit(";"))
    cut = at.select("path", "start", (F.col("end") + F.octet_length(tail)).cast("int").alias("end"), F.lit("").alias("replacement"), F.col("ord").alias("seq"))
    ends = F.col("stmt_end") + F.when(T.byte_slice(F.col("text"), F.col("stmt_end"), F.lit(1)) == ";", 1).otherwise(0)
    return cut.unionByName(at.select("path", ends.cast("int").alias("start"), ends.cast("int").alias("end"), line.alias("replacement"), F.col("ord").alias("seq")))


def respelled(hit: DataFrame, package: str) -> tuple[DataFrame, DataFrame]:
    """(edits, notices) for imports of rebased() with own and mpath of their module: entries of groups become notices."""
    known_as = F.col("known_as") if "known_as" in hit.columns else None
    spelled = hit.withColumn("replacement", render(F.col("head"), F.lit(package), F.col("apath"), F.col("own"), F.col("mpath"), known_as))
    edits = spelled.filter("not grouped and replacement <> raw").select("path", "start", "end", "replacement", F.col("ord").alias("seq"))
    return edits, spelled.filter("grouped").select("path", "start", F.lit("unrewritable import").alias("kind"), "raw")


def widened(kind: Column, path: Column) -> Column:
    """The modifier for a reach; everyone is never inferred and gives null."""
    return F.when(kind == "package", "pub(crate)").when((kind == "within") & (F.size(path) == 0), "pub(crate)").when(kind == "within", F.concat(F.lit("pub(in crate::"), F.array_join(path, "::"), F.lit(")")))


def review(edits: DataFrame, notices: DataFrame | None = None) -> DataFrame:
    """One row: edits, files, bytes removed and added, notices."""
    out = edits.agg(F.count("*").alias("edits"), F.countDistinct("path").alias("files"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("removed"), F.coalesce(F.sum(F.octet_length("replacement")), F.lit(0)).alias("added"))
    count = notices.count() if notices is not None else 0
    return out.withColumn("notices", F.lit(count))
