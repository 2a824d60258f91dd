"""Search: literal prefilter, tokens, declarations, roles, positions, order, pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions import text as T
from treeline.session import few, settle

ROLES = ("declaration", "import", "use")
_PIECE = np.array([1 if chr(c).isalpha() and c < 128 or c == 95 else 2 if 48 <= c < 58 else 0 for c in range(256)], np.uint8)


def with_literals(files: DataFrame, words: list[str]) -> DataFrame:
    """Files that hold every word whole; run before any parser."""
    for w in words:
        files = files.filter(T.whole_word(F.col("text"), w))
    return files


#: Bytes of text whose identifiers make one batch of rows.
TEXT_BYTES = 1 << 18


def _identifiers_of(raw: pa.Buffer) -> tuple[np.ndarray, ...] | None:
    """(bytes of all identifiers, lengths, starts, lines, columns) of a text."""
    data = np.frombuffer(raw, np.uint8)
    kind = _PIECE[data]
    word = kind > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    keep = kind[starts] == 1
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return None
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, starts)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    first = np.concatenate(([0], breaks + 1))[line]
    return data[np.cumsum(inside[:-1]) > 0], ends - starts, starts, line, chars[starts] - chars[first]


def identifiers(files: DataFrame, fresh: bool = False) -> DataFrame:
    """path, ord, name, start, end, line, col of every ASCII identifier of any text. No shuffle: a file is read in its task, names are cut without a loop over them, and no text becomes an object of Python.

    fresh adds a column of that name: whether the file's text holds the name here for the first time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            paths = pa.array([p for p, _ in held], pa.string()).take(pa.array(np.repeat(np.arange(len(held)), [len(x[1]) for _, x in held])))
            raw, lengths, starts, lines, cols = (np.concatenate([x[k] for _, x in held]) for k in range(5))
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            names = pa.Array.from_buffers(pa.string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
            order = np.concatenate([np.arange(len(x[1])) for _, x in held])
            numbers = (order, starts, starts + lengths, lines, cols)
            number, start, end, line, col = (pa.array(x.astype(np.int32)) for x in numbers)
            columns = [paths, number, names, start, end, line, col]
            if fresh:
                code = names.dictionary_encode().indices.to_numpy().astype(np.int64)
                first = np.zeros(len(code), bool)
                first[np.unique(np.repeat(np.arange(len(held)), [len(x[1]) for _, x in held]) * len(code) + code, return_index=True)[1]] = True
                columns.append(pa.array(first))
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["path", "ord", "name", "start", "end", "line", "col", *(["fresh"] if fresh else [])])

        for batch in batches:
            for path, text in zip(batch.column("path"), batch.column("text"), strict=True):
                raw = text.as_buffer() if text.is_valid else None
                if raw is not None and raw.size and (found := _identifiers_of(raw)) is not None:
                    held.append((path.as_py(), found))
                    size += raw.size
                if size >= TEXT_BYTES:
                    yield out()
                    size = 0
        if held:
            yield out()

    return files.select(F.col("path").cast("string").alias("path"), "text").mapInArrow(run, "path string, ord int, name string, start int, end int, line int, col int" + (", fresh boolean" if fresh else ""))


def word_counts(files: DataFrame) -> DataFrame:
    """path, n, starts, ends, names: identifiers of each path, sums of their places, and distinct names. Names of one text are told apart in its task; only those of paths with several texts are shuffled."""
    sums = [F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends")]
    again = few(files.groupBy("path").agg(F.count("*").alias("texts")).filter("texts > 1").select("path"))
    once_only = identifiers(files.join(again, "path", "left_anti"), fresh=True).groupBy("path").agg(*sums, F.count_if("fresh").alias("names"))
    return once_only.unionByName(identifiers(files.join(again, "path", "left_semi")).groupBy("path").agg(*sums, F.countDistinct("name").alias("names")))


def named(tokens: DataFrame, name: str) -> DataFrame:
    """Bare-name search: every identifier with this spelling."""
    return tokens.filter(F.col("name") == name)


def declarations(symbols: DataFrame, kind: str | None = None, name: str | None = None) -> DataFrame:
    """Declaration search; `impl` blocks are shown only when asked for."""
    out = symbols.filter(F.col("kind") == kind) if kind else symbols.filter("kind <> 'impl'")
    return out.filter(F.col("name") == name) if name else out


def attach(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds symbol_kind: the declaration whose name is exactly the hit."""
    at = symbols.select("path", F.col("name_start").alias("start"), F.col("name_end").alias("end"), F.col("kind").alias("symbol_kind")).filter("symbol_kind <> 'impl'")
    return hits.join(at, ["path", "start", "end"], "left")


def roles(hits: DataFrame, statements: DataFrame) -> DataFrame:
    """Adds role to hits with symbol_kind: declaration, else import inside a statement(path, stmt_start, stmt_end), else use.

    A hit is inside a statement if one that begins at or before it reaches its end: a running maximum
    over hits and statements in order of place, so hits are computed once and no pairs are made.
    """
    spans = statements.select("path", F.col("stmt_start").alias("start"), F.col("stmt_end").alias("__reach")).filter("start is not null")
    both = hits.withColumn("__reach", F.lit(None).cast("int")).withColumn("__hit", F.lit(1)).unionByName(spans.withColumn("__hit", F.lit(0)), allowMissingColumns=True)
    so_far = F.max("__reach").over(Window.partitionBy("path").orderBy("start", "__hit").rowsBetween(Window.unboundedPreceding, 0))
    role = F.when(F.col("symbol_kind").isNotNull(), "declaration").when(so_far >= F.col("end"), "import").otherwise("use")
    return both.withColumn("role", role).filter("__hit = 1").drop("__reach", "__hit")


def in_scope(paths: list[str] | None = None, packages: list[str] | None = None) -> Column:
    """Rows under any of the paths and in any of the packages. Paths match by whole parts."""
    keep = F.lit(True)
    if paths is not None:
        for p in paths:
            if ".." in p.split("/") or "\\" in p or ":" in p:
                raise ValueError(f"not a workspace path: {p}")
        keep = F.lit(False)
        for p in paths:
            keep = keep | (F.col("path") == p.rstrip("/")) | F.col("path").startswith(p.rstrip("/") + "/")
    return keep & F.col("package").isin(*packages) if packages is not None else keep


def locate(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Adds line, col, line_text and id to hits(path, start, end, name). Tokens bring line and col and need the line's text alone."""
    text, named_so = F.col("text"), T.match_id(F.col("path"), F.col("start"), F.col("end"), F.col("name"))
    if {"line", "col"} <= set(hits.columns):
        rows = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "line_text"))
        return hits.join(rows, ["path", "line"]).withColumn("id", named_so)
    line = T.line_of(text, F.col("start"))
    out = hits.drop("line", "col").join(files.select("path", "text"), "path")
    return out.withColumns({"line": line, "col": T.column_of(text, F.col("start")), "line_text": F.element_at(F.split(text, "\n"), line + 1), "id": named_so}).drop("text")


def numbered(hits: DataFrame) -> DataFrame:
    """Adds the 1-based ordinal of the search order: declarations, then path, then position.

    The hits are written once and dealt into ranges of that order; rows are counted inside a range and offset by
    the counts of the ranges before it, so no task sees all rows, not even all rows of one path.
    """
    keys = ["rank", "path", "start", "end"]
    keyed = settle(hits.withColumn("rank", F.when(F.col("role") == "declaration", 0).otherwise(1)))
    ranged = settle(keyed.repartitionByRange(*keys).withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))  # a row a range: as many as shuffle partitions
    base = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*keys))
    return ranged.withColumn("inside", inside).join(F.broadcast(base), "range").withColumn("ordinal", (F.col("base") + F.col("inside")).cast("long")).drop("inside", "base", "rank", "range")


def summary(hits: DataFrame) -> DataFrame:
    """One row: declarations, uses, files."""
    return hits.agg(F.count_if(F.col("role") == "declaration").alias("declarations"), F.count_if(F.col("role") != "declaration").alias("uses"), F.countDistinct("path").alias("files"))


def by_file(hits: DataFrame) -> DataFrame:
    """Hits of each file in order: path, n, starts."""
    return hits.groupBy("path").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("start")).alias("starts")).orderBy("path")


#: Bytes of a stretch of a file: a span is listed at each stretch that it touches, a hit asks the list of its own.
STRETCH = 1024


def _listed(spans: DataFrame, start: str, end: str, fields: dict[str, Column]) -> DataFrame:
    """path, stretch, held: the spans that touch each stretch of a file."""
    touched = F.sequence(F.floor(F.col(start) / STRETCH), F.floor(F.greatest(F.col(end) - 1, F.col(start)) / STRETCH))
    rows = spans.select("path", F.explode(touched).alias("stretch"), F.struct(*[c.alias(k) for k, c in fields.items()]).alias("s"))
    return rows.groupBy("path", "stretch").agg(F.collect_list("s").alias("held"))


def enclosing(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds the innermost declaration whose extent holds the hit: kind, name and start, null at top level."""
    fields = {"size": F.col("ext_end") - F.col("ext_start"), "back": -F.col("ext_start"), "kind": F.col("kind"), "name": F.col("name"), "end": F.col("ext_end")}
    at = _listed(symbols, "ext_start", "ext_end", fields)
    around = F.filter("held", lambda s: (-s["back"] <= F.col("start")) & (F.col("start") < s["end"]))
    best = F.array_min(around)
    out = hits.withColumn("stretch", F.floor(F.col("start") / STRETCH)).join(at, ["path", "stretch"], "left").withColumn("in", best)
    return out.withColumns({"in_kind": F.col("in.kind"), "in_name": F.col("in.name"), "in_start": -F.col("in.back")}).drop("stretch", "held", "in")


def depths(spans: DataFrame) -> DataFrame:
    """Adds depth: how many other spans of the file hold the span(path, start, end)."""
    at = _listed(spans, "start", "end", {"s": F.col("start"), "e": F.col("end")})
    around = F.filter("held", lambda x: (x["s"] <= F.col("start")) & (F.col("end") <= x["e"]) & ((x["s"] != F.col("start")) | (x["e"] != F.col("end"))))
    out = spans.withColumn("stretch", F.floor(F.col("start") / STRETCH)).join(at, ["path", "stretch"], "left")
    return out.withColumn("depth", F.coalesce(F.size(around), F.lit(0)).cast("long")).drop("stretch", "held")


def names_in(tokens: DataFrame, extents: DataFrame) -> DataFrame:
    """path, names: distinct names of the tokens inside an extent(path, start, end) of each file."""
    at = extents.select("path", F.col("start").alias("from"), F.col("end").alias("to"))
    return tokens.join(at, "path").filter((F.col("start") >= F.col("from")) & (F.col("end") <= F.col("to"))).groupBy("path").agg(F.countDistinct("name").alias("names"))


def find_in_file(files: DataFrame, needle: str) -> DataFrame:
    """path and byte start of every exact occurrence, overlaps left out. Files without it never leave the JVM."""
    if not needle:
        raise ValueError("an empty text is found nowhere")
    sought = needle.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw, found = text.encode(), []
                at = raw.find(sought)
                while at >= 0:
                    found.append(at)
                    at = raw.find(sought, at + len(sought))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array(found, pa.int32())], ["path", "start"])

    return files.filter(F.col("text").contains(needle)).select(F.col("path").cast("string").alias("path"), "text").mapInArrow(run, "path string, start int")


def bounded(rows: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """rows, if their serialised size is at most `most_bytes`; else an error, before any of them is brought anywhere."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*rows.columns)))), F.lit(0))).first()[0]
    if size > most_bytes:
        raise OverflowError(f"the answer holds {size} bytes, more than {most_bytes}; narrow the search")
    return rows


def holding(matches: DataFrame, symbols: DataFrame, kind: str | None = None, name: str | None = None) -> DataFrame:
    """Structural matches that hold the name of a declaration of the kind and name: structural and symbolic at once."""
    wanted = declarations(symbols, kind, name).select("path", F.col("name_start").alias("at")).distinct()
    rest = [c for c in matches.columns if c != "captures"]
    held = matches.select(*rest).join(wanted, "path").filter((F.col("start") <= F.col("at")) & (F.col("at") < F.col("end"))).select("path", "start", "end").distinct()
    return matches.join(held, ["path", "start", "end"], "left_semi")


def language_report(files: DataFrame, accepted: list[str]) -> DataFrame:
    """Files of each language, and whether a search leaves them out: language null stands for files that none claims."""
    taken = F.coalesce(F.col("language").isin(*accepted), F.lit(False))
    return files.groupBy("language").agg(F.count("*").alias("files")).withColumn("skipped", ~taken)


def across(parts: dict[str, DataFrame]) -> DataFrame:
    """The union of what each language finds, with the language; columns are matched by name."""
    out = None
    for language, found in parts.items():
        one = found.withColumn("language", F.lit(language))
        out = one if out is None else out.unionByName(one)
    return out


def narrowed(files: DataFrame, *scopes: Column) -> DataFrame:
    """Files that lie in every scope."""
    for scope in scopes:
        files = files.filter(scope)
    return files


def except_known(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """rows without those whose keys are known already, such as an own name, an own path, a module that was seen."""
    return rows.join(known.select(*keys), keys, "left_anti")


def once(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first in order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first")).select(*keys, *[f"first.{c}" for c in rest])


def selected(hits: DataFrame, ids: list[str] | None = None, ordinals: list[int] | None = None) -> DataFrame:
    """The chosen hits; a choice that does not exist is an error, never dropped."""
    if ids and ordinals:
        raise ValueError("ids and ordinals cannot be mixed")
    if ids is None and ordinals is None:
        return hits
    column, wanted = ("id", ids) if ids is not None else ("ordinal", ordinals)
    out = hits.filter(F.col(column).isin(*wanted))
    found = {r[0] for r in out.select(column).distinct().collect()}  # at most the choices given
    if missing := [w for w in wanted if w not in found]:
        raise LookupError(f"no such match: {missing}")
    return out


def parse_choice(text: str) -> list[int]:
    """`3,27-33` as ordinals."""
    out: list[int] = []
    for part in text.split(","):
        a, _, b = part.partition("-")
        out += range(int(a), int(b or a) + 1)
    return out


def parse_bar(text: str) -> dict[str, str]:
    """`symbol: kind: name: lang:` words and the rest, the pattern."""
    out, rest = {}, []
    for word in text.split():
        key, colon, value = word.partition(":")
        if colon and key in ("symbol", "kind", "name", "lang") and value:
            out[key] = value
        else:
            rest.append(word)
    return out | ({"pattern": " ".join(rest)} if rest else {})


def page(rows: DataFrame, after: int = 0, max_items: int = 20, max_bytes: int = 16384) -> DataFrame:
    """Rows with an ordinal after `after`, as many as the limits of items and of serialised bytes let in.

    Only max_items rows can be on a page, so the running size is taken over that many.
    """
    first = rows.filter(F.col("ordinal") > after).orderBy("ordinal").limit(max_items)
    size = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)])))
    w = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("page_bytes", F.sum(size).over(w)).filter(F.col("page_bytes") <= max_bytes)


def fuzzy_score(path: str, terms: list[str]) -> int | None:
    """Score of a path for terms that must all match as subsequences, letter case aside; null if one does not."""
    low, total = path.lower(), 0
    name = low.rfind("/") + 1
    for term in (t.lower() for t in terms):
        best: dict[int, int] = {}
        for k, c in enumerate(term):
            now: dict[int, int] = {}
            top = None  # best score of a place before the one at hand, less its gap
            for i, x in enumerate(low):
                if top is not None:
                    top -= 2
                if k and i - 1 in best and (top is None or best[i - 1] > top):
                    top = best[i - 1]
                if x == c and (not k or top is not None):
                    gain = 10 + (12 if i == 0 or low[i - 1] in "/_-. " else 0) + (12 if i >= name else 0)
                    if not k:
                        now[i] = gain - min(i, 30)
                    else:
                        join = best[i - 1] + 16 if i - 1 in best else None
                        now[i] = gain + max(x for x in (top, join) if x is not None)
            best = now
            if not best:
                return None
        total += max(best.values())
    return total


def fuzzy_rank(paths: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """The best paths for a query of one or more terms. Paths that do not hold every term's characters in order are left out before any is scored."""
    terms = query.split()
    for term in terms:
        paths = paths.filter(F.lower("path").rlike("(?s)" + ".*".join(re.escape(c) for c in term.lower())))
    scored = F.pandas_udf(lambda p: pd.Series([fuzzy_score(x, terms) for x in p], dtype="Int64"), "long")
    return paths.withColumn("score", scored("path")).filter("score is not null").orderBy(F.desc("score"), "path").limit(limit)
