"""Column functions over module paths and addresses. Paths are arrays of segments; prefixes are taken by segment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions probed for an import without one, and index files probed for a folder, in order.
PROBES = ("ts", "tsx", "d.ts", "js", "jsx", "mts", "cts")
INDEXES = ("index.ts", "index.tsx", "index.js")


def path_parse(raw: Column, syntax: str = "scoped") -> Column:
    """struct(head, ups, segments) of a written path: `::` paths, or `/` paths for "posix"."""
    if syntax == "scoped":
        parts = F.split(raw, "::")
        first = F.element_at(parts, 1)
        supers = F.size(F.filter(parts, lambda x: x == "super"))
        head = F.when(first == "", "root").when(first.isin("crate", "Self"), first).when((first == "super") | ((first == "self") & (F.element_at(parts, F.least(F.lit(2), F.size(parts))) == "super")), "super").when(first == "self", "self").otherwise("named")
        drop = F.when(head == "named", 0).when(head == "super", supers + F.when(first == "self", 1).otherwise(0)).otherwise(1)
        return F.struct(head.alias("head"), F.when(head == "super", supers).otherwise(0).alias("ups"), F.slice(parts, drop + 1, F.size(parts)).alias("segments"))
    parts = F.filter(F.split(raw, "/"), lambda x: x != "")
    ups = F.size(F.filter(parts, lambda x: x == ".."))
    head = F.when(raw.startswith("/"), "root").when(raw.startswith(".."), "up").when(raw.startswith("."), "here").when(raw.startswith("@"), "package").otherwise("named")
    return F.struct(head.alias("head"), ups.alias("ups"), F.filter(parts, lambda x: ~x.isin(".", "..")).alias("segments"))


def path_spell(head: Column, ups: Column, segments: Column, syntax: str = "scoped") -> Column:
    """The inverse of path_parse."""
    rest = F.array_join(segments, "::" if syntax == "scoped" else "/")
    if syntax == "scoped":
        lead = F.when(head == "root", "::").when(head == "named", "").when(head == "super", F.repeat(F.lit("super::"), ups)).otherwise(F.concat(head, F.lit("::")))
        full = F.concat(lead, rest)
        return F.when((F.size(segments) == 0) & (head != "named") & (head != "root"), F.substring(full, 1, F.length(full) - 2)).otherwise(full)
    lead = F.when(head == "root", "/").when(head == "here", "./").when(head == "up", F.repeat(F.lit("../"), ups)).otherwise("")
    return F.concat(lead, rest)


def join(address: Column, segments: Column) -> Column:
    return F.concat(address, segments)


def parent(address: Column) -> Column:
    """null at the root."""
    return F.when(F.size(address) > 0, F.slice(address, 1, F.greatest(F.size(address) - 1, F.lit(0))))


def starts_with(address: Column, prefix: Column) -> Column:
    return F.slice(address, 1, F.size(prefix)) == prefix


def strip_prefix(address: Column, prefix: Column) -> Column:
    """The rest after a prefix, else null."""
    return F.when(starts_with(address, prefix), F.slice(address, F.size(prefix) + 1, F.size(address)))


def rebase(address: Column, old: Column, new: Column) -> Column:
    """The address with prefix `old` replaced by `new`, else null."""
    return F.concat(new, strip_prefix(address, old))


def common_ancestor(a: Column, b: Column) -> Column:
    """Longest common prefix."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    n = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda acc, s: F.struct((acc["n"] + F.when(acc["go"] & s, 1).otherwise(0)).alias("n"), (acc["go"] & s).alias("go")))["n"]
    return F.slice(a, 1, n)


def prefixes(address: Column) -> Column:
    """All prefixes, from the root to the address itself: exploded, a prefix join becomes an equi-join."""
    return F.transform(F.sequence(F.lit(0), F.size(address)), lambda n: F.slice(address, 1, n))


def segment_at(segments: Column, offset: Column, separator: int = 2) -> Column:
    """0-based number of the segment that holds a byte offset of the path as written; null between segments and beyond."""
    sizes = F.transform(segments, F.octet_length)
    found = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("hit")),
        lambda acc, n: F.struct((acc["i"] + 1).alias("i"), (acc["at"] + n + separator).alias("at"), F.coalesce(acc["hit"], F.when((offset >= acc["at"]) & (offset < acc["at"] + n), acc["i"])).alias("hit")),
    )
    return found["hit"]


def normalise(path: Column) -> Column:
    """A `/` path without `.`, `..` and empty parts; null if it climbs above its root."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    walked = F.aggregate(
        parts,
        F.struct(F.expr("cast(array() as array<string>)").alias("p"), F.lit(True).alias("ok")),
        lambda acc, x: F.struct(
            F.when(x != "..", F.concat(acc["p"], F.array(x))).otherwise(F.slice(acc["p"], 1, F.greatest(F.size(acc["p"]) - 1, F.lit(0)))).alias("p"),
            (acc["ok"] & ((x != "..") | (F.size(acc["p"]) > 0))).alias("ok"),
        ),
    )
    return F.when(walked["ok"], F.array_join(walked["p"], "/"))


def relative_path(target: Column, folder: Column) -> Column:
    """How a file is written from a folder, both arrays of parts: `./` or `../` and the way down."""
    shared = F.size(common_ancestor(target, folder))
    ups = F.size(folder) - shared
    return F.concat(F.when(ups == 0, F.lit("./")).otherwise(F.repeat(F.lit("../"), ups)), F.array_join(F.slice(target, shared + 1, F.size(target)), "/"))


def known_extension(path: Column) -> Column:
    """A module file's extension, `d.ts` before `ts`; null for others."""
    out = F.when(path.endswith(".d.ts"), "d.ts")
    for e in PROBES:
        out = out.when(path.endswith(f".{e}"), e)
    return out


def probe_candidates(path: Column) -> Column:
    """Files that an import of `path` may mean, best first."""
    swaps = F.when(path.endswith(".js"), F.array(path, F.regexp_replace(path, r"\.js$", ".ts"))).when(path.endswith(".jsx"), F.array(path, F.regexp_replace(path, r"\.jsx$", ".tsx"))).when(path.endswith(".mjs"), F.array(path, F.regexp_replace(path, r"\.mjs$", ".mts"))).when(path.endswith(".cjs"), F.array(path, F.regexp_replace(path, r"\.cjs$", ".cts")))
    added = F.array(*[F.concat(path, F.lit(f".{e}")) for e in PROBES], *[F.concat(path, F.lit(f"/{x}")) for x in INDEXES])
    return swaps.when(known_extension(path).isNotNull(), F.array(path)).otherwise(added)


def language_of(path: Column) -> Column:
    """Language of a file by its extension; null for files that none claims."""
    return F.when(path.endswith(".rs"), "rust").when(path.endswith(".tsx"), "tsx").when(path.rlike(r"\.[mc]?ts$"), "typescript").when(path.endswith(".p"), "fake")
