"""Source trees as tables: scans, overlays, stamps, manifests, facts, snapshots."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import text as T
from treeline.functions.paths import language_of
from treeline.lang import fake, rust, typescript
from treeline.lang.model import FACTS
from treeline.session import settle
from treeline.sources import listing

PARSERS = {"rust": rust.facts, "typescript": typescript.facts, "tsx": typescript.facts, "fake": fake.facts}


def ignore_regex(pattern: str) -> str:
    """A line of an ignore file as a regular expression over workspace paths."""
    return listing.pattern_body(pattern)[0] + "(/|$)"


def with_ignores(files: DataFrame, patterns: list[str], hidden: bool = False) -> DataFrame:
    """files without ignored ones: the last pattern that matches decides, `!` takes a file back in; hidden parts are skipped."""
    keep = F.lit(True)
    for p in patterns:
        if p.strip() and not p.startswith("#"):
            keep = F.when(F.col("path").rlike(ignore_regex(p.lstrip("!"))), F.lit(p.startswith("!"))).otherwise(keep)
    out = files.filter(keep)
    return out if hidden else out.filter(~F.col("path").rlike(r"(^|/)[.]"))


def scan_tree(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """path, text, stamp_ms, n_bytes, language, content_id of the files under a folder, without those that the tree's ignore files or `patterns` leave out.

    Folders are listed and files read in tasks. The listing is written once; texts are read from the tree whenever a table of them is computed.
    A file that is no UTF-8 has a null text, and its stamp for a content_id.
    """
    files = listing.contents(listing.listed(spark, root, patterns), root).select("path", "text", "stamp_ms", "n_bytes")
    stamp = F.concat_ws("-", F.lit("stamp"), F.col("stamp_ms").cast("string"), F.col("n_bytes").cast("string"))
    return claim(files).withColumn("content_id", F.coalesce("content_id", stamp))


def memory_tree(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """A tree given as path to text."""
    rows = [(p, t, 0, len(t.encode())) for p, t in sorted(files.items())]
    return claim(spark.createDataFrame(rows, "path string, text string, stamp_ms long, n_bytes long"))


def claim(files: DataFrame) -> DataFrame:
    """Adds language and content_id."""
    return files.withColumns({"language": language_of(F.col("path")), "content_id": T.content_id(F.col("text"))})


def overlay(base: DataFrame, staged: DataFrame, gone: DataFrame) -> DataFrame:
    """Reads see staged(path, text) first, then base; paths in gone(path) are hidden."""
    kept = base.select("path", "text").join(gone.select("path"), "path", "left_anti")
    both = kept.join(staged.select("path", F.col("text").alias("new")), "path", "full")
    return both.select("path", F.coalesce("new", "text").alias("text"))


def inventory(files: DataFrame) -> DataFrame:
    return files.select("path").orderBy("path")


def refresh(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and change (appeared, changed, vanished) between two snapshots(path, content_id)."""
    a, b = old.select("path", F.col("content_id").alias("was")), new.select("path", F.col("content_id").alias("is"))
    change = F.when(F.col("was").isNull(), "appeared").when(F.col("is").isNull(), "vanished").when(F.col("was") != F.col("is"), "changed")
    return a.join(b, "path", "full").select("path", change.alias("change")).filter("change is not null")


def unread(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose stamp (time and size) the last read does not know: only these are parsed again."""
    return files.join(known.select("path", "stamp_ms", "n_bytes"), ["path", "stamp_ms", "n_bytes"], "left_anti")


def snapshot_id(files: DataFrame) -> DataFrame:
    """One row: a digest of all (path, content_id), and the number of files. Summed hashes need no order."""
    each = F.conv(F.substring(F.sha2(F.concat_ws("|", "path", "content_id"), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return files.agg(F.coalesce(F.sum(each), F.lit(0)).cast("string").alias("snapshot"), F.count("*").alias("files"))


def captured(files: DataFrame) -> DataFrame:
    """A snapshot: the files as they are now, written once. A file that reads differently twice meanwhile is an error."""
    held = settle(files.select("path", "text", "language", "content_id"))
    torn = refresh(held, files.select("path", "content_id")).filter("change = 'changed'").limit(1).collect()
    if torn:
        raise RuntimeError(f"{torn[0]['path']} changed while it was read")
    return held


def revalidated(snapshot: DataFrame, files: DataFrame) -> DataFrame:
    """What has changed since a snapshot: path, change. No rows: answers from the snapshot still hold."""
    return refresh(snapshot, files)


def facts(files: DataFrame) -> DataFrame:
    """path, language and one array column for each family of facts: every file is parsed once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {k: pa.list_(pa.struct([_arrow_field(c) for c in _columns(v)])) for k, v in FACTS.items()}
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                rows = [PARSERS[lang](text or "") for lang, text in zip(part["language"].to_pylist(), part["text"].to_pylist(), strict=True)]
                lists = {k: pa.array([getattr(r, k) for r in rows], kind) for k, kind in kinds.items()}
                yield pa.RecordBatch.from_pydict({"path": part["path"], "language": part["language"]} | lists)

    schema = "path string, language string, " + ", ".join(f"{k} array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in _columns(v))}>>" for k, v in FACTS.items())
    return files.filter(F.col("language").isin(*PARSERS)).select("path", "language", "text").mapInArrow(run, schema)


_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}


def _arrow_type(kind: str) -> pa.DataType:
    """The Arrow type of a column of facts: a plain one, a list, or a struct of plain ones."""
    if kind.startswith("array<"):
        return pa.list_(_arrow_type(kind[6:-1]))
    if kind.startswith("struct<"):
        return pa.struct([(name, _ARROW[of]) for name, of in (c.split(":") for c in kind[7:-1].split(","))])
    return _ARROW[kind]


def _arrow_field(column: str) -> tuple[str, pa.DataType]:
    name, kind = column.strip().split(" ", 1)
    return name, _arrow_type(kind)


def _columns(ddl: str) -> list[str]:
    out, depth, held = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(held)
            held = ""
        else:
            held += c
    return [*out, held]


def family(parsed: DataFrame, name: str) -> DataFrame:
    """One table of facts, a row a fact: path, language and the family's columns."""
    return parsed.select("path", "language", F.explode(name).alias("x")).select("path", "language", "x.*")


_MANIFEST = "root string, name string, dependencies array<struct<used_as:string,dep_name:string>>, error string"


def _read_manifest(path: str, text: str) -> tuple:
    root = path.rpartition("/")[0]
    try:
        found = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        return root, None, [], str(e)
    package = found.get("package", {})
    name = found.get("lib", {}).get("name") or package.get("name")
    tables = [found, *found.get("target", {}).values()]
    used = {}
    for table in tables:
        for kind in ("dependencies", "dev-dependencies", "build-dependencies"):
            for key, spec in table.get(kind, {}).items():
                real = spec.get("package", key) if isinstance(spec, dict) else key
                used.setdefault(key.replace("-", "_"), real.replace("-", "_"))
    return root, name.replace("-", "_") if name else None, [{"used_as": k, "dep_name": v} for k, v in sorted(used.items())], None


def manifests(files: DataFrame) -> DataFrame:
    """root, name, dependencies, error of each Cargo.toml; the name is null for a workspace without package."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([_read_manifest(p, t or "") for p, t in zip(frame["path"], frame["text"], strict=True)], columns=["root", "name", "dependencies", "error"])

    return files.filter(F.col("path").rlike(r"(^|/)Cargo\.toml$")).select("path", "text").mapInPandas(run, _MANIFEST)


def preview(files: DataFrame, parsed: DataFrame, path: str) -> DataFrame:
    """One row for one file: text, highlights, symbols and identifiers of one content."""
    return files.filter(F.col("path") == path).join(parsed.drop("language"), "path", "left").select("path", "text", "content_id", "highlights", "symbols", "tokens")


def invalid_facts(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Facts whose spans are not spans of their file: path, family, start, end, problem."""
    sizes = files.select("path", F.octet_length("text").alias("n_bytes"), "text")
    parts = []
    for name, ddl in FACTS.items():
        if "start int, end int" in ddl:
            rows = family(parsed, name).select("path", F.lit(name).alias("family"), "start", "end")
            parts.append(rows)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    problem = F.coalesce(T.span_violation(F.col("start"), F.col("end"), F.col("n_bytes")), F.when(T.inside_character(F.col("text"), F.col("start")) | T.inside_character(F.col("text"), F.col("end")), "inside a character"))
    return out.join(sizes, "path").withColumn("problem", problem).filter("problem is not null").select("path", "family", "start", "end", "problem")
