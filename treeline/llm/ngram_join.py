"""N-gram Jaccard self-join by MinHash banding.

1. A text becomes the set of its runs of five words (as 64-bit hashes). Rows with the same
   set form a class; from here on a class is one row, so copies cost nothing.
2. A signature of rows x bands minima is cut into bands. The counts are chosen so that a
   pair at the threshold shares a band with at least the target probability.
3. Classes are shuffled on band hashes; a bucket yields one edge from each member to its
   smallest member (never all pairs), and the components of these edges are clusters of
   candidates.
4. Inside a cluster all pairs are verified on their full sets, in memory and block against
   block: large clusters are dealt into blocks, each pair of blocks is a task of bounded
   size. Only counts and a spanning forest leave the task.

Result: one row per row of docs: doc_id, class_id (smallest doc_id with the same set),
component_id (smallest doc_id reachable by links), n_links (other documents at the
threshold or above, copies included), kept (doc_id = component_id).

Defined cases: null, empty and wordless texts link with nothing; a text of one to four
words is one run; texts of any length are read whole; a null doc_id links with nothing and is
kept; rows that repeat a doc_id count as texts of one document; extra columns are ignored, and kept by keep_one; the
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from treeline.llm.components import connected_components, local_components
from treeline.llm.shared import settle, small_side, text_slices, with_plain_names
from treeline.llm.text import SHINGLE, mix, shingle_sets

THRESHOLD, TARGET_RECALL, MOST_HASHES = 0.8, 0.994, 360
#: Classes in one block of a large cluster.
BLOCK = 256


def choose_bands(threshold: float = THRESHOLD, recall: float = TARGET_RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, with which `most` hashes reach the recall at the threshold."""
    best = (most, 1)
    for rows in range(1, most + 1):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                best = (bands, rows)
                break
    return best


def _factors(n: int) -> np.ndarray:
    return (mix(np.arange(1000, 1000 + n, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def band_hashes(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash a band; the band's number is part of it."""
    factors = _factors(bands * rows)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):  # products stay in cache
        np.minimum(least, (low[at : at + 512, None] * factors).min(axis=0), out=least)
    h = mix(np.arange(bands, dtype=np.uint64))
    for column in least.reshape(bands, rows).T.astype(np.uint64):
        h = mix(h + column)
    return h


def _signatures(docs: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 1 << 19):
            sets = shingle_sets([(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()], width)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            hashed = [band_hashes(s, bands, rows).view(np.int64) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(hashed, pa.list_(pa.int64()))], ["doc_id", "set_key", "bands"])

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return slim.mapInArrow(scan, "doc_id long, set_key binary, bands array<long>")


def _with_sets(members: DataFrame, width: int) -> DataFrame:
    """Replaces text by the set; drops rows whose text is not the class's (a doc_id with several texts)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 1 << 19):
            sets = shingle_sets([(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()], width)
            same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == k for s, k in zip(sets, batch.column("set_key").to_pylist(), strict=True)]
            columns = {n: batch.column(n) for n in batch.schema.names if n != "text"} | {"grams": pa.array([s.tobytes() for s in sets], pa.binary())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns)).filter(pa.array(same, pa.bool_()))

    kept = [f for f in members.schema.fields if f.name != "text"]
    return members.mapInArrow(scan, StructType([*kept, StructField("grams", BinaryType())]))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from products of incidence matrices over the grams that occur twice or more."""
    sets = left + right
    grams, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    columns = np.where(counts > 1, number, -1)[inverse]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    owner, columns = owner[columns >= 0], columns[columns >= 0]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(columns, kind="stable")
    owner, columns = owner[order], columns[order]
    step, width = 8192, int(columns[-1]) + 1 if len(columns) else 0
    for at in range(0, width, step):
        a, b = np.searchsorted(columns, (at, at + step))
        part = np.zeros((len(sets), min(step, width - at)), np.float32)
        part[owner[a:b], columns[a:b] - at] = 1
        out += part[: len(left)] @ part[len(left) :].T
    return out.astype(np.int64)


def _verify(threshold: float):  # noqa: ANN202
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["rep", "set_key"]).sort_values("rep", kind="stable")
        first, second = key[1], key[2]
        is_left = (group["block"] == first).to_numpy()
        sets = [np.frombuffer(g, np.uint64) for g in group["grams"]]
        here = np.flatnonzero(is_left)
        there = here if first == second else np.flatnonzero(~is_left)
        links = np.zeros(len(group), np.int64)
        a = b = np.zeros(0, np.int64)
        if len(here) and len(there):
            size = np.array([len(s) for s in sets])
            both = overlaps([sets[i] for i in here], [sets[i] for i in there])
            union = size[here][:, None] + size[there][None, :] - both
            # Exact in integers up to rounding of the one division.
            hit = both >= threshold * union - 1e-9
            if first == second:
                hit = np.triu(hit, 1)
            x, y = np.nonzero(hit)
            a, b = here[x], there[y]
            copies = group["copies"].to_numpy(np.int64)
            links += np.bincount(a, copies[b], len(group)).astype(np.int64) + np.bincount(b, copies[a], len(group)).astype(np.int64)
        label = local_components(len(group), a, b)
        reps = group["rep"].to_numpy(np.int64)
        return pd.DataFrame({"rep": reps, "links": links, "head": reps[label], "alone": group["n_blocks"].to_numpy() == 1})

    return run


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, recall: float = TARGET_RECALL) -> DataFrame:
    """doc_id, class_id, component_id, n_links, kept for every row of docs."""
    bands, rows = choose_bands(threshold, recall)
    signed = settle(_signatures(docs, bands, rows, width), "signed")
    known = signed.filter("set_key is not null and doc_id is not null")
    classes = settle(_classes(known), "classes")

    spread = classes.select("rep", F.explode("bands").alias("band"))
    buckets = spread.groupBy("band").agg(F.min("rep").alias("head"), F.count("*").alias("n")).filter("n > 1").select("band", "head")
    stars = spread.join(buckets, "band").filter("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b"))
    clusters = connected_components(stars)
    sizes = clusters.groupBy("component").agg(F.count("*").alias("n")).select("component", F.ceil(F.col("n") / BLOCK).cast("int").alias("n_blocks"))
    members = clusters.join(sizes, "component").join(classes.select(F.col("rep").alias("node"), "set_key", "copies"), "node")
    members = settle(members.select(F.col("node").alias("rep"), F.col("component").alias("cluster"), "n_blocks", F.pmod(F.xxhash64("node"), "n_blocks").cast("int").alias("block"), "set_key", "copies"), "members")

    texts = docs.select(docs["doc_id"].cast("long").alias("rep"), docs["text"].alias("text")).join(small_side(members, 64), "rep")
    sets = _with_sets(texts, width)
    # A member meets each block of its cluster once: rows in tasks are members times blocks.
    met = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})
    verified = settle(met.groupBy("cluster", "first", "second").applyInPandas(_verify(threshold), "rep long, links long, head long, alone boolean"), "verified")
    linked = verified.groupBy("rep").agg(F.sum("links").alias("links"), F.min("head").alias("head"), F.first("alone").alias("alone"))
    joined = connected_components(verified.filter("not alone").select(F.col("rep").alias("a"), F.col("head").alias("b")))
    linked = linked.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "links", F.coalesce("component", F.when(F.col("alone"), F.col("head")), "rep").alias("component"))

    # Only classes with copies or candidates need a join; all other rows stand alone.
    busy = classes.join(linked, "rep", "left").filter("copies > 1 or links > 0").select("set_key", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    # Rows without a set or an id have nothing to look up and pass the join by.
    alone = signed.filter("set_key is null or doc_id is null").select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in busy.drop("set_key").dtypes])
    looked_up = known.select("doc_id", "set_key").join(busy, "set_key", "left").drop("set_key")
    out = looked_up.unionByName(alone)
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id", F.coalesce("rep", "doc_id").alias("class_id"), component.alias("component_id"),
        F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _classes(known: DataFrame) -> DataFrame:
    """One row a distinct set: rows of one doc_id count once; equal rows are combined before the shuffle."""
    once = known.groupBy("set_key", "doc_id").agg(F.first("bands").alias("bands"))
    return once.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each group of linked texts: the one with the smallest doc_id. Rows with a null doc_id all stay.

    Where rows share a doc_id each is judged by its own text; equal rows of one doc_id become one.
    """
    return with_plain_names(docs, ("doc_id", "text"), lambda plain: _keep_one(plain, threshold))


def _keep_one(docs: DataFrame, threshold: float) -> DataFrame:
    known = docs.filter("doc_id is not null")
    if known.groupBy("doc_id").count().filter("count > 1").isEmpty():
        result = settle(ngram_join(docs, threshold).select("doc_id", "kept"), "join-result")
        gone = small_side(result.filter("not kept").select("doc_id"), 16)
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # Row numbers in the order of doc_ids take the place of ids, so the smallest doc_id still wins. One field holds the row: no name can clash.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    once = known.dropDuplicates(["doc_id", "text"]).orderBy("doc_id", "text").select(F.monotonically_increasing_id().alias("doc_id"), "text", row.alias("row"))
    once = settle(once, "join-rows")
    kept = settle(ngram_join(once.select("doc_id", "text"), threshold).filter("kept").select("doc_id"), "join-result")
    left = once.join(small_side(kept, 16), "doc_id", "left_semi").select("row.*")
    return left.unionByName(docs.filter("doc_id is null"))
