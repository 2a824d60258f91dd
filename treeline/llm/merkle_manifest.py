"""A Merkle manifest of a dataset, kept as a node store outside memory.

1. One scan hashes every row into a leaf; texts are read once and never shuffled.
2. Leaves are range-partitioned and sorted by (source, doc_id, leaf): sorted runs. A run's rows are
   numbered as they are written, and the counts of each source in each run make the numbers gapless
   places inside the source, so no task ever holds a source.
3. The nodes of a level lie in Parquet, partitioned by level, by coordinate (source, place). Every level is one sequential
   read of the level below: sixteen neighbours become one node. Sources leave the loop when one node remains.
4. The subroots, in the order of sources, are the leaves of a second tree of the same kind; it gives the root.
5. Proofs come from merges by coordinate, from the root downwards: a run of siblings joins the one row of its
   parent, so a key has at most sixteen rows, however large its source.

Defined cases: a null doc_id comes first and is never tampered; a null source is a source of its own and comes first; rows of
one doc_id are ordered by their leaves, so equal rows may change places without a change of any hash; a source of one
row has that leaf as its subroot; an empty table gives an empty result; extra columns are ignored; texts of any length are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from treeline.llm.shared import new_path, settle, small_side

#: Children of a node.
ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value as it enters a leaf: `-`, or the count of its UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(row: dict[str, Column]) -> Column:
    """The leaf of a row, as lower-case hex."""
    return F.sha2(F.concat(*[field(row[name]) for name in FIELDS]), 256)


def node_hash(hashes: Column) -> Column:
    """The node over an array of hashes."""
    return F.sha2(F.array_join(hashes, ""), 256)


def folded_ascii(text: Column) -> Column:
    """The tampering: A-Z become lower case, nothing else changes."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame) -> DataFrame:
    """tree (the source, or a mark of null), doc_id, leaf, other (the tampered row's leaf where the row is to be tampered) and place, gapless in each source."""
    row = {name: docs[name] for name in FIELDS}
    hit = F.pmod(F.crc32(docs["doc_id"].cast("string").cast("binary")), F.lit(5)) == 0
    hashed = docs.select(
        F.struct(docs["source"].isNotNull().alias("named"), docs["source"].alias("source")).alias("tree"), docs["doc_id"].alias("doc_id"), leaf_hash(row).alias("leaf"),
        F.when(hit, leaf_hash(row | {"text": folded_ascii(docs["text"])})).alias("other"), F.monotonically_increasing_id().alias("salt"),
    )
    order = ["tree", F.col("doc_id").asc_nulls_first(), "leaf", "salt"]  # the salt cuts groups of equal rows, which any order fits
    # Rows are numbered inside their run as it is written; the upper bits of the number are the run's.
    runs = settle(hashed.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt").withColumn("n", F.monotonically_increasing_id()), "merkle-leaves")
    runs = runs.withColumn("run", F.shiftright("n", 33))
    heads = runs.groupBy("tree", "run").agg(F.min("n").alias("first"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("tree").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = settle(heads.select("tree", "run", (before - F.col("first")).alias("shift")), "merkle-heads")  # runs and sources, not rows
    placed = runs.join(small_side(heads, 64), ["tree", "run"]).select("tree", "doc_id", "leaf", "other", (F.col("n") + F.col("shift")).alias("place"))
    return settle(placed, "merkle-placed")


class NodeStore:
    """Trees of nodes in Parquet, one folder a level; a node's coordinate is (tree, place)."""

    def __init__(self, spark: SparkSession, bottom: DataFrame, tag: str) -> None:
        """bottom: tree, place, hash."""
        self.spark, self.path = spark, new_path(spark, f"merkle-{tag}")
        self.schema = bottom.select("tree", F.col("place").cast("long").alias("place"), "hash").schema
        self.sizes = settle(bottom.groupBy("tree").agg(F.count("*").alias("size")), f"merkle-{tag}-sizes")
        self.heights: list[DataFrame] = []  # by level, runs of siblings: tree, run, hashes
        self.roots = settle(self._build(bottom), f"merkle-{tag}-roots")

    def _level(self, k: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/level={k}")

    def _build(self, bottom: DataFrame) -> DataFrame:
        widest = self.sizes.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
        bottom.select("tree", F.col("place").cast("long").alias("place"), "hash").write.parquet(f"{self.path}/level=0")
        roots, k = [], 0
        while True:
            level = self._level(k)
            left = self.sizes.select("tree", F.ceil(F.col("size") / ARITY**k).alias("left")) if k else self.sizes.withColumnRenamed("size", "left")
            roots.append(level.join(small_side(left.filter("left = 1"), 64), "tree").select("tree", "hash"))
            if widest <= 1:
                break
            more = level.join(small_side(left.filter("left > 1"), 64), "tree")
            run = F.floor(F.col("place") / ARITY)
            met = more.groupBy("tree", run.alias("run")).agg(F.array_sort(F.collect_list(F.struct("place", "hash"))).alias("met"))  # sixteen at most
            runs = settle(met.select("tree", "run", F.col("met.hash").alias("hashes")), f"merkle-runs-{k}")
            self.heights.append(runs)
            runs.select("tree", F.col("run").alias("place"), node_hash(F.col("hashes")).alias("hash")).write.parquet(f"{self.path}/level={k + 1}")
            widest, k = -(-widest // ARITY), k + 1
        out = roots[0]
        for r in roots[1:]:
            out = out.unionByName(r)
        return out

    def paths(self, upper: DataFrame) -> DataFrame:
        """tree, run, path and the further columns of `upper` (tree, path, ...): for the runs of the lowest level, the runs met on the way up, upper's path at its end. A lone leaf has run 0.

        path is an array of (at, hashes): the place of the node on the way inside its run, and the whole run; the place in the
        first run is left to the leaf.
        """
        kind = "array<struct<at:int,hashes:array<string>>>"
        more = [c for c in upper.columns if c not in ("tree", "path")]  # carried along, so no source's rows are joined by their source
        above = self.roots.select("tree").join(upper, "tree", "left").select("tree", F.lit(0).cast("long").alias("run"), F.coalesce("path", F.expr(f"cast(array() as {kind})")).alias("path"), *more)
        if not self.heights:
            return above
        # `open`: paths of the nodes of a level, by (tree, place); a tree joins at the level of its root.
        sizes, done = self.sizes, None
        open_ = None
        for k in range(len(self.heights) - 1, -1, -1):
            runs = self.heights[k]
            tops = sizes.filter((F.ceil(F.col("size") / ARITY ** (k + 1)) == 1) & (F.ceil(F.col("size") / ARITY**k) > 1)).select("tree").join(above, "tree")
            parents = tops if open_ is None else open_.unionByName(tops)
            met = runs.join(parents, ["tree", "run"]).select("tree", "run", F.concat(F.array(F.struct(F.lit(None).cast("int").alias("at"), F.col("hashes"))), "path").alias("path"), *more)
            if not k:
                done = met
                break
            below = met.select("tree", F.posexplode(F.col("path")[0]["hashes"]).alias("at", "hash"), "run", "path", *more)
            here = F.transform("path", lambda x, i: F.when(i == 0, F.struct(F.col("at").cast("int").alias("at"), x["hashes"].alias("hashes"))).otherwise(x))
            open_ = settle(below.select("tree", (F.col("run") * ARITY + F.col("at")).alias("run"), here.alias("path"), *more), f"merkle-paths-{k}")
        lone = sizes.filter("size = 1").select("tree").join(above, "tree")
        return done.unionByName(lone)


def proof(path: Column) -> Column:
    """The siblings on a path, left to right and level by level, hashed."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda s: F.filter(s["hashes"], lambda _, i: i != s["at"]))), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, leaf, lambda now, s: node_hash(F.transform(s["hashes"], lambda h, i: F.when(i == s["at"], now).otherwise(h))))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of docs."""
    spark = docs.sparkSession
    rows = leaves(docs)
    own = NodeStore(spark, rows.select("tree", "place", F.col("leaf").alias("hash")), "rows")
    # One row a source. Places in the order of sources: runs again, as sources may be many.
    subs = settle(own.roots.repartitionByRange("tree").sortWithinPartitions("tree").withColumn("n", F.monotonically_increasing_id()), "merkle-subroots")
    subs = subs.withColumn("part", F.shiftright("n", 33))
    counts = subs.groupBy("part").agg(F.min("n").alias("first"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    subs = subs.join(F.broadcast(counts.select("part", (before - F.col("first")).alias("shift"))), "part")
    subs = settle(subs.select(F.lit(0).alias("tree"), F.col("tree").alias("source"), (F.col("n") + F.col("shift")).alias("place"), "hash"), "merkle-order")
    top = NodeStore(spark, subs.select("tree", "place", "hash"), "sources")
    over = top.paths(spark.createDataFrame([], "tree int, path array<struct<at:int,hashes:array<string>>>"))
    first = lambda path, place: F.transform(path, lambda x, i: F.when((i == 0) & x["at"].isNull(), F.struct(F.pmod(place, F.lit(ARITY)).cast("int").alias("at"), x["hashes"].alias("hashes"))).otherwise(x))
    upper = subs.withColumn("run", F.floor(F.col("place") / ARITY)).join(over, ["tree", "run"]).select(F.col("source").alias("tree"), first("path", F.col("place")).alias("path"), F.col("hash").alias("subroot"))
    upper = settle(upper.crossJoin(F.broadcast(top.roots.select(F.col("hash").alias("root")))), "merkle-upper")  # the one root
    ways = own.paths(upper)
    # A run of siblings has sixteen leaves at most, and they are neighbours in the sorted runs.
    met = rows.withColumn("run", F.floor(F.col("place") / ARITY)).join(ways, ["tree", "run"]).withColumn("path", first("path", F.col("place")))
    out = met.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.coalesce("other", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
