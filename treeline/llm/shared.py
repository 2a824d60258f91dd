"""What the operators share: tables in the cluster's shared folder, checked broadcasts, batches of bounded size.

Nothing here keeps a file on one machine. Intermediate tables go to the folder named by
``spark.checkpoint.dir``; a folder is chosen here only where that setting is absent (tests,
local sessions).
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its measured size is at most this.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = known.get() if known.isDefined() else None
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):  # one machine, one process
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may already be gone at exit
        pass


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the interpreter ends."""
    path = f"{shared_dir(spark)}/tables/{tag}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends here, and no executor's loss undoes it."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def unsettle(df: DataFrame) -> None:
    """Drop a table of settle() that nothing reads any more."""
    if path := getattr(df, "_settled", None):
        _delete(df.sparkSession, path)


def with_plain_names(docs: DataFrame, kept: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage over docs with all columns but the kept ones numbered, and the names put back: no name can clash, hold a dot or differ by case alone."""
    plain = docs.toDF(*[c if c in kept else f"c{i}" for i, c in enumerate(docs.columns)])
    return stage(plain).select(*plain.columns).toDF(*docs.columns)


def small_side(df: DataFrame, bytes_per_row: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows fit the limit, else df as it is (a shuffled join follows)."""
    return F.broadcast(df) if df.count() * bytes_per_row <= limit else df


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, held_out, per_class: int, seed: int, payload: str) -> DataFrame:  # noqa: ANN001 - held_out: a function of a column's name
    """doc_id, mark and payload of at most per_class rows of docs of each label 0 and 1, none of them held out.

    Only ids that docs holds are drawn, those with the smallest hashes. An id whose labels differ has
    none; rows that repeat an id and its payload count once.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("mark")).filter("doc_id is not null and mark in (0, 1)").filter(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.min("mark").alias("mark"), F.max("mark").alias("other")).filter("mark = other").drop("other")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[payload].alias(payload))
    there = rows.select("doc_id").join(small_side(known, 16), "doc_id").distinct()

    def drawn(of: DataFrame, *ties: str) -> DataFrame:
        one = [of.filter(F.col("mark") == k).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", *ties).limit(per_class) for k in (0, 1)]
        return one[0].unionByName(one[1])

    ids = settle(drawn(there), "sample-ids")  # 2 * per_class rows at most
    found = rows.join(F.broadcast(ids), "doc_id").withColumn("h", F.xxhash64(payload)).dropDuplicates(["doc_id", "h"])
    return drawn(found, "h").select("doc_id", "mark", payload)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the column's text is about `most` bytes a slice (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)
