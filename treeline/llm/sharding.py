"""Sharding by sampled splitters.

Records are ordered by a hash of their text, then by doc_id, then by a number of the row, and that order is cut into
shards of nearly equal bytes:

1. every record becomes a row of (doc_id, size, text hashes, row), no text;
2. keys are drawn with a chance that grows with the record's share of bytes and of rows;
3. quantiles of the drawn keys are the splitters of many small ranges, so neither bytes nor
   rows pile up in one range, and a group of equal rows of any size is cut;
4. exact sizes of the ranges are added up; an overfull range is subdivided at keys drawn inside it;
5. a record's shard follows from the bytes before it. Equal texts stay in one shard while
   the group is small against a shard, in bytes and in rows; a larger group is cut where the shard is full. Large
   groups are few by their size, so they are told by a broadcast and never meet in one task.

Defined cases: a null text has size 16 and crc32 0 and differs from the empty text only in
nothing (both have no bytes, so they form one group); texts of any length count whole, by their
bytes; a null doc_id comes before all others; repeated doc_ids and rows are separate records
with their own slots; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.shared import settle

#: Bytes counted for a record besides its text.
OVERHEAD = 16
#: Keys drawn for each range, and the most rows meant for one range.
DRAWS_PER_RANGE, ROWS_PER_RANGE = 32, 1 << 20
#: A group of equal texts is kept whole if its bytes and its rows are at most this part of a shard's.
WHOLE_GROUP = 0.02


def _records(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    raw = text.cast("binary")
    return docs.select(
        docs["doc_id"].alias("doc_id"), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("key"), F.xxhash64(raw, F.lit(1)).alias("key2"),
    )


def _id() -> Column:
    return F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long")


def _draw(records: DataFrame, n_rows: int, n_bytes: int, n_ranges: int) -> np.ndarray:
    """Sorted keys (key, id, row); a record comes in with a chance in proportion to its share of bytes plus its share of rows."""
    share = F.col("size") / F.lit(float(n_bytes)) + F.lit(1.0 / n_rows)
    chance = share * F.lit(DRAWS_PER_RANGE * n_ranges / 2.0)
    dice = F.pmod(F.xxhash64("row", "key2"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    frame = records.filter(dice < chance).select("key", _id().alias("id"), "row").toPandas().sort_values(["key", "id", "row"])
    out = np.empty(len(frame), dtype=[("key", "<i8"), ("id", "<i8"), ("row", "<i8")])
    for name in out.dtype.names:
        out[name] = frame[name]
    return out


def _placed(records: DataFrame, cuts: np.ndarray) -> DataFrame:
    """Adds `part`, the number of splitters at or below the record's (key, id, row)."""
    keys, rest = cuts["key"].copy(), cuts[["id", "row"]].copy()

    def locate(key: pd.Series, doc_id: pd.Series, row: pd.Series) -> pd.Series:
        k = key.to_numpy(np.int64)
        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        at = high.copy()
        split = np.flatnonzero(high > low)  # splitters inside a group of equal texts
        own = np.empty(len(split), rest.dtype)
        own["id"], own["row"] = doc_id.to_numpy(np.int64)[split], row.to_numpy(np.int64)[split]
        for first in np.unique(low[split]):
            here = low[split] == first
            at[split[here]] = first + np.searchsorted(rest[first : high[split[here][0]]], own[here], "right")
        return pd.Series(at.astype(np.int64))

    return records.withColumn("part", F.pandas_udf(locate, "long")("key", _id(), "row"))


def shard_by_bytes(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every record of docs."""
    records = settle(_records(docs).withColumn("row", F.monotonically_increasing_id()), "shard-records")
    n_rows, n_bytes = records.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not n_rows:
        return records.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    n_ranges = max(16 * shards, -(-n_rows // ROWS_PER_RANGE))
    drawn = _draw(records, n_rows, n_bytes, n_ranges)
    cuts = np.unique(drawn[:: max(1, len(drawn) // n_ranges)])
    def sizes(placed: DataFrame) -> dict:
        # One row a range, and the number of ranges is set above: small by construction.
        return {r["part"]: (r["n"], r["b"]) for r in placed.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()}

    placed = _placed(records, cuts)
    totals = sizes(placed)
    full = [p for p, (n, b) in totals.items() if n * n_ranges > 2 * n_rows or b * n_ranges > 2 * n_bytes]
    if full and len(drawn):  # subdivide overfull ranges at all the keys drawn inside them
        bounds = np.searchsorted(drawn, cuts)
        extra = [drawn[(bounds[p - 1] if p else 0) : (bounds[p] if p < len(cuts) else len(drawn))] for p in full]
        cuts = np.unique(np.concatenate([cuts, *extra]))
        placed = _placed(records, cuts)
        totals = sizes(placed)
    placed = settle(placed, "shard-placed")

    session = docs.sparkSession
    order = sorted(totals)
    base = np.concatenate([[0], np.cumsum([totals[p][1] for p in order])])[:-1]
    before = session.createDataFrame([(int(p), int(b)) for p, b in zip(order, base, strict=True)], "part long, base long")
    # Groups of equal texts; one may span many ranges. Of large ones there are at most 2 * shards / WHOLE_GROUP.
    groups = placed.groupBy("key", "key2").agg(F.sum("size").alias("group_bytes"), F.count("*").alias("copies"), F.min(F.struct("part", _id().alias("id"), "row")).alias("first")).filter("copies > 1")
    groups = settle(groups.withColumn("large", (F.col("group_bytes") > WHOLE_GROUP * n_bytes / shards) | (F.col("copies") > F.greatest(F.lit(WHOLE_GROUP * n_rows / shards), F.lit(8)))), "shard-groups")
    large = F.broadcast(groups.filter("large").select("key", "key2", "large"))
    # One table row a range: bounded, see n_ranges.
    w = Window.partitionBy("part").orderBy("key", "key2", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("inside", F.coalesce(F.sum("size").over(w), F.lit(0))).join(F.broadcast(before), "part").withColumn("start", F.col("base") + F.col("inside")).drop("inside", "base")
    ranked = settle(ranked.join(large, ["key", "key2"], "left"), "shard-ranked")
    kept = groups.filter("not large").select("key", "key2", "group_bytes", F.col("first.part").alias("part"), F.col("first.row").alias("row"))
    heads = ranked.join(kept, ["key", "key2", "part", "row"]).select("key", "key2", (F.col("start") + F.col("group_bytes") / 2).alias("middle"))
    small = ranked.filter("large is null").join(heads, ["key", "key2"], "left")
    middle = F.coalesce("middle", F.col("start") + F.col("size") / 2)
    dealt = small.unionByName(ranked.filter("large").withColumn("middle", F.lit(None).cast("double"))).withColumn("shard", F.least(F.floor(middle * shards / F.lit(float(n_bytes))), F.lit(shards - 1)).cast("int"))
    dealt = settle(dealt.select("doc_id", "size", "text_crc32", "key", "key2", "part", "row", "shard"), "shard-dealt")
    # Slots: rows of the shard in earlier ranges, then the place inside the range. A count row for each range and shard that meet.
    counts = sorted(tuple(r) for r in dealt.groupBy("shard", "part").count().collect())
    offsets, shard_now, run = [], None, 0
    for shard, part, n in counts:
        run = 0 if shard != shard_now else run
        offsets.append((shard, part, run))
        shard_now, run = shard, run + n
    offset = session.createDataFrame(offsets, "shard int, part long, offset long")
    place = F.row_number().over(Window.partitionBy("part", "shard").orderBy("key", "key2", "doc_id", "row"))
    return dealt.withColumn("place", place).join(F.broadcast(offset), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
