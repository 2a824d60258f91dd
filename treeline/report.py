"""Reports: an answer as a document of lines for people, or as JSON, both as tables that any sink can write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_lines(answer: DataFrame, title: str, group: str | None = None, order: list[str] | None = None) -> DataFrame:
    """(block, ord, value): the title with the number of rows, then a line a row, under a heading for each group."""
    order = order or [c for c in answer.columns if c != group]
    shown = [c for c in answer.columns if c != group]
    line = F.concat_ws("  ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in shown])
    key = F.coalesce(F.col(group).cast("string"), F.lit("-")) if group else F.lit("")
    rows = answer.select(key.alias("block"), F.lit(1).alias("rank"), F.struct(*order).alias("at"), F.concat(F.lit("  "), line).alias("value"))
    top = answer.agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias("block"), F.lit(0).alias("rank"), F.concat(F.lit(f"{title}: "), F.col("n").cast("string")).alias("value"))
    heads = answer.groupBy(key.alias("block")).agg(F.count("*").alias("n")).select("block", F.lit(0).alias("rank"), F.concat("block", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("value"))
    out = rows.unionByName(top, allowMissingColumns=True)
    out = out.unionByName(heads, allowMissingColumns=True) if group else out
    return out.orderBy(F.asc_nulls_first("block"), "rank", "at").select("block", "value")


def as_json(answer: DataFrame, title: str) -> DataFrame:
    """One JSON text a row, with the report's title and kind."""
    return answer.select(F.to_json(F.struct(F.lit(title).alias("report"), F.struct(*answer.columns).alias("row"))).alias("value"))
