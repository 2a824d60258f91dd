"""Tables of the workspace may be large whatever the size of their files, so none is sent through the driver."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeline import queries
from treeline.functions import text as T
from treeline.operators import graph, namespaces
from treeline.session import settle


def test_settled_tables_meet_in_shuffled_joins(spark):
    a = settle(spark.range(1000).select("id", F.array_repeat(F.lit("x"), 50).alias("facts")))
    b = settle(spark.range(1000).withColumn("n", F.col("id") % 7))
    facts = a.select("id", F.explode("facts").alias("f"))
    for joined in (facts.join(b, "id"), b.join(facts, "id", "left"), b.join(facts.groupBy("id").agg(F.count("*").alias("k")), "id", "left_anti")):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert facts.join(F.broadcast(b.filter("id < 5")), "id").count() == 250  # what is known to be small still goes to all tasks


def test_line_starts_of_empty_null_and_sliced_texts(spark):
    texts = [None, "", "\n", "a\nb", "é\n\n€x\n", "no break", None, "\n\n"] * 3
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
    found = {r["k"]: r["at"] for r in rows.select("k", T.line_starts(F.col("t")).alias("at")).collect()}
    for k, t in enumerate(texts):
        assert found[k] == (None if t is None else [0, *[i + 1 for i, c in enumerate(t.encode()) if c == 10]])
    plan = rows.select(T.line_starts(F.col("t")).alias("at"))._jdf.queryExecution().executedPlan().toString()
    assert "SQL_SCALAR_PANDAS_UDF" not in plan and "pandas" not in plan.lower()


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_line_starts_take_no_memory_in_proportion_to_a_batch(monkeypatch, kind):
    made = []
    monkeypatch.setattr(T.F, "arrow_udf", lambda f, _: made.append(f) or (lambda c: c))
    T.line_starts(None)
    texts = ["x" * 1000 + "\n" + "é" * 500, None, "", "\n" * 3, "y" * 3_000_000 + "\nz"] + ["w" * 16_000 + "\n"] * 2000
    held = pa.array(texts, kind)
    for batch in (held, held.slice(1, 900), held.slice(0, 0)):
        tracemalloc.start()
        found = made[0](batch)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found.type == pa.list_(pa.int32()) and len(found) == len(batch)
        assert found.to_pylist() == [None if t is None else [0, *[i + 1 for i, c in enumerate(t.encode()) if c == 10]] for t in batch.to_pylist()]
        assert peak < 8 << 20, f"{peak} bytes for {batch.nbytes}"


def test_the_forest_of_aliases_is_joined_by_shuffles(spark, monkeypatch):
    plans, real = [], graph.settle

    def spy(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(graph, "settle", spy)
    assert queries.f1_alias_forest(spark, "/root/testdata/sf0.001").count() > 0
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_members_of_namespaces_are_joined_by_shuffles(spark, monkeypatch):
    plans, real = [], namespaces.settle

    def spy(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(namespaces, "settle", spy)
    assert queries.w_members(spark, "/root/testdata/sf0.001").count() > 0
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
