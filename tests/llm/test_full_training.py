"""op3 learns from every labelled row, not from a sample."""

import numpy as np
from pyspark.sql import functions as F

from treeline.llm import quality_rank as Q


def _table(spark, good, bad):
    rng = np.random.default_rng(3)
    word = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(n))
    docs = [(i, word(20) + ".") for i in range(good)] + [(good + i, word(20).upper() + " !!! " * 5) for i in range(bad)]
    labels = [(i, 1 if i < good else 0) for i in range(good + bad)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_every_labelled_row_is_learned_from(spark):
    docs, labels = _table(spark, 700, 300)
    wanted = labels.filter(~Q.held_out("doc_id")).count()
    rows = Q.labelled(Q.features(docs), labels)
    assert rows.count() == wanted
    dealt, copies = Q._dealt(rows, {r["mark"]: r["count"] for r in rows.groupBy("mark").count().collect()})
    assert dealt.filter("copy = 0").select("doc_id").distinct().count() == wanted and copies == 1
    ranking = Q.train(Q.features(docs), labels)
    f = np.array([r["f"] for r in rows.orderBy("doc_id").collect()])
    assert np.allclose(ranking.mean, f.mean(0)) and np.allclose(ranking.scale, f.std(0) + 1e-6)


def test_a_rare_label_is_in_every_bucket(spark, monkeypatch):
    monkeypatch.setattr(Q, "BUCKET", 50)
    docs, labels = _table(spark, 600, 9)
    rows = Q.labelled(Q.features(docs), labels)
    counts = {r["mark"]: r["count"] for r in rows.groupBy("mark").count().collect()}
    dealt, copies = Q._dealt(rows, counts)
    marks = dealt.groupBy("bucket").agg(F.countDistinct("mark").alias("n"))
    assert copies > 1 and marks.filter("n < 2").count() == 0
    out = Q.score(docs, labels).collect()
    assert all(r["predicted"] == (r["doc_id"] < 600) for r in out)


def test_the_cut_makes_the_fewest_errors(spark):
    class Own:
        def strengths(self, rows):
            return rows[:, 0]

    for marks in ([0, 0, 1, 0, 1, 1], [1, 1, 1], [0, 0, 0], [1, 0], [0, 1, 0, 1], [1, 0, 0, 1, 1, 1, 0]):
        rows = spark.createDataFrame([([float(k)] + [0.0] * (len(Q.NAMES) - 1), m) for k, m in enumerate(marks)], "f array<double>, mark int")
        cut = Q._cut(rows, Own())
        errors = lambda c: sum((k >= c) != (m == 1) for k, m in enumerate(marks))
        # A cut at a value stands for the one beside it where there is nothing beyond.
        assert errors(cut) <= min(errors(k + 0.5) for k in range(-1, len(marks))) + (cut in (0.0, len(marks) - 1.0))
