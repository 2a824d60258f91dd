"""Stages of the pipeline take columns of any name and give the same rows back."""

import time

import pytest

from treeline.llm import decontaminate, ngram_join, secrets, toxicity_gru

NAMES = ["doc_id", "text", "lang", "source", "n_chars", "a.b", "`tick`", "Text", "c1", "rep", "a b", "DOC_ID2", "hits"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), 1.5, "x", "y", i, 3, [1], None, "z") for i, t in enumerate(["one two three four five six", "one two three four five six", None, "", "password = hunter2hunter2", "seven eight nine"])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, k5 double, k6 string, k7 string, k8 int, k9 int, k10 array<int>, k11 string, k12 string"
    return spark.createDataFrame(rows, schema).toDF(*NAMES)


@pytest.fixture(scope="module")
def insensitive(spark):
    was = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")  # two names that differ by case alone need it
    yield
    spark.conf.set("spark.sql.caseSensitive", was)


def test_stages(spark, docs, insensitive):
    labels = spark.createDataFrame([(0, 0), (5, 0)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "seven eight nine")], "item_id long, text string")
    for out, ids in (
        (ngram_join.keep_one(docs), {0, 2, 3, 4, 5}), (secrets.redact_secrets(docs), {0, 1, 2, 3, 4, 5}), (decontaminate.remove_contaminated(docs, items), {0, 1, 2, 3, 4}),
        (toxicity_gru.remove_toxic(docs, labels), {0, 1, 2, 3, 4, 5}), (ngram_join.keep_one(docs.union(docs)), {0, 2, 3, 4, 5}),
    ):
        assert out.columns == NAMES and out.dtypes == docs.dtypes
        rows = out.collect()
        assert {r[0] for r in rows} == ids and all(r[8] == r[0] and r[10] == [1] and r[5] == 1.5 for r in rows)
    assert secrets.redact_secrets(docs).filter("doc_id = 4").first()[1] == "[secret]"


def test_many_assignments_in_one_text():
    text = " ".join(f"password=abc{i % 9}defgh" for i in range(40_000))
    began = time.perf_counter()
    assert len(secrets.find_spans(text)) == 40_000 and time.perf_counter() - began < 60
    inside = 'token="abcdefgh12" passphrase = \'abcdefgh12-xyz-90\''
    assert [(a, k) for a, _, k, _ in secrets.find_spans(inside)] == [(0, "assign"), (33, "guess")]


def test_separators_cost_less_than_letters():
    assert secrets.guess_cost("not-set") < 8 < secrets.guess_cost("xKqZ-vwPl_mTrHs!")
    assert secrets.guess_cost("the-list") < secrets.guess_cost("the~list")
