"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from treeline.llm import decontaminate, html_wrapper, ngram_join, piece_sampling, quality_rank, secrets, sharding, toxicity_gru, vector_neardup, warc_bundle

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
TEXTS = [None, "", " ", "\n\n", "one", "one two three four", LONG, LONG, "same text again and again here", "same text again and again here", "é ▁ 日本 😀 password=hunter2hunter2", "the cat sat on the mat and looked at me for a very long time today"]
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, score string, spans string, bands int, rep int, hits int, c0 string, label int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), 1, "x", "y", 2, 3, 4, "z", 5) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[8], (None, "no id at all", None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 1), (8, 1, 0), (9, 0, 1), (99, 1, 1), (6, None, None), (None, 1, 1), (10, 1, 1), (11, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat and looked at me for a very long time"), (2, "one"), (3, None), (4, ""), (1, "again here")], "item_id long, text string")


def counts(docs, out):
    assert out.count() == docs.count()
    return {(r["doc_id"]): r for r in out.collect()}


def test_decontamination(docs, items):
    out = counts(docs, decontaminate.contamination(docs, items))
    assert out[0]["n_words"] == out[1]["n_words"] == 0 and not out[0]["contaminated"]
    assert out[11]["contaminated"] and out[11]["n_items"] == 1
    assert out[4]["n_hit"] == 1 and out[4]["items"] == [2]
    kept = decontaminate.remove_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.filter("doc_id = 11").count() == 0 and kept.filter("doc_id = 6").count() == 1
    assert decontaminate.cut_hits(docs, items).filter("doc_id = 11").first()["text"] == " today"
    assert decontaminate.contamination(docs, items.limit(0)).filter("contaminated").count() == 0


def test_blocks_of_items_give_the_same(docs, items):
    one = decontaminate.judge(decontaminate.find_hits(docs.select("doc_id", "text"), items)).select("doc_id", "n_hit", "items_sha256").collect()
    many = decontaminate.judge(decontaminate.find_hits(docs.select("doc_id", "text"), items, block_words=3)).select("doc_id", "n_hit", "items_sha256").collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_quality_and_toxicity(docs, labels):
    for scored in (quality_rank.score(docs, labels), toxicity_gru.score(docs, labels), quality_rank.score(docs, labels.limit(0)), toxicity_gru.score(docs, labels.limit(0))):
        rows = counts(docs, scored)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    assert toxicity_gru.remove_toxic(docs, labels).columns == docs.columns


def test_secrets(docs):
    out = counts(docs, secrets.scan(docs))
    assert out[10]["n_assign"] == 1 and out[0]["spans"] == ""
    clean = secrets.redact_secrets(docs)
    assert clean.columns == docs.columns and "hunter2" not in clean.filter("doc_id = 10").first()["text"]
    assert clean.filter("doc_id = 0").first()["text"] is None


def test_join(docs):
    out = counts(docs, ngram_join.ngram_join(docs))
    assert out[6]["n_links"] == 1 and out[7]["component_id"] == 6 and not out[7]["kept"]
    assert out[9]["component_id"] == 8 and out[0]["n_links"] == 0 and out[None]["kept"]
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id in (7, 9)").count() == 0 and kept.filter("doc_id = 4").count() == 1


def test_one_row_of_each_group_with_shared_and_null_ids(spark):
    text = lambda tag: " ".join(f"{tag}{k}" for k in range(60))
    near = text("a") + " more"
    rows = [(1, text("a")), (1, text("a")), (2, text("b")), (2, text("c")), (3, text("d")), (3, near), (4, near), (7, None), (7, ""), (7, ""), (None, text("e")), (None, text("f")), (None, None), (None, text("a"))]
    docs = spark.createDataFrame([(*r, "r") for r in rows], "doc_id long, text string, row string").repartition(3)
    kept = ngram_join.keep_one(docs)
    want = [(1, text("a")), (2, text("b")), (2, text("c")), (3, text("d")), (7, None), (7, ""), *rows[10:]]
    assert kept.columns == docs.columns and sorted(map(repr, ((r[0], r[1]) for r in kept.collect()))) == sorted(map(repr, want))


def test_sharding(docs):
    out = sharding.shard_by_bytes(docs, 4)
    assert out.count() == docs.count()
    slots = out.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top"), F.countDistinct("slot").alias("d")).collect()
    assert all(r["n"] == r["d"] == r["top"] + 1 for r in slots)


def test_pieces(docs):
    out = piece_sampling.encode_rows(docs)
    assert out.count() == docs.count() and out.filter("not lossless").count() == 0
    back = {r["doc_id"]: r["text"] for r in piece_sampling.decode_rows(out).collect()}
    assert back[10] == TEXTS[10] and back[6] == LONG


def test_pages(spark):
    page = "<html><body><nav>menu</nav><article><h1>T &amp; U</h1><p>a  b<br>c</p></article><footer>the foot of the page</footer></body></html>"
    rows = [(0, "http://a/x", page), (1, "http://a/y", page), (1, "http://a/y", page), (2, None, "<p>free</p>"), (3, "http://b", None), (4, "http://b", ""), (5, "http://a/z", "<p>" + "long " * 50_000), (None, "http://a/q", page)]
    pages = spark.createDataFrame([(*r, "t", 1, 2) for r in rows], "page_id long, url string, html string, text string, wrapper int, host int")
    out = html_wrapper.extract_pages(pages)
    assert out.count() == len(rows)
    texts = {r["page_id"]: r["text"] for r in out.collect()}
    assert texts[0] == "T & U\na b c" and texts[2] == "free" and texts[3] == texts[4] == "" and len(texts[5]) == 249_999
    assert html_wrapper.extract_pages(pages.limit(0)).count() == 0
    back = warc_bundle.round_trip(pages)
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in back.collect()}
    assert back.count() == len(rows) and {(0, "response", None), (1, "revisit", 0), (None, "revisit", 0), (4, "response", None)} <= kinds
    assert warc_bundle.round_trip(pages.limit(0)).count() == 0


def test_vectors(spark):
    nan = math.nan
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (2, [1.0, 0.0], 2), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [None, 1.0], 1), (7, [], 1), (8, [1.0, 0.0, 0.0], 1), (9, [1.0, 0.0], None), (0, [1.0, 0.0], 1), (10, [2.0, 0.0], 1)]
    vectors = spark.createDataFrame([(*r, 9, "q") for r in rows], "vec_id long, embedding array<double>, label int, block int, leaf string")
    out = vector_neardup.vector_neardup(vectors)
    assert out.count() == len(rows)
    by = {r["vec_id"]: r for r in out.collect()}
    assert by[0]["n_links"] == by[1]["n_links"] == by[10]["n_links"] == 2 and by[10]["component_id"] == 0
    assert all(by[k]["n_links"] == 0 and by[k]["kept"] for k in (2, 3, 4, 5, 6, 7, 8, 9))


def test_empty_tables(spark, docs, labels, items):
    none = docs.limit(0)
    for out in (decontaminate.contamination(none, items), quality_rank.score(none, labels), toxicity_gru.score(none, labels), secrets.scan(none), ngram_join.ngram_join(none), sharding.shard_by_bytes(none), piece_sampling.encode_rows(none)):
        assert out.count() == 0
    assert vector_neardup.vector_neardup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_stages_keep_columns(spark, docs, labels, items, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, plain, str(tmp_path)).columns == plain.columns
