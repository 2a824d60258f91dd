"""Cases at the edges: hard pages, null ids, skewed groups, values of any length, blocks of items, queries against SQL."""

import math
import random
import time
from functools import lru_cache
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from treeline.llm import decontaminate, html_wrapper, ngram_join, queries, secrets, sharding, shared, vector_neardup, warc_bundle

DATA = Path("/root/testdata/sf0.001")
here = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


@here
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    want, out = con.sql(queries.oracle_sql()[name]), queries.queries()[name](spark, str(DATA))
    assert sorted(out.columns) == sorted(want.columns)
    assert sorted(map(str, out.select(*want.columns).collect())) == sorted(f"Row({', '.join(f'{c}={v!r}' for c, v in zip(want.columns, r, strict=True))})" for r in want.fetchall())


def test_pages_of_any_depth_are_read_in_linear_time():
    deep = "<div>" * 50_000 + "deep" + "</div>" * 50_000 + "<p>after"
    for page, text in (
        (deep, "deep\nafter"), ("<b>" * 50_000 + "one<p>two</b>", "one\ntwo"), ("<div>" * 400 + "<nav>menu</nav><p>text" + "</div>" * 400, "text"), ("<p>x</p>" + "<a " * 200_000, "x"),
        ("<p>x</p>" + '<a ="' * 200_000, "x"), ("<p>a<!-- <p>b", "a"), ("<p>1 < 2</p><p title=it's>b", "1 < 2\nb"), ("<b>" * 20_000 + "</i>" * 20_000 + "x", "x"),
    ):
        began = time.perf_counter()
        assert html_wrapper.extract(page, None) == text
        assert time.perf_counter() - began < 20
    assert html_wrapper.extract("<div>" * 300 + "x1" + "</div>" * 300, html_wrapper.from_json(html_wrapper.to_json(html_wrapper.induce(["<div>" * 300 + f"x{i}" + "</div>" * 300 for i in range(3)])))) == "x1"


def test_tags_with_slashes():
    assert html_wrapper.extract("<a href=/x/>link</a> free <div/>text", None) == "link free\ntext"


def test_a_class_name_counts_as_a_whole():
    page = lambda i: f'<body><article><h1>A{i}</h1><div class="share-price"><p>Price {i} rose</p></div><p>Text {i} {"more " * 9}</p><div class="share-buttons"><p>Tell {i}</p></div></article></body>'
    assert html_wrapper.extract(page(7), html_wrapper.induce([page(i) for i in range(4)])) == f"A7\nPrice 7 rose\nText 7 {('more ' * 9).strip()}"


def test_long_lists_of_siblings_keep_their_order():
    page = lambda k, n: "".join(f"<p>a{k}.{i}</p><div>b{k}.{i}</div>" for i in range(n))
    wrapper = html_wrapper.induce([page(0, 700), page(1, 650)])
    assert html_wrapper.extract(page(2, 660), wrapper) == "\n".join(f"a2.{i}\nb2.{i}" for i in range(660))


def test_wrappers_too_large_to_send(spark, monkeypatch):
    page = lambda i: f"<body><div>Site</div><p>Words of {i}</p></body>"
    pages = spark.createDataFrame([(i, f"http://h{i % 2}/{i}", page(i)) for i in range(20)] + [(1, "http://h1/1", page(1))] * 30 + [(99, None, None)], "page_id long, url string, html string")
    want = sorted(map(str, html_wrapper.extract_pages(pages).collect()))
    monkeypatch.setattr(html_wrapper, "BROADCAST_BYTES", 0)
    assert sorted(map(str, html_wrapper.extract_pages(pages).collect())) == want and len(want) == 51


def test_null_item_ids(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, "none")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "alpha"), (None, "beta"), (5, "alpha beta"), (7, "gamma"), (None, None)], "item_id long, text string")
    for words in (decontaminate.BLOCK_WORDS, 1):
        found = decontaminate.judge(decontaminate.find_hits(docs, items, block_words=words))
        rows = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["__items"]) for r in found.collect()}
        assert rows == {1: (2, 2, 2, [5, None]), 2: (2, 1, 1, [7]), 3: (1, 0, 0, [])}
    assert decontaminate.contamination(docs, items).filter("doc_id = 1").first()["items_sha256"] == __import__("hashlib").sha256(b"5").hexdigest()


def test_blocks_carry_all_columns(spark):
    docs = spark.createDataFrame([(i % 3, f"w{i} alpha beta w{i}", f"x{i}") for i in range(30)] + [(None, None, "n")], "doc_id long, text string, hits string")
    items = spark.createDataFrame([(i, t) for i, t in enumerate(["alpha beta", "beta", "w3", "w4 alpha", "nothing here"])], "item_id long, text string")
    one, many = (sorted(map(str, decontaminate.judge(decontaminate.find_hits(docs, items, block_words=n)).drop("__hits").collect())) for n in (1000, 1))
    assert one == many and len(one) == 31


def test_an_automaton_of_equal_words_is_built_in_linear_time():
    began = time.perf_counter()
    matcher = decontaminate.Matcher([(1, [b"a"] * 60_000)])
    assert time.perf_counter() - began < 20 and matcher.find([b"a"] * 13)[1] == {1} and matcher.find([b"a"] * 12)[1] == set()


def test_guess_cost_is_the_least():
    rng = random.Random(4)

    def least(value):
        brute, by = secrets._brute(value), {}
        for i, j, cost in secrets.segments(value):
            by.setdefault(i, []).append((j, cost))

        @lru_cache(None)
        def go(i):
            if i == len(value):
                return 0.0
            options = [(j, brute[j] - brute[i] + math.log10(2)) for j in range(i + 1, len(value) + 1)] + by.get(i, [])
            return min(cost + (secrets.JOIN + go(j) if j < len(value) else 0) for j, cost in options)

        return max(0.0, go(0))

    for _ in range(400):
        value = "".join(rng.choice(["pass", "word", "a", "1", "2", "19", "qwe", "!", "Xy", "abab", "P4ss", "20240131", "é"]) for _ in range(rng.randint(0, 9)))
        assert abs(secrets.guess_cost(value) - least(value)) < 1e-9


def test_runs_are_all_maximal_runs():
    rng = random.Random(2)
    for _ in range(400):
        v, want = "".join(rng.choice("ab") for _ in range(rng.randint(0, 20))), set()
        for p in range(1, len(v) // 2 + 1):
            for a in range(len(v)):
                for b in range(a + 2 * p, len(v) + 1):
                    holds = lambda x, y, q: all(v[k] == v[k + q] for k in range(x, y - q))  # noqa: B023, E731
                    if holds(a, b, p) and not (a and holds(a - 1, b, p)) and not (b < len(v) and holds(a, b + 1, p)) and not any(holds(a, b, q) for q in range(1, p)):
                        want.add((a, b, p))
        found = list(secrets.runs(v))
        assert set(found) == want and len(found) == len(want)


def test_long_values_are_judged_whole():
    cost = secrets.guess_cost
    assert cost("ab1" * 13) < cost("ab1" * 40) < cost("ab1" * 4000) < secrets.LEAST_COST and cost("a" * 100_000) < secrets.LEAST_COST
    assert not secrets.find_spans('auth: "' + "xz1" * 4000 + '"')
    rng = random.Random(1)
    value = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+") for _ in range(20_000))
    assert cost(value) > 20_000 and [s[:3] for s in secrets.find_spans(f'auth: "{value}"')] == [(7, 20_007, "guess")]


def test_shards_of_many_equal_rows(spark):
    rows = [(None, None)] * 700 + [(5, "same text")] * 900 + [(i, f"text {i}") for i in range(1000)]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 8)
    found = out.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top"), F.countDistinct("slot").alias("d"), F.sum("size").alias("b")).collect()
    mean = sum(r["b"] for r in found) / 8
    assert len(found) == 8 and sum(r["n"] for r in found) == 2600 and all(r["n"] == r["d"] == r["top"] + 1 and abs(r["b"] - mean) < 0.1 * mean for r in found)


def test_cuts_grown_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(2)
    cloud = rng.standard_normal((900, 6))
    cloud = np.concatenate([cloud, cloud[:200] + rng.standard_normal((200, 6)) * 0.05, np.tile(cloud[:1], (150, 1))])
    unit = cloud / np.linalg.norm(cloud, axis=1)[:, None]
    want = (unit @ unit.T >= 0.98).sum(1) - 1
    vectors = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(cloud)], "vec_id long, embedding array<double>, label int")
    for name, value in (("LEAF", 40), ("BLOCK", 32), ("SAMPLE", 260)):
        monkeypatch.setattr(vector_neardup, name, value)
    rounds = []
    grown = vector_neardup._grown
    monkeypatch.setattr(vector_neardup, "_grown", lambda placed, full, reach, k: rounds.append(k) or grown(placed, full, reach, k))
    out = {r["vec_id"]: r["n_links"] for r in vector_neardup.vector_neardup(vectors).collect()}
    assert len(rounds) >= 3 and all(out[i] <= want[i] for i in out) and sum(out.values()) >= 0.99 * want.sum()


def test_records_by_identifier(spark, tmp_path):
    pages = spark.createDataFrame([(i, "" if i == 3 else f"http://h/{i}", f"page {i} " * 40) for i in range(50)] + [(60, None, None), (61, "a\nb", "")], "page_id long, url string, html string")
    index = warc_bundle.write_bundles(pages, str(tmp_path / "w"))
    got = {r["page_id"]: (r["url"], r["payload"].decode()) for r in warc_bundle.find_records(index, str(tmp_path / "w"), [3, 7, 60, 61, 99]).collect()}
    assert got == {3: ("", "page 3 " * 40), 7: ("http://h/7", "page 7 " * 40), 60: ("urn:none", ""), 61: ("a%0Ab", "")}


def test_samples_of_labelled_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c"), (4, "d"), (4, "e"), (None, "f")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (4, 1), (9, 1), (8, 0), (None, 1), (3, None)], "doc_id long, m int")
    none = lambda c: F.lit(False)  # noqa: E731, ARG005
    rows = shared.labelled_sample(docs, labels, "m", none, 10, 1, "text").collect()
    assert sorted(tuple(r) for r in rows) == [(1, 1, "a"), (3, 0, "c"), (4, 1, "d"), (4, 1, "e")]
    assert len(shared.labelled_sample(docs, labels, "m", none, 1, 1, "text").collect()) == 2


def test_join_with_many_empty_rows(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(i, None if i % 2 else "") for i in range(40)] + [(100, text), (101, text), (None, text)]
    out = {r["doc_id"]: r for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(out) == 43 and all(out[i]["kept"] and out[i]["n_links"] == 0 and out[i]["component_id"] == i for i in range(40))
    assert (out[100]["n_links"], out[101]["component_id"], out[None]["kept"], out[None]["component_id"]) == (1, 100, True, None)


def test_stages_keep_all_clean_rows(spark, tmp_path):
    """Rows with null and repeated ids, no labels of both classes, nothing planted: every distinct text goes through all stages."""
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "an item that no text holds")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = lambda tag: " ".join(f"{tag}{k}" for k in range(40))
    rows = [(1, text("a")), (1, text("b")), (2, text("c")), (None, text("d")), (None, text("d")), (None, None), (3, ""), (4, None), (2, text("c"))]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == (9 if name == "toxicity" else 8), name
