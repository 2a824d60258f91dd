"""The queries of this subpackage and their SQL, as the entry module registers them."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from treeline.llm import decontaminate, html_wrapper, merkle_manifest, ngram_join, piece_sampling, quality_rank, repeat_groups, secrets, sharding, source_divergence, toxicity_gru, vector_neardup, warc_bundle


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract_pages(_table(spark, sf_dir, "pages"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


def op3_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rank.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


def op6_warc_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_bundle.round_trip(_table(spark, sf_dir, "pages"))


def op7_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_gru.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), shards=40)


def op9_vector_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_neardup.vector_neardup(_table(spark, sf_dir, "embeddings"))


def op10_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.encode_rows(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(_table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(_table(spark, sf_dir, "documents"))


def op13_repeat_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_groups.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f for f in (
            op1_html_wrapper, op2_decontaminate, op3_quality_rank, op4_secrets, op5_ngram_join, op6_warc_bundle, op7_toxicity_gru, op8_sharding, op9_vector_neardup, op10_piece_sampling, op11_merkle_manifest,
            op12_source_divergence, op13_repeat_groups,
        )
    }


_OP6 = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, url, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to, coalesce(url, 'urn:none') AS url
FROM f
"""


_LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_OP2 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents
), i AS (
  SELECT row_number() OVER () AS k, item_id, coalesce({_WORDS}, []) AS w FROM benchmark
), v AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[pos : pos + least(len(w), 13) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS pos FROM i WHERE len(w) > 0)
), s AS (
  SELECT DISTINCT n FROM v
), p AS (
  SELECT r, pos, n, array_to_string(w[pos : pos + n - 1], ' ') AS t FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, s WHERE len(w) >= n)
), h AS (
  SELECT r, pos, p.n, item_id FROM p JOIN v ON v.n = p.n AND v.t = p.t
), c AS (
  SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(pos, pos + n)) FROM h) GROUP BY r
), m AS (
  SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)
"""

_OP5 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[pos : pos + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS pos FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y, c = a.n AND c = b.n AS same FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c >= 0.8 * (a.n + b.n - c) - 1e-9
), r(x, y) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y
), k AS (
  SELECT x, count(*) AS n_links, min(CASE WHEN same THEN y END) AS least FROM l GROUP BY x
), m AS (
  SELECT x, min(y) AS component_id FROM r GROUP BY x
)
SELECT doc_id, least(doc_id, coalesce(k.least, doc_id)) AS class_id, component_id, coalesce(n_links, 0) AS n_links, doc_id = component_id AS kept
FROM d JOIN m ON m.x = doc_id LEFT JOIN k ON k.x = doc_id
"""

_OP9 = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), g AS (
  SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(v, lambda x: x * x)) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), r(x, y) AS (
  SELECT vec_id, vec_id FROM e UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y
), n AS (
  SELECT x, count(DISTINCT y) AS n_links FROM l GROUP BY x
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) ON x = vec_id LEFT JOIN n ON n.x = vec_id
"""


def _op11(levels: int = 6, tops: int = 4) -> str:
    """Level by level; 16 ** levels rows a source and 16 ** tops sources fit."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256(concat({', '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))}, {field(text)}))"
    # crc32 by bytes of the decimal id, as SQL has no function for it.
    step = "list_reduce([xor(c, ascii(d)), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    rounds = "".join(f", k{i} AS (SELECT * REPLACE (CASE WHEN length(s) >= {i} THEN {step.replace('ascii(d)', f'ascii(substr(s, {i}, 1))::BIGINT')} ELSE c END AS c) FROM k{i - 1})" for i in range(1, 21))
    out = f"""
WITH k0 AS (
  SELECT row_number() OVER () AS r, *, CAST(doc_id AS VARCHAR) AS s, 4294967295::BIGINT AS c FROM documents
){rounds}, l AS (
  SELECT r, doc_id, source, {leaf('text')} AS leaf,
         CASE WHEN xor(c, 4294967295) % 5 = 0 THEN {leaf(_LOWER)} ELSE {leaf('text')} END AS other FROM k20
), n0 AS (
  SELECT source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, leaf AS h, r FROM l
), w0 AS (
  SELECT l.r, doc_id, leaf, n0.tree, n0.p, '' AS sib, CASE WHEN doc_id IS NULL THEN leaf ELSE other END AS cur FROM l JOIN n0 USING (r)
)"""

    def climb(n: str, w: str, k: int, to: str, up: str) -> str:
        return f""", g{to} AS (
  SELECT tree, p // 16 AS run, list(h ORDER BY p) AS hs, count(*) OVER (PARTITION BY tree) AS runs FROM {n} GROUP BY tree, p // 16
), {up} AS (
  SELECT {w}.r, doc_id, leaf, {w}.tree, CASE WHEN one THEN {w}.p ELSE {w}.p // 16 END AS p,
         CASE WHEN one THEN sib ELSE sib || array_to_string(list_concat(hs[1 : {w}.p % 16], hs[{w}.p % 16 + 2 :]), '') END AS sib,
         CASE WHEN one THEN cur ELSE sha256(array_to_string(list_concat(hs[1 : {w}.p % 16], [cur], hs[{w}.p % 16 + 2 :]), '')) END AS cur
  FROM (SELECT {w}.*, runs = 1 AND len(hs) = 1 AS one, hs FROM {w} JOIN g{to} ON {w}.tree IS NOT DISTINCT FROM g{to}.tree AND {w}.p // 16 = g{to}.run) AS {w}
), {to} AS (
  SELECT tree, run AS p, CASE WHEN runs = 1 AND len(hs) = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM g{to}
)"""

    for k in range(levels):
        out += climb(f"n{k}", f"w{k}", k, f"n{k + 1}", f"w{k + 1}")
    out += f""", t0 AS (
  SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS p, h, tree AS source FROM n{levels}
), v0 AS (
  SELECT r, doc_id, leaf, 0 AS tree, t0.p, sib, cur, t0.h AS subroot FROM w{levels} AS w JOIN t0 ON w.tree IS NOT DISTINCT FROM t0.source
)"""
    for k in range(tops):
        out += climb(f"t{k}", f"v{k}", k, f"t{k + 1}", f"v{k + 1}")
    return out + f"""
SELECT v.doc_id, v.leaf, v0.subroot, t.h AS root, sha256(v.sib) AS proof_sha256, v.cur AS folded_root, v.cur = t.h AS verified
FROM v{tops} AS v JOIN v0 USING (r), t{tops} AS t
"""


_OP12 = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), g AS (
  SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), v AS (
  SELECT lang, term, count(*) AS n FROM d GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), l AS (
  SELECT lang, count(*) AS v, sum(n) AS n FROM v GROUP BY lang
), c AS (
  SELECT g.lang, g.source, v.term, coalesce(x.n, 0) AS n, v.n AS nl
  FROM g JOIN v USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM d GROUP BY ALL) AS x ON x.lang = g.lang AND x.source = g.source AND x.term = v.term
), s AS (
  SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source
), p AS (
  SELECT c.lang, c.source, c.term, c.n, 1 + (CAST(1000000000 AS HUGEINT) * (c.n + 5)) // CAST(total + 5 * v AS HUGEINT) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (nl + 5)) // CAST(l.n + 5 * v AS HUGEINT) AS q
  FROM c JOIN s ON s.lang = c.lang AND s.source = c.source JOIN l ON l.lang = c.lang
), a AS (
  SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p AS x JOIN p AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), b AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g JOIN g AS h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN a ON a.lang = g.lang AND a.source = g.source AND a.item = h.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q
), o AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM b
)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 50
"""


_OP13 = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), w AS (
  SELECT r, i, md5_number(substr(x, 2 * i + 1, 400)) AS k FROM (SELECT r, x, unnest(range(0, strlen(x) // 2 - 199)) AS i FROM d WHERE strlen(x) >= 400)
), s AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1
), o AS (
  SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, CASE WHEN i > 200 + lag(i) OVER (PARTITION BY r ORDER BY i) THEN 1 ELSE 0 END AS fresh FROM s)
), m AS (
  SELECT r, min(i) AS a, max(i) + 200 AS b FROM o GROUP BY r, run
), k AS (
  SELECT r, b AS a, coalesce(lead(a) OVER (PARTITION BY r ORDER BY a), 1000000000) AS b FROM (SELECT r, a, b FROM m UNION ALL SELECT r, -1, 0 FROM d)
), t AS (
  SELECT r, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS kept FROM k JOIN d USING (r) GROUP BY r
), c AS (
  SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM m GROUP BY r
)
SELECT doc_id, CAST(strlen(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t USING (r) LEFT JOIN c USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": _OP2, "op5_ngram_join": _OP5, "op6_warc_bundle": _OP6, "op9_vector_neardup": _OP9, "op11_merkle_manifest": _op11(), "op12_source_divergence": _OP12, "op13_repeat_groups": _OP13}
