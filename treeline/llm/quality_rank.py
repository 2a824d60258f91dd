"""Quality by Bradley-Terry pairwise ranking.

A text has a strength s = w . f(text). For a pair of a better and a worse text the model says that
the better one wins with probability 1 / (1 + exp(-(s_better - s_worse))), so w is learned by
logistic loss on feature differences alone; no intercept exists. The cut between keeping and
dropping is a quantile of the training texts' strengths, chosen to give the fewest errors, and
scores are squeezed so that the cut is 0.5.

f is a bounded description of the whole text: shares of kinds of characters, word lengths,
repetition of words and lines, marks at line and word ends. One pass over the text makes it;
the table of features is written once, and training and scoring read that.

Training rows: all labelled rows that are not held out. They are dealt into buckets of about BUCKET
rows by hash, and each row is paired with PAIRS rows of the other label in its bucket; rows of a rare
label go to several buckets, with a weight that keeps their share. Each step of Newton's method sums
loss, gradient and curvature over all pairs in tasks; the driver holds these sums alone. The cut is
found over the strengths of all training rows, ranked by Spark.

Defined cases: null and empty texts have the features of no text (all 0) and are scored like
others; texts of any length are described whole; labels that are null, stand for no document or
differ for one doc_id are not used; with one class only, or no labels, every score is 0.5 and predicted 1;
repeated rows each give a row; an empty documents table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.shared import settle, small_side, text_slices
from treeline.llm.text import FOLD

BUCKET, PAIRS, RARE, STEPS, RIDGE = 2000, 4, 64, 30, 1e-4

_KINDS = {
    "upper": [*range(0x41, 0x5B)], "lower": [*range(0x61, 0x7B)], "digit": [*range(0x30, 0x3A)], "high": [*range(0x80, 0x100)], "blank": [0x20, 0x09], "line": [0x0A, 0x0D],
    "stop": [0x2E, 0x3F], "comma": [0x2C, 0x3B, 0x3A], "bang": [0x21], "bar": [0x7C], "mark": [ord(c) for c in "*#$%&@^~_=+<>\\/"], "quote": [0x22, 0x27, 0x28, 0x29, 0x5B, 0x5D, 0x7B, 0x7D, 0x2D],
}
_TABLE = np.full(256, len(_KINDS), np.uint8)
for _k, _codes in enumerate(_KINDS.values()):
    _TABLE[_codes] = _k
NAMES = (
    "log_words", "word_length", "log_line_words", "distinct_words", "same_as_last", "top_word", "distinct_lines", "distinct_pairs", "zipped", "wordless",
    *_KINDS, "other", "upper_start", "marks_a_word", "stops_a_word", "repeat_run", "period_words",
)


def describe(text: str | None) -> np.ndarray:
    """The features of a text, in the order of NAMES; every one is finite."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    ws = raw.translate(FOLD).split()
    out = np.zeros(len(NAMES))
    if not raw:
        return out
    n, size = len(ws), len(raw)
    shares = np.bincount(_TABLE[np.frombuffer(raw, np.uint8)], minlength=len(_KINDS) + 1) / size
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[0] = np.log1p(n)
    out[9] = n == 0
    out[10 : 10 + len(shares)] = shares
    out[8] = min(1.0, len(zlib.compress(raw, 1)) / size)
    if n:
        ids: dict[bytes, int] = {}
        code = np.fromiter((ids.setdefault(w, len(ids)) for w in ws), np.int64, n)
        counts = np.bincount(code)
        out[1] = sum(map(len, ws)) / n / 10
        out[2] = np.log1p(n / max(1, len(lines)))
        out[3] = len(ids) / n**0.8
        if n > 1:
            same = code[1:] == code[:-1]
            out[4] = same.mean()
            out[7] = len(np.unique(code[1:] * len(ids) + code[:-1])) / (n - 1)
            changes = np.flatnonzero(np.concatenate(([True], ~same, [True])))
            out[-2] = np.log1p(np.diff(changes).max()) / 5
            # Words that return at the same distance as they did before: looped passages.
            order = np.argsort(code, kind="stable")
            gaps = np.diff(order)[code[order][1:] == code[order][:-1]]
            out[-1] = (np.bincount(np.minimum(gaps, 4096)).max() / n) if len(gaps) else 0.0
        out[5] = counts.max() / n
        words = raw.split()
        out[-5] = sum(w[:1].isupper() for w in words) / max(1, len(words))
        out[-4] = (shares[list(_KINDS).index("mark")] + shares[list(_KINDS).index("bang")] + shares[list(_KINDS).index("bar")]) * size / n
        out[-3] = shares[list(_KINDS).index("stop")] * size / n
    if lines:
        out[6] = len(set(lines)) / len(lines)
    return out


def features(docs: DataFrame) -> DataFrame:
    """doc_id and f, the features, for every row of docs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            rows = np.array([describe(t) for t in batch.column("text").to_pylist()]).ravel()
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(rows))], ["doc_id", "f"])

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return slim.mapInArrow(scan, "doc_id long, f array<double>")


class Ranking:
    """Weights on standardised features and the cut."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray) -> None:
        self.mean, self.scale = mean, scale
        self.w, self.cut = np.zeros(2 * len(mean)), 0.0

    def expand(self, rows: np.ndarray) -> np.ndarray:
        """Standardised features, clipped, with their squares: a share may be bad when high and when low."""
        z = np.clip((rows - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, z * z / 6], 1)

    def strengths(self, rows: np.ndarray) -> np.ndarray:
        return self.expand(rows) @ self.w

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strengths(rows) - self.cut, -30, 30)))


def held_out(doc_id: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(described: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, h, mark, f of every labelled row that is not held out. An id whose labels differ has none; rows that repeat an id and its features count once."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("mark")).filter("doc_id is not null and mark in (0, 1)").filter(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.min("mark").alias("mark"), F.max("mark").alias("other")).filter("mark = other").drop("other")
    return described.join(small_side(known, 16), "doc_id").withColumn("h", F.xxhash64("f")).dropDuplicates(["doc_id", "h"]).select("doc_id", "h", "mark", "f")


def _dealt(rows: DataFrame, counts: dict[int, int]) -> tuple[DataFrame, int]:
    """rows in buckets, each bucket whole in one file and in a fixed order, and in how many buckets a row of the rarer label is."""
    n = sum(counts.values())
    buckets = -(-n // BUCKET)
    rare = min(counts, key=lambda k: (counts[k], k))
    copies = min(buckets, -(-RARE * buckets // counts[rare]))
    first = F.expr(f"pmod(xxhash64(doc_id, h, 17), {buckets})")
    spread = F.when(F.col("mark") == rare, F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))
    out = rows.withColumn("copy", F.explode(spread)).withColumn("bucket", (first + F.col("copy")) % buckets)
    parts = min(buckets, max(rows.sparkSession.sparkContext.defaultParallelism, n // 200_000 + 1))  # files below a row group of Parquet, so that no bucket is torn
    return settle(out.repartition(parts, "bucket").sortWithinPartitions("bucket", "mark", "doc_id", "h"), "quality-buckets"), copies


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(NAMES))


def _summed(rows: DataFrame, batches_to_sums) -> np.ndarray:  # noqa: ANN001 - of an iterator of batches a flat array of sums
    """The sums of all tasks: a row a task comes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = batches_to_sums(batches)
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.float64()))], ["s"])

    found = rows.mapInArrow(run, "s array<double>").collect()
    return np.sum([r["s"] for r in found], 0)


def _moments(rows: DataFrame, about: np.ndarray) -> np.ndarray:
    """Means of the differences to `about`, and of their squares."""
    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        out = np.zeros(1 + 2 * len(NAMES))
        for batch in batches:
            d = _matrix(batch.column("f")) - about
            out += np.concatenate([[len(d)], d.sum(0), (d * d).sum(0)])
        return out if out[0] else None

    sums = _summed(rows, run)
    return sums[1:].reshape(2, -1) / sums[0]


def _pairs(marks: np.ndarray, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the better and the worse row of each pair of a bucket, and whose pair it is."""
    rng = np.random.default_rng(bucket)
    better, worse = np.flatnonzero(marks == 1), np.flatnonzero(marks == 0)
    if not len(better) or not len(worse):
        return (np.zeros(0, np.int64),) * 3
    a = np.concatenate([np.repeat(better, PAIRS), rng.choice(better, len(worse) * PAIRS)])
    b = np.concatenate([rng.choice(worse, len(better) * PAIRS), np.repeat(worse, PAIRS)])
    return a, b, np.repeat([1, 0], [len(better) * PAIRS, len(worse) * PAIRS])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, features, marks), bucket after bucket, of rows in order of buckets."""
    held: list[pa.RecordBatch] = []

    def out() -> tuple[int, np.ndarray, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks()
        return rows["bucket"][0].as_py(), _matrix(rows["f"].combine_chunks()), rows["mark"].to_numpy()

    for batch in batches:
        at = batch.column("bucket").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            if held and held[-1].column("bucket")[0].as_py() != at[lo]:
                yield out()
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield out()


def _slope(rows: DataFrame, ranking: Ranking, weights: tuple[float, float]) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature at the ranking's weights, over the pairs of all buckets. weights: those of a pair that belongs to a row of label 0 or 1."""
    k = len(ranking.w)

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        out = np.zeros(2 + k + k * k)
        for bucket, f, marks in _buckets(batches):
            a, b, whose = _pairs(marks, bucket)
            x, weight = ranking.expand(f), np.asarray(weights)[whose]
            diff = x[a] - x[b]
            margin = diff @ ranking.w
            lost = 1 / (1 + np.exp(np.clip(margin, -700, 700)))
            bent = diff * (weight * lost * (1 - lost))[:, None]
            out += np.concatenate([[weight.sum(), (weight * np.logaddexp(0, -margin)).sum()], -(diff * (weight * lost)[:, None]).sum(0), (diff.T @ bent).ravel()])
        return out if out[0] else None

    sums = _summed(rows, run)
    n, w = sums[0], ranking.w
    return sums[1] / n + RIDGE / 2 * (w @ w), sums[2 : 2 + k] / n + RIDGE * w, sums[2 + k :].reshape(k, k) / n + RIDGE * np.eye(k)


def _cut(rows: DataFrame, ranking: Ranking) -> float:
    """The cut between strengths with the fewest errors, in the middle of such cuts; labels weighted as they come. Rows are ranked inside ranges of strength and offset by the ranges before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = pa.array(np.where(batch.column("mark").to_numpy() == 1, 1, -1))
            yield pa.RecordBatch.from_arrays([pa.array(ranking.strengths(_matrix(batch.column("f")))), step], ["strength", "step"])

    ranged = settle(rows.mapInArrow(run, "strength double, step long").repartitionByRange("strength", "step").withColumn("range", F.spark_partition_id()), "quality-ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"), F.sum("step").alias("d"))  # a row a range
    base = sizes.select("range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"base_{c}") for c in ("n", "d")])
    order = Window.partitionBy("range").orderBy("strength", "step")
    ranked = ranged.join(F.broadcast(base), "range").select("strength", (F.col("base_n") + F.row_number().over(order)).alias("k"), (F.col("base_d") + F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("wrong"))
    ranked = settle(ranked, "quality-ranks")
    # Below rank 0 nothing is dropped: as many errors as there are rows of label 0, from which `wrong` counts.
    least = min(0, ranked.agg(F.min("wrong")).first()[0])
    found = ranked.filter(F.col("wrong") == least).agg(F.count("*").alias("n"), F.sum("k").alias("k"), F.min("k").alias("first")).first()
    none = least == 0
    middle, first = round((found["k"] or 0) / (found["n"] + none)), 0 if none else found["first"]
    there = {r["k"]: r for r in ranked.filter(F.col("k").isin(*{k for m in (middle, first) for k in (m, m + 1, 1)})).collect()}  # five rows at most
    at = middle if (there[middle]["wrong"] if middle else 0) == least else first
    low = there[max(at, 1)]["strength"]
    return (low + there[at + 1]["strength"]) / 2 if at and at + 1 in there else low


def train(described: DataFrame, labels: DataFrame) -> Ranking | None:
    """A ranking fitted on all labelled rows; none if a class is missing."""
    rows = settle(labelled(described, labels), "quality-labelled")
    counts = {r["mark"]: r["n"] for r in rows.groupBy("mark").agg(F.count("*").alias("n")).collect()}  # a row a label
    if len(counts) < 2:
        return None
    dealt, copies = _dealt(rows, counts)
    own = dealt.filter("copy = 0")
    mean = _moments(own, np.zeros(len(NAMES)))[0]
    off, square = _moments(own, mean)
    ranking = Ranking(mean, np.sqrt(np.maximum(square - off * off, 0)) + 1e-6)
    weights = tuple(1 / copies if k == min(counts, key=lambda k: (counts[k], k)) else 1.0 for k in (0, 1))
    base, best, move = ranking.w, np.inf, np.zeros_like(ranking.w)
    for _ in range(STEPS):
        ranking.w = base + move
        loss, gradient, curvature = _slope(dealt, ranking, weights)
        if loss > best:  # too far: half the way
            move = move / 2
            continue
        gain, base, best = best - loss, ranking.w, loss
        if gain < 1e-9:
            break
        move = -np.linalg.solve(curvature, gradient)
    ranking.w = base
    ranking.cut = float(_cut(own, ranking))
    return ranking


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    described = settle(features(docs), "quality-features")
    shared = docs.sparkSession.sparkContext.broadcast(train(described, labels))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranking = shared.value
        for batch in batches:
            rows = batch.column("f").flatten().to_numpy().reshape(-1, len(NAMES))
            scores = ranking.scores(rows) if ranking else np.full(len(rows), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    out = described.mapInArrow(scan, "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
