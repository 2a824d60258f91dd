"""Near-duplicate vectors by collision counting over one-dimensional projections.

Unit vectors with cosine at least c lie within distance d = sqrt(2 - 2c). On a random unit-variance
projection their difference is at most w = WINDOW_SIGMAS * d with a known chance. Many
projections are drawn; each is sorted, a window of half-width w is laid around every query's
place in the order, and a pair collects one count for each projection in which the other
vector lies inside the window. Pairs with at least the count that `least_count` calibrates for
the target recall are verified by cosine in double precision.

Only vectors of equal label are compared. A label's vectors are cut into leaves of bounded
size at quantiles of sampled projections; a vector just above a cut is also put below it, so
every pair within the cut's window meets in exactly one leaf (copies made at the same cut do not
count their pair again). Cuts are grown in rounds, for all leaves that are too large at once: each
is a task that gets the projections of at most SAMPLE of its vectors, so a round makes leaves smaller by up to
SAMPLE / 64 times and neither driver nor task holds more at any size. A leaf that no cut parts, such as a knot of near copies, is dealt
into blocks, and each pair of blocks is a task. Only counts and a spanning forest leave a task.

Defined cases: vectors that are null, zero, empty or hold a null or non-finite component,
rows with a null label and rows with a null vec_id link with nothing; vectors of different
lengths never link, vectors of any length are compared whole; repeated vec_ids are one vector each time they differ, and equal rows count once;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.components import connected_components, local_components
from treeline.llm.shared import BROADCAST_BYTES, settle, small_side, unsettle

THRESHOLD, PROJECTIONS, TARGET_RECALL = 0.98, 24, 0.9995
WINDOW_SIGMAS, CUT_SIGMAS = 2.0, 3.5
#: Vectors meant for one leaf, and in one block of a leaf that holds more.
LEAF, BLOCK = 4096, 2048
#: Vectors of a leaf, in one round, whose projections place its cuts. The sample shapes the leaves, not the result.
SAMPLE = 65_536
#: Cuts above one another: each has a bit in a row's marks.
DEEPEST = 60


def least_count(m: int = PROJECTIONS, recall: float = TARGET_RECALL, sigmas: float = WINDOW_SIGMAS) -> int:
    """The largest count that a pair at the threshold reaches with the target probability, collisions being independent."""
    p = math.erf(sigmas / math.sqrt(2))
    tail = 0.0
    for k in range(m, -1, -1):
        tail += math.comb(m, k) * p**k * (1 - p) ** (m - k)
        if tail >= recall:
            return k
    return 0


def projections(vectors: np.ndarray) -> np.ndarray:
    """Places of the unit vectors on the PROJECTIONS lines drawn for their dimension."""
    lines = np.random.default_rng(vectors.shape[1]).standard_normal((vectors.shape[1], PROJECTIONS))
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    return ((vectors @ lines) / norms[:, None]).astype(np.float32)


def usable(vectors: pd.Series) -> np.ndarray:
    """Which rows hold a vector that can link."""

    def fit(v) -> bool:  # noqa: ANN001
        if v is None or len(v) == 0:
            return False
        v = np.asarray(v, np.float64)
        return bool(np.isfinite(v).all() and v.any() and np.isfinite(v @ v) and v @ v > 0)

    return np.fromiter((fit(v) for v in vectors), bool, len(vectors))


def grow(sample: np.ndarray, scale: float, reach: float, most: int, room: int) -> list:
    """Cuts of one leaf: nested [projection, cut, lower, upper], or [] for a leaf. scale: vectors a sampled one stands for; most: vectors meant for a leaf; room: cuts that may stand above one another."""
    if len(sample) * scale <= most or len(sample) < 64 or not room:
        return []
    line = int(np.argmax(np.quantile(sample, 0.9, axis=0) - np.quantile(sample, 0.1, axis=0)))
    at = sample[:, line]
    cut = float(np.median(at))
    low, high = at < cut + reach, at >= cut
    if max(low.mean(), high.mean()) > 0.9:  # a knot that cuts do not part
        return []
    return [line, cut, grow(sample[low], scale, reach, most, room - 1), grow(sample[high], scale, reach, most, room - 1)]


def leaves(tree: list, places: np.ndarray, reach: float, above: str = "") -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(leaf, rows, marks) below the leaf `above`: marks has a bit for each cut at which the row was also put below."""

    def walk(node: list, rows: np.ndarray, marks: np.ndarray, name: str) -> Iterator:
        if not node or not len(rows):
            if len(rows):
                yield name, rows, marks
            return
        line, cut, lower, upper = node
        at = places[rows, line]
        over, near = at >= cut, at < cut + np.float32(reach)
        copied = marks | np.where(over, np.int64(1) << len(name), 0)
        yield from walk(lower, rows[near], copied[near], name + "0")
        yield from walk(upper, rows[over], marks[over], name + "1")

    yield from walk(tree, np.arange(len(places)), np.zeros(len(places), np.int64), above)


_LEAF_KEY = ["label", "dim", "leaf"]
_ROW_DDL = "vec_id long, label string, dim int, leaf string, marks long, embedding array<double>"


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _grown(placed: DataFrame, full: DataFrame, reach: float, round_: int) -> DataFrame:
    """label, dim, leaf, tree (as text) of the leaves full(label, dim, leaf, n) that cuts part."""

    def lay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, group in frame.groupby("dim"):
                yield group[[*_LEAF_KEY, "n"]].assign(places=list(projections(_stacked(group["embedding"]))))

    def cut(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        places = np.stack(group["places"].to_numpy()).astype(np.float32)
        tree = grow(places, float(group["n"].iloc[0]) / len(group), reach, most, DEEPEST - len(key[2]))
        return pd.DataFrame({"label": [key[0]], "dim": np.array([key[1]], np.int32), "leaf": [key[2]], "tree": [json.dumps(tree)]})

    most = LEAF
    dice = F.pmod(F.xxhash64("vec_id", F.lit(round_)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = placed.join(small_side(full, 128), _LEAF_KEY).filter(dice * F.col("n") < SAMPLE * 0.98).select(*_LEAF_KEY, "n", "embedding")
    laid = drawn.mapInPandas(lay, "label string, dim int, leaf string, n long, places array<float>")
    return laid.groupBy(*_LEAF_KEY).applyInPandas(cut, "label string, dim int, leaf string, tree string").filter("tree <> '[]'")


def _parted(placed: DataFrame, trees: DataFrame, reach: float) -> DataFrame:
    """placed with the rows of leaves that have a tree in the leaves below it."""

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list] = {}
        for frame in frames:
            for (label, dim, leaf, text), group in frame.groupby([*_LEAF_KEY, "tree"], dropna=False):
                if not isinstance(text, str):
                    yield group.drop(columns="tree")
                    continue
                if text not in known:
                    known.clear()
                    known[text] = json.loads(text)
                for name, at, marks in leaves(known[text], projections(_stacked(group["embedding"])), reach, leaf):
                    out = group.iloc[at]
                    yield pd.DataFrame({"vec_id": out["vec_id"], "label": label, "dim": np.int32(dim), "leaf": name, "marks": out["marks"] | marks, "embedding": out["embedding"]})

    held = trees.agg(F.coalesce(F.sum(F.octet_length("tree") + 64), F.lit(0))).first()[0]
    joined = placed.join(F.broadcast(trees) if held <= BROADCAST_BYTES else trees, _LEAF_KEY, "left")
    return joined.select("vec_id", *_LEAF_KEY, "marks", "embedding", "tree").mapInPandas(part, _ROW_DDL)


def candidate_pairs(a: np.ndarray, b: np.ndarray, window: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) with enough collisions, given places on all projections."""
    order = np.argsort(b, axis=0, kind="stable")
    ranks = np.empty(b.shape, np.uint16)
    starts, widths = np.empty(a.shape, np.uint16), np.empty(a.shape, np.uint16)
    for i in range(b.shape[1]):
        ranks[order[:, i], i] = np.arange(len(b), dtype=np.uint16)
        line = b[order[:, i], i]
        lo, hi = np.searchsorted(line, a[:, i] - np.float32(window), "left"), np.searchsorted(line, a[:, i] + np.float32(window), "right")
        starts[:, i], widths[:, i] = lo, hi - lo
    ranks = np.ascontiguousarray(ranks.T)
    left, right = [], []
    for at in range(0, len(a), 64):
        part = slice(at, at + 64)
        counts = np.zeros((len(a[part]), len(b)), np.uint8)
        for i in range(b.shape[1]):
            counts += (ranks[i][None, :] - starts[part, i][:, None]) < widths[part, i][:, None]
        x, y = np.nonzero(counts >= least)
        left.append(x + at)
        right.append(y)
    return np.concatenate(left), np.concatenate(right)


def _verify(threshold: float):  # noqa: ANN202
    window, least = WINDOW_SIGMAS * math.sqrt(2 - 2 * threshold), least_count()

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        first, second = key[3], key[4]
        vectors = np.stack(group["embedding"].to_numpy()).astype(np.float64)
        ids, marks = group["vec_id"].to_numpy(np.int64), group["marks"].to_numpy(np.int64)
        is_left = (group["block"] == first).to_numpy()
        here = np.flatnonzero(is_left)
        there = here if first == second else np.flatnonzero(~is_left)
        links = np.zeros(len(group), np.int64)
        a = b = np.zeros(0, np.int64)
        if len(here) and len(there):
            places = projections(vectors)
            x, y = candidate_pairs(places[here], places[there], window, least)
            a, b = here[x], there[y]
            fits = ((marks[a] & marks[b]) == 0) & (ids[a] != ids[b])
            if first == second:
                fits &= a < b
            a, b = a[fits], b[fits]
            norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
            close = np.zeros(len(a), bool)
            for at in range(0, len(a), 1 << 16):
                p, q = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
                close[at : at + (1 << 16)] = np.einsum("ij,ij->i", vectors[p], vectors[q]) / (norms[p] * norms[q]) >= threshold
            a, b = a[close], b[close]
            links += np.bincount(a, minlength=len(group)) + np.bincount(b, minlength=len(group))
        label = local_components(len(group), a, b)
        return pd.DataFrame({"vec_id": ids, "links": links, "head": ids[label]})

    return run


def vector_neardup(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding, label)."""
    reach = CUT_SIGMAS * math.sqrt(2 - 2 * threshold)
    fit = F.pandas_udf(lambda v: pd.Series(usable(v)), "boolean")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = rows.filter("vec_id is not null and label is not null and embedding is not null").filter(fit("embedding")).withColumn("dim", F.size("embedding"))
    good = settle(good.dropDuplicates(["vec_id", "label", "embedding"]) if _repeats(rows) else good, "vectors")

    placed = good.select("vec_id", "label", "dim", F.lit("").alias("leaf"), F.lit(0).cast("long").alias("marks"), "embedding")
    for round_ in count():
        counts = settle(placed.groupBy(*_LEAF_KEY).agg(F.count("*").alias("n")), "leaf-counts")
        full = counts.filter(F.col("n") > (2 * LEAF if round_ else LEAF))
        if full.isEmpty() or (trees := settle(_grown(placed, full, reach, round_), "leaf-trees")).isEmpty():
            break
        before, placed = placed, settle(_parted(placed, trees, reach), "placed")
        unsettle(before)
    sizes = counts.select(*_LEAF_KEY, F.ceil(F.col("n") / BLOCK).cast("int").alias("n_blocks"))
    dealt = placed.join(small_side(sizes, 128), _LEAF_KEY).withColumn("block", F.pmod(F.xxhash64("vec_id"), "n_blocks").cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})
    found = settle(met.groupBy("label", "dim", "leaf", "first", "second").applyInPandas(_verify(threshold), "vec_id long, links long, head long"), "links")
    linked = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("vec_id").alias("a"), F.col("head").alias("b")))
    result = linked.filter("links > 0").join(joined.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return rows.select("vec_id").join(result, "vec_id", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def _repeats(rows: DataFrame) -> bool:
    return not rows.groupBy("vec_id").count().filter("count > 1 and vec_id is not null").isEmpty()
