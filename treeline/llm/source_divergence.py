"""How far the sources of a language lie apart, in exact integers, from joint count histograms.

1. Tasks count the terms of their rows by (lang, source) in bounded tables; one shuffle adds the counts up. The documents of
   a term are counted alongside, so the texts are read once.
2. A language keeps the terms that enough of its documents hold.
3. For each pair of sources of a language the terms that both hold are tallied by (count, count): a row of this histogram is a
   combination, not a term. Cells with a zero are implied: the terms of a source with a given count, less those tallied, have
   a zero on the other side, and what is left of the kept terms has two.
4. The difference of two shares is computed once a combination and multiplied with its tally.

Defined cases: null text, lang and source count as ''; a group without terms is a group, and all its counts are zero; a language that keeps no term has
pairs of value 0 and no term rows; rows that repeat count again, as documents and as occurrences; texts of any length are read whole, and
a word of any length is a term; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from treeline.llm.shared import settle, small_side, text_slices

LEAST_DOCS, SCALE, PRIOR, TOP = 30, 1_000_000_000, 5, 50
#: Counts that a task holds before it passes them on.
HELD = 200_000
#: Maps A-Z to lower case, letters and bytes from 0x80 on to themselves, all others to a blank.
LETTERS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); a row with a null term for every group."""
    slim = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in groups.items():
                terms = [None, *n]
                # Bytes from 0x80 on are never cut, so every term is whole UTF-8.
                names = pa.array([None if t is None else t.decode("utf-8", "replace") for t in terms], pa.string())
                fixed = [pa.array([v] * len(terms), pa.string()) for v in (lang, source)]
                yield pa.RecordBatch.from_arrays([*fixed, names, pa.array([n.get(t, 0) for t in terms], pa.int64()), pa.array([d.get(t, 0) for t in terms], pa.int64())], ["lang", "source", "term", "n", "docs"])
            groups.clear()

        for batch in text_slices(batches, "text"):
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                n, d = groups.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                once = Counter(text.encode("utf-8", "replace").translate(LETTERS).split())
                n.update(once)
                d.update(dict.fromkeys(once, 1))
                held += len(n) - before
                if held > HELD:
                    yield from flushed()
                    held = 0
        yield from flushed()

    partial = slim.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)), in exact arithmetic."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, (total + PRIOR * kept).cast("decimal(20,0)"))


def _apart(a: Column, b: Column) -> Column:
    return F.abs(a - b)


class Counts:
    """The kept terms' counts of all groups and languages, each table written once."""

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS) -> None:
        self.all = settle(term_counts(docs), "divergence-counts")
        found = self.all.filter("term is not null")
        by_lang = found.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs")
        self.kept = settle(by_lang, "divergence-kept")
        #: lang, source, term, n of kept terms with n > 0.
        self.cells = settle(found.select("lang", "source", "term", "n").join(small_side(self.kept.select("lang", "term", "n_lang"), 64), ["lang", "term"]), "divergence-cells")
        langs = self.kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n_lang").alias("total_lang"))
        totals = self.cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
        groups = self.all.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "held", "kept", "total_lang"])
        #: One row a group: lang, source, total, held (terms with a count), kept (terms of the language), total_lang.
        self.groups = settle(groups, "divergence-groups")


def joint_histograms(counts: Counts) -> DataFrame:
    """lang, a, b (two sources, a before b), x, y, terms: how many kept terms have count x in a and y in b; zero cells included."""
    cells = counts.cells.select("lang", "source", "term", "n")
    left, right = cells.select("lang", "term", F.col("source").alias("a"), F.col("n").alias("x")), cells.select("lang", "term", F.col("source").alias("b"), F.col("n").alias("y"))
    key = ["lang", "a", "b", "x", "y"]
    both = settle(left.join(right, ["lang", "term"]).filter("a < b").groupBy(*key).agg(F.count("*").alias("terms")), "divergence-both")
    g = counts.groups.filter("kept > 0").select("lang", "source", "held", "kept")
    pairs = g.select("lang", F.col("source").alias("a"), F.col("held").alias("held_a"), "kept").join(g.select("lang", F.col("source").alias("b"), F.col("held").alias("held_b")), "lang").filter("a < b")
    pairs = settle(pairs, "divergence-pairs")  # as many rows as half the result's
    alone = settle(cells.groupBy("lang", "source", F.col("n").alias("k")).agg(F.count("*").alias("terms")), "divergence-alone")
    zero = F.lit(0).cast("long")
    parts = [
        both.select(*key, "terms"),
        # Terms of a source, and of these less the ones tallied.
        pairs.join(alone.withColumnRenamed("source", "a"), ["lang", "a"]).select("lang", "a", "b", F.col("k").alias("x"), zero.alias("y"), "terms"),
        both.groupBy("lang", "a", "b", "x").agg((-F.sum("terms")).alias("terms")).select("lang", "a", "b", "x", zero.alias("y"), "terms"),
        pairs.join(alone.withColumnRenamed("source", "b"), ["lang", "b"]).select("lang", "a", "b", zero.alias("x"), F.col("k").alias("y"), "terms"),
        both.groupBy("lang", "a", "b", "y").agg((-F.sum("terms")).alias("terms")).select("lang", "a", "b", zero.alias("x"), "y", "terms"),
        # Terms of neither.
        pairs.select("lang", "a", "b", zero.alias("x"), zero.alias("y"), (F.col("kept") - F.col("held_a") - F.col("held_b")).alias("terms")),
        both.groupBy("lang", "a", "b").agg(F.sum("terms").alias("terms")).select("lang", "a", "b", zero.alias("x"), zero.alias("y"), "terms"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*key).agg(F.sum("terms").alias("terms")).filter("terms > 0")


def pair_distances(counts: Counts) -> DataFrame:
    """lang, source, item (another source of the language), value."""
    g = counts.groups.select("lang", "source", "total", "kept")
    side = lambda s, t: small_side(g.select("lang", F.col("source").alias(s), F.col("total").alias(t), *(["kept"] if s == "a" else [])), 64)
    met = joint_histograms(counts).join(side("a", "total_a"), ["lang", "a"]).join(side("b", "total_b"), ["lang", "b"])
    f = _apart(share(F.col("x"), F.col("total_a"), F.col("kept")), share(F.col("y"), F.col("total_b"), F.col("kept")))
    known = met.groupBy("lang", "a", "b").agg(F.sum(f * F.col("terms")).alias("value"))
    none = g.filter("kept = 0").select("lang", F.col("source").alias("a")).join(g.filter("kept = 0").select("lang", F.col("source").alias("b")), "lang").filter("a < b").withColumn("value", F.lit(0).cast("long"))
    one_way = settle(known.unionByName(none), "divergence-pair-values")
    return one_way.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(one_way.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))


def term_distances(counts: Counts) -> DataFrame:
    """lang, source, item (a kept term that the group holds with a larger share than its language), value."""
    g = small_side(counts.groups.select("lang", "source", "total", "kept", "total_lang"), 64)
    met = counts.cells.join(g, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("n_lang"), F.col("total_lang"), F.col("kept"))
    return met.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q").select("lang", "source", "item", _apart(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: all pairs of sources, and the `top` terms of each group."""
    counts = Counts(docs, least_docs)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    columns = lambda part: ["lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), rank]
    # The limit on ranks is taken before the shuffle too, so a group's terms never all meet in one task.
    return pair_distances(counts).select(*columns("pair")).unionByName(term_distances(counts).select(*columns("term")).filter(F.col("rank") <= top))
