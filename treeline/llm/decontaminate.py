"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds every substring of every test item. Training words are streamed through
it; at each word it knows the longest run of words, ending there, that occurs in some item.
A window is `WINDOW` consecutive words of an item, or a whole item that is shorter. Every
word inside an occurrence of a window is a hit.

Items are dealt into blocks of bounded size, one automaton a block, each sent to all tasks. With
one block nothing is shuffled. With more, the documents are numbered and written once, each
block reads them and leaves rows for documents that it hits alone, and those few are united
and joined back; a block's table is dropped when its hits are written.

Defined cases: null and empty texts have no words and no hits; texts of any length are read
whole; an item without words has no window; repeated items each count with their own
item_id, equal item_ids as one item; items with a null item_id count together as one item that
the digest and the list leave out; an empty items table leaves every document clean; an empty
documents table gives an empty result; repeated rows of documents each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.shared import settle, small_side, text_slices, with_plain_names
from treeline.llm.text import word_spans, words

WINDOW = 13
#: A document is contaminated if hit words are at least one in so many of its words.
COVERAGE = 20
#: Words of items in one automaton (about 150 bytes a word as broadcast).
BLOCK_WORDS = 250_000


class SuffixAutomaton:
    """Minimal automaton of all substrings of the items added. State 0 is the empty run."""

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.longest = [0]

    def _state(self, longest: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.longest.append(longest)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        copy = self._state(self.longest[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:  # the run is known already
            return q if self.longest[q] == self.longest[last] + 1 else self._split(last, q, c)
        new = self._state(self.longest[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.longest[q] == self.longest[p] + 1 else self._split(p, q, c)
        return new

    def add(self, item: list[int]) -> None:
        last = 0
        for c in item:
            last = self._extend(last, c)


class Matcher:
    """A suffix automaton with, for every state, the items and windows that a match there completes."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for i, ws in items if ws]
        sam = SuffixAutomaton()
        for _, ws in coded:
            sam.add(ws)
        self.step, self.link, self.longest = sam.step, sam.link, sam.longest
        n = len(self.link)
        full: list[set[int | None]] = [set() for _ in range(n)]  # items that contain a window of the state's class
        short: list[list[tuple[int, int | None]]] = [[] for _ in range(n)]  # (length, item) of whole short items
        # The state of the last `window` words of a match in each state, shortest states first: suffix links are followed once.
        order = sorted(range(n), key=self.longest.__getitem__)
        self.anchors = [0] * n
        for s in order:
            if self.longest[s] >= window:
                up = self.link[s]
                self.anchors[s] = s if self.longest[up] < window else self.anchors[up]
        for item, ws in coded:
            state, length = 0, 0
            for c in ws:  # every prefix of an item is in the automaton
                state, length = self.step[state][c], length + 1
                if length >= window:
                    full[self.anchors[state]].add(item)
            if length < window:
                at = state
                while at > 0 and self.longest[self.link[at]] >= length:
                    at = self.link[at]
                short[at].append((length, item))
        self.full = [tuple(x) for x in full]
        self.short: list[tuple[tuple[int, int], ...]] = [()] * n
        for s in order:
            self.short[s] = tuple(short[s]) + (self.short[self.link[s]] if s else ())
        self.least = min([window, *(len(ws) for _, ws in coded)]) if coded else window
        # Pairs of words that follow one another in an item: a cheap test of where a match may run.
        self.pairs = np.unique(np.array([a * len(self.vocabulary) + b for _, ws in coded for a, b in zip(ws, ws[1:], strict=False)], np.int64))

    def find(self, ws: list[bytes]) -> tuple[np.ndarray, set[int | None]]:
        """Which words are hit, and the items that occur."""
        n = len(ws)
        hit = np.zeros(n + 1, np.int32)
        items: set[int | None] = set()
        if n < self.least or not self.vocabulary:
            return hit[:n] > 0, items
        get, v = self.vocabulary.get, len(self.vocabulary)
        ids = np.fromiter((get(w, -1) for w in ws), np.int64, n)
        if self.least > 1:
            near = (ids[:-1] >= 0) & (ids[1:] >= 0)
            code = (ids[:-1] * v + ids[1:])[near]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            follows = np.zeros(n, bool)
            follows[:-1][near] = self.pairs[at] == code
            edges = np.flatnonzero(np.diff(np.concatenate(([False], follows, [False])).astype(np.int8)))
            runs = [(a, b + 1) for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True) if b - a + 1 >= self.least]
        else:
            runs = [(0, n)]
        for a, b in runs:
            self._stream(ids[a:b].tolist(), a, hit, items)
        return np.cumsum(hit[:n]) > 0, items

    def _stream(self, ids: list[int], first: int, hit: np.ndarray, items: set[int]) -> None:
        step, link, longest, window = self.step, self.link, self.longest, self.window
        state = length = 0
        for i, c in enumerate(ids, first):
            while state and c not in step[state]:
                state = link[state]
                length = longest[state]
            if c in step[state]:
                state, length = step[state][c], length + 1
            else:
                length = 0
            covered = 0
            if length >= window:
                items.update(self.full[self.anchors[state]])
                covered = length
            for m, item in self.short[state]:
                if m <= length:
                    items.add(item)
                    covered = max(covered, m)
            if covered:
                hit[i - covered + 1] += 1
                hit[i + 1] -= 1


def _block_count(items: DataFrame, block_words: int) -> int:
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(1, -(-total // (block_words * 6)))


def _block(items: DataFrame, k: int, n: int) -> list[tuple[int | None, list[bytes]]]:
    """Block k of n, fetched by a filter on the hash of the item's id and text, so the driver holds one block."""
    part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
    return [(r["item_id"], words(r["text"])) for r in part.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator()]


_RUN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_HITS, _ITEMS, _WORDS, _ROW = "__hits", "__items", "__n_words", "__row"


_NONE_FOUND = {_WORDS: "cast(0 as bigint)", _HITS: "cast(array() as array<struct<start:int,end:int>>)", _ITEMS: "cast(array() as array<bigint>)"}


def _runs(hit: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))).tolist()
    return [{"start": a, "end": b} for a, b in zip(edges[0::2], edges[1::2], strict=True)]


def _listed(items: set[int | None]) -> list[int | None]:
    return sorted(items, key=lambda i: (i is None, i or 0))


def _pass_block(rows: DataFrame, shared, hits_alone: bool) -> DataFrame:  # noqa: ANN001 - a broadcast Matcher
    """rows with their words counted and the hits of one automaton; only rows with hits, without their text, if asked so."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = shared.value
        for batch in text_slices(batches, "text"):
            hits, found, counts = [], [], []
            for text in batch.column("text").to_pylist():
                ws = words(text)
                hit, items = matcher.find(ws)
                counts.append(len(ws))
                hits.append(_runs(hit) if items else [])
                found.append(_listed(items))
            kept = [batch.column(n) for n in names]
            out = pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64()), pa.array(hits, pa.list_(_RUN)), pa.array(found, pa.list_(pa.int64()))], [*names, *_NONE_FOUND])
            yield out.filter(pa.array([bool(x) for x in found], pa.bool_())) if hits_alone else out

    names = [_ROW] if hits_alone else rows.columns
    return rows.mapInArrow(scan, rows.select(*names).withColumns({k: F.expr(v) for k, v in _NONE_FOUND.items()}).schema)


def _united(parts: DataFrame) -> DataFrame:
    """The hits of all blocks of each document: a row a document, runs that overlap joined."""

    def unite(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            hits, items = [], []
            for runs, ids in zip(batch.column(_HITS).to_pylist(), batch.column(_ITEMS).to_pylist(), strict=True):
                joined: list[dict[str, int]] = []
                for run in sorted((r for part in runs for r in part), key=lambda r: r["start"]):
                    if joined and run["start"] <= joined[-1]["end"]:
                        joined[-1]["end"] = max(joined[-1]["end"], run["end"])
                    else:
                        joined.append(dict(run))
                hits.append(joined)
                items.append(_listed({i for part in ids for i in part}))
            yield pa.RecordBatch.from_arrays([batch.column(_ROW), pa.array(hits, pa.list_(_RUN)), pa.array(items, pa.list_(pa.int64()))], [_ROW, _HITS, _ITEMS])

    together = parts.groupBy(_ROW).agg(F.collect_list(_HITS).alias(_HITS), F.collect_list(_ITEMS).alias(_ITEMS))  # a row a block at most
    return together.mapInArrow(unite, parts.select(_ROW, _HITS, _ITEMS).schema)


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with __n_words, __hits (runs of hit words, end exclusive) and __items (ids of the items that occur)."""
    context = docs.sparkSession.sparkContext
    n = _block_count(items, block_words)
    if n == 1:
        return _pass_block(docs, context.broadcast(Matcher(_block(items, 0, 1), window)), False)
    rows = settle(docs.withColumn(_ROW, F.monotonically_increasing_id()), "numbered")
    parts = None
    for k in range(n):  # one automaton at a time in memory
        shared = context.broadcast(Matcher(_block(items, k, n), window))
        hit = settle(_pass_block(rows.select(_ROW, "text"), shared, True), "hits")
        shared.unpersist()
        parts = hit if parts is None else parts.unionByName(hit)
    counted = _pass_block(rows, context.broadcast(Matcher([], window)), False).drop(_HITS, _ITEMS)
    out = counted.join(small_side(settle(_united(parts), "united"), 256), _ROW, "left")
    return out.select(*docs.columns, _WORDS, *[F.coalesce(k, F.expr(v)).alias(k) for k, v in _NONE_FOUND.items() if k != _WORDS])


def judge(hits: DataFrame) -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256 and contaminated to the rows of find_hits."""
    n_hit = F.aggregate(_HITS, F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    listed = F.array_join(F.array_sort(F.transform(_ITEMS, lambda x: x.cast("string"))), ",")
    out = hits.withColumns({"n_words": F.col(_WORDS), "n_hit": n_hit, "n_items": F.size(_ITEMS).cast("long"), "items_sha256": F.sha2(listed, 256)})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * COVERAGE >= F.col("n_words")))


def _plain(docs: DataFrame) -> DataFrame:
    """docs with its text as `text` and all other columns numbered, so that no name can clash."""
    return docs.toDF(*["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)])


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the documents whose hit words pass the coverage limit; all others stay as they are."""
    return with_plain_names(docs, ("text",), lambda plain: judge(find_hits(plain, items)).filter(~F.col("contaminated")))


def cut_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs with the runs of hit words taken out of the texts of contaminated documents."""
    plain = _plain(docs)
    names = list(plain.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            texts = []
            for text, runs, bad in zip(batch.column("text").to_pylist(), batch.column(_HITS).to_pylist(), batch.column("contaminated").to_pylist(), strict=True):
                if bad:
                    raw = text.encode("utf-8", "surrogatepass")
                    at = word_spans(raw)
                    for run in reversed(runs):
                        raw = raw[: at[run["start"]][0]] + raw[at[run["end"] - 1][1] :]
                    text = raw.decode("utf-8", "surrogatepass")
                texts.append(text)
            columns = [batch.column(n) if n != "text" else pa.array(texts, pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return judge(find_hits(plain, items)).mapInArrow(cut, plain.schema).toDF(*docs.columns)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The report: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items."""
    slim = docs.select("doc_id", "text")
    return judge(find_hits(slim, items)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", F.col(_ITEMS).alias("items"))
