"""Maximal repeats of at least 200 bytes over all texts, as groups with all their occurrences, from suffix arrays that fit tasks.

1. Anchors. Every window of 200 bytes names the rightmost least hash among its 64-byte grams. Equal windows name the same gram at
   the same place, so equal windows meet under the hash of their anchor. The windows of a text that share an anchor form a cell: a stretch of bytes, some 270 on average.
2. Cells that are equal byte for byte become one with a weight. Only cells whose anchor occurs again go on; their
   bytes are cut out of one text that holds them. Groups of one anchor too large for a task are split by longer cores of their
   windows, level by level, down to single windows, which are all equal and therefore one.
3. Suffix array. The suffixes at the anchors are sorted; a suffix that begins `a` bytes before its anchor is ranked by those bytes and the
   rank of the anchor's suffix. Common prefixes of neighbours come from range minima over the anchors' common prefixes.
4. Interval tree. A scan with a stack over the common prefixes opens and closes intervals; an interval whose occurrences do not all follow
   the same byte is a maximal repeat. The start of a cell counts as a change, so repeats longer than a cell go on in the next one.
   An occurrence belongs to the deepest such interval over it; the groups above follow by `parent`.

A byte goes if an occurrence of any group covers it. Groups are judged on the texts as they came, not on what is left.

Defined cases: null text counts as empty; texts below 200 bytes have no repeats; rows that repeat an id and a text are texts of
their own and repeat each other; overlapping occurrences in one text count; texts of any length are read whole; an empty table gives
an empty result; extra columns are ignored. Equality of cells is that of 128 bits of two hashes; inside a task bytes are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.shared import BROADCAST_BYTES, settle, small_side, text_slices, unsettle

#: Bytes of a repeat at least, and of an anchor.
LEAST, GRAM = 200, 64
#: Windows named at a time; bytes of one anchor's cells that one task takes; bytes of cells sorted together.
STRIDE, GROUP_BYTES, BATCH_BYTES = 1 << 20, 1 << 18, 1 << 21
#: Widths of the classes of windows (by the place of their anchor) into which a large group is split, in turn.
LEVELS = (32, 8, 2, 1)
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_LOW = _U((1 << 24) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def gram_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each `width` bytes, by doubling."""
    block, size, out, done = raw.astype(np.uint64) + _U(1), 1, None, 0
    while True:
        power = _U(pow(_BASE, size, 1 << 64))
        if width & size:
            if out is None:
                out = block
            else:
                n = min(len(out), len(block) - done)
                out = out[:n] * power + block[done : done + n]
            done += size
        if width < 2 * size:
            return _mix(out)
        block = block[:-size] * power + block[size:]
        size *= 2


def cells(raw: bytes, least: int = LEAST, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For stretches of the text: first window, last window, place of the anchor and its hash, of every cell."""
    span = least - gram + 1
    for begin in range(0, len(raw) - least + 1, STRIDE):
        part = np.frombuffer(raw, np.uint8, min(STRIDE + least - 1, len(raw) - begin), begin)
        hashes = gram_hashes(part, gram)
        # The upper bits order, the lower ones hold the place, counted down: the least value is the rightmost least hash.
        low = (hashes & ~_LOW) | (_LOW - np.arange(len(hashes), dtype=np.uint64))
        size = 1
        while 2 * size <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < span:
            low = np.minimum(low[: size - span], low[span - size :])
        at = (_LOW - (low & _LOW)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        last = np.append(first[1:] - 1, len(at) - 1)
        yield first + begin, last + begin, at[first] + begin, hashes[at[first]]


def _shared_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def _sorted_with_prefixes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """rank of each part, and by rank the bytes shared with the part before."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    rank = np.empty(len(parts), np.int64)
    rank[order] = np.arange(len(parts))
    return rank, np.array([0] + [_shared_prefix(parts[a], parts[b]) for a, b in zip(order, order[1:], strict=False)], np.int64)


class _Minima:
    """Least values of ranges, from tables of powers of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        while len(self.rows[-1]) > 1 << (len(self.rows) - 1):
            half = 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-half], self.rows[-1][half:]))
        self.table = np.full((len(self.rows), len(values)), np.iinfo(np.int64).max)
        for k, row in enumerate(self.rows):
            self.table[k, : len(row)] = row

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Over values[low..high], both included."""
        k = np.floor(np.log2(high - low + 1)).astype(np.int64)
        return np.minimum(self.table[k, low], self.table[k, high - (1 << k) + 1])


def interval_tree(prefixes: list[int], changes: list[bool]) -> tuple[list[tuple[int, int, int]], list[int], list[int]]:
    """Maximal repeats of a run of suffixes in sorted order.

    prefixes[i] and changes[i]: bytes that suffix i shares with suffix i - 1, and whether other bytes come before them; those of suffix 0 do not count.
    Returns the groups (length, first and last suffix) with an inner group before those around it, the parent of each (-1: none), and the
    deepest group over each suffix.
    """
    n = len(prefixes)
    steps = [0] * (n + 1)  # changes up to a suffix
    for i in range(1, n):
        steps[i + 1] = steps[i] + bool(changes[i])
    groups: list[tuple[int, int, int]] = []
    parent: list[int] = []
    over = [-1] * n
    open_ = [(0, 0)]  # length, first suffix
    waiting: list[tuple[int, int]] = [(0, 0)]  # first suffix, suffix or ~group, that no group has taken yet
    for i in range(1, n + 1):
        here, first = prefixes[i] if i < n else 0, i - 1
        while here < open_[-1][0]:
            length, first = open_.pop()
            if steps[i] - steps[first + 1]:
                g = len(groups)
                groups.append((length, first, i - 1))
                parent.append(-1)
                while waiting and waiting[-1][0] >= first:
                    what = waiting.pop()[1]
                    if what < 0:
                        parent[~what] = g
                    else:
                        over[what] = g
                waiting.append((first, ~g))
        if here > open_[-1][0]:
            open_.append((here, first))
        if i < n:
            waiting.append((i, i))
    return groups, parent, over


def repeats(texts: list[bytes], anchors: list[int], weights: list[int], least: int = LEAST) -> tuple[list[tuple[int, int, int]], list[tuple[bytes, int, bytes | None]]]:
    """Maximal repeats among cells with their anchors' places and weights.

    Returns occurrences (cell, place, group), each under the deepest group over it, and groups (digest, length, digest of the parent).
    """
    found: list[tuple[int, int, int]] = []
    groups: list[tuple[bytes, int, bytes | None]] = []
    if not texts:
        return found, groups
    anchor, many = np.array(anchors, np.int64), np.array(weights, np.int64) > 1
    right = [t[a:] for t, a in zip(texts, anchors, strict=True)]
    right_rank, right_shared = _sorted_with_prefixes(right)
    left_rank, left_shared = _sorted_with_prefixes([t[:a][::-1] for t, a in zip(texts, anchors, strict=True)])
    minima = _Minima(right_shared)
    size = np.array([len(t) for t in texts], np.int64)
    joined, start = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(size)[:-1]])
    tail = size - anchor
    nearest = np.maximum(anchor - (size - least), 0)  # bytes before the anchor, of the last window
    by_rank = np.argsort(right_rank)
    for before in range(int(nearest.min()), int(anchor.max()) + 1):
        some = by_rank[(nearest[by_rank] <= before) & (before <= anchor[by_rank])]
        if not len(some):
            continue
        # Equal bytes before the anchor first, then the rank of what follows from it.
        same = np.cumsum(left_shared < before)[left_rank[some]]
        some_order = np.argsort(same, kind="stable")
        some, same = some[some_order], same[some_order]
        rank = right_rank[some]
        shared = np.zeros(len(some), np.int64)
        near = np.flatnonzero(same[1:] == same[:-1]) + 1
        if len(near):
            shared[near] = before + minima.least(rank[near - 1] + 1, rank[near])
        # A cell of several occurrences stands twice, with all of its bytes in common.
        entry = np.repeat(np.arange(len(some)), 1 + many[some])
        twin = np.zeros(len(entry), bool)
        twin[1:] = entry[1:] == entry[:-1]
        cell = some[entry]
        shared = np.where(twin, before + tail[cell], shared[entry])
        linked = shared >= least
        if not linked.any():
            continue
        at = anchor[cell] - before
        byte = np.where(at > 0, joined[start[cell] + at - 1].astype(np.int64), -1 - np.arange(len(cell)))
        change = np.zeros(len(cell), bool)
        change[1:] = byte[1:] != byte[:-1]
        run = np.cumsum(~linked)
        busy = np.zeros(run[-1] + 1, bool)
        busy[run[linked & change]] = True
        take = np.flatnonzero(busy[run])
        cut = np.flatnonzero(np.diff(run[take])) + 1
        for part in np.split(take, cut) if len(take) else []:
            inner, above, over = interval_tree(shared[part].tolist(), change[part].tolist())
            base, names = len(groups), []
            for length, first, _ in inner:
                c, place = int(cell[part[first]]), int(at[part[first]])
                names.append(hashlib.blake2b(texts[c][place : place + length], digest_size=16).digest())
            groups += [(name, g[0], names[p] if p >= 0 else None) for name, g, p in zip(names, inner, above, strict=True)]
            seen: dict[tuple[int, int], int] = {}
            for k, g in zip(part.tolist(), over, strict=True):
                if g >= 0:
                    seen.setdefault((int(cell[k]), int(at[k])), base + g)
            found += [(c, place, g) for (c, place), g in seen.items()]
    return found, groups


_CELL = "h1 long, h2 long, anchor long, cell long, first long, size int, inside int"


def _keyed(docs: DataFrame) -> DataFrame:
    """h1, h2, text: 128 bits tell a row's id and text."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text, docs["doc_id"]).alias("h2"), text.alias("text"))


def _all_cells(docs: DataFrame, least: int) -> DataFrame:
    """The cells of all texts: anchor and cell are hashes, first is the cell's place in the text, size its bytes, inside the anchor's place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            columns: list[list] = [[] for _ in range(7)]
            for h1, h2, text in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "text")), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for first, last, at, hashes in cells(raw, least):
                    size = last - first + least
                    names = np.fromiter((xxhash.xxh3_64_intdigest(raw[a : a + n]) for a, n in zip(first.tolist(), size.tolist(), strict=True)), np.uint64, len(first))
                    for column, values in zip(columns, (np.full(len(first), h1, np.int64), np.full(len(first), h2, np.int64), hashes.view(np.int64), names.view(np.int64), first, size.astype(np.int32), (at - first).astype(np.int32)), strict=True):
                        column.append(values)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["h1", "h2", "anchor", "cell", "first", "size", "inside"])

    return settle(_keyed(docs).filter(F.octet_length("text") >= least).mapInArrow(run, _CELL), "repeat-cells")


def _cut_out(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """anchor, cell, weight, inside, body of the wanted cells (h1, h2, cells), cut out of one text that holds each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            rows = []
            for text, wants in zip(batch.column("text").to_pylist(), batch.column("wants").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(w["anchor"], w["cell"], w["weight"], w["inside"], raw[w["first"] : w["first"] + w["size"]]) for w in wants]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["anchor", "cell", "weight", "inside", "body"])

    lists = wanted.groupBy("h1", "h2").agg(F.collect_list(F.struct("anchor", "cell", "weight", "inside", "first", "size")).alias("wants"))  # fewer bytes than the text
    holders = settle(wanted.select("h1", "h2").distinct(), "repeat-holders")
    rows = _keyed(docs)
    if holders.count() * 64 <= BROADCAST_BYTES:  # else the join below leaves the other texts out
        rows = rows.join(F.broadcast(holders), ["h1", "h2"], "left_semi")
    once = rows.groupBy("h1", "h2").agg(F.first("text").alias("text"))  # equal rows meet before the shuffle
    return once.join(lists, ["h1", "h2"]).mapInArrow(run, "anchor long, cell long, weight long, inside int, body binary")


def _split(bodies: DataFrame, width: int, least: int) -> DataFrame:
    """Cells of large groups, cut by classes of windows whose anchors stand in the same `width` places: each class shares a longer core.

    anchor and cell name the new cells, from_anchor, from_cell and shift the old one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for anchor, cell, weight, inside, body in zip(*(batch.column(c).to_pylist() for c in ("anchor", "cell", "weight", "inside", "body")), strict=True):
                near, far = inside - (len(body) - least), inside  # bytes before the anchor, of the last and the first window
                for k in range(near // width, far // width + 1):
                    a, b = inside - min(far, k * width + width - 1), inside - max(near, k * width)
                    part, core = body[a : b + least], body[inside - k * width : inside - (k * width + width - 1) + least]
                    rows.append((xxhash.xxh3_64_intdigest(core, seed=width * 1024 + k) - (1 << 63), xxhash.xxh3_64_intdigest(part) - (1 << 63), weight, inside - a, part, anchor, cell, a))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["anchor", "cell", "weight", "inside", "body", "from_anchor", "from_cell", "shift"])

    return bodies.mapInArrow(run, "anchor long, cell long, weight long, inside int, body binary, from_anchor long, from_cell long, shift int")


def _scanned(bodies: DataFrame, least: int) -> DataFrame:
    """anchor, cell, place, length, repeat, parent: occurrences; and groups, as rows without a cell. Groups of one anchor are no larger than a task takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        nbytes, last = 0, None

        def done() -> pa.RecordBatch:
            found, groups = repeats([h[4] for h in held], [h[3] for h in held], [h[2] for h in held], least)
            rows = [(held[c][0], held[c][1], place, groups[g][1], groups[g][0], None) for c, place, g in found] + [(None, None, None, length, name, up) for name, length, up in groups]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], ["anchor", "cell", "place", "length", "repeat", "parent"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "cell", "weight", "inside", "body")), strict=True):
                if row[:2] == last:
                    continue
                if nbytes >= BATCH_BYTES and row[0] != last[0]:
                    yield done()
                    held, nbytes = [], 0
                held.append(row)
                nbytes, last = nbytes + len(row[4]), row[:2]
        if held:
            yield done()

    dealt = bodies.select("anchor", "cell", "weight", "inside", "body").repartition("anchor").sortWithinPartitions("anchor", "cell")
    return dealt.mapInArrow(run, "anchor long, cell long, place int, length int, repeat binary, parent binary")


def _join_busy(rows: DataFrame, side: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """rows joined with side (one row a key, its column `weight` the rows of the key); keys of more than limit rows pass the shuffle by."""
    busy = settle(side.filter(F.col("weight") > limit), "repeat-busy")  # at most rows / limit
    found = rows.join(F.broadcast(busy), keys)
    rest = rows.join(F.broadcast(busy.select(*keys)), keys, "left_anti").join(side.filter(F.col("weight") <= limit), keys)
    return found.unionByName(rest)


class Repeats:
    """The maximal repeats of a table of texts."""

    def __init__(self, docs: DataFrame, least: int = LEAST, group_bytes: int = GROUP_BYTES) -> None:
        self.docs, self.least = docs, least
        every = _all_cells(docs, least)
        again = settle(every.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "repeat-anchors")
        #: Cells of anchors that occur again, in all texts.
        self.cells = settle(every.join(small_side(again, 16), "anchor", "left_semi"), "repeat-met")
        unsettle(every)
        unsettle(again)
        kinds = self.cells.groupBy("anchor", "cell").agg(F.count("*").alias("weight"), F.min(F.struct("h1", "h2", "first", "size", "inside")).alias("at")).select("anchor", "cell", "weight", "at.*")
        self.kinds = settle(kinds, "repeat-kinds")
        bodies, links, found, groups = settle(_cut_out(docs, self.kinds), "repeat-bodies"), [], [], []
        for width in (*LEVELS, 0):
            heavy = bodies.groupBy("anchor").agg(F.sum(F.octet_length("body")).alias("bytes")).filter(F.col("bytes") > group_bytes) if width else None
            heavy = settle(heavy.select("anchor"), "repeat-heavy") if width else None
            none = heavy is None or heavy.isEmpty()
            light = bodies if none else bodies.join(small_side(heavy, 16), "anchor", "left_anti")
            scanned = settle(_scanned(light, least), "repeat-found")
            occurrences = scanned.filter("cell is not null").select("anchor", "cell", "place", "length", "repeat")
            groups.append(scanned.filter("cell is null").select("repeat", "length", "parent"))
            for link in reversed(links):  # places in the cells of the texts
                occurrences = _join_busy(link, occurrences.groupBy("anchor", "cell").agg(F.collect_list(F.struct("place", "length", "repeat")).alias("hits"), F.first("anchor").alias("_")).drop("_").join(link.groupBy("anchor", "cell").agg(F.count("*").alias("weight")), ["anchor", "cell"]), ["anchor", "cell"], 256)
                occurrences = occurrences.select(F.col("from_anchor").alias("anchor"), F.col("from_cell").alias("cell"), "shift", F.explode("hits").alias("hit"))
                occurrences = settle(occurrences.select("anchor", "cell", (F.col("hit.place") + F.col("shift")).alias("place"), "hit.length", "hit.repeat"), "repeat-lifted")
            found.append(occurrences)
            if none:
                break
            parts = settle(_split(bodies.join(small_side(heavy, 16), "anchor", "left_semi"), width, least), "repeat-split")
            links.append(parts.select("anchor", "cell", "from_anchor", "from_cell", "shift"))
            bodies = settle(parts.groupBy("anchor", "cell").agg(F.sum("weight").alias("weight"), F.first("inside").alias("inside"), F.first("body").alias("body")), "repeat-bodies")
        self._found, self._groups = found[0], groups[0]
        for f, g in zip(found[1:], groups[1:], strict=True):
            self._found, self._groups = self._found.unionByName(f), self._groups.unionByName(g)

    def groups(self) -> DataFrame:
        """repeat (a digest of its bytes), length, parent (the longest repeat of this one's beginning, its occurrences are theirs too)."""
        return self._groups

    def _placed(self) -> DataFrame:
        """h1, h2, first, hits for each cell that holds occurrences."""
        hits = self._found.groupBy("anchor", "cell").agg(F.collect_list(F.struct("place", "length", "repeat")).alias("hits"))  # as many as the cell has windows, at most
        weighed = hits.join(self.kinds.select("anchor", "cell", "weight"), ["anchor", "cell"])
        total = self.cells.count()
        return _join_busy(self.cells.select("anchor", "cell", "h1", "h2", "first"), settle(weighed, "repeat-hits"), ["anchor", "cell"], max(256, total // 4096))

    def occurrences(self) -> DataFrame:
        """repeat, length, doc_id, at (byte): all occurrences, each under the longest group it belongs to."""
        rows = self._placed().select("h1", "h2", "first", F.explode("hits").alias("hit"))
        ids = self.docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h1"), F.xxhash64(F.lit(1), F.coalesce("text", F.lit("")), "doc_id").alias("h2"), "doc_id").distinct()
        return rows.join(ids, ["h1", "h2"]).select("hit.repeat", "hit.length", "doc_id", (F.col("first") + F.col("hit.place")).alias("at"))

    def spans(self) -> DataFrame:
        """h1, h2, spans: for each text, by its key, the stretches that occurrences cover, those that touch as one."""
        covers = F.transform("hits", lambda h: F.struct((F.col("first") + h["place"]).alias("a"), (F.col("first") + h["place"] + h["length"]).alias("b")))
        # The stretches of a cell that touch become one; rows that repeat have the same key and the same spans.
        joined = F.aggregate(
            F.array_sort(covers), F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)"),
            lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= s["a"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], s["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(s))),
        )
        met = self._placed().select("h1", "h2", F.explode(joined).alias("s")).groupBy("h1", "h2").agg(F.collect_set("s").alias("spans"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spans = [[{"a": a, "b": b} for a, b in _merged(s)] for s in batch.column("spans").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], ["h1", "h2", "spans"])

        return met.mapInArrow(run, "h1 long, h2 long, spans array<struct<a:bigint,b:bigint>>")


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or []):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def with_spans(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, text and spans, a list of the stretches (a, b in bytes) that repeat, for every row of docs."""
    spans = settle(Repeats(docs, least).spans(), "repeat-spans")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text, docs["doc_id"]).alias("h2"))
    held = spans.agg(F.coalesce(F.sum(F.size("spans") * 24 + 64), F.lit(0))).first()[0]
    if held <= BROADCAST_BYTES:
        met = rows.join(F.broadcast(spans), ["h1", "h2"], "left")
    else:
        keys = rows.select("h1", "h2")
        busy = keys.groupBy("h1", "h2").agg(F.count("*").alias("weight")).filter("weight > 4096").select("h1", "h2")  # rows that repeat whole
        busy = settle(spans.join(F.broadcast(busy), ["h1", "h2"]), "repeat-busy")
        plain = rows.join(F.broadcast(busy.select("h1", "h2")), ["h1", "h2"], "left_anti").join(spans, ["h1", "h2"], "left")
        met = rows.join(F.broadcast(busy), ["h1", "h2"]).unionByName(plain)
    return met.select("doc_id", "text", "spans")


def remove_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            rows = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw, gone = (text or "").encode("utf-8", "surrogatepass"), _merged(spans)
                kept = b"".join(raw[a:b] for a, b in zip([0, *[b for _, b in gone]], [*[a for a, _ in gone], len(raw)], strict=True))
                rows.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    met = with_spans(docs, least)
    kind = next(t for n, t in met.dtypes if n == "doc_id")
    return met.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
