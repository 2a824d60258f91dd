"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text becomes its pieces by a random segmentation. All segmentations of a text form a lattice:
an edge from i to j for each piece of the vocabulary that spells characters i..j. Forward
filtering adds up, from the left, the weight of all paths to each place; backward sampling
walks from the end and draws each edge with its share of that weight, so a segmentation comes
with a probability in proportion to the product of its pieces' weights.

No piece joins a visible character to a blank after it (this is checked when the model is read), so
the lattice falls apart into units: a run of blanks with the visible run that follows, and
line ends. Forward filtering is done once for each distinct unit of a slice of rows, for all
units of one length together; the draws run over all occurrences at once.

Every draw is a hash of the seed, the row key, the unit's number in the text and the draw's
number in the unit: the result does not depend on how rows are split or ordered.

Characters outside the vocabulary, and U+2581, which stands for a blank inside the model, go
through byte pieces, so decoding returns every text exactly.

Weights: scores of a unigram model are log-probabilities and are used as such. A BPE model's
scores are ranks; a piece of rank r gets the weight 1 / (r + RANK_SHIFT). The exponent
`alpha` sharpens (above 1) or flattens (below 1) the weights.

Defined cases: null and empty texts have no pieces (null decodes to null); a null row key
draws as key 0; rows that repeat key and text get the same segmentation; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.shared import text_slices
from treeline.llm.text import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RANK_SHIFT, SLICE = 20.0, 1 << 20
#: Units of more characters are filtered one by one, others in groups of one length.
SHORT = 48
#: Each piece's weight is multiplied by this to the power of its length; a path's share is unchanged, and products stay in range.
_LIFT = 40.0
_FALLBACK = 1 << 24
_UNIT = re.compile(r" *[^ \n]+| +|\n")
_BASE = np.uint64(0x100000001B3)


class Pieces:
    """The vocabulary as a hashed table of prefixes, and the pieces' bytes for decoding."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], special: set[int], alpha: float) -> None:
        self.byte_ids = np.array(byte_ids, np.int64)
        skip = special | set(byte_ids)
        ranked = all(float(s).is_integer() and s <= 0 for s in scores)
        self.spelled: list[bytes] = [b""] * len(pieces)
        for b, i in enumerate(byte_ids):
            self.spelled[i] = bytes([b])
        self.weight: dict[str, tuple[int, float]] = {}
        for i, piece in enumerate(pieces):
            if i in skip or not piece:
                continue
            spelling = piece.replace("▁", " ")
            if " " in spelling.lstrip(" ") or "\n" in spelling:
                raise ValueError(f"piece {i} joins words; units would not be independent")
            self.spelled[i] = spelling.encode()
            self.weight[spelling] = (i, (1 / (RANK_SHIFT - scores[i]) if ranked else float(np.exp(scores[i]))) ** alpha)
        self.longest = max(map(len, self.weight))
        self.floor = min(w for _, w in self.weight.values())
        prefixes = {p[:k] for p in self.weight for k in range(1, len(p) + 1)}
        self.keys = np.zeros(len(prefixes), np.uint64)
        self.ids, self.weights = np.full(len(prefixes), -1, np.int64), np.zeros(len(prefixes))
        self.bits = np.uint64(64 - max(12, (4 * len(prefixes)).bit_length()))
        self.slots = np.full((1 << int(64 - int(self.bits))) + 64, -1, np.int32)
        for k, p in enumerate(sorted(prefixes)):
            h = 0
            for c in p:
                h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            self.keys[k] = h
            if p in self.weight:
                self.ids[k], w = self.weight[p]
                self.weights[k] = w * _LIFT ** len(p)
            at = int(_spread(np.array([h], np.uint64))[0] >> self.bits)
            while self.slots[at] >= 0:
                at += 1
            self.slots[at] = k
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("prefix hashes collide")

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hashed prefix, or -1."""
        at = (_spread(h) >> self.bits).astype(np.int64)
        out = self.slots[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != h))
        while len(open_):
            at[open_] += 1
            out[open_] = self.slots[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[out[open_]] != h[open_])]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of pieces; the blank that encoding puts before a text is taken off."""
        raw = b"".join(map(self.spelled.__getitem__, ids))
        return raw[1:].decode("utf-8", "surrogatepass")


def _spread(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)


def load(path: str = MODEL, alpha: float = 1.0) -> Pieces:
    """Read a SentencePiece model file (on the driver; executors get the table)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
    if any(not model.is_byte(i) for i in byte_ids):
        raise ValueError("the model has no byte pieces, so decoding would lose characters")
    return Pieces([model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)], byte_ids, special, alpha)


def _edges(pieces: Pieces, points: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lattice edges of units of one length: unit row, start, end, piece code and share of the weight at the end. points: code points, a row a unit."""
    m, n = points.shape
    alpha = np.zeros((n + 1, m))
    alpha[0] = 1
    found = []
    for i in range(n):
        rows, h = np.arange(m), np.zeros(m, np.uint64)
        single = np.zeros(m, bool)
        for j in range(i + 1, min(n, i + pieces.longest) + 1):
            c = points[rows, j - 1]
            h = h * _BASE + c.astype(np.uint64) + np.uint64(1)
            at = pieces.find(h)
            known = (at >= 0) & (c != 0x2581)
            rows, h, at = rows[known], h[known], at[known]
            if not len(rows):
                break
            ends = pieces.ids[at] >= 0
            r = rows[ends]
            if j == i + 1:
                single[r] = True
            share = alpha[i, r] * pieces.weights[at[ends]]
            alpha[j, r] += share
            found.append((r, np.full(len(r), i), np.full(len(r), j), pieces.ids[at[ends]], share))
        r = np.flatnonzero(~single)  # a character without a piece of its own: its bytes
        if len(r):
            c = points[r, i].astype(np.int64)
            code = np.where(c < 128, pieces.byte_ids[np.minimum(c, 127)], _FALLBACK + c)
            share = alpha[i, r] * pieces.floor * _LIFT
            alpha[i + 1, r] += share
            found.append((r, np.full(len(r), i), np.full(len(r), i + 1), code, share))
    row, start, end, code, share = (np.concatenate(x) for x in zip(*found, strict=True))
    return row, start, end, code, share / alpha[end, row]


def _long_edges(pieces: Pieces, unit: str) -> tuple[np.ndarray, ...]:
    """The same for one long unit, with sums scaled as they grow."""
    n = len(unit)
    into: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
    total = np.zeros(n + 1)
    total[0] = 1
    for i in range(n):
        if i % 16 == 0 and i:  # only ratios of sums that meet at one place matter
            scale = total[i : i + pieces.longest + 1].max()
            if scale > 0:
                total[i : i + pieces.longest + 1] /= scale
                for j in range(i + 1, min(n, i + pieces.longest) + 1):
                    into[j] = [(a, code, w / scale) for a, code, w in into[j]]
        alone = False
        for j in range(i + 1, min(n, i + pieces.longest) + 1):
            piece = unit[i:j] if "▁" not in unit[i:j] else ""
            if piece in pieces.weight:
                code, w = pieces.weight[piece]
                share = total[i] * w * _LIFT ** (j - i)
                into[j].append((i, code, share))
                total[j] += share
                alone |= j == i + 1
        if not alone:
            c = ord(unit[i])
            share = total[i] * pieces.floor * _LIFT
            into[i + 1].append((i, int(pieces.byte_ids[c]) if c < 128 else _FALLBACK + c, share))
            total[i + 1] += share
    flat = [(0, a, j, code, share / total[j]) for j in range(1, n + 1) for a, code, share in into[j]]
    return tuple(np.array(x) for x in zip(*flat, strict=True))


def encode(pieces: Pieces, keys: list[int | None], texts: list[str | None], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all texts, one after another, and the number of pieces of each text."""
    numbers: dict[str, int] = {}
    units, counts = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        if text:
            found = _UNIT.findall(" " + text)
            counts[k] = len(found)
            units += [numbers.setdefault(u, len(numbers)) for u in found]
    if not units:
        return np.zeros(0, np.int32), counts
    distinct = list(numbers)
    sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
    first = np.cumsum(sizes) - sizes  # number of the group of edges into the unit's place 1
    parts = []
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        if n <= SHORT:
            points = np.array([distinct[i] for i in at], f"<U{n}").view(np.uint32).reshape(len(at), -1)[:, :n]
            row, start, end, code, share = _edges(pieces, points)
            parts.append((first[at[row]] + end - 1, start, code, share))
        else:
            for i in at:
                _, start, end, code, share = _long_edges(pieces, distinct[i])
                parts.append((first[i] + end - 1, start, code, share))
    group, start, code, share = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(group, kind="stable")
    group, start, code, share = group[order], start[order], code[order], share[order]
    edge = np.searchsorted(group, np.arange(int(sizes.sum()) + 1))  # edges of group g: edge[g] .. edge[g + 1]
    heights = np.cumsum(share)
    heights -= np.repeat((heights[edge[:-1]] - share[edge[:-1]]), np.diff(edge))
    heights = group + np.minimum(heights, 1.0)  # group g covers the heights g .. g + 1

    unit = np.array(units, np.int64)
    row = np.repeat(np.arange(len(texts)), counts)
    number = np.arange(len(unit)) - (np.cumsum(counts) - counts)[row]
    key = np.array([0 if k is None else k for k in keys], np.int64).view(np.uint64)
    dice = mix(mix(mix(key + np.uint64(seed) * _BASE)[row] + number.astype(np.uint64)))
    place, live = sizes[unit], np.arange(len(unit))
    drawn = []
    lengths = np.zeros(len(unit), np.int64)
    while len(live):
        dice[live] = mix(dice[live] + np.uint64(0x9E3779B97F4A7C15))
        u = (dice[live] >> np.uint64(11)).astype(np.float64) / (1 << 53)
        g = first[unit[live]] + place[live] - 1
        at = np.searchsorted(heights, g + u, "right")
        at = np.clip(at, edge[g], edge[g + 1] - 1)
        drawn.append((live, code[at]))
        lengths[live] += 1
        place[live] = start[at]
        live = live[start[at] > 0]
    ends = np.cumsum(lengths)
    out = np.zeros(int(ends[-1]), np.int64)
    for step, (who, codes) in enumerate(drawn):
        out[ends[who] - 1 - step] = codes
    per_text = np.bincount(row, lengths, len(texts)).astype(np.int64)
    wide = np.flatnonzero(out >= _FALLBACK)
    if len(wide):
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in (out[wide] - _FALLBACK).tolist()]
        repeat = np.ones(len(out), np.int64)
        repeat[wide] = [len(b) for b in spelled]
        owner = np.repeat(np.repeat(np.arange(len(texts)), per_text), repeat)
        out = np.repeat(out, repeat)
        out[out >= _FALLBACK] = pieces.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        per_text = np.bincount(owner, minlength=len(texts))
    return out.astype(np.int32), per_text


def encode_rows(docs: DataFrame, model: str = MODEL, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """doc_id, n_chars, n_pieces, ids, and lossless: whether decoding the ids gave the text back, for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model, alpha))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for batch in text_slices(batches, "text", SLICE):
            texts = batch.column("text").to_pylist()
            ids, counts = encode(pieces, batch.column("doc_id").to_pylist(), texts, seed)
            ends = np.concatenate([[0], np.cumsum(counts)])
            flat = ids.tolist()
            same = [(pieces.decode(flat[a:b]) if t else t) == t for t, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([None if t is None else len(t) for t in texts], pa.int64()), pa.array(counts), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), pa.array(same)],
                ["doc_id", "n_chars", "n_pieces", "ids", "lossless"],
            )

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return slim.mapInArrow(scan, "doc_id long, n_chars long, n_pieces long, ids array<int>, lossless boolean")


def decode_rows(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded(ids, ...) with a column text decoded from ids; null for null, empty for none."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else shared.value.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    out = encoded.select(*[c for c in encoded.columns if c != "text"])
    return out.mapInArrow(scan, out.withColumn("text", F.lit("")).schema)
