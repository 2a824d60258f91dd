"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of a word: an embedding by the word (of the training vocabulary, else "unknown") next
to the scaled sum of embeddings of its character 3- and 4-grams with its ends marked. Two gated
recurrent layers read a window of words forwards and backwards, attention weights the
states, their sum gives a logit. A text is cut into windows that overlap by half; all are
scored, and the text's score is that of its worst window, calibrated so that 0.5 parts the
training classes best.

Training: at most TRAIN_PER_CLASS labelled rows of each label, the ones with the smallest hash of
doc_id, are settled as a table and stay on the executors. First the network takes stochastic
steps on windows drawn at random from the whole length of each row, FIRST_DRAWS a row, which carry
their row's label. Then, in ROUNDS rounds, executors score all windows of all these rows, and the
network takes steps on the highest window of each (multiple-instance learning). The place of
0.5 is set by the highest of all windows of each row. The driver gets FIRST_DRAWS windows, then one
window a row, and the words that occur in LEAST_TEXTS rows, VOCABULARY at most. Besides, the
network learns that repetition is no abuse: windows made of one to three words of harmless rows (JUNK, or half
as many as there are rows) are trained as harmless; they stand for junk in the documents
and use no labels but those of the sample. Scoring reads every word of every text.

Defined cases: null, empty and wordless texts have one window without words, scored by the
bias alone; texts of any length are learnt from and scored whole; labels that are null, stand for no
document or differ for one doc_id are not used; with no usable labels of both classes every score is 0; repeated rows
each give a row; an empty documents table gives an empty result; other columns are ignored, and
kept by remove_toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.shared import labelled_sample, settle, text_slices, with_plain_names
from treeline.llm.text import words

WINDOW, STRIDE = 32, 16
TRAIN_PER_CLASS, FIRST_DRAWS, ROUNDS, VOCABULARY, JUNK = 1500, 16, 5, 20_000, 500
WORD_DIM, CHAR_DIM, HIDDEN, BUCKETS = 8, 8, 8, 8192
#: Words whose gate inputs a worker keeps at hand; the table is emptied when full.
CACHE = 60_000
#: Texts of the sample in which a word must occur to get an embedding of its own; how often training hides it; weight decay.
LEAST_TEXTS, HIDE, DECAY = 6, 0.15, 0.002
_CHUNK = 2048


def starts(n: int) -> range | list[int]:
    """First words of the windows of a text of n words: every STRIDE, and one that ends with the text."""
    if n <= WINDOW:
        return [0]
    last = n - WINDOW
    return [*range(0, last, STRIDE), last]


def char_grams(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character grams of the words (bytes stand for characters), and how many each word has."""
    raw = np.frombuffer(b"".join(b"\x01" + w + b"\x02" for w in batch), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, batch), np.int64, len(batch)) + 2
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(batch)), sizes)
    at = np.arange(len(raw))
    room = ends[owner] - at
    pad = np.concatenate([raw, np.zeros(3, np.uint32)])
    three = pad[:-3] * np.uint32(0x9E3779B1) ^ pad[1:-2] * np.uint32(0x85EBCA77) ^ pad[2:-1] * np.uint32(0xC2B2AE3D)
    four = three ^ pad[3:] * np.uint32(0x27D4EB2F) ^ np.uint32(0x165667B1)
    both = np.stack([three, four], 1)
    both = (both ^ (both >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    both = (both ^ (both >> np.uint32(12))) % np.uint32(BUCKETS)
    fits = np.stack([room >= 3, room >= 4], 1)
    counts = np.bincount(owner, fits.sum(1), len(batch)).astype(np.int64)
    return both[fits].astype(np.int64), counts


def _tanh_gate(x: np.ndarray) -> np.ndarray:
    """The logistic function of 2x."""
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class Network:
    """The weights, the forward pass for scoring, and forward and backward passes for training."""

    def __init__(self, vocabulary: list[bytes], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        size = WORD_DIM + CHAR_DIM
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.vocabulary = {w: i for i, w in enumerate(vocabulary, 1)}
        self.p = {"word": rng.standard_normal((len(vocabulary) + 1, WORD_DIM)).astype(np.float32) * 0.3, "char": rng.standard_normal((BUCKETS, CHAR_DIM)).astype(np.float32) * 0.3}
        for side in "fb":
            self.p |= {f"w{side}": draw(size, 3 * HIDDEN), f"b{side}": np.zeros(3 * HIDDEN, np.float32), f"g{side}": draw(HIDDEN, 2 * HIDDEN), f"n{side}": draw(HIDDEN, HIDDEN)}
        self.p |= {"att": draw(2 * HIDDEN, HIDDEN), "query": draw(HIDDEN, 1)[:, 0], "out": draw(2 * HIDDEN, 1)[:, 0], "bias": np.zeros(1, np.float32)}
        self.shift, self.slope = 0.0, 1.0
        self._reset()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._reset()

    def _reset(self) -> None:
        self._rows: dict[bytes, int] = {}
        self._gates = np.zeros((1024, 6 * HIDDEN), np.float32)

    # Inputs

    def inputs(self, batch: list[bytes]) -> tuple[np.ndarray, tuple]:
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in batch), np.int64, len(batch))
        grams, counts = char_grams(batch)
        scale = (1 / np.sqrt(np.maximum(counts, 1))).astype(np.float32)
        owner = np.repeat(np.arange(len(batch)), counts)
        chars = np.zeros((len(batch), CHAR_DIM), np.float32)
        some = np.flatnonzero(counts)
        if len(some):
            chars[some] = np.add.reduceat(self.p["char"][grams], (np.cumsum(counts) - counts)[some], axis=0)
        return np.concatenate([self.p["word"][ids], chars * scale[:, None]], 1), (ids, grams, owner, scale)

    def _lookup(self, flat: list[bytes]) -> np.ndarray:
        """Rows of the gate table for the words, new ones computed together."""
        if len(self._rows) > CACHE:
            self._reset()
        rows = self._rows
        new = [w for w in dict.fromkeys(flat) if w not in rows]
        if new:
            first = len(rows)
            x, _ = self.inputs(new)
            gates = np.concatenate([x @ self.p["wf"] + self.p["bf"], x @ self.p["wb"] + self.p["bb"]], 1)
            while len(self._gates) < first + len(new):
                self._gates = np.concatenate([self._gates, np.zeros_like(self._gates)])
            self._gates[first : first + len(new)] = gates
            rows.update(zip(new, range(first, first + len(new)), strict=True))
        return np.fromiter(map(rows.__getitem__, flat), np.int64, len(flat))

    # Scoring

    def window_logits(self, gates: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Logits of windows of equal length; index: (length, windows) rows of gates."""
        length, n = index.shape
        if not length:
            return np.full(n, self.p["bias"][0], np.float32)
        p, both = self.p, np.empty((length, n, 2 * HIDDEN), np.float32)
        inputs = np.take(gates, index, axis=0)
        for k, side in enumerate("fb"):
            h = np.zeros((n, HIDDEN), np.float32)
            half = slice(k * HIDDEN, (k + 1) * HIDDEN)
            for t in range(length) if side == "f" else range(length - 1, -1, -1):
                x = inputs[t, :, 3 * HIDDEN * k : 3 * HIDDEN * (k + 1)]
                gate = h @ p[f"g{side}"]
                gate += x[:, : 2 * HIDDEN]
                _tanh_gate(gate)
                new = (gate[:, HIDDEN:] * h) @ p[f"n{side}"]
                new += x[:, 2 * HIDDEN :]
                np.tanh(new, out=new)
                h -= new
                h *= gate[:, :HIDDEN]
                h += new
                both[t, :, half] = h
        score = np.tanh(both @ p["att"]) @ p["query"]
        score -= score.max(0)
        np.exp(score, out=score)
        value = both @ p["out"]
        return (score * value).sum(0) / score.sum(0) + p["bias"][0]

    def worst(self, texts: list[list[bytes]]) -> np.ndarray:
        """The highest window logit of each text."""
        rows = self._lookup(list(chain.from_iterable(texts)))
        out = np.full(len(texts), -np.inf)
        by_length: dict[int, list[tuple[int, int]]] = {}
        at = 0
        for i, ws in enumerate(texts):
            by_length.setdefault(min(len(ws), WINDOW), []).extend((i, at + s) for s in starts(len(ws)))
            at += len(ws)
        for length, found in by_length.items():
            owner, first = np.array(found, np.int64).T
            for a in range(0, len(owner), _CHUNK):
                index = rows[first[None, a : a + _CHUNK] + np.arange(length)[:, None]] if length else np.zeros((0, len(owner[a : a + _CHUNK])), np.int64)
                np.maximum.at(out, owner[a : a + _CHUNK], self.window_logits(self._gates, index))
        return out

    def tops(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The highest window logit of each text, and the first word of that window (the first of equal ones)."""
        best, first = self.worst(texts), np.zeros(len(texts), np.int64)
        rows = self._lookup(list(chain.from_iterable(texts)))
        at = 0
        for i, ws in enumerate(texts):
            if len(ws) > WINDOW:
                begin = np.array(starts(len(ws)), np.int64)
                logits = np.concatenate([self.window_logits(self._gates, rows[at + begin[None, a : a + _CHUNK] + np.arange(WINDOW)[:, None]]) for a in range(0, len(begin), _CHUNK)])
                first[i] = begin[int(logits.argmax())]
            at += len(ws)
        return best, first

    def scores(self, texts: list[list[bytes]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.worst(texts) - self.shift) * self.slope, -30, 30)))

    # Training

    def gradients(self, batch: list[list[bytes]], labels: np.ndarray, weights: np.ndarray, hidden: np.random.Generator | None = None) -> dict:
        """Gradients of the weighted logistic loss over windows of equal length; embeddings come as (rows, values)."""
        p, n, length = self.p, len(batch), len(batch[0])
        unique = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(batch)))}
        index = np.fromiter((unique[w] for w in chain.from_iterable(batch)), np.int64, n * length).reshape(n, length).T
        x, (ids, grams, owner, scale) = self.inputs(list(unique))
        if hidden is not None:
            ids = np.where(hidden.random(len(ids)) < HIDE, 0, ids)
            x[:, :WORD_DIM] = p["word"][ids]
        both = np.empty((length, n, 2 * HIDDEN), np.float32)
        kept: dict[str, list] = {"f": [], "b": []}
        for k, side in enumerate("fb"):
            gates = (x @ p[f"w{side}"] + p[f"b{side}"])[index]
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(length) if side == "f" else range(length - 1, -1, -1):
                gate = _tanh_gate(h @ p[f"g{side}"] + gates[t, :, : 2 * HIDDEN])
                z, r = gate[:, :HIDDEN], gate[:, HIDDEN:]
                rh = r * h
                new = np.tanh(rh @ p[f"n{side}"] + gates[t, :, 2 * HIDDEN :])
                kept[side].append((t, h, z, r, rh, new))
                h = new + z * (h - new)
                both[t, :, k * HIDDEN : (k + 1) * HIDDEN] = h
        hid = np.tanh(both @ p["att"])
        score = hid @ p["query"]
        alpha = np.exp(score - score.max(0))
        alpha /= alpha.sum(0)
        value = both @ p["out"]
        logit = (alpha * value).sum(0) + p["bias"][0]
        d = ((1 / (1 + np.exp(-logit)) - labels) * weights / weights.sum()).astype(np.float32)
        g = {"bias": np.array([d.sum()]), "out": np.einsum("tn,tnh->h", alpha * d, both)}
        d_both = (alpha * d)[:, :, None] * p["out"]
        d_alpha = value * d
        d_score = alpha * (d_alpha - (alpha * d_alpha).sum(0))
        g["query"] = np.einsum("tn,tnh->h", d_score, hid)
        d_hid = d_score[:, :, None] * p["query"] * (1 - hid * hid)
        g["att"] = both.reshape(-1, 2 * HIDDEN).T @ d_hid.reshape(-1, HIDDEN)
        d_both += d_hid @ p["att"].T
        dx = np.zeros_like(x)
        for k, side in enumerate("fb"):
            d_gates = np.zeros((length, n, 3 * HIDDEN), np.float32)
            dg, dn, dh = np.zeros_like(p[f"g{side}"]), np.zeros_like(p[f"n{side}"]), np.zeros((n, HIDDEN), np.float32)
            for t, h, z, r, rh, new in reversed(kept[side]):
                dh = dh + d_both[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                d_new = dh * (1 - z) * (1 - new * new)
                d_z = dh * (h - new) * 2 * z * (1 - z)
                d_rh = d_new @ p[f"n{side}"].T
                d_r = d_rh * h * 2 * r * (1 - r)
                zr = np.concatenate([d_z, d_r], 1)
                dg += h.T @ zr
                dn += rh.T @ d_new
                dh = dh * z + d_rh * r + zr @ p[f"g{side}"].T
                d_gates[t, :, : 2 * HIDDEN], d_gates[t, :, 2 * HIDDEN :] = zr, d_new
            per_word = np.zeros((len(x), 3 * HIDDEN), np.float32)
            order = np.argsort(index, axis=None, kind="stable")
            heads = np.searchsorted(index.ravel()[order], np.arange(len(x)))
            per_word += np.add.reduceat(d_gates.reshape(-1, 3 * HIDDEN)[order], heads, axis=0)
            g |= {f"w{side}": x.T @ per_word, f"b{side}": per_word.sum(0), f"g{side}": dg, f"n{side}": dn}
            dx += per_word @ p[f"w{side}"].T
        word, char = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(word, ids, dx[:, :WORD_DIM])
        spread = (dx[:, WORD_DIM:] * scale[:, None])[owner]
        for c in range(CHAR_DIM):
            char[:, c] = np.bincount(grams, spread[:, c], BUCKETS)
        return g | {"word": word, "char": char}

    def calibrate(self, logits: np.ndarray, labels: np.ndarray) -> None:
        """Puts 0.5 in the middle of the gap that parts the classes with the fewest errors."""
        order = np.argsort(logits)
        ranked, marks = logits[order], labels[order]
        wrong = np.concatenate([[np.sum(marks == 0)], np.sum(marks == 0) + np.cumsum(np.where(marks == 1, 1, -1))])
        inner = wrong.copy()
        best = np.flatnonzero(inner == inner.min())
        gaps = [(ranked[k] - ranked[k - 1] if 0 < k < len(ranked) else 0.0, k) for k in best]
        _, k = max(gaps)
        self.shift = float((ranked[k - 1] + ranked[k]) / 2 if 0 < k < len(ranked) else ranked[0] - 1 if k == 0 else ranked[-1] + 1)


def held_out(doc_id) -> F.Column:  # noqa: ANN001
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Trainer:
    """Steps of Adam on windows with marks, both classes with equal weight."""

    def __init__(self, network: Network, seed: int = 11, batch: int = 256) -> None:
        self.network, self.rng, self.batch, self.step = network, np.random.default_rng(seed), batch, 0
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}

    def run(self, windows: list[list[bytes]], marks: np.ndarray, steps: int, rate: float) -> None:
        full = np.array([i for i, w in enumerate(windows) if len(w) == WINDOW], np.int64)
        share = np.clip(marks.mean(), 1e-3, 1 - 1e-3)
        lengths: dict[int, list[int]] = {}
        for i, w in enumerate(windows):
            if 0 < len(w) < WINDOW:
                lengths.setdefault(len(w), []).append(i)
        done = 0
        while done < steps and (len(full) or lengths):
            groups = np.array_split(self.rng.permutation(full), max(1, len(full) // self.batch)) if len(full) else []
            groups += [np.array(x) for x in lengths.values()]
            for k in self.rng.permutation(len(groups))[: steps - done]:
                at = groups[k]
                y = marks[at]
                weights = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32) * (1.0 if len(at) >= 8 else 0.3)
                self._adam(self.network.gradients([windows[i] for i in at], y, weights, self.rng), rate)
                done += 1
        self.network._reset()

    def _adam(self, gradients: dict, rate: float) -> None:
        self.step += 1
        p = self.network.p
        for name, grad in gradients.items():
            m, v = self.moments[name]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            p[name] -= (rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-8)).astype(np.float32)
            if name in ("word", "char"):
                p[name] *= np.float32(1 - rate * DECAY * 10)


def held_out(doc_id) -> F.Column:  # noqa: ANN001
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _often(sample: DataFrame) -> tuple[list[bytes], list[bytes]]:
    """The words of at least LEAST_TEXTS rows, commonest first, and words of harmless rows, as many, drawn by hash."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            for text, mark in zip(batch.column("text").to_pylist(), batch.column("mark").to_pylist(), strict=True):
                if found := sorted(set(words(text))):
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([mark == 0] * len(found))], ["word", "mild"])

    counts = settle(sample.mapInArrow(spell, "word binary, mild boolean").groupBy("word").agg(F.count("*").alias("n"), F.bool_or("mild").alias("mild")), "sample-words")
    often = counts.filter(F.col("n") >= LEAST_TEXTS).orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    mild = counts.filter("mild").orderBy(F.xxhash64("word"), "word").limit(VOCABULARY).collect()
    return [bytes(r["word"]) for r in often], sorted(bytes(r["word"]) for r in mild)


def _windows(sample: DataFrame, of) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:  # noqa: ANN001 - of: texts and row numbers to (text, first word, logit)
    """Windows that executors choose from the rows with words, their marks and logits, in the order of the rows' numbers."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            texts = [words(t) for t in batch.column("text").to_pylist()]
            numbers, marks = batch.column("number").to_pylist(), batch.column("mark").to_pylist()
            some = [i for i, ws in enumerate(texts) if ws]
            chosen = [(some[k], first, logit) for k, first, logit in of([texts[i] for i in some], [numbers[i] for i in some])]
            columns = [[numbers[i] for i, _, _ in chosen], [marks[i] for i, _, _ in chosen], [b" ".join(texts[i][a : a + WINDOW]) for i, a, _ in chosen], [float(x) for _, _, x in chosen]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.float64()), strict=True)], ["number", "mark", "window", "logit"])

    rows = sample.mapInArrow(choose, "number long, mark int, window binary, logit double").collect()
    rows.sort(key=lambda r: (r["number"], bytes(r["window"])))
    return [bytes(r["window"]).split() for r in rows], np.array([r["mark"] for r in rows], np.int64), np.array([r["logit"] for r in rows])


def _draw(texts: list[list[bytes]], numbers: list[int]) -> Iterator[tuple[int, int, float]]:
    """FIRST_DRAWS windows of each text, all of them if there are no more."""
    for k, (ws, number) in enumerate(zip(texts, numbers, strict=True)):
        begin = list(starts(len(ws)))
        picks = range(len(begin)) if len(begin) <= FIRST_DRAWS else np.random.default_rng(number).choice(len(begin), FIRST_DRAWS, replace=False)
        yield from ((k, begin[i], 0.0) for i in picks)


def train(docs: DataFrame, labels: DataFrame) -> Network | None:
    """A network fitted on the bounded sample of labelled rows; none if a class is missing."""
    context = docs.sparkSession.sparkContext
    found = labelled_sample(docs, labels, "toxic", held_out, TRAIN_PER_CLASS, 5, "text").withColumn("number", F.xxhash64("doc_id", "text").bitwiseAND((1 << 62) - 1))
    sample = settle(found.repartition(max(8, context.defaultParallelism), "number"), "toxic-sample")
    first, marks, _ = _windows(sample, _draw)
    if len(set(marks.tolist())) < 2:
        return None
    often, mild = _often(sample)
    network = Network(often)
    rng = np.random.default_rng(3)
    junk = []
    for _ in range(max(JUNK, sample.count() // 2)):
        few = [mild[i] for i in rng.integers(0, len(mild), rng.integers(1, 4))]
        junk.append(list(chain.from_iterable([w] * -(-WINDOW // len(few)) for w in few))[:WINDOW])
    none = np.zeros(len(junk), np.int64)
    trainer = Trainer(network)
    trainer.run(first + junk, np.concatenate([marks, none]).astype(np.float64), 160, 0.01)

    def tops() -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
        shared = context.broadcast(network)

        def highest(texts: list[list[bytes]], numbers: list[int]) -> list[tuple[int, int, float]]:
            if not texts:
                return []
            logits, at = shared.value.tops(texts)
            shared.value._reset()
            return list(zip(range(len(texts)), at.tolist(), logits.tolist(), strict=True))

        try:
            return _windows(sample, highest)
        finally:
            shared.unpersist()

    for round_ in range(ROUNDS):
        top, marks, _ = tops()
        trainer.run(top + junk, np.concatenate([marks, none]).astype(np.float64), 24, 0.01 * 0.7**round_)
    _, marks, logits = tops()
    network.calibrate(np.concatenate([logits, network.worst(junk)]), np.concatenate([marks, none]))
    network._reset()
    return network


def _scorer(shared):  # noqa: ANN001, ANN202 - a broadcast network or none
    def score(texts: list[str | None]) -> np.ndarray:
        network = shared.value
        if network and not texts:
            network._reset()
            return np.zeros(0)
        return network.scores([words(t) for t in texts]) if network else np.zeros(len(texts))

    return score


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    run = _scorer(docs.sparkSession.sparkContext.broadcast(train(docs, labels)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(run(batch.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])
        run([])  # lets go of the task's word table

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    out = slim.mapInArrow(scan, "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows scored 0.5 or more."""
    run = _scorer(docs.sparkSession.sparkContext.broadcast(train(docs, labels)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            yield batch.filter(pa.array(run(batch.column("text").to_pylist()) < 0.5, pa.bool_()))
        run([])  # lets go of the task's word table

    return with_plain_names(docs, ("text",), lambda plain: plain.mapInArrow(scan, plain.schema))
