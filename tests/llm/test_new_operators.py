"""The manifest, the divergence audit and the repeats against plain versions, with rows of every awkward kind."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from treeline.llm import merkle_manifest, repeat_groups, source_divergence

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, place long, leaf string, spans string, `a.b` int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 7, "x", "y", 1) for r in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    out = [(i, draw.choice(["s", "s", "s", "t", "é", None, ""]), draw.choice(["en", None]), i, f"Text {i % 50} OF É {'Word ' * draw.randint(0, 5)}") for i in range(700)]
    out += [(None, "s", "en", None, None), (None, "s", "en", None, None), (None, None, None, None, ""), (5, "lone", "en", 3, "ABC" * 70_000), (5, "s", "en", 5, "again"), (5, "s", "en", 5, "again"), (8, "zz", None, None, None)]
    return out + [(1000 + i, f"many{i}", "en", 1, "X") for i in range(20)]


def hashed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    def leaf(row):
        return hashed(*["-" if row[k] is None else f"{len(str(row[k]).encode())}:{row[k]}" for k in (0, 1, 2, 3, 4)])

    def tree(level):
        out = [level]
        while len(out[-1]) > 1:
            out.append([hashed(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
        return out

    def way(levels, at):
        for level in levels[:-1]:
            yield at % 16, level[at // 16 * 16 : at // 16 * 16 + 16]
            at //= 16

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in groups[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            steps = [*way(trees[s], i), *way(top, k)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now = leaf((*r[:4], r[4].translate(LOWER) if hit and r[4] is not None else r[4]))
            for at, run in steps:
                now = hashed(*[now if j == at else h for j, h in enumerate(run)])
            proof = hashed(*[h for at, run in steps for j, h in enumerate(run) if j != at])
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(map(str, out))


def test_manifest(spark, rows):
    out = merkle_manifest.manifest(table(spark, rows))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = out.collect()
    assert sorted(str(tuple(r)) for r in got) == plain_manifest(rows)
    assert any(not r["verified"] for r in got) and any(r["verified"] for r in got)


@pytest.mark.parametrize("n", [0, 1, 16, 17, 256, 257])
def test_manifest_of_full_and_lone_runs(spark, n):
    rows = [(i, "s", None, i, f"T{i}") for i in range(n)]
    assert sorted(str(tuple(r)) for r in merkle_manifest.manifest(table(spark, rows)).collect()) == plain_manifest(rows)


def plain_audit(rows, least, top):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOWER))
    count, held, groups = collections.Counter(), collections.defaultdict(set), set()
    for i, r in enumerate(rows):
        source, lang, text = r[1] or "", r[2] or "", r[4] or ""
        groups.add((lang, source))
        for w in words(text):
            count[lang, source, w] += 1
            held[lang, w].add(i)
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(w for g, w in held if g == lang and len(held[g, w]) >= least)
        names = sorted(s for g, s in groups if g == lang)
        of = {s: {w: count[lang, s, w] for w in kept} for s in names}
        whole = {w: sum(of[s][w] for s in names) for w in kept}
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        p, q = {s: share(of[s]) for s in names}, share(whole)
        for s in names:
            pairs = sorted((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode(), o) for o in names if o != s)
            terms = sorted((q[w] - p[s][w], w.encode(), w) for w in kept if of[s][w] and p[s][w] > q[w])
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)] + [(lang, s, "term", w, -v, k) for k, (v, _, w) in enumerate(terms, 1) if k <= top]
    return sorted(map(str, out))


@pytest.mark.parametrize(("least", "top"), [(30, 50), (3, 4), (10_000, 50)])
def test_audit(spark, least, top):
    draw = random.Random(3)
    some = [f"w{chr(97 + k)}" for k in range(26)] + ["É", "日本", "don't"]
    rows = [(i, draw.choice(["a", "a", "a", "b", "c", "é", None]), draw.choice(["en", "en", "de", None]), 1, " ".join(draw.choices(some, k=draw.choice([0, 3, 40])))) for i in range(400)]
    rows += [(None, "alone", "xx", None, None), (1, "empty", "en", None, "123 456"), rows[3], rows[3], (9, "long", "en", 1, "Wa " * 50_000 + "b" * 100_000)]
    out = source_divergence.audit(table(spark, rows), least, top)
    assert sorted(str(tuple(r)) for r in out.select("lang", "source", "part", "item", "value", "rank").collect()) == plain_audit(rows, least, top)
    assert source_divergence.audit(table(spark, [])).count() == 0


def test_audit_with_small_tables_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "HELD", 3)
    rows = [(i, "ab"[i % 2], "en", 1, f"one two {'three ' * (i % 3)}") for i in range(90)]
    assert sorted(str(tuple(r)) for r in source_divergence.audit(table(spark, rows)).select("lang", "source", "part", "item", "value", "rank").collect()) == plain_audit(rows, 30, 50)


def test_joint_histograms_count_every_kept_term(spark):
    rows = [(i, "abc"[i % 3], "en", 1, "x " * (i % 3) + "y z " + "u " * (i % 2)) for i in range(120)]
    counts = source_divergence.Counts(table(spark, rows))
    tally = {(r["a"], r["b"]): r["n"] for r in source_divergence.joint_histograms(counts).groupBy("a", "b").agg(F.sum("terms").alias("n")).collect()}
    assert tally == {("a", "b"): 4, ("a", "c"): 4, ("b", "c"): 4}


def mixed(seed, n=40):
    draw = random.Random(seed)
    letters = lambda k: "".join(draw.choices("abcdefgh éß", k=k))
    shared = [letters(draw.randint(150, 900)) for _ in range(4)]
    out = []
    for _ in range(n):
        text = "".join(draw.choice(shared)[draw.randint(0, 60) :][: draw.randint(100, 700)] if draw.random() < 0.6 else letters(draw.randint(0, 200)) for _ in range(draw.randint(0, 5)))
        out.append(text if draw.random() < 0.7 else text[: len(text) // 2] + "X" + text[len(text) // 2 :])
    return [*out, None, "", "a" * 900, "a" * 199, "ab" * 400, out[0], out[0], shared[0] * 3]


def covered(texts, least):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + least] for r in raws for i in range(len(r) - least + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - least + 1):
            if seen[r[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), len(r) - len(kept), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("seed", "group_bytes"), [(1, repeat_groups.GROUP_BYTES), (2, 1), (3, 2000)])
def test_repeats(spark, monkeypatch, seed, group_bytes):
    """Groups of any size give the same: bounds of a byte split every anchor's cells down to single windows."""
    monkeypatch.setattr(repeat_groups.Repeats.__init__, "__defaults__", (repeat_groups.LEAST, group_bytes))
    texts = mixed(seed)
    docs = table(spark, [(k if k % 9 else 0, "s", "en", 1, t) for k, t in enumerate(texts)])
    out = repeat_groups.remove_repeats(docs).drop("kept")
    want = sorted(str((k if k % 9 else 0, *c)) for k, c in enumerate(covered(texts, 200)))
    assert sorted(str(tuple(r)) for r in out.collect()) == want


def test_repeat_groups_hold_all_their_occurrences(spark):
    texts = mixed(4, 25)
    docs = table(spark, [(k, "s", "en", 1, t) for k, t in enumerate(texts)])
    found = repeat_groups.Repeats(docs)
    raws = [(t or "").encode() for t in texts]
    up = {bytes(r["repeat"]): (r["length"], r["parent"] and bytes(r["parent"])) for r in found.groups().collect()}
    members = collections.defaultdict(set)
    bytes_of = {}
    for r in found.occurrences().collect():
        name = bytes(r["repeat"])
        body = raws[r["doc_id"]][r["at"] : r["at"] + r["length"]]
        assert hashlib.blake2b(body, digest_size=16).digest() == name and len(body) == up[name][0] >= 200
        while name:
            members[name].add((r["doc_id"], r["at"]))
            bytes_of[name] = raws[r["doc_id"]][r["at"] : r["at"] + up[name][0]]
            name = up[name][1]
    for name, body in bytes_of.items():
        everywhere = {(d, i) for d, raw in enumerate(raws) for i in range(len(raw)) if raw.startswith(body, i)}
        assert members[name] <= everywhere and len(everywhere) >= 2
        assert members[name] == everywhere or len(body) > 200  # longer ones may be cut where another cell begins


def test_repeats_of_nothing_and_of_null_ids(spark):
    assert repeat_groups.remove_repeats(table(spark, [])).count() == 0
    docs = table(spark, [(None, None, None, None, "q" * 50 + "z" * 200), (None, None, None, None, "z" * 200), (3, None, None, None, "short")])
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in repeat_groups.remove_repeats(docs).collect()) == [(5, 0, 0), (200, 200, 1), (250, 200, 1)]


def test_long_texts_are_named_in_strides(monkeypatch):
    draw = random.Random(9)
    passage = bytes(draw.choices(b"abcdefgh", k=700))
    text = bytes(draw.choices(b"xyz ", k=5000)) + passage + bytes(draw.choices(b"xyz ", k=3000)) + passage
    whole = {(int(f), int(l), int(a)) for part in repeat_groups.cells(text) for f, l, a, _ in zip(*part, strict=True)}
    monkeypatch.setattr(repeat_groups, "STRIDE", 1000)
    cut = {w: int(a) for part in repeat_groups.cells(text) for f, l, a, _ in zip(*part, strict=True) for w in range(f, l + 1)}
    assert cut == {w: a for f, l, a in whole for w in range(f, l + 1)} and len(cut) == len(text) - 199


def test_interval_tree():
    # banana: suffixes a, ana, anana, banana, na, nana; shared 0 1 3 0 0 2; before them n, n, b, -, a, a
    groups, parent, over = repeat_groups.interval_tree([0, 1, 3, 0, 0, 2], [False, False, True, True, True, False])
    assert groups == [(3, 1, 2), (1, 0, 2)] and parent == [1, -1] and over == [1, 0, 0, -1, -1, -1]
