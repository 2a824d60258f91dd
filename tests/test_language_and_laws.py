"""Parsers without Spark, and laws of edits and addresses."""

from hypothesis import given, settings
from hypothesis import strategies as st

from treeline.lang import fake, rust, typescript
from treeline.operators import search
from treeline.sources.workspace import ignore_regex


def test_rust_items():
    f = rust.facts("use a::{b::C as D, self, e::*};\n/// d\n#[x]\npub(crate) struct S<T> { f: T }\nimpl S<u8> { fn m(&self, k: u8) { k.go(q::r(1)) } }\nenum E { A, B(u8) }\nmod t { fn inner() {} }\n")
    assert [(s["kind"], s["name"]) for s in f.symbols] == [("struct", "S"), ("field", "f"), ("impl", "S"), ("method", "m"), ("enum", "E"), ("variant", "A"), ("variant", "B"), ("module", "t"), ("function", "inner")]
    assert f.symbols[0]["modifier"] == "pub(crate)" and f.symbols[0]["ext_start"] == 32
    assert [(i["raw"], i["glob"], i["binding"]) for i in f.imports if i["declares"] and not i["is_prefix"]] == [("a::b::C", False, "D"), ("a", False, "a"), ("a::e", True, None)]
    assert [(c["callee"], c["kind"]) for c in f.calls] == [("go", "member"), ("r", "direct")]


def test_typescript_items():
    f = typescript.facts('import d, { a as b } from "./x";\nexport default function f<T>(p: T, { q }: Q) { g(p); }\nexport const k = (u) => h(u);\ninterface I { m(): void; n: string }\nenum E { A = 1, B }\n')
    assert [(s["kind"], s["name"]) for s in f.symbols] == [("function", "f"), ("variable", "k"), ("interface", "I"), ("method", "m"), ("field", "n"), ("enum", "E"), ("variant", "A"), ("variant", "B")]
    assert {(n["local"], n["imported"]) for n in f.named_imports} == {("d", "default"), ("b", "a")}
    assert {c["callee"] for c in f.calls} == {"g", "h"} and {"p", "q", "u"} <= {x["name"] for x in f.lexical}


def test_fake_language():
    f = fake.facts("def Engine\nuse a.p/Engine\nEngine")
    assert f.symbols[0]["name"] == "Engine" and f.imports[0]["segments"] == ["a.p", "Engine"]


@given(st.text(max_size=300))
@settings(max_examples=150, deadline=None)
def test_parsers_take_any_text(text):
    for parse in (rust.facts, typescript.facts, fake.facts):
        size = len(text.encode("utf-8", "replace"))
        try:
            found = parse(text)
        except UnicodeEncodeError:
            return
        assert all(0 <= t["start"] <= t["end"] <= size for t in found.tokens)


def test_ignores_and_choices():
    import re

    assert re.search(ignore_regex("*.log"), "a/b.log") and not re.search(ignore_regex("/b.log"), "a/b.log")
    assert re.search(ignore_regex("a/**/z"), "a/x/y/z") and not re.search(ignore_regex("src/a"), "src/ab")
    assert search.parse_choice("3,27-29") == [3, 27, 28, 29]
    assert search.parse_bar("kind:struct foo name:Bar") == {"kind": "struct", "name": "Bar", "pattern": "foo"}


def test_fuzzy_scores():
    assert search.fuzzy_score("src/main.rs", ["zz"]) is None
    assert search.fuzzy_score("src/main.rs", ["main"]) > search.fuzzy_score("src/m_a_i_n.rs", ["main"])


words = st.lists(st.text("ab é\n", max_size=6), min_size=1, max_size=6)


@given(words, words)
@settings(max_examples=5, deadline=None)
def test_splice_is_the_plain_splice(kept, put):
    from pyspark.sql import SparkSession

    from treeline.plans import edits

    spark = SparkSession.builder.getOrCreate()
    text, at, rows, want = "#".join(kept), 0, [], ""
    for k, piece in enumerate(kept):
        want += piece
        at += len(piece.encode())
        if k < len(kept) - 1:
            new = put[k % len(put)]
            rows.append(("p", at, at + 1, new, k))
            want += new
            at += 1
    if rows:
        files = spark.createDataFrame([("p", text)], "path string, text string")
        changes = spark.createDataFrame(rows, "path string, start int, end int, replacement string, seq int")
        assert edits.splice(files, changes).first()["text"] == want


def test_sites_of_patterns():
    f = rust.facts("fn f((a, P(b, _)): T, mut c: u8) {\n match a { x => 1, O | S::D if a > 0 => { let k = 1; } R(n @ 1..=9) | S::B { side: n } => if n { 1 } else { 2 } S::B { side } => match side { 0 => w, v => v }, 0..=MAX => 4, Q((ref y, I | z)) => 5, vec!(q) => 0, _ => 6 };\n if let Some(u) | None = q {}\n}\n")
    seen = [("::".join(r["segments"]), r["role"], r["shape"], r["explicit"]) for r in f.patterns]
    assert seen == [
        ("a", "identifier", None, False), ("P", "constructor", "tuple", False), ("b", "identifier", None, False), ("c", "identifier", None, True), ("x", "identifier", None, False), ("O", "identifier", None, False),
        ("S::D", "identifier", None, False), ("k", "identifier", None, False), ("R", "constructor", "tuple", False), ("n", "identifier", None, True), ("S::B", "constructor", "record", False), ("n", "identifier", None, True),
        ("S::B", "constructor", "record", False), ("side", "identifier", None, True), ("v", "identifier", None, False), ("MAX", "constant", None, False), ("Q", "constructor", "tuple", False), ("y", "identifier", None, True),
        ("I", "identifier", None, False), ("z", "identifier", None, False), ("Some", "constructor", "tuple", False), ("u", "identifier", None, False), ("None", "identifier", None, False),
    ]
    branches = {r["name"]: [(b["branch"], b["of"]) for b in r["branches"]] for r in f.patterns if r["branches"]}
    assert branches["O"] == branches["R"] == branches["Some"] == [(0, 2)] and branches["z"] == branches["None"] == [(1, 2)] and "Q" not in branches
    assert {r["name"]: r["by_ref"] for r in f.patterns}["y"] and {r["name"]: r["mutable"] for r in f.patterns}["c"]


def test_items_of_blocks_are_seen_in_their_blocks():
    f = rust.facts("fn f() { g(); { const K: u8 = 1; struct S; } fn g() {} }\n")
    assert [(x["name"], x["kind"], x["namespace"], x["scope_start"]) for x in sorted(f.lexical, key=lambda x: (x["name_start"], x["namespace"] == "type"))] == [("K", "const", "value", 14), ("S", "struct", "value", 14), ("S", "struct", "type", 14), ("g", "function", "value", 7)]


def test_sources_of_any_depth():
    n = 20_000
    for text in ("fn f() {" + "{" * n + "}" * n + "}", "".join(f"mod m{i % 7} {{" for i in range(n)) + "}" * n, "fn f() { " + "if a { match b { x => { " * (n // 10) + "} } } " * (n // 10) + "}"):
        found = rust.facts(text)
        assert found.tokens and found.symbols
    assert len(rust.facts("use a::{b::" * 2000 + "c" + "}" * 2000 + ";").imports) > 2000
    for text in ("function f() {" + "{" * n + "}" * n + "}", "class A { m() { " * 2000 + "} }" * 2000, "if (a) { " * n + "}" * n, "f(() => {" * 3000 + "})" * 3000):
        assert typescript.facts(text).tokens
