"""Trees of sources and structural search over them."""

import pytest

from treeline.engine import Workspace
from treeline.lang import tree
from treeline.operators import structure
from treeline.sources import workspace

TREE = {
    "a.rs": "pub fn go(a: u8, b: &T) -> u8 {\n    let c = a + 1 * b;\n    f(x.y(1)?, &z, g());\n    if a == b { one(1) } else { h!(q) }\n}\nfn none() {}\nstruct P { x: u8 }\n",
    "b.rs": "fn é() { match v { A::B => f(1), C { x } if x > 0 => { f(f(2), é) } _ => P { x: 1 }.go() } return x == x || y == z; }\n",
    "c.ts": 'import { a } from "./x";\nexport function f(p: T) { const k = (u) => g(u) + 1; return k(p).b; }\n',
}


def shown(text, language="rust"):
    rows, below = tree.nodes(text, language), {}
    for r in rows:
        below.setdefault(r["parent"], []).append(r)
    out = {}
    for r in reversed(rows):
        out[r["pre"]] = r["text"] if r["text"] is not None else f"{r['kind']}[{' '.join(out[c['pre']] for c in below.get(r['pre'], []))}]"
    return out[0]


def test_trees():
    assert shown("let c = a + 1 * -b;") == "source_file[let_declaration[let c = binary_expression[a + binary_expression[1 * unary_expression[- b]]] ;]]"
    assert shown("x.y(1)?.z = a == b && c;") == "source_file[expression_statement[assignment_expression[field_expression[try_expression[call_expression[field_expression[x . y] arguments[( 1 )]] ?] . z] = binary_expression[binary_expression[a = = b] && c]] ;]]"
    assert shown("pub(crate) fn f(a: &mut T) {}") == "source_file[function_item[visibility_modifier[pub ( crate )] fn f parameters[( parameter[a : reference_expression[& mut T]] )] block[{ }]]]"
    assert "match_arm[C field_initializer_list" not in shown(TREE["b.rs"]) and "match_arm[struct_expression[C field_initializer_list[{ x }]] if binary_expression[x > 0] => block[" in shown(TREE["b.rs"])
    assert shown(TREE["c.ts"], "typescript").startswith('program[import_statement[import named_imports[{ a }] from "./x" ;] function_declaration[export function f formal_parameters[( parameter[p : T] )] statement_block[{ lexical_declaration[const k = arrow_function[')


@pytest.mark.parametrize("text", [*TREE.values(), "", "}{)(", "fn f() { " + "{" * 20_000 + "}" * 20_000, "x = " + "(" * 20_000 + "1", "- " * 20_000 + "a", "if a { " * 5_000])
def test_intervals_nest(text):
    rows = tree.nodes(text, "rust")
    assert [r["pre"] for r in rows] == list(range(len(rows))) and sorted(r["post"] for r in rows) == list(range(len(rows)))
    for r in rows[1:]:
        up = rows[r["parent"]]
        assert up["pre"] < r["pre"] and r["post"] < up["post"] and up["start"] <= r["start"] <= r["end"] <= up["end"] and r["ord"] + r["rord"] == up["n"] - 1


@pytest.fixture(scope="module")
def ws(spark):
    return Workspace(workspace.memory_tree(spark, TREE))


def hits(ws, pattern, language="rust", kind=None):
    return sorted((r["path"], TREE[r["path"]].encode()[r["start"] : r["end"]].decode(), r["captures"]) for r in structure.structural(ws.files, ws.tree, pattern, language, kind).collect())


def test_single_nodes_and_runs(ws):
    assert hits(ws, "f($X)") == [("b.rs", "f(1)", {"X": "1"}), ("b.rs", "f(2)", {"X": "2"})]
    assert sorted(c["A"] for _, _, c in hits(ws, "f($$$A)")) == sorted(["x.y(1)?, &z, g()", "1", "2", "f(2), é"])
    assert hits(ws, "let c = $X;") == [("a.rs", "let c = a + 1 * b;", {"X": "a + 1 * b"})]
    assert hits(ws, "fn $N() { $$$B }") == [("a.rs", "fn none() {}", {"N": "none", "B": ""}), ("b.rs", TREE["b.rs"].strip(), {"N": "é", "B": TREE["b.rs"].strip()[9:-2]})]
    assert hits(ws, "$F($$$A, &z, $$$B)") == [("a.rs", "f(x.y(1)?, &z, g())", {"F": "f", "A": "x.y(1)?", "B": "g()"})]
    assert hits(ws, "pub fn $N($$$) -> u8 { $$$A f($$$); $$$B }") == [("a.rs", TREE["a.rs"].split("fn none")[0].strip(), {"N": "go", "A": "let c = a + 1 * b;", "B": "if a == b { one(1) } else { h!(q) }"})]
    assert hits(ws, "$X == $X") == [("b.rs", "x == x", {"X": "x"})]


def test_kinds(ws):
    assert [h[1] for h in hits(ws, "$X.go()", kind="call_expression")] == ["P { x: 1 }.go()"] and hits(ws, "$X.go()", kind="block") == []
    assert hits(ws, "k($A)", "typescript") == [("c.ts", "k(p)", {"A": "p"})]
    found = structure.inside(ws.tree.filter("kind = 'integer_literal'"), ws.tree.filter("kind = 'match_arm'")).select("text").collect()
    assert sorted(r[0] for r in found) == ["0", "1", "1", "2"]
    with pytest.raises(ValueError, match="whole construct"):
        structure.parse_pattern("a b", "rust")
