"""Names in patterns, on sources checked by hand."""

import pytest

from treeline.engine import Workspace
from treeline.sources import workspace

TREE = {
    "p/Cargo.toml": '[package]\nname = "p"\n',
    "p/src/lib.rs": "pub mod kinds;\nmod used;\npub use kinds::Sort as Order;\npub use kinds::low as floor;\n",
    "p/src/kinds.rs": "pub const low: u8 = 1;\npub static ONCE: u8 = 2;\nconst hidden: u8 = 3;\npub enum Sort { Up, Down(u8), Both { far: u8 } }\npub struct Point { x: u8 }\npub fn call() {}\n",
    "p/src/used.rs": (
        "use crate::floor;\nuse crate::Order;\nuse crate::kinds::{hidden, ONCE, call};\n"
        "fn a(v: Order) { match v { Order::Up => {} Order::Down(floor) => {} Order::Both { far } => { far; } } }\n"
        "fn b(v: u8) { const mine: u8 = 1; match v { mine => {} floor => { floor; } other => { other; } } { const other: u8 = 2; match v { other => {} } } }\n"
        "fn c(v: u8) { match v { ONCE => {} hidden => {} call => {} } }\n"
        "fn d(v: u8) { if let (low, 1) | (1, low) = v {} let Order::Up = w; for Order::Down(n) in q {} }\n"
    ),
}


@pytest.fixture(scope="module")
def ws(spark):
    return Workspace(workspace.memory_tree(spark, TREE))


def at(name, nth=0, path="p/src/used.rs"):
    text, i = TREE[path], -1
    for _ in range(nth + 1):
        i = text.index(name, i + 1)
    return i


def test_outcomes(ws):
    found = {r["start"]: (r["outcome"], r["targets"], r["why"]) for r in ws.patterns.filter("path = 'p/src/used.rs'").collect()}
    bound, torn = ("binding", None, None), ("unavailable", None, "unsupported-context")
    one = lambda addr: ("resolved", [addr], None)
    assert found[at("Order::Up")] == found[at("Order::Up", 1)] == one("p::kinds::Sort::Up")
    assert found[at("Order::Down")] == found[at("Order::Down", 1)] == one("p::kinds::Sort::Down") and found[at("Order::Both")] == one("p::kinds::Sort::Both")
    assert found[at("(floor)") + 1] == found[at("floor => { floor")] == one("p::kinds::low")
    assert found[at("far }")] == bound
    assert found[at("mine =>")] == one(f"p/src/used.rs@{at('mine: u8')}")
    assert found[at("other => { other")] == bound and found[at("other => {}")] == one(f"p/src/used.rs@{at('other: u8')}")
    assert found[at("ONCE =>")] == torn  # a static is no pattern
    assert found[at("hidden =>")] == bound or found[at("hidden =>")] == torn  # not in reach
    assert found[at("call =>")] == bound  # functions take no part
    assert found[at("(low, 1)") + 1] == found[at("(1, low)") + 4] == bound and found[at("(n)") + 1] == bound


def test_uses_of_a_constant_are_not_local(ws):
    local = {r["start"]: r["b_start"] for r in ws.bindings().filter("path = 'p/src/used.rs'").collect()}
    assert at("floor; }") not in local and local[at("other; }")] == at("other => { other")
    assert local[at("far; }")] == at("far }")
    assert ws.navigate("p/src/used.rs", at("Up =>")).first()["tier"] == "pattern"
    assert ws.navigate("p/src/used.rs", at("floor; }")).first()["targets"] == ["p::kinds::low"]
