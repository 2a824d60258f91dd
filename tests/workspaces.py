"""A small source tree for the tests: tide tables, berths and a desk, with a few script modules for charts."""

TREE = {
    "Cargo.toml": '[workspace]\nmembers = ["tide", "berth", "desk"]\n',
    "tide/Cargo.toml": '[package]\nname = "tide"\n',
    "berth/Cargo.toml": '[package]\nname = "berth-plan"\n[dependencies]\ntide = "1"\n',
    "desk/Cargo.toml": '[package]\nname = "desk"\n[dependencies]\nplan = { package = "berth-plan" }\n',
    # Level is offered under three more names, one above the other, the last in another package.
    "tide/src/lib.rs": "pub mod gauge;\npub use gauge::Level;\n",
    "tide/src/gauge/mod.rs": "pub mod clock;\npub mod level;\npub use level::Level;\n\npub fn read(at: u16) -> Level {\n    Level { cm: clock::turns(at) }\n}\n",
    "tide/src/gauge/level.rs": "/// Height of the water, in µm.\npub struct Level {\n    pub cm: u16,\n}\n\nimpl Level {\n    pub fn ebb(self, by: u16) -> u16 {\n        self.cm - by\n    }\n}\n",
    "tide/src/gauge/clock.rs": "pub fn turns(at: u16) -> u16 {\n    at / half()\n}\n\nfn half() -> u16 {\n    372\n}\n\nconst LEAP: u16 = 4;\n",
    # Two modules that offer all of each other, and a module whose path holds one name twice.
    "berth/src/lib.rs": "pub mod quay;\npub mod east;\npub mod west;\npub use tide::Level as Water;\n",
    "berth/src/east.rs": "pub use crate::west::*;\n\npub fn sunrise() {}\n",
    "berth/src/west.rs": "pub use crate::east::*;\n\npub fn sunset() {}\n",
    "berth/src/quay/mod.rs": "use std::fmt::Debug;\nuse tide::gauge::{clock::turns, level};\n\npub mod quay;\n\npub enum Slot {\n    Free,\n    Taken { ship: u16 },\n}\n\npub fn deepest(at: u16) -> level::Level {\n    let n = turns(at);\n    tide::gauge::read(n)\n}\n",
    "berth/src/quay/quay.rs": "pub fn quay() -> u16 {\n    9\n}\n",
    "desk/src/main.rs": "mod board;\n\nuse plan::{quay::*, Water};\n\nfn main() {\n    let w: Water = deepest(7);\n    board::show(w);\n    plan::east::sunset();\n}\n",
    "desk/src/board.rs": "use plan::quay::Slot;\nuse plan::quay::quay::quay;\nuse plan::Water as Sea;\n\npub fn show(s: Sea) -> u16 {\n    let held = Slot::Taken { ship: quay() };\n    drop((s, held));\n    3\n}\n",
    "site/index.ts": 'export * from "./main";\nexport { metre as meter } from "./units";\n',
    "site/main.ts": 'import { plot, Mark } from "./chart/plot";\nimport * as units from "./units";\nexport const first: Mark = plot(units.metre);\n',
    "site/chart/plot.ts": "export interface Mark { x: number }\nexport function plot(x: number): Mark { return { x }; }\n",
    "site/units.ts": "export const metre = 1;\n",
    "notes/ships.txt": "not a source file\n",
}
