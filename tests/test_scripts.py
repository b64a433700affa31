"""Declarations and imports of script files."""

from siftline.operators import graph, scripts

SOURCE = """// function no() {}
import base, { a as b, type C } from './x';
import * as all from "../y.js"
import './side';
export { d, e as f } from './z';
export * from './w';
const text = 'import q from "r"; {';
export const made = [
  1,
  { k: /[}'"]/ },
]
export async function run({ p }: { p: number }): { a: number } {
  function inner() { return `}` }
  return { a: p };
}
export default class Box<T> extends Base {
  private size = 1;
  name?: string
  constructor(x: number) { super(); }
  static async open<U>(u: U): Promise<void> {
    if (u) { run(); }
  }
}
type Pair =
  | 'a'
  | { b: 1 };
interface Shape { area(): number; kind: string }
enum Color { Red, Green }
"""


def test_declarations():
    lines = lambda a, b: (SOURCE[:a].count("\n") + 1, SOURCE[:b].count("\n") + 1)
    got = [(kind, q, *lines(a, b), out) for kind, _, q, a, b, out in scripts.declarations(SOURCE)]
    assert got == [
        ("variable", "text", 7, 7, False), ("variable", "made", 8, 11, True), ("function", "run", 12, 15, True), ("class", "Box", 16, 23, True),
        ("property", "Box.size", 17, 17, False), ("property", "Box.name", 18, 18, False), ("method", "Box.constructor", 19, 19, False), ("method", "Box.open", 20, 22, False),
        ("type", "Pair", 24, 26, False), ("interface", "Shape", 27, 27, False), ("method", "Shape.area", 27, 27, False), ("property", "Shape.kind", 27, 27, False), ("enum", "Color", 28, 28, False),
    ]
    assert list(scripts.declarations("")) == [] and list(scripts.declarations("class X {"))[0][:2] == ("class", "X")
    assert len(list(scripts.declarations("function f() {}\n" * 20_000))) == 20_000


def test_imports():
    got = [(kind, s, local, name) for kind, s, local, name, _ in scripts.imports(SOURCE)]
    assert got == [
        ("imports", "./x", "base", "default"), ("imports", "./x", "b", "a"), ("imports", "./x", "C", "C"), ("imports", "../y.js", "all", "*"), ("imports", "./side", None, None),
        ("exports", "./z", "d", "d"), ("exports", "./z", "f", "e"), ("exports", "./w", None, "*"),
    ]


def test_tables(spark):
    files = spark.createDataFrame([("src/a.ts", "h", SOURCE), ("src/x.ts", "h", None), ("src/é.ts", "h", "/* 😀 */ export function g() {}")], "path string, source_hash string, content string")
    resolved = graph.resolve_imports(graph.extract_imports(files), files)
    assert {(r["specifier"], r["target"]) for r in resolved.collect()} == {("./x", "src/x.ts"), ("../y.js", None), ("./side", None), ("./z", None), ("./w", None)}
    nodes = {(r["path"], r["qualified_name"]): r for r in graph.extract_nodes(files).collect()}
    run = nodes["src/a.ts", "run"]
    assert (run["start_line"], run["start_column"], run["end_line"], run["end_column"], run["excerpt_truncated"]) == (12, 1, 15, 2, False)
    assert nodes["src/é.ts", "g"]["start_column"] == 10 and ("src/x.ts", "src/x.ts") in nodes


def test_far_apart_parts_of_one_thing():
    """White space and type parameters of any length change nothing about what is a body, a method or a statement's end."""
    from siftline.operators.scripts import declarations

    for n in (1, 199, 201, 499, 501, 5_000):
        gap = " " * n
        code = f"class A {{\n  m<T extends {'U' * n}>(x: T) {{ return 1 }}\n  p: B\n}}\nfunction f(): {gap}{{ a: 1 }} {{ return 2 }}\nconst c ={chr(10)}{gap}1\ntype D = A{chr(10) * n}| B\nconst e = 2\n"
        found = [(k, q, code[a:b].strip()) for k, _, q, a, b, _ in declarations(code)]
        assert [(k, q) for k, q, _ in found] == [("class", "A"), ("method", "A.m"), ("property", "A.p"), ("function", "f"), ("variable", "c"), ("type", "D"), ("variable", "e")]
        texts = {q: t for _, q, t in found}
        assert texts["A.m"].endswith("return 1 }") and texts["f"].endswith("return 2 }") and texts["c"].endswith("1") and texts["D"].endswith("| B") and texts["e"] == "const e = 2"
