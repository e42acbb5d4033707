import pytest

from codeloom.extract.languages import extract, python_imports

RUST = '''use a::b;

/// Adds.
/// Twice.
#[inline]
pub fn add(a: i32, b: &str) -> i32 { helper(a); m::other(b) }
fn helper(x: i32) {}
pub trait Shape { fn area(&self) -> f64; fn name(&self) -> String { self.area(); String::new() } }
impl<T: Copy> geo::Shape for Square<T> where T: Sized {
    fn area(&self) -> f64 { compute("}") }
}
const LIMIT: usize = 3;
static NAME: &str = "x";
enum Kind { A, B(i32) }
'''
PYTHON = '''"""Module."""
LIMIT = 5
rate: float = 0.5
TEXT = """a
def no(): pass
"""

@overload
def f(a: int) -> int: ...
@typing.overload
def f(a: str) -> str: ...

class Base(pkg.Root, Other):
    """Base class."""
    x = 3

    def run(self, a: int, b="q", *args) -> None:
        """Runs."""
        def inner():
            return helper(a)
        y = 1
        self.step(
            a)

    async def step(self): return run()
def broken(
'''
TS = '''/** Adds. */
export function add(a: number, b?: string): number { return helper(a); }
export const mul = (x: number): number => { return add(x, "}"); };
const LIMIT = 3;
let calc = compute(1);
export abstract class Shape extends Base implements A, ns.B<C> {
  static make(n: number) { return new Shape(); }
  /** Area. */
  area(): number { if (this.x) { return this.side(); } return 0; }
  x = 3;
}
interface Thing { go(): void; }
'''
GO = '''package p

// Doc one.

// Add adds.
func Add(a, b int, s string) (int, error) { return util.Sum(a, b), nil }

type (
	Box struct { v int }
)

func (b *Box[T]) Get() int { return Add(b.v, 1) }
const Max = 3
const (
	A, B = 1, 2
	C = iota
)
'''


def names(nodes):
    return [(n["kind"], n["node_id"].split(":", 2)[2]) for n in nodes]


def test_rust():
    nodes, refs = extract("src/lib.rs", "rust", RUST)
    assert names(nodes) == [("function", "_:add"), ("function", "_:helper"), ("class", "_:Shape"), ("function", "_:name"), ("function", "Square<T><Shape>:area"), ("function", "_:area"), ("constant", "_:LIMIT"), ("constant", "_:NAME"), ("class", "_:Kind")]
    add = nodes[0]
    assert add["description"] == "Adds. Twice." and (add["start_line"], add["end_line"]) == (6, 6)
    assert add["signatures"] == [{"params": [{"name": "a", "type": "i32"}, {"name": "b", "type": "&str"}], "returns": "i32"}]
    assert [(r["kind"], r["from_id"].split(":")[-1], r["ref_name"]) for r in refs if r["kind"] == "calls"] == [("calls", "add", "helper"), ("calls", "add", "other"), ("calls", "name", "area"), ("calls", "name", "new"), ("calls", "area", "compute")]
    assert [(r["from_id"].split(":")[-1], r["ref_name"]) for r in refs if r["kind"] == "implements"] == [("Square", "Shape")]
    assert "m::other" in [r["ref_name"] for r in extract("src/lib.rs", "rust", RUST, compat=True)[1]]


def test_python():
    nodes, refs = extract("p/m.py", "python", PYTHON)
    assert names(nodes) == [("constant", "_:LIMIT"), ("constant", "_:rate"), ("constant", "_:TEXT"), ("function", "_:f"), ("class", "_:Base"), ("function", "Base:run"), ("function", "Base:inner"), ("function", "Base:step"), ("function", "_:broken")]
    by = {n["name"]: n for n in nodes}
    assert len(by["f"]["signatures"]) == 2 and not by["f"]["content_hash"].startswith("overload")
    assert by["run"]["description"] == "Runs." and by["run"]["signatures"][0]["params"] == [{"name": "a", "type": "int"}, {"name": "b", "type": None}]
    assert PYTHON.split("\n")[by["run"]["end_line"] - 1].strip() == "a)"
    assert [(r["kind"], r["from_id"].split(":")[-1], r["ref_name"]) for r in refs] == [("inherits_from", "Base", "Root"), ("inherits_from", "Base", "Other"), ("calls", "inner", "helper"), ("calls", "run", "step"), ("calls", "step", "run")]


def test_typescript():
    nodes, refs = extract("s/a.ts", "typescript", TS)
    assert names(nodes) == [("function", "_:add"), ("function", "_:mul"), ("constant", "_:LIMIT"), ("class", "_:Shape"), ("function", "Shape:make"), ("function", "Shape:area"), ("class", "_:Thing")]
    by = {n["name"]: n for n in nodes}
    assert by["add"]["description"] == "Adds." and by["area"]["description"] == "Area." and by["add"]["signatures"][0]["params"][1] == {"name": "b", "type": "string"}
    assert [(r["kind"], r["from_id"].split(":")[-1], r["ref_name"]) for r in refs] == [("calls", "add", "helper"), ("calls", "mul", "add"), ("inherits_from", "Shape", "Base"), ("implements", "Shape", "A"), ("implements", "Shape", "B"), ("calls", "area", "side")]


def test_overloads_by_class():
    text = "class A { m() {} }\nclass B { m() {} }\n"
    assert len(extract("a.ts", "typescript", text)[0]) == 4 and len(extract("a.ts", "typescript", text, compat=True)[0]) == 3


def test_go():
    nodes, refs = extract("p/a.go", "go", GO)
    assert sorted(names(nodes)) == sorted([("function", "_:Add"), ("class", "_:Box"), ("function", "Box:Get"), ("constant", "_:Max"), ("constant", "_:A"), ("constant", "_:C")])
    add = next(n for n in nodes if n["name"] == "Add")
    assert add["description"] == "Add adds." and add["signatures"][0] == {"params": [{"name": x, "type": t} for x, t in (("a", "int"), ("b", "int"), ("s", "string"))], "returns": "(int, error)"}
    assert [(r["from_id"].split(":", 2)[2], r["ref_name"]) for r in refs] == [("_:Add", "Sum"), ("Box:Get", "Add")]


def test_java():
    text = "class A extends B {\n /* Doc. */\n A(int n) { run(n); }\n static <T> List<T> of(final T[] x) throws E { return new ArrayList<>(util.list(x)); }\n enum K { X }\n}\n"
    nodes, refs = extract("A.java", "java", text)
    assert names(nodes) == [("class", "_:A"), ("function", "A:A"), ("function", "A:of"), ("class", "_:K")]
    assert nodes[1]["description"] == "Doc." and nodes[2]["signatures"][0] == {"params": [{"name": "x", "type": "T[]"}], "returns": "List<T>"}
    assert [(r["from_id"].split(":")[-1], r["ref_name"]) for r in refs] == [("A", "run"), ("of", "list")]


def test_python_imports():
    text = "import os.path, re as r\nfrom a.b import (c as d,\n e)\ndef f():\n    import x\n"
    assert python_imports(text) == [("path", "os.path"), ("r", "re"), ("d", "a.b.c"), ("e", "a.b.e")]


@pytest.mark.parametrize("language", ["rust", "python", "typescript", "javascript", "go", "java"])
def test_never_raises(language):
    import random

    rng = random.Random(1)
    parts = ["fn ", "def f", "class A", "impl ", "(", ")", "{", "}", "[", "]", '"', "'", "`", "/*", "*/", "//", "#", "\n", "    ", "=>", ":", "=", "func ", "const x", "<", ">", "é", "\\", "r#\"", '"""', "for "]
    for _ in range(300):
        extract("a/b.x", language, "".join(rng.choice(parts) for _ in range(rng.randrange(40))))
    assert extract("a", "cobol", "x") == ([], [])


@pytest.mark.parametrize("language", ["rust", "python", "typescript", "go", "java"])
def test_time_grows_with_the_file_and_not_its_square(language):
    import time

    from codeloom.queries import PROJECT

    _, head, body, tail = PROJECT[language]

    def seconds(n: int) -> float:
        text = head + "".join(body.replace("{k}", str(k)).replace("{n}", str(k + 1)) for k in range(n)) + tail
        began = time.process_time()
        nodes, refs = extract("src/f.x", language, text)
        assert len(refs) == n and len(nodes) == n + (language == "java")
        return time.process_time() - began

    seconds(100)
    assert seconds(8000) < 20 * min(seconds(1000), seconds(1000))  # 8 times the text; 34 to 46 times before


def test_long_strings_are_no_names():
    import time

    began = time.process_time()
    assert [r["ref_name"] for r in extract("a.ts", "typescript", "function f() {\n  g('" + "x" * 40_000 + "'); }\n")[1]] == ["g"]
    assert time.process_time() - began < 3
