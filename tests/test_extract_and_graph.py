"""Extractors on snippets, the tree source, and the whole way from a folder to a graph."""

import json
import time

import pytest
from loomgraph.extract import EXTRACTORS
from loomgraph.extract.sites import Lines, enclosed, signature
from loomgraph.graph import CodeGraph
from loomgraph.sources import git_clone, graph_json, ignore, repo_tree, view_state
from loomgraph.functions.style import DetailSettings
from loomgraph.streaming import progress


def found(language, source):
    blocks, parents, refs = enclosed(EXTRACTORS[language](source))
    named = [(b.kind, b.name, b.visibility) for b in blocks]
    inside = [(r.kind, r.name) for r, around in refs for _ in around]
    return named, inside, [None if p is None else blocks[p].name for p in parents]


@pytest.mark.parametrize(
    "language,source,block",
    [
        ("Python", "def foo(): pass", ("Function", "foo", "Public")),
        ("Python", "class Foo:\n    pass", ("Class", "Foo", "Public")),
        ("Python", "async def _private(): pass", ("Function", "_private", "Private")),
        ("Python", "def broken(:\n    x()\n", ("Function", "broken", "Public")),
        ("TypeScript", "export function greet(n: string): void {}", ("Function", "greet", "Public")),
        ("TypeScript", "class Foo {}", ("Class", "Foo", "Public")),
        ("TypeScript", "interface Bar { x: number }", ("Interface", "Bar", "Public")),
        ("TypeScript", "type Alias = string | number;", ("TypeAlias", "Alias", "Public")),
        ("TypeScript", "enum Color { Red, Green }", ("Enum", "Color", "Public")),
        ("TypeScript", "const add = (a: number) => a + 1;", ("Function", "add", "Public")),
        ("JavaScript", "const add = function(a) { return a; }", ("Function", "add", "Public")),
        ("JavaScript", "function* gen() { yield 1; }", ("Function", "gen", "Public")),
        ("Rust", "fn f() {}", ("Function", "f", "Private")),
        ("Rust", "pub async fn f() {}", ("Function", "f", "Public")),
        ("Rust", "pub(crate) fn f() {}", ("Function", "f", "Crate")),
        ("Rust", "pub(super) fn f() {}", ("Function", "f", "Protected")),
        ("Rust", "struct Foo { a: u8 }", ("Struct", "Foo", "Private")),
        ("Rust", "enum E { A, B(u8) }", ("Enum", "E", "Private")),
        ("Rust", "trait T { fn a(&self); }", ("Trait", "T", "Private")),
        ("Rust", "impl Foo {}", ("Impl", "impl Foo", "Private")),
        ("Rust", "impl Display for Foo {}", ("Impl", "Display for Foo", "Private")),
        ("Rust", "mod inner {}", ("Module", "inner", "Private")),
        ("Rust", "const MAX: u32 = 3;", ("Constant", "MAX", "Private")),
        ("Rust", "type Short = Vec<u8>;", ("TypeAlias", "Short", "Private")),
    ],
)
def test_one_block(language, source, block):
    assert found(language, source)[0] == [block]


@pytest.mark.parametrize(
    "language,source,refs",
    [
        ("Python", "import os\nfrom a import b", []),
        ("Python", "def f():\n    import os, sys\n    from .x import y", [("Import", "os"), ("Import", ".x")]),
        ("Python", "def f():\n    obj.method()\n    bar()", [("MethodCall", "method"), ("FunctionCall", "bar")]),
        ("Python", "def f(a: MyClass, b: int) -> MyResult: pass", [("TypeReference", "MyClass"), ("TypeReference", "MyResult")]),
        ("Python", "class Foo(Bar): pass", [("Inheritance", "Bar")]),
        ("Python", "class A:\n    def m(self):\n        go()", [("FunctionCall", "go")] * 2),
        ("TypeScript", "import { a } from './a';", []),
        ("TypeScript", "function f() { const x = require('fs'); }", [("FunctionCall", "require")]),
        ("TypeScript", "function f() { obj.run(); go(); }", [("MethodCall", "run"), ("FunctionCall", "go")]),
        ("TypeScript", "function f(a: Foo, b: number): Bar { }", [("TypeReference", "Foo"), ("TypeReference", "Bar")]),
        ("TypeScript", "function f(a: string): void { }", []),
        ("TypeScript", "class Foo extends Bar {}", [("TypeReference", "Foo"), ("Inheritance", "Bar")]),
        ("JavaScript", "class Foo extends Bar {}", []),
        ("Rust", "fn f() { self.method(); foo.bar(); Vec::new(); baz(); }", [("MethodCall", "method"), ("MethodCall", "bar"), ("FunctionCall", "new"), ("FunctionCall", "baz")]),
        ("Rust", "use std::collections::HashMap;", []),
        ("Rust", "mod m { use std::collections::HashMap; }", [("Import", "HashMap")]),
        ("Rust", 'fn f() { let s = "x()"; /* y() */ // z()\n }', []),
        ("Rust", "fn a<'a>(x: &'a str) -> &'a str { b() }", [("FunctionCall", "b")]),
        ("Rust", "fn a() { b('x', b'\\x41', '\\u{1F600}', '\\'', '日'); 'outer: loop { c() } }", [("FunctionCall", "b"), ("FunctionCall", "c")]),
        ("Rust", "impl<'a, 'b> T for P<'a, 'b> { }", [("TraitImpl", "T"), ("TypeReference", "T"), ("TypeReference", "P")]),
        ("JavaScript", "function f() { return `${g()} ${`${h(`}`)}`} ${{a: i()}}`; j() }", [("FunctionCall", c) for c in "ghij"]),
        ("JavaScript", "function f() { g(`never ends ${h()", [("FunctionCall", "g"), ("FunctionCall", "h")]),
        ("Python", 'def f(a: T) -> R:\n    import os\n    g()\n    print "x", h()\n    k()', [("TypeReference", "T"), ("TypeReference", "R"), ("Import", "os"), ("FunctionCall", "g"), ("FunctionCall", "h"), ("FunctionCall", "k")]),
        ("Python", "class A(B):\n    def f(self, x: T):\n        if x = 1:\n            g()\nexec 'y'", [("Inheritance", "B"), ("TypeReference", "T"), ("TypeReference", "T"), ("FunctionCall", "g"), ("FunctionCall", "g")]),
    ],
)
def test_references(language, source, refs):
    assert found(language, source)[1] == refs


def test_python_that_stays_unreadable_is_scanned_by_line():
    bad = "\n".join(f"print 'x{i}'" for i in range(60))
    blocks, refs, parents = found("Python", f"class A(B, c.D):\n    import os\n    from .x import y\n    def f(self, a: T[U]) -> R:\n        g(); o.h()\n{bad}\ndef z(): z1()\n")
    assert blocks == [("Class", "A", "Public"), ("Function", "f", "Public"), ("Function", "z", "Public")]
    assert parents == [None, "A", None]
    assert set(refs) >= {("Inheritance", "B"), ("Import", "os"), ("Import", ".x"), ("TypeReference", "R"), ("TypeReference", "U"), ("FunctionCall", "g"), ("MethodCall", "h"), ("FunctionCall", "z1")}


def test_a_long_flat_file_is_scanned_in_linear_time():
    source = "print 'x'\n" * 60 + "def f(): g()\n" * 20_000
    began = time.perf_counter()
    assert sum(s.kind == "Function" for s in EXTRACTORS["Python"](source)) == 20_000
    assert time.perf_counter() - began < 60


def test_trait_implementation_and_nesting():
    assert ("TraitImpl", "Display") in found("Rust", "impl Display for Foo { fn fmt(&self) {} }")[1]
    assert found("Python", "class Foo:\n    def bar(self): pass")[2] == [None, "Foo"]
    assert found("TypeScript", "class A { m() { if (x) { y(); } } }")[2] == [None, "A"]
    assert all(found(language, "") == ([], [], []) for language in EXTRACTORS)


def test_lines_and_signature():
    lines = Lines("é = 1\nfoo")
    assert lines.at(2) == (1, 3) and lines.at(7) == (2, 1) and lines.offset(1, 3) == 2
    assert signature("  def f(\n a)") == "def f(" and signature("") is None


def test_ignore_rules():
    rules = [("", ignore.parse("# c\n*.log\n/build\nout/\n!keep.log\na/**/z\nx[0-9]?\n"))]
    check = lambda p, d=False: ignore.ignored(p, d, rules)
    assert check("a.log") and check("b/c.log") and not check("keep.log")
    assert check("build") and not check("src/build") and check("src/out", True) and not check("src/out")
    assert check("a/z") and check("a/b/c/z") and check("x1y") and not check("xay")


@pytest.fixture
def repo(tmp_path):
    files = {
        "src/main.py": "from utils import helper\ndef main():\n    from src.utils import helper\n    helper()\n",
        "src/utils.py": "def helper():\n    return _inner()\ndef _inner(): pass\n",
        "src/__init__.py": "",
        "pkg/_priv.ts": "export class Priv { go() { helper(); } }",
        ".hidden/x.py": "def no(): pass",
        "skip/gone.py": "def no(): pass",
        ".gitignore": "skip/\n",
        "README.md": "text",
        "bad.py": b"\xff\xfe",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    return tmp_path


def test_scan_and_parse(spark, repo, tmp_path_factory):
    graph = CodeGraph.scan(spark, str(repo))
    ids = {r.id: r for r in graph.nodes.collect()}
    assert set(ids) == {"", "src", "pkg", "README.md", "bad.py", "src/main.py", "src/utils.py", "src/__init__.py", "pkg/_priv.ts"}
    assert ids["src/main.py"].ancestors == ["", "src"] and ids[""].container_id is None
    parsed = graph.parse()
    blocks = {r.id: r for r in parsed.nodes.filter("type = 'CodeBlock'").collect()}
    assert set(blocks) == {"src/main.py::main@2", "src/utils.py::helper@1", "src/utils.py::_inner@3", "pkg/_priv.ts::Priv@1", "pkg/_priv.ts::go@1"}
    go = blocks["pkg/_priv.ts::go@1"]
    assert (go.parent_id, go.container_id) == ("pkg/_priv.ts::Priv@1", "pkg/_priv.ts")
    edges = {(r.source, r.target, r.kind): r.weight for r in parsed.edges.collect()}
    assert edges == {
        ("src/main.py::main@2", "src/utils.py::helper@1", "FunctionCall"): 1,
        ("src/utils.py::helper@1", "src/utils.py::_inner@3", "FunctionCall"): 1,
        ("pkg/_priv.ts::go@1", "src/utils.py::helper@1", "FunctionCall"): 1,
        ("pkg/_priv.ts::Priv@1", "src/utils.py::helper@1", "FunctionCall"): 1,
        ("src/main.py", "src/utils.py", "Import"): 1,
    }
    folded = progress.fold(parsed.events()).first()
    assert (folded.parsed_files, folded.parsed_blocks, folded.n_errors, folded.complete) == (5, 5, 1, True)
    sub = parsed.subgraph(["src/main.py::main@2", "nowhere", "src/utils.py::helper@1", "src/main.py::main@2"], ["FunctionCall"])
    assert sub.nodes.count() == 3 and sub.edges.count() == 1
    with pytest.raises(ValueError):
        parsed.subgraph(["x"], ["NoSuchKind"])
    out = tmp_path_factory.mktemp("json")
    text = parsed.to_json().first().json
    assert json.loads(text)["nodes"]["src/utils.py"]["children"] == ["src/utils.py::helper@1", "src/utils.py::_inner@3"]
    (out / "g.json").write_text(text)
    nodes, again, root = graph_json.from_json(spark, str(out))
    assert nodes.count() == parsed.nodes.count() and again.count() == 5 and root.first().root == ""


def test_a_session_with_default_settings_can_scan(spark, repo):
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert spark.conf.get("spark.sql.python.filterPushdown.enabled") == "false"
    parsed = CodeGraph.scan(spark, str(repo)).parse()
    assert parsed.counts()[1] == 5
    parsed.release()
    assert parsed.edges.count() == 5


def test_source_filters_and_paths(spark, repo):
    repo_tree.register(spark)
    df = spark.read.format("repo_tree").option("content", "true").load(str(repo))
    assert {r.path for r in df.filter("language = 'Python' and path like 'src/%'").collect()} == {"src/__init__.py", "src/main.py", "src/utils.py"}
    assert bytes(df.filter("path = 'README.md'").first().content) == b"text"
    with pytest.raises(NotADirectoryError):
        CodeGraph.scan(spark, str(repo / "README.md"))
    with pytest.raises(FileNotFoundError):
        CodeGraph.scan(spark, str(repo / "none"))
    with pytest.raises(ValueError):
        git_clone.clone("https://example.org/a/b", repo)
    (repo / "b").mkdir()
    assert git_clone.clone("https://github.com/a/b.git/", repo) == repo / "b"


def test_view_state(spark, tmp_path):
    ids = spark.createDataFrame([("a",), ("b",), ("a",)], "id string")
    view_state.save(ids, str(tmp_path / "t"), "/some/folder", "visible")
    assert {r.id for r in view_state.load(spark, str(tmp_path / "t"), "/some/folder", "visible").collect()} == {"a", "b"}
    assert view_state.load(spark, str(tmp_path / "t"), "/some/folder", "expanded").count() == 0
    assert view_state.load_settings(spark, str(tmp_path / "s")) == DetailSettings()
    chosen = DetailSettings(minimap_opacity=0.4, hidden_at_overview=("Import",))
    view_state.save_settings(spark, chosen, str(tmp_path / "s"))
    assert view_state.load_settings(spark, str(tmp_path / "s")) == chosen


def test_long_statements_are_read_whole():
    names = ", ".join(f"n{i}" for i in range(2000))
    assert ("Import", "./big") in found("TypeScript", "class A { m() { import { " + names + " } from './big'; } }")[1]
    deep = "::".join(f"m{i}" for i in range(40))
    assert found("Rust", f"pub(in crate::{deep}) fn f() {{}}")[0] == [("Function", "f", "Crate")]


def test_first_reference_follows_the_order_of_paths(spark, tmp_path):
    for name in ("z", "b", "m"):
        (tmp_path / f"{name}.py").write_text("def go():\n    helper()\n    helper()\n")
    (tmp_path / "a.py").write_text("def helper(): pass\n")
    parsed = CodeGraph.scan(spark, str(tmp_path)).parse()
    order = [r.source for r in parsed.edges.orderBy("seq").collect()]
    assert order == ["b.py::go@1", "m.py::go@1", "z.py::go@1"]
