"""Trees listed by the executors: every source of ignore rules, many rounds, and the same graph as from the driver's list."""

import pytest
from loomgraph.graph import CodeGraph
from loomgraph.sources import frontier, repo_tree
from loomgraph.streaming import live, runs


def make(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text if isinstance(text, bytes) else text.encode())


def paths(tree):
    return {r.path for r in tree.collect()}


def test_every_source_of_rules_and_their_order(spark, tmp_path, monkeypatch):
    home = tmp_path / "home"
    make(home, {".gitconfig": "[user]\n\tname = x\n[core]\n\teditor = vi\n\texcludesFile = ~/mine\n", "mine": "*.global\n*.both\n", ".config/git/ignore": "*.py\n"})
    monkeypatch.setenv("HOME", str(home))
    monkeypatch.delenv("XDG_CONFIG_HOME", raising=False)
    outer = tmp_path / "outer"
    make(outer, {".gitignore": "*.beyond\n", ".ignore": "*.far\n"})
    make(outer / "repo", {".git/HEAD": "", ".git/info/exclude": "", ".gitignore": "*.above\n/part/sub/no.txt\n"})
    root = outer / "repo" / "part"
    make(root, {
        ".gitignore": "*.git1\n!kept.global\n", ".ignore": "!forced.git1\n*.own\n", "sub/.gitignore": "!deep.own\n!deep.git1\n*.sub\n", "sub/.ignore": "!x.sub\n",
        "a.global": "", "kept.global": "", "a.above": "", "a.beyond": "", "a.far": "", "a.git1": "", "forced.git1": "", "a.own": "", "a.py": "",
        "sub/deep.own": "", "sub/deep.git1": "", "sub/a.sub": "", "sub/x.sub": "", "sub/no.txt": "", "sub/yes.txt": "", ".hidden/a.py": "", "z.both": "",
    })
    expected = {"kept.global", "a.beyond", "forced.git1", "a.py", "sub", "sub/deep.git1", "sub/x.sub", "sub/yes.txt"}
    assert paths(frontier.list_tree(spark, str(root))) == expected

    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "none"))
    (home / ".gitconfig").unlink()
    assert "z.both" in paths(frontier.list_tree(spark, str(root)))
    (outer / "repo" / ".git" / "info" / "exclude").write_text("*.nothing-of-the-part\n")
    alone = tmp_path / "alone"
    make(alone, {".git/info/exclude": "*.log\n", "a.log": "", "a.txt": ""})
    assert paths(frontier.list_tree(spark, str(alone))) == {"a.txt"}
    (alone / ".gitignore").write_text("!a.log\n*.txt\n")
    assert paths(frontier.list_tree(spark, str(alone))) == {"a.log"}


@pytest.mark.parametrize("directories", [1, 3, 500])
def test_rounds_give_the_list_of_the_driver(spark, tmp_path, directories):
    make(tmp_path, {f"d{i % 5}/e{i % 3}/f{i % 2}/g{i}.py": "x" * i for i in range(30)} | {"d1/.gitignore": "e2/\n", "d2/empty/.keep": ""})
    (tmp_path / "link").symlink_to(tmp_path / "d0")
    found = sorted((r.path, r.type == "Directory", r.size) for r in frontier.list_tree(spark, str(tmp_path), directories=directories).collect())
    assert found == sorted(repo_tree.walk(str(tmp_path)))
    assert ("link", True, 0) in found and ("d2/empty", True, 0) in found


def test_an_empty_tree_and_wrong_roots(spark, tmp_path):
    assert frontier.list_tree(spark, str(tmp_path)).count() == 0
    assert frontier.with_content(frontier.list_tree(spark, str(tmp_path)), str(tmp_path)).count() == 0
    with pytest.raises(FileNotFoundError):
        frontier.list_tree(spark, str(tmp_path / "none"))


def test_the_graph_is_the_same_and_its_files_are_told(spark, tmp_path):
    make(tmp_path / "repo", {"src/main.py": "from src.utils import helper\ndef main():\n    helper()\n", "src/utils.py": "def helper(): pass\n", "bad.py": b"\xff", "README.md": "text"})
    run = live.begin(str(tmp_path / "events"), "r")
    here, there = CodeGraph.scan(spark, str(tmp_path / "repo")).parse(), CodeGraph.scan(spark, str(tmp_path / "repo"), by_executors=True).parse(run)
    for a, b in ((here.nodes, there.nodes), (here.edges, there.edges)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert runs.replay(live.told(spark, run.folder)).first().total_files == 3
