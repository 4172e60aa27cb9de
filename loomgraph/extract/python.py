"""Python: the standard parser. Lines that it rejects are taken out, a file that stays unreadable is scanned by line."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

from loomgraph.extract.sites import Lines, Site

#: Type names that no project defines.
BUILTIN_TYPES = frozenset(
    "int str float bool bytes list dict set tuple None type object complex range frozenset bytearray memoryview".split()
)
DEFINITION = re.compile(r"^([ \t]*)((?:async[ \t]+)?def|class)[ \t]+([A-Za-z_]\w*)", re.MULTILINE)
CALL = re.compile(r"(?<![\w.])((?:[A-Za-z_]\w*\.)*)([A-Za-z_]\w*)[ \t]*\(")
NOT_CALLED = frozenset("and as assert async await class def del elif else except finally for from global if import in is lambda not or pass print raise return while with yield".split()) - {"print"}


def called(text: str) -> str:
    return text.rsplit("::", 1)[-1] if "::" in text else text.rsplit(".", 1)[-1]


def _visibility(name: str) -> str:
    return "Private" if name.startswith("_") else "Public"


#: Lines of a file that may be taken out; with more it is scanned by line.
MOST_BAD_LINES = 40
#: A line that a deeper one may follow.
OPENS = re.compile(r"^\s*(?:async|class|def|if|elif|else|for|while|try|except|finally|with)\b.*:\s*(?:#.*)?$")
HEAD = re.compile(r"^[ \t]*((?:import|from|class|def|async[ \t]+def)\b.*)$", re.MULTILINE)


def _parsed(source: str) -> ast.AST | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(source)
    except (ValueError, RecursionError, MemoryError):
        return None


def extract(source: str) -> Iterator[Site]:
    """Sites of all statements that can be parsed, and the calls of lines that cannot."""
    starts = Lines(source).starts
    rest, bad = source, []
    for _ in range(MOST_BAD_LINES + 1):
        try:
            tree = _parsed(rest)
            break
        except SyntaxError as e:
            if e.lineno is None or not 1 <= e.lineno <= len(starts) or e.lineno in bad:
                tree = None
                break
            # The line becomes blanks and a statement of the same indentation, where there is room for one.
            start, stop = starts[e.lineno - 1], starts[e.lineno] - 1 if e.lineno < len(starts) else len(source)
            line = rest[start:stop]
            indent = len(line) - len(line.lstrip())
            put = "if 1:" if OPENS.match(line) else "0"
            rest = rest[:start] + (line[:indent] + put).ljust(len(line))[: len(line)] + rest[stop:]
            bad.append(e.lineno)
    else:
        tree = None
    if tree is None:
        yield from _by_line(source)
        return
    yield from _of_tree(tree, rest)
    spans = [(starts[line - 1], starts[line] if line < len(starts) else len(source)) for line in bad]
    for start, stop in spans:
        yield from _calls(source, start, stop)
    if spans:
        yield from (site for site in _definitions(source) if any(start <= site.start < stop for start, stop in spans))


def _of_tree(tree: ast.AST, source: str, shift: int = 0) -> Iterator[Site]:
    """Sites of a parsed ``source``, moved by ``shift``."""
    lines = Lines(source)
    span = lambda n: (shift + lines.offset(n.lineno, n.col_offset), shift + lines.offset(n.end_lineno, n.end_col_offset))
    text = lambda n: source[span(n)[0] - shift : span(n)[1] - shift]

    def types(annotation: ast.AST) -> Iterator[Site]:
        name = text(annotation).strip()
        if name and name not in BUILTIN_TYPES:
            yield Site("TypeReference", name, *span(annotation))
        inner = annotation.slice if isinstance(annotation, ast.Subscript) else annotation
        if isinstance(inner, ast.BinOp):
            parts = [inner.left, inner.right]
        elif inner is annotation:
            parts = []
        else:
            parts = inner.elts if isinstance(inner, ast.Tuple) else [inner]
        for part in parts:
            if not isinstance(part, ast.Constant) or part.value is None:
                yield from types(part)

    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield Site("Function", node.name, *span(node), _visibility(node.name))
            if node.returns:
                yield from types(node.returns)
        elif isinstance(node, ast.ClassDef):
            yield Site("Class", node.name, *span(node), "Public")
            for base in node.bases:
                if isinstance(base, ast.Name):
                    yield Site("Inheritance", base.id, *span(base))
        elif isinstance(node, ast.Import):
            first = node.names[0]
            name = f"{first.name} as {first.asname}" if first.asname else first.name
            yield Site("Import", name, *span(node), module_path=name)
        elif isinstance(node, ast.ImportFrom):
            name = "." * node.level + (node.module or "")
            yield Site("Import", name, *span(node), module_path=name)
        elif isinstance(node, ast.Call):
            name = called(text(node.func))
            if name:
                yield Site("MethodCall" if isinstance(node.func, ast.Attribute) else "FunctionCall", name, *span(node))
        elif isinstance(node, ast.arg) and node.annotation:
            yield from types(node.annotation)
        elif isinstance(node, ast.AnnAssign):
            yield from types(node.annotation)


def _calls(source: str, start: int, stop: int) -> Iterator[Site]:
    defined = {m.start(3) for m in DEFINITION.finditer(source, start, stop)}
    for m in CALL.finditer(source, start, stop):
        if m.start(2) not in defined and m[2] not in NOT_CALLED:
            yield Site("MethodCall" if m[1] else "FunctionCall", m[2], m.start(), m.end())


def _definitions(source: str) -> Iterator[Site]:
    """Definitions by line: they last until a line that is indented no deeper."""
    open_: list[tuple[int, re.Match]] = []
    found: list[tuple[re.Match, int]] = []
    starting = {m.start(): m for m in DEFINITION.finditer(source)}
    for start in Lines(source).starts:
        stop = source.find("\n", start)
        line = source[start : stop if stop >= 0 else len(source)]
        code = line.lstrip(" \t")
        if not code.strip() or code.startswith("#"):
            continue
        while open_ and open_[-1][0] >= len(line) - len(code):
            found.append((open_.pop()[1], start - 1))
        if start in starting:
            open_.append((len(line) - len(code), starting[start]))
    found += [(m, len(source.rstrip())) for _, m in open_]
    for m, stop in sorted(found, key=lambda x: x[0].start()):
        visibility = "Public" if m[2] == "class" else _visibility(m[3])
        yield Site("Class" if m[2] == "class" else "Function", m[3], m.start(2), stop, visibility)


def _by_line(source: str) -> Iterator[Site]:
    """Definitions and calls by line; of a line that reads as a whole, imports, base classes and types."""
    yield from _definitions(source)
    for m in HEAD.finditer(source):
        head = m[1] if m[1].startswith(("import", "from")) else m[1].split("#")[0].rstrip() + " pass"
        try:
            tree = _parsed(head)
        except SyntaxError:
            continue
        if tree is not None:
            kinds = ("Import", "Inheritance", "TypeReference")
            yield from (s for s in _of_tree(tree, head, m.start(1)) if s.kind in kinds)
    yield from _calls(source, 0, len(source))
