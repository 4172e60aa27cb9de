"""Rust: items by keyword and bracket pairs."""

from __future__ import annotations

from collections.abc import Iterator

from loomgraph.extract.sites import Site
from loomgraph.extract.tokens import RUST, Cursor

#: Primitive types.
BUILTIN_TYPES = frozenset("i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64 bool char str".split())
ITEMS = {"fn": "Function", "struct": "Struct", "enum": "Enum", "trait": "Trait", "mod": "Module", "const": "Constant", "static": "Constant", "type": "TypeAlias"}
QUALIFIERS = frozenset("async unsafe extern const default".split())
KEYWORDS = frozenset(
    """as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref
    return self Self static struct super trait true type unsafe use where while""".split()
)


def _visibility(modifier: str | None) -> str:
    if modifier is None:
        return "Private"
    if modifier == "pub":
        return "Public"
    return "Crate" if "crate" in modifier else "Protected" if "super" in modifier else "Public"


class _Scan:
    def __init__(self, source: str):
        self.source, self.c = source, Cursor(source, RUST)
        self.named: set[int] = set()
        self.opening: dict[int, int] = {}
        for opening, closing in self.c.close.items():
            self.opening.setdefault(closing, opening)

    def text(self, start: int, stop: int) -> str:
        return self.source[self.c[start].start : self.c[stop - 1].end] if stop > start else ""

    def types(self, start: int, stop: int) -> Iterator[Site]:
        """References to the types named among tokens ``start`` .. ``stop``; of a path the last part."""
        c = self.c
        for i in range(start, min(stop, len(c))):
            t = c[i]
            if t.kind == "word" and t.text not in KEYWORDS and t.text not in BUILTIN_TYPES and c[i + 1].text not in ("::", ":", "!"):
                yield Site("TypeReference", t.text, t.start, t.end)

    def first_token(self, i: int) -> tuple[int, str | None]:
        """First token of the item whose keyword is ``i``, and its visibility modifier."""
        c = self.c
        while c[i - 1].text in QUALIFIERS or c[i - 1].kind == "string" and c[i - 2].text == "extern":
            i -= 1
        if c[i - 1].text == "pub":
            return i - 1, "pub"
        if c[i - 1].text == ")":
            opening = self.opening.get(i - 1, -1)
            if c[opening - 1].text == "pub":
                return opening - 1, self.text(opening - 1, i)
        return i, None

    def typed_list(self, opening: int) -> Iterator[Site]:
        """Types after the colons of parameters or fields."""
        c, i, stop = self.c, opening + 1, self.c.close.get(opening, len(self.c))
        while i < stop:
            colon = c.find(i, ":", ",")
            if colon >= stop:
                return
            i = colon + 1
            if c[colon].text == ":":
                end = self.type_end(i, stop)
                yield from self.types(i, end)
                i = end + 1

    def type_end(self, i: int, stop: int) -> int:
        c, depth = self.c, 0
        while i < stop:
            depth += {"<": 1, ">": -1}.get(c[i].text, 0)
            if depth <= 0 and c[i].text in (",", ";", "=", "{", "}", ")"):
                return i
            i = c.close.get(i, i) + 1
        return stop

    def item(self, i: int) -> Iterator[Site]:
        c, kind = self.c, ITEMS[self.c[i].text]
        name = i + 1 + (c[i + 1].text == "mut")
        if not c.is_word(name) or c[i].text == "const" and c[i + 1].text in ("fn", "unsafe", "async", "extern"):
            return
        self.named.add(name)
        first, modifier = self.first_token(i)
        if c[i].text in ("const", "static", "type"):
            body = c.find(name, ";")
        else:
            body = c.find(name + 1, "{", ";")
        end = c.close.get(body, body) if c[body].text == "{" else body
        if kind == "Function" and end == body:  # a signature only
            return
        yield Site(kind, c[name].text, c[first].start, c[min(end, len(c) - 1)].end, _visibility(modifier))
        if kind in ("Struct", "Enum", "Trait", "TypeAlias"):
            yield from self.types(name, name + 1)
        if kind == "Function":
            opening = c.after_generics(name + 1)
            yield from self.types(name + 2, opening - 1)
            yield from self.typed_list(opening) if c[opening].text == "(" else ()
            arrow = c.close.get(opening, opening) + 1
            yield from self.types(arrow, body) if c[arrow].text in ("->", "where") else ()
        elif kind == "Struct":
            opening = body if c[body].text == "{" else c.find(name + 1, "(", ";", "where")
            yield from self.typed_list(opening) if c[body].text == "{" else self.types(opening, c.close.get(opening, opening)) if c[opening].text == "(" else ()
        elif kind == "Enum":
            self.named.update(k for k in range(body + 1, end) if c.is_word(k) and c[k + 1].text in ("(", "{"))
            for k in range(body, end):
                if c[k].text == "(":
                    yield from self.types(k, c.close.get(k, k))
                elif c[k].text == "{" and k > body:
                    yield from self.typed_list(k)
        elif kind == "Constant":
            yield from self.types(name + 2, self.type_end(name + 2, body)) if c[name + 1].text == ":" else ()
        elif kind == "TypeAlias":
            yield from self.types(name + 1, body)

    def implementation(self, i: int) -> Iterator[Site]:
        c = self.c
        body = c.find(i + 1, "{", ";")
        if c[body].text != "{":
            return
        head = c.after_generics(i + 1)
        stop = next((k for k in range(head, body) if c[k].text == "where"), body)
        turn = next((k for k in range(head, stop) if c[k].text == "for" and c[k + 1].text != "<"), None)
        first, _ = self.first_token(i)
        if turn is None:
            name = f"impl {self.text(head, stop)}" if stop > head else "impl"
        else:
            name = f"{self.text(head, turn)} for {self.text(turn + 1, stop)}"
            yield Site("TraitImpl", self.text(head, turn), c[head].start, c[turn - 1].end)
        yield Site("Impl", name, c[first].start, c[c.close.get(body, body)].end, "Private")
        yield from self.types(i + 1, body)

    def sites(self) -> Iterator[Site]:
        c = self.c
        for i, t in enumerate(c.all):
            if t.kind == "mark" and t.text == "->" or t.kind != "word":
                continue
            if t.text in ITEMS and c[i - 1].text not in (".", "::", "*"):
                yield from self.item(i)
            elif t.text == "impl" and c[i - 1].text in ("", "}", ";", "{", "unsafe", "]"):
                yield from self.implementation(i)
            elif t.text == "use" and c[i - 1].text in ("", "}", ";", "{", "pub", ")", "]"):
                end = c.find(i, ";")
                words = [k for k in range(i + 1, end) if c.is_word(k) and c[k].text not in KEYWORDS]
                if words:
                    name = c[words[-1]].text
                    yield Site("Import", name, t.start, c[end].end, module_path=name)
            elif t.text == "let":
                colon = c.find(i + 1, ":", "=", ";")
                if c[colon].text == ":":
                    yield from self.types(colon + 1, self.type_end(colon + 1, len(c)))
            elif t.text == "as" and c.is_word(i + 1):
                yield from self.types(i + 1, i + 2)
            elif t.text[0].isupper() and i not in self.named and c[i + 1].text == "{" and c[i - 1].text in ("=", "(", ",", "return", "{", ";", "=>", "}"):
                yield from self.types(i, i + 1)
        yield from self.calls()

    def calls(self) -> Iterator[Site]:
        c = self.c
        for i, t in enumerate(c.all):
            if t.kind != "word" or t.text in KEYWORDS or i in self.named:
                continue
            if c[i + 1].text == "(":
                kind = "MethodCall" if c[i - 1].text == "." else "FunctionCall"
                yield Site(kind, t.text, t.start, c[c.close.get(i + 1, i + 1)].end)
            elif c[i + 1].text == "::" and c[i + 2].text == "<" and c[after := c.after_generics(i + 2)].text == "(":
                # Generic calls are named by their arguments, so they resolve to nothing.
                yield Site("FunctionCall", self.text(i + 2, after), t.start, c[c.close.get(after, after)].end)


def extract(source: str) -> Iterator[Site]:
    return _Scan(source).sites()
