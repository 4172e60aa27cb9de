"""TypeScript and JavaScript: declarations by keyword and bracket pairs."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from loomgraph.extract.sites import Site
from loomgraph.extract.tokens import ECMA, Cursor

DECLARES = {"class": "Class", "interface": "Interface", "enum": "Enum"}
#: Words before ``(`` that call nothing.
NOT_CALLED = frozenset(
    """if for while switch catch return typeof await function new delete void in of instanceof do else case throw yield with
    constructor async get set static""".split()
)
PREDEFINED = frozenset("any bigint boolean never null number object string symbol undefined unknown void true false this".split())
TYPE_WORDS = frozenset("keyof typeof readonly infer extends implements is asserts in new unique abstract".split())
MODIFIERS = frozenset("public private protected static async readonly override abstract get set export default declare".split())


class _Scan:
    def __init__(self, source: str, typed: bool):
        self.c, self.typed = Cursor(source, ECMA), typed
        self.named: set[int] = set()  # tokens that name a definition
        self.ends = [k for k, t in enumerate(self.c.all) if t.kind == "string" or t.text == ";"]

    def types(self, start: int, stop: int) -> Iterator[Site]:
        """References to the types named among tokens ``start`` .. ``stop``."""
        c = self.c
        for i in range(start, min(stop, len(c))) if self.typed else ():
            t = c[i]
            if t.kind == "word" and t.text not in PREDEFINED and t.text not in TYPE_WORDS and c[i + 1].text not in (":", "?", ".", "=>") and c[i - 1].text != "typeof":
                yield Site("TypeReference", t.text, t.start, t.end)

    def parameters(self, opening: int) -> Iterator[Site]:
        c, i, stop = self.c, opening + 1, self.c.close.get(opening, len(self.c))
        while i < stop:
            colon = c.find(i, ":", ",", "=")
            if colon >= stop:
                return
            i = colon + 1
            if c[colon].text == ":":
                end = c.find(i, ",", "=")
                yield from self.types(i, end)
                i = end + 1
            elif c[colon].text == "=":
                i = c.find(i, ",") + 1

    def function_end(self, opening: int) -> tuple[int, int, int]:
        """For the ``(`` of a definition: first and last token of its return type, and its last token."""
        c = self.c
        i = c.close.get(opening, len(c) - 1) + 1
        start = i + 1 if c[i].text == ":" else i
        body = i
        if c[i].text == ":":
            body = c.find(start, "{", ";", "=>")
            if c[body].text == "{" and body == start:  # an object type
                body = c.find(c.close.get(body, body) + 1, "{", ";", "=>")
        return start, body, c.close.get(body, body) if c[body].text == "{" else -1

    def arrow_end(self, i: int) -> int:
        c = self.c
        if c[i].text == "{":
            return c.close.get(i, i)
        return c.find(i, ";", ",", "const", "let", "export", "function", "class") - 1

    def declared_function(self, name: int, first: int, i: int) -> Iterator[Site]:
        """A function value given to the declared variable ``name``, from token ``first``; ``i`` is after ``async``."""
        c = self.c
        if c[i].text == "function":
            opening = c.after_generics(i + 1 + (c[i + 1].text == "*"))
            opening += c.is_word(opening)
            start, stop, end = self.function_end(c.after_generics(opening))
            if end < 0:
                return
        else:
            opening = c.after_generics(i)
            if c[opening].text == "(":
                arrow = c.find(c.close.get(opening, opening) + 1, "=>", ";", ",", "=")
                start, stop = c.close.get(opening, opening) + 2, arrow
            else:
                arrow, start, stop = opening + 1, 0, 0
            if c[arrow].text != "=>":
                return
            end = self.arrow_end(arrow + 1)
        yield Site("Function", c[name].text, c[first].start, c[end].end, "Public")
        if c[opening].text == "(":
            yield from self.parameters(opening)
        yield from self.types(start, stop)

    def members(self, opening: int) -> Iterator[Site]:
        """Methods and fields of a class body."""
        c, i, stop = self.c, opening + 1, self.c.close.get(opening, len(self.c))
        while i < stop:
            first = i
            while c[i].text in MODIFIERS and c[i + 1].text not in ("(", "=", ":", ";"):
                i += 1
            i += c[i].text in ("*", "#")
            opening = c.after_generics(i + 1)
            if c.is_word(i) and c[opening].text == "(":
                self.named.add(i)
                start, body, end = self.function_end(opening)
                if end >= 0:
                    yield Site("Function", c[i].text, c[first].start, c[end].end, "Public")
                yield from self.parameters(opening)
                yield from self.types(start, body)
                i = max(end, body) + 1
            elif c.is_word(i) and c[i + 1 + (c[i + 1].text in ("?", "!"))].text == ":":
                end = c.find(i, ";", "=")
                yield from self.types(c.find(i, ":") + 1, end)
                i = c.find(end, ";") + 1
            else:
                i = c.close.get(i, i) + 1

    def sites(self) -> Iterator[Site]:
        c = self.c
        for i, t in enumerate(c.all):
            before = c[i - 1].text
            if t.kind != "word" or before in (".", "?."):
                continue
            if t.text == "function" and c.is_word(i + 1 + (c[i + 1].text == "*")) and before not in ("=", "(", ",", ":", "return", "=>", "async"):
                yield from self.function(i, i)
            elif t.text == "async" and c[i + 1].text == "function" and c.is_word(i + 2) and before not in ("=", "(", ",", ":", "return", "=>"):
                yield from self.function(i, i + 1)
            elif t.text in DECLARES and c.is_word(i + 1) and c[i + 1].text not in ("extends", "implements"):
                yield from self.declaration(i)
            elif t.text == "type" and self.typed and c.is_word(i + 1) and c[c.after_generics(i + 2)].text == "=":
                end = c.find(c.after_generics(i + 2) + 1, ";", "const", "let", "export", "function", "class", "interface", "type", "enum")
                yield Site("TypeAlias", c[i + 1].text, t.start, c[end if c[end].text == ";" else end - 1].end, "Public")
                yield from self.types(i + 1, end)
            elif t.text in ("const", "let", "var") and c.is_word(i + 1):
                equals = i + 2
                if c[equals].text == ":":
                    equals = c.find(i + 3, "=", ";")
                    yield from self.types(i + 3, equals)
                if c[equals].text == "=":
                    yield from self.declared_function(i + 1, equals + 1, equals + 1 + (c[equals + 1].text == "async"))
            elif t.text == "as" and c.is_word(i + 1) and c.is_word(i - 1):
                yield from self.types(i + 1, i + 2)
            elif t.text == "import" and c[i + 1].text not in ("(", "."):
                at = bisect_right(self.ends, i)
                end = self.ends[at] if at < len(self.ends) else i
                if c[end].kind == "string":
                    module = c[end].text.strip("'\"")
                    yield Site("Import", module, t.start, c[end].end, module_path=module)
        yield from self.calls()

    def function(self, first: int, keyword: int) -> Iterator[Site]:
        c = self.c
        name = keyword + 1 + (c[keyword + 1].text == "*")
        self.named.add(name)
        opening = c.after_generics(name + 1)
        if c[opening].text != "(":
            return
        start, body, end = self.function_end(opening)
        if end >= 0:
            yield Site("Function", c[name].text, c[first].start, c[end].end, "Public")
        yield from self.parameters(opening)
        yield from self.types(start, body)

    def declaration(self, i: int) -> Iterator[Site]:
        c, kind = self.c, DECLARES[self.c[i].text]
        body = c.find(i + 2, "{", ";")
        if c[body].text != "{" or kind != "Class" and not self.typed:
            return
        end = c.close.get(body, body)
        yield Site(kind, c[i + 1].text, c[i].start, c[end].end, "Public")
        if kind == "Enum":
            return
        yield from self.types(i + 1, i + 2)
        parent = next((k for k in range(i + 2, body) if c[k].text == "extends"), body)
        rest = i + 2
        if kind == "Class" and parent < body and self.typed and c[parent + 2].text != ".":
            yield Site("Inheritance", c[parent + 1].text, c[parent + 1].start, c[parent + 1].end)
            rest = parent + 2
        yield from self.types(rest, body) if kind == "Interface" or rest > i + 2 or any(c[k].text == "implements" for k in range(i + 2, body)) else ()
        if kind == "Class":
            yield from self.members(body)
        else:
            self.named.update(k for k in range(body + 1, end) if c[k + 1].text == "(")
            k = body + 1
            while k < end:
                colon = c.find(k, ":", ";", ",")
                if colon >= end:
                    break
                k = colon + 1
                if c[colon].text == ":":
                    stop = c.find(k, ";", ",")
                    yield from self.types(k, min(stop, end))
                    k = stop + 1

    def calls(self) -> Iterator[Site]:
        c = self.c
        for i, t in enumerate(c.all):
            if t.kind != "word" or i in self.named or t.text in NOT_CALLED and c[i - 1].text not in (".", "?."):
                continue
            opening = i + 1
            if c[opening].text == "<" and self.typed:
                opening = c.after_generics(opening)
            if c[opening].text != "(" or c[i - 1].text in ("new", "function", "*"):
                continue
            end = c.close.get(opening, opening)
            yield Site("MethodCall" if c[i - 1].text in (".", "?.") else "FunctionCall", t.text, t.start, c[end].end)


def extract_typescript(source: str) -> Iterator[Site]:
    return _Scan(source, True).sites()


def extract_javascript(source: str) -> Iterator[Site]:
    return _Scan(source, False).sites()
