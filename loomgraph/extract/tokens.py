"""Tokens of languages with braces, and the pairs of brackets among them."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # word, string, number or mark
    text: str
    start: int
    end: int


ECMA = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<string>"(?:\\.|[^"\\\n])*(?:"|\Z)|'(?:\\.|[^'\\\n])*(?:'|\Z))
    |(?P<word>[A-Za-z_$\u0080-\uffff][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>=>|\?\.|\.\.\.|[^\s])""",
    re.VERBOSE | re.DOTALL,
)
RUST = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<string>b?r(?P<hashes>\#*)".*?(?:"(?P=hashes)|\Z)|b?"(?:\\.|[^"\\])*(?:"|\Z)
      |b?'(?:\\(?:u\{[0-9A-Fa-f_]+\}|x[0-9A-Fa-f]{2}|[^\n])|[^'\\\n])'|'[A-Za-z_]\w*)
    |(?P<word>[A-Za-z_]\w*)|(?P<number>\d[\w.]*)|(?P<mark>::|->|=>|[^\s])""",
    re.VERBOSE | re.DOTALL,
)
#: Text of a template literal, to the next substitution or its end.
TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.DOTALL)
PAIRS = {")": "(", "]": "[", "}": "{"}


def tokens(source: str, language: re.Pattern) -> list[Token]:
    """The tokens of a source; template literals are the strings around their substitutions, whose tokens stand between."""
    found, at = [], 0
    open_: list[int] = []  # open braces in each substitution around
    while m := language.match(source, at):
        text, at = m[0], m.end()
        if m["skip"] is not None:
            continue
        if language is ECMA and (text == "`" or text == "}" and open_ and not open_[-1]):
            if text == "}":
                open_.pop()
            at = TEMPLATE.match(source, at).end()
            if source.startswith("${", at):
                open_.append(0)
                at += 2
            else:
                at = min(at + 1, len(source))
            found.append(Token("string", source[m.start() : at], m.start(), at))
            continue
        if open_ and text in ("{", "}"):
            open_[-1] += 1 if text == "{" else -1
        found.append(Token(m.lastgroup if m.lastgroup != "hashes" else "string", text, m.start(), at))
    return found


def bracket_pairs(found: list[Token]) -> dict[int, int]:
    """Index of the closing token for each opening one; unclosed ones end with the file."""
    pairs, open_ = {}, []
    for i, t in enumerate(found):
        if t.kind != "mark":
            continue
        if t.text in "([{":
            open_.append(i)
        elif t.text in PAIRS:
            for k in range(len(open_) - 1, -1, -1):
                if found[open_[k]].text == PAIRS[t.text]:
                    pairs[open_[k]] = i
                    del open_[k:]
                    break
    return pairs | dict.fromkeys(open_, len(found) - 1)


class Cursor:
    """Random access to tokens, with an empty token beyond either end."""

    NONE = Token("mark", "", 0, 0)

    def __init__(self, source: str, language: re.Pattern):
        self.source, self.all = source, tokens(source, language)
        self.close = bracket_pairs(self.all)

    def __getitem__(self, i: int) -> Token:
        return self.all[i] if 0 <= i < len(self.all) else self.NONE

    def __len__(self) -> int:
        return len(self.all)

    def is_word(self, i: int) -> bool:
        return self[i].kind == "word"

    def find(self, i: int, *stops: str, words: bool = True) -> int:
        """First token from ``i`` on that is one of ``stops``, brackets skipped; the length if none is."""
        while i < len(self):
            if self[i].text in stops and (words or not self.is_word(i)):
                return i
            if self[i].text in PAIRS and self[i].kind == "mark":
                return i
            i = self.close.get(i, i) + 1
        return len(self)

    def after_generics(self, i: int) -> int:
        """Index after ``<...>`` at ``i``; ``i`` itself if there is none."""
        if self[i].text != "<":
            return i
        depth = 0
        while i < len(self):
            depth += {"<": 1, ">": -1}.get(self[i].text, 0)
            if not depth:
                return i + 1
            if self[i].text in (";", "{") and self[i].kind == "mark":
                return i
            i += 1
        return i
