"""Ignore rules of a source tree: the common subset of ``.gitignore`` patterns."""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    pattern: re.Pattern
    keep: bool
    directories_only: bool


def _expression(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "/.+", i + 3
        elif c == "*":
            while glob.startswith("*", i + 1):
                i += 1
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


def parse(text: str) -> list[Rule]:
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        glob = line[keep:]
        directories_only = glob.endswith("/")
        glob = glob.rstrip("/")
        anchored = "/" in glob
        expression = _expression(glob.lstrip("/"))
        rules.append(Rule(re.compile(expression if anchored else f"(?:.*/)?{expression}"), keep, directories_only))
    return rules


def ignored(path: str, is_directory: bool, levels: list[tuple[str, list[Rule]]]) -> bool:
    """Whether the last rule that fits ``path`` drops it; ``levels`` are (directory, rules), outermost first."""
    verdict = False
    for directory, rules in levels:
        inside = path[len(directory) + 1 :] if directory else path
        for rule in rules:
            if (is_directory or not rule.directories_only) and rule.pattern.fullmatch(inside):
                verdict = not rule.keep
    return verdict
