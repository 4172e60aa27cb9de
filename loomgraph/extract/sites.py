"""What extractors find in a source file, and the registry of extractors.

An extractor takes source text and yields sites: blocks and references with character offsets.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable
from typing import NamedTuple


class Site(NamedTuple):
    """A block (``visibility`` set) or a reference (``visibility`` None) at ``start`` .. ``end``."""

    kind: str
    name: str
    start: int
    end: int
    visibility: str | None = None
    module_path: str | None = None


Extractor = Callable[[str], Iterable[Site]]
EXTRACTORS: dict[str, Extractor] = {}


def register_language(name: str, extractor: Extractor) -> None:
    """Use ``extractor`` for files of a language; replaces an earlier one."""
    EXTRACTORS[name] = extractor


class Lines:
    """Offsets to 1-based lines and 0-based byte columns."""

    def __init__(self, source: str):
        self.source = source
        self.starts = [0, *(i + 1 for i, c in enumerate(source) if c == "\n")]

    def at(self, offset: int) -> tuple[int, int]:
        line = bisect_right(self.starts, offset)
        return line, len(self.source[self.starts[line - 1] : offset].encode("utf-8", "surrogatepass"))

    def offset(self, line: int, byte_column: int) -> int:
        start = self.starts[line - 1]
        end = self.starts[line] if line < len(self.starts) else len(self.source)
        return start + len(self.source[start:end].encode("utf-8", "surrogatepass")[:byte_column].decode("utf-8", "ignore"))


def signature(text: str) -> str | None:
    """First line of a block, trimmed; None for an empty text."""
    return text.split("\n", 1)[0].strip() if text else None


def enclosed(sites: Iterable[Site]) -> tuple[list[Site], list[int | None], list[tuple[Site, list[int]]]]:
    """Blocks in order, the index of the innermost other block around each, and references with all blocks around them."""
    ordered = sorted(sites, key=lambda s: (s.start, -s.end, s.visibility is None))
    blocks, parents, references, around = [], [], [], []
    for site in ordered:
        while around and blocks[around[-1]].end <= site.start:
            around.pop()
        over = [i for i in around if blocks[i].end >= site.end]
        if site.visibility is None:
            references.append((site, over))
        else:
            parents.append(over[-1] if over else None)
            around.append(len(blocks))
            blocks.append(site)
    return blocks, parents, references
