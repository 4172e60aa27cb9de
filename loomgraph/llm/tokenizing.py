"""Task-side access to a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
import re
from collections import Counter
from functools import lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
#: Characters whose classes agree in all versions of Unicode that the libraries may carry.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa0-ɏ‐-―‘-‟•…€]*")
#: Longer texts are counted in parts, cut in front of white space, where no pre-token can span.
PART = 1 << 20


def vocabulary_path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _tokenizer(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(name))


@lru_cache(maxsize=4)
def _pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


class PreTokens:
    """Cuts texts into pre-tokens and counts the pieces of one; ids of a text are never built."""

    def __init__(self, name: str = VOCABULARY):
        self.tokenizer = _tokenizer(name)
        contents = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, contents)) or r"(?!)")

    def frequencies(self, text: str | None) -> tuple[int, tuple[Counter, Counter]]:
        """Number of special strings, and how often the rest has each pre-token: as it stands, or in the library's byte alphabet."""
        plain, mapped = Counter(), Counter()
        if not text:
            return 0, (plain, mapped)
        sections = self.special.split(text)
        for part in (p for s in sections if s for p in parts(s)):
            if PLAIN.fullmatch(part):
                plain.update(_pattern().findall(part))
            else:
                mapped.update(p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part))
        return len(sections) - 1, (plain, mapped)

    def pieces_of(self, pre_token: str, mapped: bool) -> int:
        if mapped:
            return len(self.tokenizer.model.tokenize(pre_token))
        return len(self.tokenizer.encode(pre_token, add_special_tokens=False))


def parts(text: str, size: int = PART) -> list[str]:
    """``text`` cut in front of white space that follows other characters, about ``size`` each."""
    if len(text) <= size:
        return [text]
    out, start, edge = [], 0, re.compile(r"(?<=[!-~])(?=[ \n])")
    while len(text) - start > size and (m := edge.search(text, start + size)):
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


class TokenIds:
    """Token ids as the ``tokenizers`` library gives them.

    Plain texts go through ``tiktoken`` with the same vocabulary, which gives equal ids several
    times faster; texts with special strings, unusual characters or unbroken runs go through
    ``tokenizers`` itself.
    """

    def __init__(self, name: str = VOCABULARY):
        self.tokenizer = _tokenizer(name)
        contents = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([*map(re.escape, contents), r"\S{400}"]))
        self.fast = _ranked(name)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=np.uint32)
        if self.fast is not None and PLAIN.fullmatch(text) and not self.odd.search(text):
            return np.asarray(self.fast.encode_ordinary(text), dtype=np.uint32)
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(maxsize=4)
def _ranked(name: str):
    """The vocabulary as ranks, where such a file stands beside it."""
    path = os.path.splitext(vocabulary_path(name))[0] + ".tiktoken"
    if not os.path.exists(path):
        return None
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
