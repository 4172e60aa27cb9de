"""Secret scans: fixed patterns, and Shannon entropy in windows over candidate strings.

The patterns find assignments of credentials, access key ids and long hexadecimal runs. The
entropy method looks at every run of key-like characters that is long enough: a window slides
over it, the counts of its characters are updated by the one that enters and the one that leaves,
and so is the sum of c * log2(c) that the entropy needs. The whole run is judged as base64, and each
of its pieces between ``+ / _ = -`` once more by the class of the characters in each window
(hexadecimal, letters of one case with digits, letters of both cases with digits, letters of both cases in like
shares), each with a threshold of its own. Windows at or above it are merged to a span.

The allow-list: runs that are numbers or a UUID as a whole give no entropy span, runs of words are not
judged as base64, and placeholders cut a run, so what is beside them is judged without them. Letters of one case
alone cannot be told from words by their entropy and give none. What a pattern has matched is that
match's; it cuts a run too, and the parts before and after it are candidates of their own.

Positions are code points, the end exclusive. Defined results: a null or empty text has no
spans; a text of any length is scanned whole, in time proportional to it; equal rows are scanned each; an empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from math import log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
BASE_KINDS = KINDS[:3]

WINDOW = 20
#: Pieces of fewer than ``WINDOW`` characters are one window, down to this length.
SHORTEST = 16
#: Candidate strings of the entropy method, and the pieces of them that are judged by window.
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
PIECE = re.compile(rf"[A-Za-z0-9]{{{SHORTEST},}}")
HEX_DIGITS = frozenset("0123456789abcdefABCDEF")
#: Bits per character that a window of each class needs: hexadecimal, one case and digits, both cases and digits, both cases, any run.
HEX_BITS, ONE_CASE_BITS, MIXED_BITS, LETTERS_BITS, BASE64_BITS = 3.0, 3.5, 3.6, 3.85, 3.9
#: Of letters alone, each case must have this share of a window, in percent.
CASE_SHARE = 35
WORDS = re.compile(r"[A-Za-z]+(?:[-_/=][A-Za-z]+)*[=]*")
#: Runs of these shapes are no secrets: numbers and dates, UUIDs.
ALLOWED = re.compile(r"[0-9]+(?:[-_/][0-9]+)*|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
#: Placeholders: nothing that holds one of these is a secret.
PLACEHOLDER = re.compile(r"EXAMPLE|example|xxxx|XXXX|0000|1234567|placeholder|changeme")
LOG = [0.0, *(c * log2(c) for c in range(1, WINDOW + 1))]


def high_entropy(candidate: str, threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Spans of ``candidate`` covered by windows of at least ``threshold`` bits a character."""
    counts: dict[str, int] = {}
    weighted, spans = 0.0, []
    for end, entering in enumerate(candidate, 1):
        c = counts.get(entering, 0)
        counts[entering] = c + 1
        weighted += LOG[c + 1] - LOG[c]
        if end >= window:
            if log2(window) - weighted / window >= threshold - 1e-9:
                start = end - window
                if spans and start <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], end)
                else:
                    spans.append((start, end))
            leaving = candidate[end - window]
            c = counts[leaving]
            counts[leaving] = c - 1
            weighted += LOG[c - 1] - LOG[c]
    return spans


def _judged(window: int, digits: int, upper: int, other: int) -> tuple[str, float]:
    """Kind and threshold of a window by how many of its characters are digits, upper case and no hexadecimal digits; 0: no key."""
    letters = window - digits
    if not letters:
        return "", 0.0
    if not digits:
        lower = letters - upper
        return "entropy_base64", LETTERS_BITS if 100 * min(upper, lower) >= CASE_SHARE * window else 0.0
    if not other:
        return "entropy_hex", HEX_BITS
    if upper not in (0, letters):
        return "entropy_base64", MIXED_BITS
    return "entropy_base64", ONE_CASE_BITS if digits > 1 else 0.0


def key_windows(piece: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the windows of ``piece`` (letters and digits) that reach the threshold of their class."""
    window = min(WINDOW, len(piece))
    shift = log2(WINDOW / window)  # a short window has as much less entropy at most
    counts: dict[str, int] = {}
    weighted, digits, upper, other, found = 0.0, 0, 0, 0, []
    for end, entering in enumerate(piece, 1):
        c = counts.get(entering, 0)
        counts[entering] = c + 1
        weighted += LOG[c + 1] - LOG[c]
        digits += entering.isdigit()
        upper += entering.isupper()
        other += entering not in HEX_DIGITS
        if end < window:
            continue
        kind, bits = _judged(window, digits, upper, other)
        if bits and log2(window) - weighted / window >= bits - shift - 1e-9:
            found.append((kind, end - window, end))
        leaving = piece[end - window]
        c = counts[leaving]
        counts[leaving] = c - 1
        weighted += LOG[c - 1] - LOG[c]
        digits -= leaving.isdigit()
        upper -= leaving.isupper()
        other -= leaving not in HEX_DIGITS
    return found


def entropy_spans(run: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the spans of a candidate that are covered by windows of high entropy."""
    if ALLOWED.fullmatch(run):
        return []
    words = WORDS.fullmatch(run)
    marks = [m.span() for m in PLACEHOLDER.finditer(run)]
    starts, ends = [0, *(b for _, b in marks)], [*(a for a, _ in marks), len(run)]
    windows = []
    for at, upto in zip(starts, ends, strict=True):
        part = run[at:upto]
        if not words and not set(part) <= HEX_DIGITS:
            windows += [("entropy_base64", a + at, b + at) for a, b in high_entropy(part, BASE64_BITS)]
        for m in PIECE.finditer(part):
            windows += [(kind, a + at + m.start(), b + at + m.start()) for kind, a, b in key_windows(m[0])]
    spans: list[tuple[str, int, int]] = []
    for kind, start, end in sorted(windows, key=lambda w: w[1:]):
        if spans and start <= spans[-1][2]:
            before = spans[-1]
            spans[-1] = (max(before[0], kind, key=KINDS.index), before[1], max(before[2], end))
        else:
            spans.append((kind, start, end))
    return spans


def _outside(start: int, end: int, taken: list[list[int]]) -> Iterator[tuple[int, int]]:
    """What ``taken`` (in order, apart from one another) leaves of a stretch."""
    for a, b in taken[max(0, bisect_right(taken, [start, start]) - 1) :]:
        if a >= end:
            break
        if a > start:
            yield start, a
        start = max(start, b)
    if start < end:
        yield start, end


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in order of start, then kind."""
    if not text:
        return []
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    taken: list[list[int]] = []
    for _, start, end in sorted(found, key=lambda s: s[1]):
        if taken and start <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], end)
        else:
            taken.append([start, end])
    for m in CANDIDATE.finditer(text):
        for at, upto in _outside(m.start(), m.end(), taken):
            if upto - at >= SHORTEST:
                found += [(kind, at + start, at + end) for kind, start, end in entropy_spans(text[at:upto])]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def of_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                spans = scan(text)
                base = [s for s in spans if s[0] in BASE_KINDS]
                counts = [sum(s[0] == kind for s in base) for kind in BASE_KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), of_batches(F.col(text_col)).alias("found")).select("doc_id", "found.*")


def redact(docs: DataFrame, *, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by ``mark``; nulls stay."""

    @F.pandas_udf("string")
    def of_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else _redacted(t, mark) for t in texts], dtype=object)

    return docs.withColumn(text_col, of_batches(F.col(text_col)))


def _redacted(text: str, mark: str) -> str:
    out, at = [], 0
    for _, start, end in scan(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
