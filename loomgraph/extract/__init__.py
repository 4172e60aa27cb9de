"""Blocks and references of source files."""

from loomgraph.extract import ecma, python, rust
from loomgraph.extract.sites import EXTRACTORS, Site, register_language

for _name, _extractor in (
    ("Python", python.extract),
    ("TypeScript", ecma.extract_typescript),
    ("JavaScript", ecma.extract_javascript),
    ("Rust", rust.extract),
):
    register_language(_name, _extractor)

__all__ = ["EXTRACTORS", "Site", "register_language"]
