"""Extraction as a Spark job: files in, blocks, references and per-file results out."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.extract.sites import EXTRACTORS, Lines, enclosed, signature
from loomgraph.streaming.live import LiveRun

SPAN = ("start_line", "start_col", "end_line", "end_col")
#: ``around``: ids of the blocks around a site, of a block the innermost.
SITES = """path string, what string, ordinal long, id string, kind string, name string, module_path string, visibility string, signature string,
start_line int, start_col int, end_line int, end_col int, around array<string>, message string, n_refs long"""
#: Sites handed over at a time.
ROWS = 10_000
ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
SCHEMA = pa.schema([(c.split()[0], ARROW[c.split()[1]]) for c in SITES.split(",")])


def _rows(path: str, language: str, content: bytes | None, extractors: dict) -> Iterator[tuple]:
    blank = (None,) * 11
    if content is None:
        yield path, "error", 0, *blank, "cannot be read", 0
        return
    try:
        source = content.decode("utf-8")
    except UnicodeDecodeError as e:
        yield path, "error", 0, *blank, f"not valid UTF-8: {e}", 0
        return
    lines = Lines(source)
    blocks, parents, references = enclosed(extractors[language](source))
    places = [(*lines.at(block.start), *lines.at(block.end)) for block in blocks]
    ids = [f"{path}::{block.name}@{place[0]}" for block, place in zip(blocks, places, strict=True)]
    for i, (block, parent) in enumerate(zip(blocks, parents, strict=True)):
        around = [] if parent is None else [ids[parent]]
        text = signature(source[block.start : block.end])
        yield path, "block", i, ids[i], block.kind, block.name, None, block.visibility, text, *places[i], around, None, None
    for i, (ref, around) in enumerate(references):
        if around:
            place = (*lines.at(ref.start), *lines.at(ref.end))
            yield path, "ref", i, None, ref.kind, ref.name, ref.module_path, None, None, *place, [ids[k] for k in around], None, None
    yield path, "done", len(blocks), *blank, None, len(references)


def extract_sites(files: DataFrame, report: LiveRun | None = None) -> DataFrame:
    """(path, language, content) to sites; files of languages without an extractor give nothing.

    Tasks tell ``report`` of each file once it is read.
    """
    extractors = dict(EXTRACTORS)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        log = report.log() if report is not None else None

        def handed_over() -> pa.RecordBatch:
            columns = zip(*found, strict=True) if found else [[] for _ in SCHEMA]
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)
            found.clear()
            return out

        for batch in batches:
            for path, language, content in zip(*(batch[c].to_pylist() for c in ("path", "language", "content")), strict=True):
                began = time.time_ns() // 1000
                found += _rows(path, language, content, extractors)
                if log is not None:
                    last = dict(zip(SCHEMA.names, found[-1], strict=True))
                    log.done(path, len(content or b""), began, last["ordinal"], last["message"])
                if len(found) >= ROWS:
                    yield handed_over()
        if log is not None:
            log.close()
        yield handed_over()

    known = files.filter(F.col("language").isin(*extractors))
    return known.select("path", "language", "content").mapInArrow(of_batches, SITES)


def _span():
    return F.when(F.col("start_line").isNotNull(), F.struct(*SPAN)).alias("span")


def blocks_of(sites: DataFrame) -> DataFrame:
    """Block nodes; a block's lexical parent is the innermost block around it, else its file."""
    return sites.filter("what = 'block'").select(
        "id",
        F.lit("CodeBlock").alias("type"),
        "name",
        F.lit(None).cast("string").alias("path"),
        F.lit(None).cast("string").alias("language"),
        "kind",
        _span(),
        "signature",
        "visibility",
        F.coalesce(F.get("around", F.lit(0)), "path").alias("parent_id"),
        F.col("path").alias("file_path"),
        F.col("ordinal").alias("child_ordinal"),
    )


def references_of(sites: DataFrame) -> DataFrame:
    """Raw references, one for each block around a site, with the file as ``file_path``."""
    refs = sites.filter("what = 'ref'").withColumn("from_node", F.explode("around"))
    return refs.select("from_node", "kind", "name", "module_path", _span(), F.col("path").alias("file_path"), "ordinal")


def results_of(sites: DataFrame) -> DataFrame:
    """(path, blocks, message, n_refs), a row per file."""
    return sites.filter("what in ('done', 'error')").select(
        "path", F.when(F.col("what") == "done", F.col("ordinal")).alias("blocks"), "message", "n_refs"
    )
