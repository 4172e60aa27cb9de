"""A source tree listed by the executors: a frontier of directories is expanded in rounds, and no list of names reaches the driver.

Ignore rules come from, the later deciding: the global file (``core.excludesFile`` of the driver's user, else
``git/ignore`` in the folder for settings), ``.git/info/exclude``, each ``.gitignore`` and then each ``.ignore`` from the outermost
directory to the innermost. Those of directories above the root hold too, ``.gitignore`` up to the one with ``.git``. The tree must
be on a file system that all executors see.
"""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.shared import durable
from loomgraph.sources import ignore
from loomgraph.sources.repo_tree import OPEN_BYTES, PARTITION_BYTES, check_root, language_of

#: Directories that a task lists before it hands on those it has found below.
DIRECTORIES = 500
#: Directories of a task's share in a round, and files whose contents are handed over at a time.
SHARE = 20
FILES = 50
FOUND = "path string, name string, type string, language string, size long, open boolean"
COLUMNS = [c.split()[0] for c in FOUND.split(", ")]


def _text(path: str) -> str:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return ""


def global_rules() -> str:
    """The text of the user's global ignore file; empty without one."""
    settings = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
    chosen = f"{settings}/git/ignore"
    for config in (f"{settings}/git/config", os.path.expanduser("~/.gitconfig")):
        section = ""
        for line in _text(config).splitlines():
            if header := re.match(r"\s*\[\s*([^\]\s]+)", line):
                section = header[1].lower()
            elif section == "core" and (value := re.match(r"\s*excludesfile\s*=\s*\"?([^\"#;]+)", line, re.IGNORECASE)):
                chosen = os.path.expanduser(value[1].strip())
    return _text(chosen)


@lru_cache(4096)
def _rules(path: str) -> tuple[ignore.Rule, ...]:
    return tuple(ignore.parse(_text(path)))


@lru_cache(4096)
def _has_git(directory: str) -> bool:
    return os.path.exists(f"{directory}/.git")


def _levels(root: str, directory: str, general: list[tuple]) -> list[tuple]:
    """Rules for what is in ``directory``, those that decide last at the end."""
    chain = [directory]
    while os.path.dirname(chain[-1]) != chain[-1]:
        chain.append(os.path.dirname(chain[-1]))
    inside = next((i for i, d in enumerate(chain) if d == root or _has_git(d)), len(chain) - 1)
    if chain[inside] == root and not _has_git(root):  # the root may lie within a repository
        inside = next((i for i, d in enumerate(chain) if i > inside and _has_git(d)), inside)
    of = lambda name, above: [(d.rstrip("/"), rules) for d in reversed(above) if (rules := _rules(f"{d}/{name}"))]
    return [*general, *of(".gitignore", chain[: inside + 1]), *of(".ignore", chain)]


def _entries(root: str, directory: str, general: list[tuple]) -> Iterator[tuple[str, str, bool, bool, int]]:
    """(path below the root, name, is a directory, may be entered, size) in ``directory``, which is below the root too."""
    full = f"{root}/{directory}" if directory else root
    levels = _levels(root, full, general)
    for entry in sorted(os.scandir(full), key=lambda e: e.name):
        is_directory = entry.is_dir()
        if entry.name.startswith(".") or ignore.ignored(f"{full}/{entry.name}", is_directory, levels):
            continue
        path = f"{directory}/{entry.name}" if directory else entry.name
        if is_directory:
            yield path, entry.name, True, not entry.is_symlink(), 0
        elif entry.is_file():
            yield path, entry.name, False, False, entry.stat().st_size


def _expand(frontier: DataFrame, root: str, general_text: str, directories: int) -> DataFrame:
    def of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _rules.cache_clear()  # a worker may have served an earlier scan
        _has_git.cache_clear()
        general = [(root, ignore.parse(general_text)), (root, ignore.parse(_text(f"{root}/.git/info/exclude")))]
        listed = 0
        for batch in batches:
            waiting = deque(batch["path"])
            found = []
            while waiting and listed < directories:
                listed += 1
                for path, name, is_directory, enter, size in _entries(root, waiting.popleft(), general):
                    found.append((path, name, "Directory" if is_directory else "File", None if is_directory else language_of(name), size, False))
                    if enter:
                        waiting.append(path)
                if len(found) >= 10_000:
                    yield pd.DataFrame(found, columns=COLUMNS)
                    found = []
            found += [(path, None, None, None, 0, True) for path in waiting]
            yield pd.DataFrame(found, columns=COLUMNS)

    return frontier.select("path").mapInPandas(of_batches, FOUND)


def list_tree(spark: SparkSession, root: str, *, directories: int = DIRECTORIES) -> DataFrame:
    """(path, name, type, language, size) of what is below ``root``, in no order.

    A task lists its share of the frontier and goes on below it until it has listed ``directories``; what it has found
    but not listed is the frontier of the next round. Each round is written to the shared folder, so a lost executor costs
    one round at most. A directory that cannot be read ends the job with its error; links to directories are
    listed, not followed.
    """
    check_root(root)
    root, general_text = os.path.realpath(root), global_rules()
    frontier, waiting, rounds = spark.createDataFrame([("",)], "path string"), 1, []
    while waiting:
        shares = max(1, min(waiting // SHARE, 100_000))
        found = durable(_expand(frontier.repartition(shares, "path"), root, general_text, directories))
        rounds.append(found.filter("not open").drop("open"))
        frontier = found.filter("open").select("path")
        waiting = frontier.count()
    every = rounds[0]
    for more in rounds[1:]:
        every = every.unionByName(more)
    return every


def with_content(tree: DataFrame, root: str) -> DataFrame:
    """Files of ``tree`` with their ``content``, null where it cannot be read.

    Partitions hold files of about equal bytes in all, in the order of their paths.
    """
    root = os.path.realpath(root)
    files = tree.filter("type = 'File'")
    total = files.agg(F.coalesce(F.sum(F.col("size") + OPEN_BYTES), F.lit(0)).alias("total")).first()["total"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, size = [], 0
            for path, language, length in batch[["path", "language", "size"]].itertuples(index=False, name=None):
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        content = f.read()
                except OSError:
                    content = None
                held.append((path, language, length, content))
                size += length
                if size >= PARTITION_BYTES or len(held) >= FILES:
                    yield pd.DataFrame(held, columns=["path", "language", "size", "content"])
                    held, size = [], 0
            yield pd.DataFrame(held, columns=["path", "language", "size", "content"])

    parted = files.select("path", "language", "size").repartition(total // PARTITION_BYTES + 1, "path").sortWithinPartitions("path")
    return parted.mapInPandas(read, "path string, language string, size long, content binary")
