"""A source tree as a Spark data source: ``spark.read.format("repo_tree").load(root)``.

Rows: path, name, type (Directory or File), language, size, content. Spark's own file sources skip
names that begin with ``_`` or ``.``, so ``__init__.py`` would be lost. Hidden names and ignored
ones are left out. The driver lists names and sizes; contents are read by the executors, in
partitions of about equal bytes. Filters on ``language`` and ``path`` are pushed down, and
``content`` is read only with option ``content=true``. The tree must be on a file system that all
executors see.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

from loomgraph.schema import LANGUAGES
from loomgraph.sources import ignore

PARTITION_BYTES = 32 << 20
#: What a file costs besides its bytes.
OPEN_BYTES = 64 << 10


def language_of(name: str) -> str | None:
    stem, dot, suffix = name.rpartition(".")
    return LANGUAGES.get(suffix) if dot and stem else None


def walk(root: str) -> Iterator[tuple[str, bool, int]]:
    """(path, is a directory, size) below ``root``, in order of path components."""
    start = [("", ignore.parse(_read(os.path.expanduser("~/.config/git/ignore")) + "\n" + _read(os.path.join(root, ".git/info/exclude"))))]

    def below(directory: str, levels: list) -> Iterator[tuple[str, bool, int]]:
        full = os.path.join(root, directory)
        own = _read(os.path.join(full, ".gitignore"))
        levels = [*levels, (directory, ignore.parse(own))] if own else levels
        for entry in sorted(os.scandir(full), key=lambda e: e.name):
            path = f"{directory}/{entry.name}" if directory else entry.name
            is_directory = entry.is_dir()
            if entry.name.startswith(".") or ignore.ignored(path, is_directory, levels):
                continue
            if is_directory:
                yield path, True, 0
                if not entry.is_symlink():
                    yield from below(path, levels)
            elif entry.is_file():
                yield path, False, entry.stat().st_size

    yield from below("", start)


def _read(path: str) -> str:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return ""


class Files(InputPartition):
    def __init__(self, entries: list[tuple[str, bool, int]]):
        self.entries = entries


class RepoTreeReader(DataSourceReader):
    def __init__(self, root: str, content: bool, languages: set[str] | None):
        self.root, self.content, self.languages = root, content, languages
        self.prefixes: list[str] = []
        self.paths: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("language",) and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.languages = wanted if self.languages is None else self.languages & wanted
            elif column == ("path",) and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = wanted if self.paths is None else self.paths & wanted
            elif column == ("path",) and isinstance(f, StringStartsWith):
                self.prefixes.append(f.value)
            else:
                yield f

    def _wanted(self, path: str, is_directory: bool) -> bool:
        if self.languages is not None and (is_directory or language_of(path.rpartition("/")[2]) not in self.languages):
            return False
        return (self.paths is None or path in self.paths) and all(path.startswith(p) for p in self.prefixes)

    def partitions(self) -> list[InputPartition]:
        parts, entries, total = [], [], 0
        for path, is_directory, size in walk(self.root):
            if self._wanted(path, is_directory):
                entries.append((path, is_directory, size))
                total += OPEN_BYTES + size * self.content
                if total >= PARTITION_BYTES:
                    parts.append(Files(entries))
                    entries, total = [], 0
        return [*parts, Files(entries)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, is_directory, size in partition.entries:
            name, content = path.rpartition("/")[2], None
            if self.content and not is_directory:
                try:
                    with open(os.path.join(self.root, path), "rb") as f:
                        content = f.read()
                except OSError:
                    content = None
            yield path, name, "Directory" if is_directory else "File", None if is_directory else language_of(name), size, content


class RepoTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo_tree"

    def schema(self) -> str:
        return "path string, name string, type string, language string, size long, content binary"

    def reader(self, schema: StructType) -> RepoTreeReader:
        root = os.path.realpath(self.options.get("path", ""))
        check_root(self.options.get("path", ""))
        languages = self.options.get("languages")
        return RepoTreeReader(root, self.options.get("content", "false").lower() == "true", set(languages.split(",")) if languages else None)


def check_root(path: str) -> None:
    """Raise unless ``path`` is a directory that exists."""
    if not path or not os.path.exists(path):
        raise FileNotFoundError(f"no such path: {path}")
    if not os.path.isdir(path):
        raise NotADirectoryError(f"not a directory: {path}")


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let Spark hand it filters: off by default, without it the reader cannot be planned."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RepoTree)
