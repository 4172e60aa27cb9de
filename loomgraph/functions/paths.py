"""Column expressions over node ids and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REPO_PREFIXES = ("https://github.com/", "git@github.com:", "https://gitlab.com/", "git@gitlab.com:")


def block_id(path: Column, name: Column, start_line: Column) -> Column:
    return F.concat(path, F.lit("::"), name, F.lit("@"), start_line.cast("string"))


def prefixes(path: Column) -> Column:
    """Ids of the directories above a path, from the root (``""``) down; empty for the root itself."""
    parts = F.split(path, "/")
    above = F.when(
        F.size(parts) > 1,
        F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(F.lit("")), above))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """Directory of a path, ``""`` at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def stem(name: Column) -> Column:
    """File name without its last suffix; names that begin with their only dot stay whole."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def without_suffix(path: Column) -> Column:
    directory = parent_dir(path)
    return F.concat(F.when(directory == "", "").otherwise(F.concat(directory, F.lit("/"))), stem(file_name(path)))


def extension(name: Column) -> Column:
    return F.regexp_extract(name, r"[^/]\.([^./]+)$", 1)


def normalise(path: Column) -> Column:
    """Path without empty and ``.`` parts; ``..`` takes back the part before it, if there is one."""
    empty = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        return (
            F.when((part == "") | (part == "."), kept)
            .when((part == "..") & (F.size(kept) == 0), kept)
            .when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .otherwise(F.concat(kept, F.array(part)))
        )

    return F.aggregate(F.split(path, "/"), empty, step, lambda kept: F.array_join(kept, "/"))


def relative_to(file_path: Column, module: Column) -> Column:
    """A relative module path seen from a file."""
    directory = parent_dir(file_path)
    return normalise(F.concat(directory, F.lit("/"), module))


def dotted_to_path(module: Column) -> Column:
    return F.replace(module, F.lit("."), F.lit("/"))


def crate_to_path(module: Column) -> Column:
    return F.concat(F.lit("src/"), F.replace(F.regexp_replace(module, "^crate::", ""), F.lit("::"), F.lit("/")))


def path_hash(path: Column) -> Column:
    """Key of a folder: 32-bit ``31 * h + unit`` over UTF-16 units, absolute, in base 36."""
    h = F.call_function("java_method", F.lit("java.util.Objects"), F.lit("hashCode"), path).cast("long")
    return F.lower(F.conv(F.abs(h).cast("string"), 10, 36))


def is_repo_url(url: Column) -> Column:
    found = F.lit(False)
    for prefix in REPO_PREFIXES:
        found = found | F.startswith(url, F.lit(prefix))
    return found


def repo_folder(url: Column) -> Column:
    """Folder that a repository is cloned to."""
    return F.substring_index(F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"(\.git)+$", ""), "/", -1)
