"""Paths, names and their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_VIRTUAL = r"^zip://(.*)!([^!]*)$"


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def is_virtual(path: Column) -> Column:
    return path.rlike(_VIRTUAL)


def archive_of(path: Column) -> Column:
    """The archive of a virtual path, up to its last exclamation mark; null for a plain path."""
    return F.nullif(F.regexp_extract(path, _VIRTUAL, 1), F.lit(""))


def inner_of(path: Column) -> Column:
    return F.when(is_virtual(path), F.regexp_extract(path, _VIRTUAL, 2))


def container(path: Column) -> Column:
    """What a page belongs to: its archive's folder, or its own."""
    return F.when(is_virtual(path), folder(archive_of(path))).otherwise(folder(path))


def volume_of(path: Column) -> Column:
    """The volume a page belongs to: its archive, or its folder."""
    return F.coalesce(archive_of(path), folder(path))


def normalized(path: Column) -> Column:
    """Forward slashes, no ``file://`` in front, no repeated slash, no dot parts, lower case."""
    plain = F.regexp_replace(F.regexp_replace(path, r"^file:/{2,3}", "/"), r"\\", "/")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?<!:)/{2,}", "/"), r"/\.(?=/|$)", "")
    return F.lower(F.regexp_replace(plain, r"(?<=.)/$", ""))


def sanitized(name: Column) -> Column:
    """A name without characters that file systems refuse."""
    return F.trim(F.regexp_replace(name, r'[\\/:*?"<>|]', "_"))


def natural_key(name: Column) -> Column:
    """An array that orders names with numbers by value: digits filled up, the rest in lower case."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"), 1)
    return F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), 20, "0")).otherwise(x))


def excluded(folder_path: Column, rules: tuple[str, ...]) -> Column:
    """Rules with a slash exclude a folder and what lies below it; others exclude by a part's name."""
    out = F.lit(False)
    for rule in rules:
        if "/" in rule:
            top = rule.rstrip("/").lower()
            out = out | (F.lower(folder_path) == top) | F.lower(folder_path).startswith(top + "/")
        else:
            out = out | F.array_contains(F.split(F.lower(folder_path), "/"), rule.lower())
    return out
