"""Dependencies listed in lock files, as array expressions over one file row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import WS, whole_json
from auditloom.operators.files import base_name, text_lines, walk_key

NPM_ENTRIES = 500
MAX_TEXT = 2**31 - 1
ITEM_TYPE = "array<struct<name:string,version:string>>"

# Ecosystem per lock file name.
ECOSYSTEMS = {
    "package-lock.json": "npm",
    "composer.lock": "Packagist",
    "requirements.txt": "PyPI",
    "go.sum": "Go",
    "Gemfile.lock": "RubyGems",
    "Cargo.lock": "crates.io",
}

_NOT_WS = rf"[^{WS}]"


def _items(names_versions: Column) -> Column:
    """Drops entries that lack a name or a version."""
    return F.filter(
        names_versions,
        lambda d: (F.coalesce(d["name"], F.lit("")) != "")
        & (F.coalesce(d["version"], F.lit("")) != ""),
    ).cast(ITEM_TYPE)


def _pair(name: Column, version: Column) -> Column:
    return F.struct(name.alias("name"), version.alias("version"))


def _last_entries(packages: Column) -> Column:
    """Entries of a parsed object; of a repeated key the last value at the first place."""
    keys, entries = F.map_keys(packages), F.map_entries(packages)
    unique = F.array_distinct(keys)
    last = F.transform(
        unique, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)
    )
    return F.when(F.size(unique) == F.size(keys), entries).otherwise(last)


def npm_items(content: Column, limit: int | None = None) -> Column:
    """Entries of ``packages``, or of ``dependencies`` where that is missing.

    Entry values stay raw JSON text, so one odd entry does not spoil the rest.
    """
    lock = F.from_json(
        whole_json(content, "}"), "packages map<string,string>, dependencies map<string,string>"
    )
    entries = F.transform(
        F.array(F.coalesce(lock["packages"], lock["dependencies"])), _last_entries
    )[0]
    items = _items(
        F.transform(
            entries,
            lambda e: _pair(
                _without(e["key"], "node_modules/"),
                F.get_json_object(e["value"], "$.version"),
            ),
        )
    )
    return items if limit is None else F.slice(items, 1, limit)


def composer_items(content: Column) -> Column:
    package = "array<struct<name:string,version:string>>"
    lock = F.from_json(whole_json(content, "}"), f"packages {package}, `packages-dev` {package}")
    none = F.array().cast(package)
    both = F.concat(
        F.coalesce(lock["packages"], none), F.coalesce(lock["packages-dev"], none)
    )
    return F.transform(
        _items(both), lambda d: _pair(d["name"], _without(d["version"], "v"))
    )


def _without(text: Column, prefix: str) -> Column:
    rest = F.substring(text, len(prefix) + 1, MAX_TEXT)
    return F.when(text.startswith(prefix), rest).otherwise(text)


def _matched_lines(lines: Column, pattern: str, literal: str) -> Column:
    """Both groups of each line that matches; ``literal`` is part of every match.

    A line holds no newline, so one replacement per line puts the groups apart
    with it, and lines that do not match stay in one piece.
    """
    groups = F.transform(
        F.filter(lines, lambda x: x.contains(literal)),
        lambda x: F.split(F.regexp_replace(x, pattern + r"[\s\S]*\z", "$1\n$2"), "\n"),
    )
    return F.transform(
        F.filter(groups, lambda g: F.size(g) == 2), lambda g: _pair(g[0], g[1])
    )


def requirements_items(content: Column) -> Column:
    pattern = rf"^[{WS}]*([A-Za-z0-9_.-]+)==([^{WS};]+)"
    return _matched_lines(text_lines(content), pattern, "==")


def go_sum_items(content: Column) -> Column:
    pattern = rf"^({_NOT_WS}++)[{WS}]++v([^{WS}/]++)(?:/go\.mod)?[{WS}]++h1:"
    return F.array_distinct(_matched_lines(text_lines(content), pattern, "h1:"))


def gemfile_items(content: Column) -> Column:
    pattern = rf"^[{WS}]{{4}}([A-Za-z0-9_.-]+) \(([^ )]+)\)"
    return _matched_lines(text_lines(content), pattern, " (")


def cargo_items(content: Column) -> Column:
    blocks = F.split(content, r"\[\[package\]\]", -1)
    field = rf'(?m)^[{WS}]*%s[{WS}]*=[{WS}]*"([^"]+)"'
    return _items(
        F.transform(
            F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))),
            lambda b: _pair(
                F.regexp_extract(b, field % "name", 1),
                F.regexp_extract(b, field % "version", 1),
            ),
        )
    )


def is_manifest(path: Column) -> Column:
    return base_name(path).isin(*ECOSYSTEMS)


def manifest_items(path: Column, content: Column, npm_limit: int | None = None) -> Column:
    """Items of the manifest by its exact base name; malformed JSON gives none."""
    name = base_name(path)
    return F.coalesce(
        F.when(name == "package-lock.json", npm_items(content, npm_limit))
        .when(name == "composer.lock", composer_items(content))
        .when(name == "requirements.txt", requirements_items(content))
        .when(name == "go.sum", go_sum_items(content))
        .when(name == "Gemfile.lock", gemfile_items(content))
        .when(name == "Cargo.lock", cargo_items(content)),
        F.array().cast(ITEM_TYPE),
    )


def ecosystem(path: Column) -> Column:
    expr = None
    for name, eco in ECOSYSTEMS.items():
        hit = base_name(path) == name
        expr = F.when(hit, eco) if expr is None else expr.when(hit, eco)
    return expr


def dependency_inventory(files: DataFrame, npm_limit: int | None = None) -> DataFrame:
    """One row per dependency of each manifest, numbered from 0 in file order."""
    path = F.col("path")
    return (
        files.filter(is_manifest(path))
        .select(
            "scan_id",
            "path",
            ecosystem(path).alias("ecosystem"),
            F.posexplode(manifest_items(path, F.col("content"), npm_limit)),
        )
        .select(
            "scan_id",
            F.col("path").alias("file"),
            walk_key(path).alias("walk"),
            "ecosystem",
            "col.name",
            "col.version",
            "pos",
        )
    )
