"""Source trees as DataFrames: one row per file, filtered by language, excludes, depth and tests."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions by language, and folders that never hold sources (fixed values).
EXTENSIONS = {"typescript": (".ts", ".tsx"), "javascript": (".js", ".jsx"), "java": (".java",), "python": (".py",)}
EXCLUDES = ("node_modules", ".git", "dist", "build", "target", "coverage", "__pycache__", ".venv", "venv")
_TESTS = r"(^|/)(tests?|__tests__|spec)/|[._](test|spec)\.[^/]+$|(^|/)test_[^/]+\.py$|Tests?\.java$"


@dataclass(frozen=True)
class ScanConfig:
    """What of a tree is scanned; ``max_depth`` counts folders below the root, None is any."""

    path: str
    project_id: str
    languages: tuple[str, ...] = tuple(EXTENSIONS)
    exclude_paths: tuple[str, ...] = EXCLUDES
    include_tests: bool = True
    max_depth: int | None = None
    project_name: str | None = None
    extended: bool = True


def exclude_regex(patterns: tuple[str, ...]) -> str:
    """A regular expression for paths that one of the patterns covers: plain names match any folder, globs the path."""
    out = []
    for p in patterns:
        if re.fullmatch(r"[^*/?]+", p):
            out.append(rf"(?:^|/){re.escape(p)}/")
        else:
            body = re.escape(p).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
            out.append(f"(?:^|/){body}$")
    return "|".join(out) or r"(?!)"


def wanted(path: Column, config: ScanConfig) -> Column:
    """Whether a path (relative to the root) is scanned."""
    ext = [e for lang in config.languages for e in EXTENSIONS.get(lang, ())]
    keep = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*ext) & ~path.rlike(exclude_regex(config.exclude_paths))
    if not config.include_tests:
        keep = keep & ~path.rlike(_TESTS)
    if config.max_depth is not None:
        keep = keep & (F.size(F.split(path, "/")) - 1 <= config.max_depth)
    return keep


def source_files(spark: SparkSession, config: ScanConfig) -> DataFrame:
    """``project_id, source_file, text`` of the tree's wanted files."""
    any_case = lambda ext: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext)
    ext = [any_case(e) for lang in config.languages for e in EXTENSIONS.get(lang, ())]
    return _read(spark, config, "*{" + ",".join(ext) + "}", lambda path: wanted(path, config))


def build_files(spark: SparkSession, config: ScanConfig, names: tuple[str, ...]) -> DataFrame:
    """``project_id, source_file, text`` of the tree's files of these names or patterns outside excluded folders."""
    return _read(spark, config, "{" + ",".join(names) + "}", lambda path: ~path.rlike(exclude_regex(config.exclude_paths)))


def _read(spark: SparkSession, config: ScanConfig, names: str, keep: Callable[[Column], Column]) -> DataFrame:
    """Files whose name matches the glob (the others aren't opened) and whose path relative to the root is kept."""
    root = config.path.rstrip("/")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(root)
    at = re.sub(r"^file:/*", "/", root)
    rel = F.regexp_replace(F.regexp_replace(F.col("path"), r"^file:/*", "/"), "^" + re.escape(at if at.startswith("/") else os.path.abspath(at)) + "/+", "")
    df = df.select(rel.alias("source_file"), "content").where(keep(F.col("source_file")))
    return df.select(F.lit(config.project_id).alias("project_id"), "source_file", F.decode("content", "UTF-8").alias("text"))


def matches(path: str, pattern: str) -> bool:
    """Whether a file's name equals or matches a pattern."""
    name = path.rsplit("/", 1)[-1]
    return name == pattern or fnmatch.fnmatch(name, pattern)
