"""Which files of a tree are read: ignore rules as predicates over paths, and the reading."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .extract import matched_glob

#: Folders that are never walked, trees that no glob matches, and folders that aren't the product.
IGNORED_DIRS = (
    "node_modules", "vendor", ".venv", "__pycache__", ".git", ".jj", ".hg", ".svn", "dist", "build", "out", "coverage", "target", ".gradle", ".next",
    ".nuxt", ".turbo", ".vercel", ".cache", ".svelte-kit", "cdk.out", ".DS_Store",
)
REJECTED = r"(?:^|[/\\])(?:node_modules|\.claude[/\\]worktrees|\.git[/\\]worktrees|\.jj)(?:[/\\]|$)"
NON_PRODUCT_DIRS = (
    "fixtures", "__fixtures__", "test-fixtures", "testfixtures", "testdata", "test", "tests", "__tests__", "spec", "specs", "__mocks__", "mocks",
    "examples", "example", "sample", "samples",
)
GENERATED = r"(?i)(\.min\.[cm]?js|\.(bundle|chunk)\.[cm]?jsx?|[.-]generated\.[a-z0-9]+|\.d\.ts)$"
MAX_SCAN_BYTES = 1_500_000


def walked(path: Column, keep_dot: tuple[str, ...] = ()) -> Column:
    """Whether a walk reaches a relative path: no part of it is an ignored folder or, unless kept, starts with a dot."""
    return ~F.exists(F.split(path, "/"), lambda x: x.isin(*IGNORED_DIRS) | (x.startswith(".") & (~x.isin(list(keep_dot)) if keep_dot else F.lit(True))))


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether an unanchored pattern (``*``, ``**``) is the path, its end, its start or within it, at slashes."""
    out = F.lit(False)
    for p in patterns:
        body = ""
        for part in re.split(r"(\*\*|\*|\.)", p.rstrip("/") or p):
            body += {"**": ".*", "*": "[^/]*", ".": r"\."}.get(part, part)
        out = out | path.rlike(f"(?:^|/){body}(?:$|/)")
    return out


def should_ignore(path: Column, everywhere: list[str], here: list[str]) -> Column:
    return ignored(path, everywhere) | ignored(path, here)


def glob_match(path: Column, globs: list[str]) -> Column:
    """Whether any anchored glob matches; copies of other trees never do."""
    hit = F.lit(False)
    for g in globs:
        hit = hit | matched_glob(path, g)
    return hit & ~path.rlike(REJECTED)


def glob_count(files: DataFrame, globs: list[str], path: str = "path") -> DataFrame:
    """One row: ``n`` files that match, null for none, as nothing may be held against a glob that doesn't resolve."""
    n = F.count_if(glob_match(F.col(path), globs))
    return files.agg(F.when(n > 0, n).alias("n"))


def non_product(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, NON_PRODUCT_DIRS)))


def scannable(path: Column, n_bytes: Column) -> Column:
    return ~path.rlike(GENERATED) & (n_bytes <= MAX_SCAN_BYTES)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """``path, n_bytes, content`` of the files that a walk of a folder reaches; too large and generated ones have null content.

    A file that can't be read fails the scan, so that a partial one never passes for whole.
    Spark's own listing leaves out names that start with a dot or an underscore
    (``__init__.py`` too); a table of paths and contents made otherwise can hold them.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "false").load(root)
    base = re.sub(r"^[a-z]+:/*", "/", root).rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + re.escape(base), "")
    out = raw.select(path.alias("path"), F.col("length").alias("n_bytes"), F.col("content"))
    text = F.when(scannable(F.col("path"), F.col("n_bytes")), F.decode("content", "UTF-8"))
    return out.where(walked(F.col("path"))).select("path", "n_bytes", text.alias("content"))
