"""Which files are scanned, and reading them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.functions.text import base_name, extension, glob_regex, glob_to_regex
from riskloom.model import LARGE_FILE_BYTES
from riskloom.rules.exemptions import SCANNED_EXTENSIONS, SKIPPED_DIRS

PROJECT_FILES = ("composer.json", "wp-config.php", ".scan-config.json")


def in_skipped_dir(path: Column) -> Column:
    names = "|".join(name.replace(".", "\\.") for name in SKIPPED_DIRS)
    return F.rlike(path, F.lit(f"(^|/)({names})/"))


def has_scanned_extension(path: Column) -> Column:
    return extension(path).isin(SCANNED_EXTENSIONS)


def is_excluded(path: Column, patterns) -> Column:
    """Glob on the whole path, glob on the base name, or plain containment."""
    excluded = F.lit(False)
    for pattern in patterns:
        regex = glob_to_regex(pattern)
        if regex is not None:
            excluded = excluded | F.rlike(path, F.lit(regex)) | F.rlike(base_name(path), F.lit(regex))
        part = pattern.removesuffix("*").removeprefix("*")
        excluded = excluded | F.contains(path, F.lit(part))
    return excluded


def excluded_by(path: Column, patterns: Column) -> Column:
    """:func:`is_excluded` for an array of ``(regex, part)``, see :func:`compiled_globs`."""
    name = base_name(path)
    return F.exists(
        patterns,
        lambda p: F.coalesce(F.rlike(path, p["regex"]) | F.rlike(name, p["regex"]), F.lit(False))
        | F.contains(path, p["part"]),
    )


def compiled_globs(patterns: Column) -> Column:
    """Exclude patterns that are data, as regular expressions and the text that is enough to contain."""
    return F.transform(
        patterns,
        lambda p: F.struct(
            glob_regex(p).alias("regex"),
            F.regexp_replace(F.regexp_replace(p, r"\*$", ""), r"^\*", "").alias("part"),
        ),
    )


def scannable(files: DataFrame, exclude_patterns=()) -> DataFrame:
    """Files a scan looks at.  Uses the path only."""
    path = F.col("path")
    kept = files.where(~in_skipped_dir(path) & has_scanned_extension(path))
    return kept.where(~is_excluded(path, exclude_patterns)) if exclude_patterns else kept


def is_large(size_bytes: Column) -> Column:
    """Flag only; large files are scanned too."""
    return size_bytes > LARGE_FILE_BYTES


def read_tree(spark: SparkSession, root: str, project: str | None = None) -> DataFrame:
    """Files below a directory as ``(project, path, content)``; paths relative to it.

    The reader's own name filter drops other extensions while it lists files.
    Contents of skipped directories are not kept: only their paths are looked at
    before the content becomes text.  A single file is accepted if its extension is scanned.
    """
    letters = lambda ext: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext)
    return _read(spark, root, project, "{" + ",".join("*" + letters(e) for e in SCANNED_EXTENSIONS) + "}")


def read_project_files(spark: SparkSession, root: str, project: str | None = None) -> DataFrame:
    """Manifests, marker and configuration files below a directory, for frameworks and settings."""
    return _read(spark, root, project, "{" + ",".join(PROJECT_FILES) + "}")


def _read(spark: SparkSession, root: str, project: str | None, name_filter: str) -> DataFrame:
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", name_filter)
        .load(root)
    )
    base = root.rstrip("/")
    relative = F.regexp_replace("path", "^.*?" + "\\Q" + base + "\\E/?", "")
    path = F.when(relative == "", base_name(F.col("path"))).otherwise(relative)
    default_project = base.rsplit("/", 1)[-1]
    return raw.where(~in_skipped_dir(path)).select(
        F.lit(project or default_project).alias("project"),
        path.alias("path"),
        F.col("content").cast("string").alias("content"),
    )


def single_file(spark: SparkSession, path: str, project: str | None = None) -> DataFrame:
    """One file; an extension that is not scanned is an error, not an empty result."""
    dot = path.rsplit("/", 1)[-1].rfind(".")
    if dot < 0 or path.rsplit("/", 1)[-1][dot:].lower() not in SCANNED_EXTENSIONS:
        raise ValueError(f"extension is not scanned: {path}")
    return read_tree(spark, path, project)


def read_table(spark: SparkSession, location: str) -> DataFrame:
    """A parquet corpus table with ``project``, ``path`` and ``content``."""
    return spark.read.parquet(location).select("project", "path", "content")


def file_overview(files: DataFrame) -> DataFrame:
    """Size, extension and flags per file."""
    size = F.octet_length("content").cast("bigint")
    return files.select(
        "project",
        "path",
        extension(F.col("path")).alias("ext"),
        size.alias("size_bytes"),
        is_large(size).alias("is_large"),
        F.sha2(F.encode("content", "UTF-8"), 256).alias("sha256"),
    )
