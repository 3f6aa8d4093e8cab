"""Relations between files: nearby tests, import targets, workspaces.

All three work on path-sized rows only and meet in one table keyed by file, so
the wide metric rows are shuffled once, by ``repo, path``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import paths

IMPORT_CANDIDATES = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
_EXTENSIONS = "|".join(fixed.SOURCE_EXTENSIONS)


def covered_stems(listing: DataFrame) -> DataFrame:
    """``repo, folder, stem`` for which a test file exists anywhere in the listing."""
    path = F.col("path")
    folder, name = paths.parent_prefix(path), paths.base_name(path)
    marked = F.regexp_extract(name, rf"^(.*)\.(?:test|spec)\.(?:{_EXTENSIONS})$", 1)
    prefixed = F.regexp_extract(name, rf"^test_(.*)\.(?:{_EXTENSIONS})$", 1)
    suffixed = F.regexp_extract(name, rf"^(.*)Test\.(?:{_EXTENSIONS})$", 1)
    outer = F.regexp_extract(folder, "^(.*)__tests__/$", 1)
    in_tests_folder = folder.rlike("(^|/)__tests__/$")
    key = lambda where, stem: F.when(
        stem != "", F.struct(where.alias("folder"), stem.alias("stem"))
    )
    keys = F.array_compact(
        F.array(
            key(folder, marked),
            F.when(in_tests_folder, key(outer, marked)),
            key(folder, prefixed),
            key(folder, suffixed),
        )
    )
    return listing.select("repo", F.inline_outer(keys)).filter(F.col("stem").isNotNull()).distinct()


def nearby_tests(files: DataFrame, listing: DataFrame) -> DataFrame:
    """``repo, path, has_tests_nearby`` for the analysed files."""
    path = F.col("path")
    keyed = files.select(
        "repo", "path", paths.parent_prefix(path).alias("folder"), paths.file_stem(path).alias("stem")
    )
    hits = covered_stems(listing).withColumn("covered", F.lit(True))
    return keyed.join(hits, ["repo", "folder", "stem"], "left").select(
        "repo", "path", (paths.is_test_file(path) | F.col("covered").isNotNull()).alias("has_tests_nearby")
    )


def import_targets(imports: DataFrame) -> DataFrame:
    """``repo, base, imports``: relative imports per resolved base path.

    Statements are counted per base before candidates are tried, so a file that
    everybody imports costs one row per task and not one row per import.
    """
    return (
        imports.select(
            "repo", F.col("path").alias("importer"), F.explode("import_sources").alias("specifier")
        )
        .filter(F.col("specifier").startswith("."))
        .select(
            "repo",
            paths.resolve(
                F.when(F.col("importer").contains("/"), paths.directory(F.col("importer"))).otherwise(F.lit("")),
                F.col("specifier"),
            ).alias("base"),
        )
        .filter(F.col("base").isNotNull())
        .groupBy("repo", "base")
        .agg(F.count("*").alias("imports"))
    )


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``repo, base, imports, target``: the first existing candidate of each base."""
    candidates = import_targets(imports).select(
        "repo",
        "base",
        "imports",
        F.posexplode(F.array(*[F.concat(F.col("base"), F.lit(c)) for c in IMPORT_CANDIDATES])).alias(
            "rank", "path"
        ),
    )
    # 'x/index.ts' of the root folder has an empty base and no leading slash.
    candidates = candidates.withColumn("path", F.regexp_replace("path", "^/", ""))
    return (
        candidates.join(files.select("repo", "path"), ["repo", "path"])
        .groupBy("repo", "base")
        .agg(F.first("imports").alias("imports"), F.min_by("path", "rank").alias("target"))
    )


def dependents(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``repo, path, dependent_count`` for files that are imported at all."""
    return (
        import_edges(imports, files)
        .groupBy("repo", F.col("target").alias("path"))
        .agg(F.sum("imports").alias("dependent_count"))
    )


def workspace_of(files: DataFrame, workspaces: DataFrame) -> DataFrame:
    """``repo, path, workspace``: deepest workspace root above each file.

    Folders are resolved instead of files, and every folder meets its ancestors
    through an equality join.
    """
    located = files.select("repo", "path", paths.directory(F.col("path")).alias("folder"))
    folders = located.select("repo", "folder").distinct()
    roots = workspaces.select("repo", F.col("root_path").alias("ancestor"))
    found = (
        folders.select("repo", "folder", F.explode(paths.ancestors(F.col("folder"))).alias("ancestor"))
        .join(roots, ["repo", "ancestor"])
        .groupBy("repo", "folder")
        .agg(F.max_by("ancestor", F.length("ancestor")).alias("workspace"))
    )
    return located.join(found, ["repo", "folder"], "left").select("repo", "path", "workspace")


def relate(metrics: DataFrame, listing: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Metric rows with ``has_tests_nearby``, ``dependent_count`` and ``workspace``."""
    files = metrics.select("repo", "path")
    names = listing.select("repo", "path")
    facts = (
        nearby_tests(files, names)
        .join(workspace_of(files, workspaces), ["repo", "path"])
        .join(dependents(metrics.select("repo", "path", "import_sources"), files), ["repo", "path"], "left")
    )
    return metrics.join(facts, ["repo", "path"]).withColumn(
        "dependent_count", F.coalesce(F.col("dependent_count"), F.lit(0)).cast("int")
    )


