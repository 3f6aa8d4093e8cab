"""Corpus scan: reading files and choosing which of them are analysed."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import paths
from ..params import Params


def read_tree(spark: SparkSession, root: str, repo_depth: int = 1) -> DataFrame:
    """Files below ``root`` as ``repo, path, content``.

    The first ``repo_depth`` folders below the root name the repository. Only
    metadata is listed until a query asks for ``content``; hidden files are
    listed too, because the ignore file is one of them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    return tree_rows(files, qualified(spark, root), repo_depth)


def qualified(spark: SparkSession, root: str) -> str:
    """The root with scheme and authority of its file system, as listings name it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return system.makeQualified(path).toString()


def tree_rows(files: DataFrame, root: str, repo_depth: int = 1) -> DataFrame:
    """Listed ``path, content`` below a qualified root; a path that is not below it is an error."""
    place = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*"  # scheme and authority
    full = F.regexp_replace("path", place, "/")
    below = paths.relative_to(F.lit(re.sub(place, "/", root).rstrip("/")), full)
    outside = F.raise_error(F.concat(F.col("path"), F.lit(" is not below "), F.lit(root)))
    relative = F.split(F.when(below.isNull(), outside.cast("string")).otherwise(below), "/")
    return files.select(
        F.array_join(F.slice(relative, 1, repo_depth), "/").alias("repo"),
        F.array_join(F.slice(relative, F.lit(repo_depth + 1), F.size(relative)), "/").alias("path"),
        F.decode("content", "UTF-8").alias("content"),
    )


def include_pattern(base_path: str = ".", extensions: Iterable[str] = tuple(fixed.SOURCE_EXTENSIONS)) -> str:
    """Path pattern of ``<base>/**/*.{extensions}``; dot files and dot folders do not match."""
    base = base_path.rstrip("/\\").replace("\\", "/")
    head = "" if base in ("", ".") else re.escape(base) + "/"
    return rf"^{head}([^./][^/]*/)*[^./][^/]*\.({'|'.join(extensions)})$"


def exclude_pattern(entries: Iterable[str]) -> str:
    """One pattern for all exclude entries.

    A plain entry hides a folder of that name at any depth; an entry with
    wildcards is a pattern of whole paths from the root.
    """
    plain, globs = [], []
    for entry in entries:
        name = entry.replace("\\", "/")
        if any(sign in name for sign in "*?{"):
            globs.append(path_glob(name.removeprefix("./")))
        else:
            plain.append(re.escape(name.strip("/")))
    parts = [f"(^|/)({'|'.join(plain)})(/|$)"] * bool(plain) + [f"^({'|'.join(globs)})(/|$)"] * bool(globs)
    return "|".join(parts) or "(?!)"


def path_glob(glob: str) -> str:
    """Expression for a path pattern with ``**``, ``*``, ``?`` and ``{a,b}``."""
    kinds = {"**/": "(.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]", "{": "(", "}": ")", ",": "|"}
    out, depth = [], 0
    for token in re.findall(r"\*\*/|\*\*|[*?{},]|[^*?{},]+", glob):
        depth += (token == "{") - (token == "}")
        special = token in kinds and (token != "," or depth > 0) and (token != "}" or depth >= 0)
        out.append(kinds[token] if special else re.escape(token))
    return "".join(out)


def ignore_rules(listing: DataFrame, file_name: str = ".gitignore") -> DataFrame:
    """One row per repository with its ordered ignore rules as patterns."""
    rule_lines = F.filter(
        F.transform(F.split("content", r"\r?\n"), lambda line: F.regexp_replace(line, r"\s+$", "")),
        lambda line: (line != "") & ~line.startswith("#"),
    )
    return listing.filter(F.col("path") == file_name).select(
        "repo", F.transform(rule_lines, _rule).alias("rules")
    )


def settings_files(listing: DataFrame, file_name: str = ".gitignore", manifest: str = "package.json") -> DataFrame:
    """The few files whose text steers a scan: root ignore files and manifests."""
    path = F.col("path")
    return listing.filter((path == file_name) | (paths.base_name(path) == manifest))


def _rule(line: Column) -> Column:
    negated = line.startswith("!")
    body = F.regexp_replace(line, r"^!", "")
    anchored = F.regexp_replace(body, "/$", "").contains("/")
    # Escape, then give the wildcards back their meaning.
    escaped = F.regexp_replace(F.regexp_replace(body, "^/", ""), r"([.+^$(){}|\\])", r"\\$1")
    deep = F.regexp_replace(F.regexp_replace(escaped, r"\*\*/", "\u0001"), r"/\*\*$", "/\u0002")
    whole = F.regexp_replace(deep, r"(^|/)\*+(/|$)", "$1[^/]\u0003$2")
    single = F.regexp_replace(F.regexp_replace(whole, r"\*+", "[^/]*"), r"\?", "[^/]")
    wild = F.replace(F.replace(single, F.lit("\u0001"), F.lit("(.*/)?")), F.lit("\u0002"), F.lit(".+"))
    wild = F.replace(wild, F.lit("\u0003"), F.lit("+"))
    head = F.when(anchored, F.lit("^")).otherwise(F.lit("^(.*/)?"))
    tail = F.when(body.endswith("/"), F.lit("$")).otherwise(F.lit("/?$"))
    return F.struct(F.concat(head, wild, tail).alias("pattern"), negated.alias("negated"))


def is_ignored(path: Column, rules: Column) -> Column:
    """Last matching rule wins for every folder on the way; an ignored folder hides its files."""
    parts = F.split(path, "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.concat(
            F.array_join(F.slice(parts, F.lit(1), n), "/"),
            F.when(n < F.size(parts), F.lit("/")).otherwise(F.lit("")),
        ),
    )
    return F.exists(
        prefixes,
        lambda p: F.aggregate(
            rules,
            F.lit(False),
            lambda acc, rule: F.when(F.regexp_like(p, rule["pattern"]), ~rule["negated"]).otherwise(acc),
        ),
    )


def candidates(listing: DataFrame, params: Params = Params()) -> DataFrame:
    """Included and not excluded rows; a filter on the path, before any content is read."""
    path = F.col("path")
    return listing.filter(
        path.rlike(include_pattern(params.base_path)) & ~path.rlike(exclude_pattern(params.exclude))
    )


def ignored_files(listing: DataFrame, rules: DataFrame, params: Params = Params()) -> DataFrame:
    """``repo, path`` of candidates hidden by the ignore file of their repository; reads paths only."""
    names = candidates(listing.select("repo", "path"), params)
    return names.join(rules, "repo").filter(is_ignored(F.col("path"), F.col("rules"))).select("repo", "path")


def drop_ignored(rows: DataFrame, ignored: DataFrame) -> DataFrame:
    """Rows (results of files, with repo and path) of files that are not ignored."""
    return rows.join(ignored, ["repo", "path"], "left_anti")


def select_sources(listing: DataFrame, params: Params = Params()) -> DataFrame:
    """``repo, path`` of the files that are analysed: included, not excluded, not ignored.

    Contents are measured where they are read: work on ``candidates`` first, then
    drop the ignored files from the narrow result with ``drop_ignored``.
    """
    names = candidates(listing.select("repo", "path"), params)
    return drop_ignored(names, ignored_files(listing, ignore_rules(listing), params))
