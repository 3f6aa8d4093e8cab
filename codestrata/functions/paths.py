"""Path expressions. Paths are relative to the repository root, with ``/`` separators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import bind, lookup, pascal_case, snake_case


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def relative_to(root: Column, path: Column) -> Column:
    """Path below ``root``, or null when it lies elsewhere."""
    prefix = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(path.startswith(prefix), path.substr(F.length(prefix) + 1, F.length(path)))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """Directory part, ``.`` for a file at the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def parent_prefix(path: Column) -> Column:
    """Directory part with a trailing slash, empty for a file at the root."""
    return F.when(path.contains("/"), F.concat(directory(path), F.lit("/"))).otherwise(F.lit(""))


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def file_stem(path: Column) -> Column:
    """File name without its last extension; a leading dot does not start one."""
    return F.regexp_replace(base_name(path), r"^(.+)\.[^.]*$", "$1")


def extension(path: Column) -> Column:
    """Last extension with its dot, empty if there is none."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1)


def language(path: Column) -> Column:
    found = lookup({"." + e: name for e, name in fixed.LANGUAGE_BY_EXTENSION.items()}, extension(path))
    return F.coalesce(found, F.lit("unknown"))


def is_script(path: Column) -> Column:
    return path.rlike(r"\.(ts|tsx|js|jsx)$")


def is_test_file(path: Column) -> Column:
    return (
        path.rlike(r"(^|[/\\])(__tests__|tests?)([/\\])")
        | path.rlike(r"\.(test|spec)\.[jt]sx?$")
        | path.rlike(r"(^|[/\\])test_[^/\\]+\.py$")
        | path.rlike(r"Test\.java$")
    )


def stays_inside(path: Column) -> Column:
    """False for absolute paths and for paths that climb above the root."""
    depths = F.aggregate(
        F.split(path, "/"),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest")),
        lambda acc, part: _step_depth(acc, part),
    )
    return ~path.startswith("/") & (depths["lowest"] >= 0)


def _step_depth(acc: Column, part: Column) -> Column:
    move = F.when(part == "..", F.lit(-1)).when(part.isin("", "."), F.lit(0)).otherwise(F.lit(1))
    depth = acc["depth"] + move
    return F.struct(depth.alias("depth"), F.least(acc["lowest"], depth).alias("lowest"))


def resolve(base_directory: Column, specifier: Column) -> Column:
    """Join a relative module specifier to a directory; null if it leaves the root."""
    joined = F.concat_ws("/", base_directory, specifier)
    parts = F.filter(F.split(joined, "/"), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")
    walked = F.aggregate(
        parts,
        F.struct(empty.alias("kept"), F.lit(True).alias("inside")),
        lambda acc, p: F.when(
            p == "..",
            F.struct(
                F.when(
                    F.size(acc["kept"]) > 0, F.slice(acc["kept"], F.lit(1), F.size(acc["kept"]) - 1)
                ).otherwise(acc["kept"]).alias("kept"),
                (acc["inside"] & (F.size(acc["kept"]) > 0)).alias("inside"),
            ),
        ).otherwise(
            F.struct(F.array_append(acc["kept"], p).alias("kept"), acc["inside"].alias("inside"))
        ),
    )
    return bind(walked, lambda w: F.when(w["inside"], F.array_join(w["kept"], "/")))


def ancestors(folder: Column) -> Column:
    """All non-empty prefixes of a folder path, shortest first."""
    parts = F.split(folder, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )


def likely_test_path(path: Column) -> Column:
    stem, parent = file_stem(path), parent_prefix(path)
    return (
        F.when(path.endswith(".py"), F.concat(parent, F.lit("test_"), stem, F.lit(".py")))
        .when(path.endswith(".java"), F.concat(parent, stem, F.lit("Test.java")))
        .otherwise(F.concat(parent, stem, F.lit(".test"), extension(path)))
    )


def workspace_guess(path: Column) -> Column:
    """``apps/x`` or ``packages/x`` at the start of a path, else null."""
    found = F.regexp_extract(path, "^((?:apps|packages)/[^/]*)", 1)
    return F.nullif(found, F.lit(""))


def _python_helper(path: Column, file_name: Column) -> Column:
    under_src = F.regexp_extract(path, "^((?:.*?/)?src/[^/]+)(?:/|$)", 1)
    return F.when(
        under_src != "", F.concat(under_src, F.lit("/services/"), file_name)
    ).otherwise(F.concat(directory(path), F.lit("/"), file_name))


def _script_helper(path: Column, folder: str, file_name: Column) -> Column:
    root = F.coalesce(F.concat(workspace_guess(path), F.lit("/")), F.lit(""))
    return F.concat(root, F.lit(f"src/{folder}/"), file_name)


def service_path(path: Column) -> Column:
    stem = file_stem(path)
    return (
        F.when(path.endswith(".py"), _python_helper(path, F.concat(stem, F.lit("_service.py"))))
        .when(
            path.endswith(".java"),
            F.concat(directory(path), F.lit("/"), pascal_case(stem), F.lit("Service.java")),
        )
        .otherwise(_script_helper(path, "services", F.concat(stem, F.lit("Service.ts"))))
    )


def shared_helper_path(path: Column, helper: Column) -> Column:
    return (
        F.when(path.endswith(".py"), _python_helper(path, F.concat(snake_case(helper), F.lit(".py"))))
        .when(
            path.endswith(".java"),
            F.concat(directory(path), F.lit("/"), pascal_case(helper), F.lit(".java")),
        )
        .otherwise(_script_helper(path, "lib", F.concat(helper, F.lit(".ts"))))
    )


def folder_prefix_of(lowest: Column, highest: Column) -> Column:
    """Longest common folder of a group, given its least and greatest folder.

    Both carry a trailing slash. The common prefix of a whole group of strings
    is the common prefix of its two extremes, so two cheap aggregates suffice.
    """
    same = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(lowest), F.length(highest)))),
        F.lit(0),
        lambda acc, n: F.when(
            (acc == n - 1) & (lowest.substr(F.lit(1), n) == highest.substr(F.lit(1), n)), n
        ).otherwise(acc),
    )
    head = lowest.substr(F.lit(1), same)
    return F.when(head.contains("/"), F.regexp_replace(head, "/[^/]*$", "")).otherwise(F.lit(""))


def grouped_helper_path(language_name: Column, workspace: Column, common: Column, helper: Column) -> Column:
    """Helper location for a group of files: shared workspace, else common folder."""
    is_python, is_java = language_name == "python", language_name == "java"
    file_name = (
        F.when(is_python, F.concat(snake_case(helper), F.lit(".py")))
        .when(is_java, F.concat(pascal_case(helper), F.lit(".java")))
        .when(language_name == "javascript", F.concat(helper, F.lit(".js")))
        .otherwise(F.concat(helper, F.lit(".ts")))
    )
    folder = F.when(is_python, F.lit("services")).otherwise(F.lit("lib"))
    return F.when(
        workspace.isNotNull(), F.concat(workspace, F.lit("/src/"), folder, F.lit("/"), file_name)
    ).otherwise(
        F.concat(F.when(common == "", F.lit("src")).otherwise(common), F.lit("/"), file_name)
    )
