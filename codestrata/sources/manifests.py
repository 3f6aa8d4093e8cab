"""Project facts from manifests, lock files and workspaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import paths
from ..params import Params

MANIFEST = "package.json"
_MAP = "map<string,string>"
_LIST_FORM = f"name string, dependencies {_MAP}, devDependencies {_MAP}, workspaces array<string>, scripts {_MAP}"
_OBJECT_FORM = "workspaces struct<packages:array<string>>"


def parse_manifests(listing: DataFrame) -> DataFrame:
    """Parsed manifests; malformed text gives empty maps and no workspaces."""
    content = F.col("content")
    as_list = F.from_json(content, _LIST_FORM, {"mode": "PERMISSIVE"})
    as_object = F.from_json(content, _OBJECT_FORM, {"mode": "PERMISSIVE"})
    valid = F.coalesce(F.try_parse_json(content).isNotNull(), F.lit(False))
    empty = F.create_map().cast(_MAP)
    part = lambda c: F.when(F.col("valid"), c)
    return (
        listing.filter(paths.base_name(F.col("path")) == MANIFEST)
        .select("repo", "path", as_list.alias("m"), as_object.alias("o"), valid.alias("valid"))
        .select(
            "repo",
            "path",
            paths.directory(F.col("path")).alias("root_path"),
            part(F.col("m.name")).alias("name"),
            F.coalesce(part(F.col("m.dependencies")), empty).alias("dependencies"),
            F.coalesce(part(F.col("m.devDependencies")), empty).alias("dev_dependencies"),
            F.coalesce(
                part(F.col("m.workspaces")), part(F.col("o.workspaces.packages")), F.array().cast("array<string>")
            ).alias("workspaces"),
            F.coalesce(part(F.col("m.scripts")), empty).alias("scripts"),
        )
    )


def _any_of(used: Column, names: list[str]) -> Column:
    return F.arrays_overlap(used, F.array(*[F.lit(n) for n in names]))


def framework(used: Column, has_app_file: Column) -> Column:
    """Framework by the names of the dependencies (an array)."""
    chain = None
    for names, label in fixed.FRAMEWORK_DEPENDENCIES:
        hit = _any_of(used, names)
        if chain is None:
            chain = F.when(hit | has_app_file, label)
        else:
            chain = chain.when(hit, label)
    return chain.otherwise("unknown")


def test_framework(used: Column) -> Column:
    chain = None
    for names, label in fixed.TEST_DEPENDENCIES:
        hit = _any_of(used, names)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain.otherwise("unknown")


def package_managers(listing: DataFrame) -> DataFrame:
    """``repo, package_manager`` by the first lock file present at the root."""
    locks = [name for name, _ in fixed.LOCK_FILES]
    rank = F.array_position(F.array(*[F.lit(n) for n in locks]), F.col("path"))
    names = F.array(*[F.lit(m) for _, m in fixed.LOCK_FILES])
    return (
        listing.filter(F.col("path").isin(locks))
        .groupBy("repo")
        .agg(F.get(names, (F.min(rank) - 1).cast("int")).alias("package_manager"))
    )


def glob_pattern(glob: Column) -> Column:
    """Regular expression for the manifests of a workspace glob, without its ``!``.

    ``*`` and ``?`` stay in a folder, ``**/`` is any number of folders, none included,
    ``{a,b}`` is one of its items.
    """
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(glob, "^!", ""), r"^\./", ""), "/$", "")
    escaped = F.regexp_replace(F.concat(bare, F.lit(f"/{MANIFEST}")), r"([.+^$()|\\])", r"\\$1")
    for sign, by in (("**/", "\u0001"), ("**", "\u0002"), ("*", "[^/]*"), ("?", "[^/]")):
        escaped = F.replace(escaped, F.lit(sign), F.lit(by))
    listed = escaped
    for sign, by in (("{", "(?:"), ("}", ")"), (",", "|")):
        listed = F.replace(listed, F.lit(sign), F.lit(by))
    plain = F.regexp_replace(escaped, "([{}])", r"\\$1")
    braced = F.when(escaped.rlike(r"\{[^{}]*,[^{}]*\}"), listed).otherwise(plain)
    whole = F.replace(F.replace(braced, F.lit("\u0001"), F.lit("(?:[^/]+/)*")), F.lit("\u0002"), F.lit(".*"))
    return F.concat(F.lit("^"), whole, F.lit("$"))


def workspaces(listing: DataFrame, manifests: DataFrame) -> DataFrame:
    """Workspaces: manifests in folders that match a glob of the root manifest, and none that starts with ``!``.

    The globs of a repository are one array on one row, so each manifest meets
    exactly one row of its repository.
    """
    negated = lambda g: g.startswith("!")
    globs = manifests.filter((F.col("path") == MANIFEST) & (F.size("workspaces") > 0)).select(
        "repo",
        F.transform(F.filter("workspaces", lambda g: ~negated(g)), glob_pattern).alias("globs"),
        F.transform(F.filter("workspaces", negated), glob_pattern).alias("barred"),
    )
    app_files = listing.filter(paths.base_name(F.col("path")) == "app.json").select(
        "repo", paths.directory(F.col("path")).alias("root_path"), F.lit(True).alias("app_file")
    )
    hidden = r"(^|/)\.|^node_modules/|^\.git/"
    inner = manifests.filter((F.col("path") != MANIFEST) & ~F.col("path").rlike(hidden))
    return (
        inner.join(globs, "repo")
        .filter(F.exists("globs", lambda g: F.regexp_like("path", g)) & ~F.exists("barred", lambda g: F.regexp_like("path", g)))
        .join(app_files, ["repo", "root_path"], "left")
        .select(
            "repo",
            "root_path",
            "name",
            framework(
                F.concat(F.map_keys("dependencies"), F.map_keys("dev_dependencies")),
                F.coalesce(F.col("app_file"), F.lit(False)),
            ).alias("framework"),
            "dependencies",
            "dev_dependencies",
            "scripts",
        )
    )


def projects(listing: DataFrame, files: DataFrame, manifests: DataFrame, found: DataFrame) -> DataFrame:
    """One row per repository: manager, frameworks, languages, number of workspaces."""
    repos = listing.groupBy("repo").agg(
        F.max(F.col("path") == "app.json").alias("app_file"),
        F.max(F.col("path") == MANIFEST).alias("has_manifest"),
    )
    root = manifests.filter(F.col("path") == MANIFEST)
    # Only the names of dependencies decide the frameworks; names known to a rule
    # are few, so the set per repository is small whatever the manifests hold.
    known = [n for names, _ in fixed.FRAMEWORK_DEPENDENCIES + fixed.TEST_DEPENDENCIES for n in names]
    used = (
        root.select("repo", "dependencies", "dev_dependencies")
        .unionByName(found.select("repo", "dependencies", "dev_dependencies"))
        .select("repo", F.explode(F.concat(F.map_keys("dependencies"), F.map_keys("dev_dependencies"))).alias("name"))
        .filter(F.col("name").isin(known))
        .groupBy("repo")
        .agg(F.collect_set("name").alias("names"))
    )
    spaces = found.groupBy("repo").agg(F.count("*").alias("workspace_count"))
    languages = (
        files.select("repo", paths.language(F.col("path")).alias("language"))
        .filter(F.col("language") != "unknown")
        .groupBy("repo")
        .agg(F.array_sort(F.collect_set("language")).alias("languages"))
    )
    names = F.coalesce(F.col("names"), F.array().cast("array<string>"))
    return (
        repos.join(package_managers(listing), "repo", "left")
        .join(used, "repo", "left")
        .join(spaces, "repo", "left")
        .join(languages, "repo", "left")
        .select(
            "repo",
            "has_manifest",
            "package_manager",
            framework(names, F.col("app_file")).alias("framework"),
            test_framework(names).alias("test_framework"),
            F.coalesce(F.col("languages"), F.array().cast("array<string>")).alias("languages"),
            F.coalesce(F.col("workspace_count"), F.lit(0)).alias("workspace_count"),
        )
    )


def dependency_table(manifests: DataFrame, found: DataFrame) -> DataFrame:
    """``repo, name, version`` after merging root, root dev, then workspaces in path order."""
    entries = lambda df, place: df.select(
        "repo",
        F.col("root_path").alias("place_path"),
        F.inline(
            F.flatten(
                F.array(
                    *[
                        F.transform(
                            F.map_entries(c),
                            lambda e, o=order: F.struct(
                                F.lit(place + o).alias("place"), e["key"].alias("name"), e["value"].alias("version")
                            ),
                        )
                        for order, c in enumerate(["dependencies", "dev_dependencies"])
                    ]
                )
            )
        ),
    )
    root = entries(manifests.filter(F.col("path") == MANIFEST), 0).withColumn("place_path", F.lit(""))
    spaces = entries(found, 0)
    return (
        root.unionByName(spaces)
        .groupBy("repo", "name")
        .agg(F.max_by("version", F.struct("place_path", "place")).alias("version"))
    )


def _script_commands(scripts: Column, command) -> Column:
    wanted = F.array(*[F.lit(s) for s in fixed.CHECK_SCRIPTS])
    return F.transform(F.filter(wanted, lambda s: F.array_contains(F.map_keys(scripts), s)), command)


def check_commands(opportunity_files: DataFrame, files: DataFrame, project: DataFrame, manifests: DataFrame,
                   found: DataFrame, params: Params = Params()) -> DataFrame:
    """``repo, id, ord, command``: configured, then workspace, then root commands, without repeats."""
    configured = [c.strip() for c in params.check_commands if c.strip()]
    tasks = opportunity_files.select("repo", "id").distinct()
    fixed_rows = tasks.select(
        "repo", "id",
        F.posexplode(F.array(*[F.lit(c) for c in configured]).cast("array<string>")).alias("step", "command"),
    ).select("repo", "id", F.lit(0).alias("source"), F.lit("").alias("place"), "step", "command")
    root = manifests.filter(F.col("path") == MANIFEST).join(project.select("repo", "package_manager"), "repo")
    manager = F.coalesce(F.col("package_manager"), F.lit("npm"))
    prefix = F.coalesce(
        *[F.when(manager == name, F.lit(text)) for name, text in fixed.SCRIPT_COMMANDS.items()], F.lit("npm run ")
    )
    root_rows = root.select(
        "repo", F.posexplode(_script_commands(F.col("scripts"), lambda s: F.concat(prefix, s))).alias("step", "command")
    )
    target = F.coalesce(F.col("name"), F.col("root_path"))
    space_rows = found.select(
        "repo",
        "root_path",
        F.posexplode(
            _script_commands(
                F.col("scripts"), lambda s: F.concat(F.lit("npm --workspace "), target, F.lit(" run "), s)
            )
        ).alias("step", "command"),
    )
    # Workspaces keep the order in which the files of a task first touch them.
    touched = (
        opportunity_files.join(files.select("repo", "path", "workspace"), ["repo", "path"])
        .filter(F.col("workspace").isNotNull())
        .groupBy("repo", "id", F.col("workspace").alias("root_path"))
        .agg(F.min("path").alias("place"))
    )
    # Workspace and root commands exist only where the root manifest does.
    with_root = root.select("repo")
    of_spaces = (
        touched.join(space_rows, ["repo", "root_path"])
        .join(with_root, "repo", "left_semi")
        .select("repo", "id", F.lit(1).alias("source"), "place", "step", "command")
    )
    of_root = tasks.join(root_rows, "repo").select(
        "repo", "id", F.lit(2).alias("source"), F.lit("").alias("place"), "step", "command"
    )
    rows = fixed_rows
    if params.auto_detect_checks:
        rows = rows.unionByName(of_spaces).unionByName(of_root)
    return rows.groupBy("repo", "id", "command").agg(F.min(F.struct("source", "place", "step")).alias("spot"))
