"""The scan as one composed job: files to ranked opportunities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import duplicates, outputs, ranking, relations, rules, runs
from ..operators.analysis import file_metrics
from ..params import Params
from ..sources import manifests as project_sources
from ..sources.files import candidates, drop_ignored, ignore_rules, ignored_files, settings_files
from ..sources.stores import (
    append_batch, materialize, read_table, settings_table, write_brief_lines, write_scan, write_settings,
)


@dataclass
class Scan:
    listing: DataFrame
    files: DataFrame
    workspaces: DataFrame
    manifests: DataFrame
    project: DataFrame
    groups: DataFrame
    members: DataFrame
    ranked: DataFrame
    files_of: DataFrame
    params: Params


@dataclass
class Corpus:
    """A corpus with the small tables that steer its scan.

    File contents are read twice in all: once for the settings files (a small
    result) and once for the metrics. Everything else reads paths.
    """

    listing: DataFrame
    names: DataFrame
    settings: DataFrame
    manifests: DataFrame
    workspaces: DataFrame


def prepare(listing: DataFrame) -> Corpus:
    names = listing.select("repo", "path")
    settings = materialize(settings_files(listing), "settings")
    manifests = project_sources.parse_manifests(settings)
    workspaces = project_sources.workspaces(names, manifests)
    return Corpus(listing, names, settings, manifests, workspaces)


def analysed_files(corpus: Corpus, params: Params = Params()) -> DataFrame:
    """Metric rows with their relations.

    Metrics are stored first, because the relations read them more than once.
    """
    metrics = materialize(selected_metrics(corpus, params), "metrics")
    return relations.relate(metrics, corpus.names, corpus.workspaces)


def selected_metrics(corpus: Corpus, params: Params = Params()) -> DataFrame:
    """Metrics of the files that are not ignored; contents are never shuffled.

    Candidates are measured where they are read; which of them are ignored is
    decided on their paths, and their narrow rows are dropped.
    """
    ignored = ignored_files(corpus.names, ignore_rules(corpus.settings), params)
    return drop_ignored(file_metrics(candidates(corpus.listing, params), params), ignored)


def scan(listing: DataFrame, params: Params = Params()) -> Scan:
    corpus = prepare(listing)
    files = materialize(analysed_files(corpus, params), "files")
    groups = materialize(duplicates.duplicate_groups(files), "groups")
    drafts = rules.file_drafts(files, params).unionByName(rules.duplicate_drafts(groups))
    ranked = materialize(ranking.ranked_opportunities(rules.score(drafts)), "ranked")
    members = duplicates.duplicate_members(files, groups)
    return Scan(
        listing=listing,
        files=files,
        workspaces=corpus.workspaces,
        manifests=corpus.manifests,
        project=project_sources.projects(corpus.names, files, corpus.manifests, corpus.workspaces),
        groups=groups,
        members=members,
        ranked=ranked,
        files_of=outputs.opportunity_files(ranked, members),
        params=params,
    )


def write_outputs(result: Scan, store: str, scan_id: str) -> None:
    """Write the complete scan, its output settings, and briefs for the limited part of it."""
    write_settings(settings_table(result.files, result.params.output), store, scan_id)
    write_scan(result.files, store, "files", scan_id)
    write_scan(result.ranked, store, "opportunities", scan_id)
    write_scan(result.files_of, store, "opportunity_files", scan_id)
    chosen = outputs.limited(result.ranked, result.params.output)
    lines = outputs.brief_lines(
        chosen, result.files_of, result.members, result.files, result.workspaces, result.project
    )
    write_brief_lines(lines, store, scan_id)


def write_task_brief(result: Scan, wanted: DataFrame, store: str, scan_id: str) -> DataFrame:
    """Write the briefs of the tasks named by ``wanted(repo, ref)`` beside the others and return the tasks."""
    found = outputs.find_tasks(result.ranked, wanted)
    lines = outputs.brief_lines(found, result.files_of, result.members, result.files, result.workspaces, result.project)
    write_brief_lines(lines, store, scan_id, replace=False)
    return found


def begin_runs(result: Scan, chosen: DataFrame, changed: DataFrame, store: str) -> tuple[DataFrame, DataFrame]:
    """Start runs for ``chosen(repo, id, run_id)``: rows stored together, and rejected ones.

    A run is its first version, the state of its target files, its brief and the commands
    that check it.
    """
    started, targets, rejected = runs.begin(result.ranked, result.files_of, result.files, chosen, changed, result.params)
    accepted = materialize(chosen.join(rejected.select("repo", "id"), ["repo", "id"], "left_anti"), "accepted")
    tasks = result.ranked.join(accepted, ["repo", "id"], "left_semi")
    files_of = result.files_of.join(accepted, ["repo", "id"], "left_semi")
    briefs = outputs.brief_lines(tasks, files_of, result.members, result.files, result.workspaces, result.project)
    commands = project_sources.check_commands(
        files_of, result.files, result.project, result.manifests, result.workspaces, result.params
    ).select("repo", "id", "command", "spot.*")
    append_batch(
        {
            "runs": started,
            "targets": targets,
            "run_briefs": briefs.join(accepted, ["repo", "id"]),
            "run_commands": commands.join(accepted, ["repo", "id"]),
        },
        store,
    )
    return read_table(result.listing.sparkSession, store, "targets"), rejected
