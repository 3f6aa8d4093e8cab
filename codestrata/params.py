"""Job parameters. Pass an instance to the operators; the defaults are the usual limits."""

from __future__ import annotations

from dataclasses import dataclass, field

from . import fixed


@dataclass(frozen=True)
class Thresholds:
    large_file_lines: int = 300
    large_component_lines: int = 250
    complex_function_lines: int = 60
    max_function_params: int = 5
    max_hooks_in_component: int = 8
    complex_function_complexity: int = 12
    max_responsibilities: int = 4


@dataclass(frozen=True)
class OutputSettings:
    limit: int = 20
    min_priority: str = "medium"

    def __post_init__(self):
        if self.limit < 0:
            raise ValueError("limit must be 0 or more")
        if self.min_priority not in ("high", "medium", "low"):
            raise ValueError("min_priority must be high, medium or low")


@dataclass(frozen=True)
class Params:
    base_path: str = "."
    exclude: tuple[str, ...] = tuple(fixed.DEFAULT_EXCLUDES)
    thresholds: Thresholds = field(default_factory=Thresholds)
    output: OutputSettings = field(default_factory=OutputSettings)
    allow_dirty: bool = True
    max_files_per_task: int = 8
    check_commands: tuple[str, ...] = ()
    auto_detect_checks: bool = True
    state_directory: str = ".codestrata"
