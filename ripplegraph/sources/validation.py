"""Checks of small settings before anything runs: flags, runner descriptions, places to write to.

They look at what a person wrote into one configuration, on the driver; each gives the reason
for a refusal, or None.
"""

from __future__ import annotations

import os
import re
from pathlib import PurePosixPath

# Flags that the runs set themselves.
END_TO_END_FLAGS = ["--grep", "-g", "--grep-invert", "--reporter", "--config", "-c"]
NAME_FLAGS = ["-t", "--t", "--testNamePattern", "--test-name-pattern"]
END_TO_END_RUNNERS = ["playwright"]
RUNNER_FIELDS = ["select", "tag", "results"]
OPTIONAL_RUNNER_FIELDS = ["artifacts", "adapter"]


def owned_flag(arguments: list[str], flags: list[str] | None = None, letters: str = "gc") -> str | None:
    """The first argument that sets what the run sets itself, spelled out or in a cluster of letters."""
    flags = END_TO_END_FLAGS if flags is None else flags
    clustered = re.compile(rf"-[A-Za-z]*[{letters}]")
    return next((a for a in arguments if a.partition("=")[0] in flags or (not a.startswith("--") and clustered.match(a))), None)


def name_flag(arguments: list[str]) -> str | None:
    """The first argument that filters tests by name."""
    clustered = re.compile(r"-(?=[A-Za-z]*t)[A-Za-z]{2,}")
    return next((a for a in arguments if a.partition("=")[0] in NAME_FLAGS or clustered.fullmatch(a.partition("=")[0])), None)


def revision_problem(revision: str) -> str | None:
    """A revision that begins with a dash would be read as an option."""
    return f"a revision may not begin with '-': {revision!r}" if str(revision).startswith("-") else None


def _leaves(root: str, *below: str) -> bool:
    top = os.path.realpath(root)
    return os.path.commonpath([top, os.path.realpath(os.path.join(root, *below))]) != top


def end_to_end_problem(repo: str, setting) -> str | None:
    """Why the description of the end-to-end runner is refused: its shape, its runner, or a folder or
    configuration that is not there or lies outside the repository."""
    if not isinstance(setting, dict):
        return "not an object with runner and cwd"
    if setting.get("runner") not in END_TO_END_RUNNERS:
        return f"runner is none of {END_TO_END_RUNNERS}"
    relative = lambda v: isinstance(v, str) and v != "" and not PurePosixPath(v).is_absolute()
    cwd, config = setting.get("cwd"), setting.get("config")
    if not relative(cwd):
        return "cwd is no path relative to the repository"
    if _leaves(repo, cwd):
        return "cwd lies outside the repository"
    if not os.path.isdir(os.path.join(repo, cwd)):
        return "cwd does not exist"
    if config is None:
        return None
    if not relative(config) or config.startswith("-"):
        return "config is no path relative to cwd"
    return "config lies outside the repository" if _leaves(repo, cwd, config) else None


def target_problem(path: str) -> str | None:
    """Why a trace cannot be written to a path: it goes beside it first and is moved into place."""
    name = os.path.basename(path)
    if name in ("", ".", "..") or os.path.isdir(path):
        return "a directory"
    folder = os.path.realpath(os.path.dirname(os.path.abspath(path)))
    device = f"{folder}/".startswith(("/dev/", "/proc/")) and not f"{folder}/".startswith("/dev/shm/")
    if device or (os.path.exists(path) and not os.path.isfile(path)):
        return "no regular file"
    if not os.path.isdir(folder):
        return "its directory does not exist"
    return None if os.access(folder, os.W_OK) else "its directory cannot be written to"


def runner_specs(settings) -> tuple[dict[str, dict], list[str]]:
    """The runners that are described well, and what is wrong with each of the others."""
    if not isinstance(settings, dict):
        return {}, ["not a mapping of runners"]
    good, wrong = {}, []
    known = [*RUNNER_FIELDS, *OPTIONAL_RUNNER_FIELDS]
    for name, spec in settings.items():
        if not isinstance(spec, dict):
            problem = "not a mapping"
        elif missing := [f for f in RUNNER_FIELDS if not spec.get(f)]:
            problem = "lacks " + ", ".join(missing)
        elif odd := [f for f in known if f in spec and not isinstance(spec[f], str)]:
            problem = "no text: " + ", ".join(odd)
        elif spec["tag"].count("{}") != 1:
            problem = "tag needs one {}"
        else:
            good[name] = {f: spec[f] for f in known if f in spec}
            continue
        wrong.append(f"{name}: {problem}")
    return good, wrong


def registry_folders(setting: str | None, repo: str | None, subfolder: str, fallback: str | None = None) -> list[str]:
    """Where a registry may lie, the most particular place first."""
    own = os.path.join(repo, subfolder) if repo else None
    return [folder for folder in (setting, own, fallback) if folder]


def project_name(repo: str) -> str:
    """The folder's name, or its parent's where that holds a bare clone with worktrees."""
    path = os.path.abspath(repo)
    above = os.path.dirname(path)
    return os.path.basename(above if os.path.isdir(os.path.join(above, ".bare")) else path)


def not_found(repo: str, folders: list[str]) -> str:
    name = project_name(repo)
    return f"no registry has the target {name!r}; looked in " + ", ".join(map(os.path.normpath, folders))
