"""Path globs as regular expressions."""

from __future__ import annotations

import re


def glob_regex(glob: str) -> str:
    """A Java and Python pattern for a whole relative path, in either case: ``**`` is any folders, ``*`` stays within one."""
    parts = glob.replace("\\", "/").removeprefix("./").split("/")
    if parts[-1] == "":
        parts[-1] = "**"
    out = ""
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:[^/]+/)*"
        else:
            out += "[^/]*".join(re.escape(x) for x in part.split("*")) + ("" if last else "/")
    return f"(?i)^{out}$"


def folder_of(glob: str) -> str:
    """The folder, in lower case and without a closing slash, that all paths of a glob are below; empty where it begins with a wildcard."""
    parts = glob.replace("\\", "/").removeprefix("./").split("/")[:-1]
    plain = next((i for i, p in enumerate(parts) if "*" in p), len(parts))
    return "/".join(parts[:plain]).lower()


def selects(path: str, include: list[str], exclude: list[str]) -> bool:
    hit = lambda globs: any(re.match(glob_regex(g), path) for g in globs)
    return hit(include) and not hit(exclude)
