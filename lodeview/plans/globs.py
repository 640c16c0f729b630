"""Path globs as regular expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a scan leaves out unless told otherwise.
DEFAULT_EXCLUDES = [
    "**/node_modules/**", "**/.git/**", "**/.pgdata/**", "**/.cache/**", "**/Library/**", "**/__pycache__/**", "**/.venv/**", "**/venv/**", "**/vendor/**", "**/dist/**", "**/build/**",
    "**/.next/**", "**/coverage/**",
]
REPO_EXCLUDES = ["**/node_modules/**", "**/.pgdata/**", "**/.cache/**"]


def to_regex(glob: str) -> str:
    """``**/`` is any folders, ``**`` anything, ``*`` and ``?`` within a name."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return f"^{out}$"


def union(*lists: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(g for one in lists for g in one))


def excluded(path: Column, globs: Iterable[str] = DEFAULT_EXCLUDES) -> Column:
    patterns = [to_regex(g) for g in globs]
    return path.rlike("|".join(patterns)) if patterns else F.lit(False)
