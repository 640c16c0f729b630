"""Git repositories: remote, branch and last commit, from the files below .git or the git program."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeview.operators.extract import repo_summary
from lodeview.sources.files import git_configs

READMES = ["README.md", "README.mdx", "README.txt", "README", "readme.md"]
README_CHARS, PACKAGE_CHARS = 32 * 1024, 16 * 1024
SCHEMA = "root_path string, repo_name string, remote_url string, current_branch string, last_commit_at string, readme string, package string"


def _git(root: str, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=20)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() or None if done.returncode == 0 else None


def _text(path: str, chars: int) -> str | None:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read(chars).strip() or None
    except OSError:
        return None


def _remote(root: str) -> str | None:
    found = re.search(r'\[remote "origin"\][^\[]*?\burl\s*=\s*(\S+)', _text(f"{root}/.git/config", 1 << 20) or "")
    return found[1] if found else None


def describe(root: str) -> tuple:
    """One repository's row."""
    branch = _git(root, "branch", "--show-current")
    head = re.fullmatch(r"ref: refs/heads/(\S+)", _text(f"{root}/.git/HEAD", 4096) or "")
    readme = next((t for name in READMES if (t := _text(f"{root}/{name}", README_CHARS))), None)
    return root, os.path.basename(root), _remote(root), branch or (head[1] if head else None), _git(root, "log", "-1", "--format=%cI"), readme, _text(f"{root}/package.json", PACKAGE_CHARS)


def repositories(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """(id, root_path, repo_name, remote_url, current_branch, last_commit_at, metadata_json, summary)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([describe(p) for p in b["root_path"]], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    found = git_configs(spark, roots).select(F.regexp_replace("path", r"/\.git/config$", "").alias("root_path")).distinct().mapInPandas(run, SCHEMA)
    return found.select(
        F.sha1("root_path").alias("id"), "root_path", "repo_name", "remote_url", "current_branch", "last_commit_at", F.lit("{}").alias("metadata_json"),
        repo_summary(F.col("repo_name"), F.col("remote_url"), F.col("readme"), F.col("package")).alias("summary"),
    )
