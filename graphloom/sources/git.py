"""A data source over one commit of a git repository; the working tree is not touched.

    spark.dataSource.register(GitRefSource)
    spark.read.format("gitref").option("ref", "origin/main").load("/path/to/clone")

The clone must be at the same path on every node. Files are dealt out by path, ``slices`` at a
time, and read by the tasks.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphloom.sources.extract import CONFIG, PYTHON, RUST, SCRIPT


def git(root: str, *args: str) -> bytes | None:
    """Standard output of a git command; None if it fails."""
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=120, check=False)
    return done.stdout if done.returncode == 0 else None


def resolve_ref(root: str, preferred: str = "") -> str:
    """``origin/PREFERRED``, else the preferred name itself, else ``origin/HEAD``, else ``HEAD``."""
    for ref in (f"origin/{preferred}", preferred, "origin/HEAD", "HEAD"):
        if ref.strip("/") and not ref.endswith("/") and git(root, "rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}"):
            return ref
    return ""


class GitRefSource(DataSource):
    """``repo, path, text`` of the source files of a commit."""

    @classmethod
    def name(cls) -> str:
        return "gitref"

    def schema(self) -> str:
        return "repo string, path string, text string"

    def reader(self, schema: object) -> DataSourceReader:
        return GitRefReader(dict(self.options))


class GitRefReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.repo = options.get("repo") or PurePosixPath(self.root).name
        self.ref = resolve_ref(self.root, options.get("ref", ""))
        self.slices = int(options.get("slices", 8))

    def partitions(self) -> list[InputPartition]:
        listed = git(self.root, "ls-tree", "-r", "-z", "--name-only", self.ref) or b""
        paths = [p for p in listed.decode("utf-8", "replace").split("\0") if p]
        known = (*PYTHON, *SCRIPT, *RUST, *CONFIG)
        paths = sorted(p for p in paths if PurePosixPath(p).suffix.lower() in known or PurePosixPath(p).name.lower() in known)
        return [InputPartition(paths[i :: self.slices]) for i in range(min(self.slices, max(1, len(paths))))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.value:
            text = git(self.root, "show", f"{self.ref}:{path}")
            if text is not None:
                yield self.repo, path, text.decode("utf-8-sig", "replace")
