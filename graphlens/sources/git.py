"""Files of a git revision as a Spark data source, without a checkout.

    spark.dataSource.register(GitSource)
    spark.read.format("graphlens_git").option("repo", path).option("ref", "HEAD").load()
"""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_REF = re.compile(r"[A-Za-z0-9_./@^~{}+=-]+")
_SHA = re.compile(r"[0-9a-f]{40}|[0-9a-f]{64}")
#: Blobs of one partition, read by one git process.
CHUNK = 200


def valid_ref(ref: str) -> bool:
    """Whether a ref can't be taken for an option, a path outside or a range."""
    return bool(_REF.fullmatch(ref)) and not ref.startswith("-") and ".." not in ref and len(ref) <= 255


def _git(repo: str, *args: str) -> list[str]:
    return ["git", "-C", repo, *args]


def _env() -> dict[str, str]:
    """The environment without git's own variables, which could point elsewhere."""
    return {k: v for k, v in os.environ.items() if not k.startswith("GIT_")}


def parse_tree(raw: bytes) -> list[tuple[str, str]]:
    """(path, blob) of ``ls-tree -z`` output; other objects and undecodable names are left out."""
    out = []
    for entry in raw.split(b"\0"):
        meta, tab, name = entry.partition(b"\t")
        parts = meta.split()
        if not tab or len(parts) < 3 or parts[1] != b"blob":
            continue
        try:
            out.append((name.decode("utf-8"), parts[2].decode("ascii")))
        except UnicodeDecodeError:
            continue
    return out


def list_tree(repo: str, ref: str) -> list[tuple[str, str]]:
    if not valid_ref(ref):
        raise ValueError(f"not a ref: {ref!r}")
    return parse_tree(subprocess.run(_git(repo, "ls-tree", "-r", "-z", "--full-tree", "--end-of-options", ref), check=True, capture_output=True, env=_env()).stdout)


def revision(repo: str, ref: str) -> str:
    """The commit of a ref."""
    if not valid_ref(ref):
        raise ValueError(f"not a ref: {ref!r}")
    return subprocess.run(_git(repo, "rev-parse", "--verify", "--end-of-options", f"{ref}^{{commit}}"), check=True, capture_output=True, text=True, env=_env()).stdout.strip()


def toplevel(repo: str) -> str:
    """The root folder of a working tree."""
    return subprocess.run(_git(repo, "rev-parse", "--show-toplevel"), check=True, capture_output=True, text=True, env=_env()).stdout.strip()


def subdirectory(repo: str) -> str:
    """A folder's place below its working tree, empty for the root."""
    below = os.path.relpath(os.path.realpath(repo), os.path.realpath(toplevel(repo)))
    return "" if below == "." else below


def tracked_files(folder: str) -> int:
    """How many files below ``folder`` git tracks; 0 outside a repository."""
    got = subprocess.run(_git(folder, "ls-files", "-z", "--", "."), capture_output=True, env=_env())
    return got.stdout.count(b"\0") if got.returncode == 0 else 0


def snapshot_id(repo: str, ref: str) -> str:
    """The commit of a ref, with eight hex digits of the subdirectory's hash if ``repo`` is one."""
    below = subdirectory(repo)
    return revision(repo, ref) + (f"-{hashlib.sha1(below.encode()).hexdigest()[:8]}" if below else "")


def read_blobs(repo: str, shas: list[str]) -> Iterator[bytes]:
    """Contents in order, from one ``cat-file`` process."""
    if bad := [s for s in shas if not _SHA.fullmatch(s)]:
        raise ValueError(f"not a blob: {bad[0]!r}")
    p = subprocess.Popen(_git(repo, "cat-file", "--batch"), stdin=subprocess.PIPE, stdout=subprocess.PIPE, env=_env())
    try:
        for s in shas:
            p.stdin.write(s.encode() + b"\n")
            p.stdin.flush()
            head = p.stdout.readline().split()
            if len(head) < 3:
                raise RuntimeError(f"blob {s} is missing")
            content = p.stdout.read(int(head[2]))
            p.stdout.read(1)
            yield content
    finally:
        p.stdin.close()
        p.stdout.close()
        p.wait()


class _Chunk(InputPartition):
    def __init__(self, entries: list[tuple[str, str]]):
        self.entries = entries


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.ref, self.prefix = options["repo"], options.get("ref", "HEAD"), options.get("prefix", "")
        self.chunk = int(options.get("chunk", CHUNK))

    def partitions(self) -> list[_Chunk]:
        files = sorted(x for x in list_tree(self.repo, self.ref) if x[0].startswith(self.prefix))
        return [_Chunk(files[k : k + self.chunk]) for k in range(0, len(files), self.chunk)] or [_Chunk([])]

    def read(self, partition: _Chunk) -> Iterator[tuple]:
        if partition.entries:
            for (path, sha), content in zip(partition.entries, read_blobs(self.repo, [s for _, s in partition.entries])):
                yield path, sha, content


class GitSource(DataSource):
    """Options: repo, ref (HEAD), prefix (a plain prefix of paths), chunk."""

    @classmethod
    def name(cls) -> str:
        return "graphlens_git"

    def schema(self) -> str:
        return "path string, blob_sha string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
