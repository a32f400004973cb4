"""Source trees on any file system that Spark reads."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parsing import scan_filter


def links(root: str) -> list[str]:
    """Paths below a local folder that are symbolic links, relative to it."""
    out = []
    for at, folders, names in os.walk(root):
        out += [os.path.relpath(os.path.join(at, n), root) for n in (*folders, *names) if os.path.islink(os.path.join(at, n))]
    return sorted(out)


def walk_safe(root: str) -> list[str]:
    """Everything below a local folder in pre-order; an error if any of it is a symbolic link."""
    if found := links(root) or ([root] if os.path.islink(root) else []):
        raise ValueError(f"{found[0]} is a link and is not followed")
    out = []
    for at, folders, names in os.walk(root):
        folders.sort()
        out += [os.path.join(at, n) for n in sorted((*folders, *names))]
    return out


def files(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), include_generated: bool = False) -> DataFrame:
    """``path, lang, content`` below ``root``; paths are relative to it.

    Only names are listed until a file passes the filters on its path.  Links
    are not followed.  A root that is a file is read whatever its suffix says of
    how it came about.
    """
    local = root.removeprefix("file://")
    single = "://" not in root.replace("file://", "") and os.path.isfile(local)
    folder = os.path.dirname(local) if single else root
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{rs,py,dart}").load(root)
    base = folder.rstrip("/").split("://")[-1]
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:(?://)?", ""), f"^/*{re.escape(base.lstrip('/'))}/", "")
    found = raw.select(rel.alias("path"), "content")
    if os.path.isdir(local) and (skip := links(local)):
        parts = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))
        found = found.where(~F.arrays_overlap(parts, F.array(*(F.lit(x) for x in skip))))
    return scan_filter(found, exclude, include_generated or single)


def walk(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), include_generated: bool = False) -> DataFrame:
    """``lang, path`` of the files that a scan would read, by path."""
    return files(spark, root, exclude, include_generated).select("lang", "path").orderBy("path")
