"""The store on shared storage: parsed units, bundles of documents, their upkeep.

``root``/units/version=V holds parsed rows by path and blob, ``root``/bundles/ID
a snapshot's documents, ``root``/snapshots its catalogs.  Every write is a folder
that the file system's commit protocol makes whole or absent.
"""

from __future__ import annotations

import os
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from . import catalog

#: Stamp of the parser's rows; units of another one are as if they were missing.
VERSION = 2
#: Parts of a bundle; a changed document rewrites one of them.
BUCKETS = 64


@dataclass
class Policy:
    """When the store cleans itself up after a write."""

    most_bytes: int = 1 << 30
    most_seconds: int = 30 * 86400

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Policy | None:
        """From GRAPHLENS_AUTO_GC (0 switches it off), _MAX_BYTES and _MAX_AGE_SECS; other values count for nothing."""
        env = dict(os.environ) if env is None else env
        if env.get("GRAPHLENS_AUTO_GC") == "0":
            return None
        number = lambda key, other: int(env[key]) if env.get(key, "").isdecimal() else other
        return cls(number("GRAPHLENS_AUTO_GC_MAX_BYTES", cls.most_bytes), number("GRAPHLENS_AUTO_GC_MAX_AGE_SECS", cls.most_seconds))


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _has(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    # -- parsed units -----------------------------------------------------
    def units(self) -> DataFrame | None:
        """Parsed rows with ``blob_sha``; None if there are none or they can't be read."""
        at = f"{self.root}/units/version={VERSION}"
        try:
            return self.spark.read.parquet(at).drop("batch") if self._has(f"units/version={VERSION}") else None
        except Exception:  # noqa: BLE001
            return None  # any damage is a miss

    def put_units(self, rows: DataFrame, files: DataFrame) -> None:
        """Keep the rows of ``files`` (path, blob_sha) as a batch of its own."""
        kept = rows.join(files.select(F.col("path").alias("file_path"), "blob_sha"), "file_path")
        kept.write.parquet(f"{self.root}/units/version={VERSION}/batch={uuid.uuid4().hex}")

    # -- bundles ----------------------------------------------------------
    def bundle(self, name: str) -> DataFrame | None:
        """``path, content`` of a bundle's documents."""
        at = f"bundles/{name}"
        return self.spark.read.schema("path string, content string, bucket int").parquet(f"{self.root}/{at}").select("path", "content") if self._has(at) else None

    def put_bundle(self, name: str, documents: DataFrame, allow_empty: bool = False) -> dict[str, int]:
        """Bring a bundle to ``documents`` (path, content): counts of written, pruned and kept.

        Only parts with a document that is new, differs or is gone are written;
        an index that differs in nothing but its time keeps the old one.  No
        documents never replace some, unless that is allowed.
        """
        new = cut(documents.select("path", "content"))
        have = self.bundle(name)
        old = cut(have if have is not None else new.limit(0))
        if new.isEmpty() and not allow_empty and not old.isEmpty():
            return {"written": 0, "pruned": 0, "kept": old.count()}
        still = F.regexp_replace("content", r'("generated_at": ?)"[^"]*"', "$1")
        keyed = lambda df: df.select(F.col("path").alias("key"), F.sha2(F.when(F.col("path") == "index.json", still).otherwise(F.col("content")), 256).alias("hash"))
        changed = cut(catalog.changed_entries(keyed(new), keyed(old)).select("key"))
        gone = cut(catalog.orphans(keyed(old), keyed(new)))
        bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
        touched = [r[0] for r in changed.unionByName(gone).select(bucket("key")).distinct().collect()]
        counts = {"written": changed.count(), "pruned": gone.count()}
        if touched:
            mine = new.withColumn("bucket", bucket("path")).where(F.col("bucket").isin(*touched))
            before = old.join(changed.withColumnRenamed("key", "path"), "path", "left_anti").select("path", F.col("content").alias("same"))
            mine = mine.join(before, "path", "left").select("path", F.coalesce("same", "content").alias("content"), "bucket")
            mine.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.root}/bundles/{name}")
            left = {r[0] for r in mine.select("bucket").distinct().collect()}
            for b in set(touched) - left:
                self._fs.delete(self._path(f"{self.root}/bundles/{name}/bucket={b}"), True)
        return {**counts, "kept": new.count() - counts["written"]}

    # -- upkeep -----------------------------------------------------------
    def entries(self) -> DataFrame:
        """``key, size, mtime``: what can be evicted, one entry a batch, bundle or snapshot."""
        out = []
        for parent in [f"units/version={VERSION}", "bundles", "snapshots"]:
            if not self._has(parent):
                continue
            for x in self._fs.listStatus(self._path(f"{self.root}/{parent}")):
                if x.isDirectory() and not x.getPath().getName().startswith((".", "_")):
                    key = f"{parent}/{x.getPath().getName()}"
                    out.append((key, int(self._fs.getContentSummary(x.getPath()).getLength()), int(x.getModificationTime()) // 1000))
        return self.spark.createDataFrame(out, "key string, size bigint, mtime bigint")

    def collect_garbage(self, most_bytes: int, older_than: int | None = None, dry_run: bool = False, now: int | None = None) -> dict[str, int]:
        """Delete entries over age, then the oldest until the rest fits; counts as ``catalog.totals``, and failures."""
        entries = self.entries()
        gone = cut(catalog.evicted(entries, most_bytes, older_than, int(time.time()) if now is None else now))
        result = catalog.totals(entries, gone).first().asDict()
        failed = 0
        if not dry_run:
            for r in gone.toLocalIterator():
                failed += not self._fs.delete(self._path(f"{self.root}/{r['key']}"), True)
            self.sweep()
        return {k: v or 0 for k, v in result.items()} | {"failed": failed}

    def auto_collect(self, policy: Policy | None, now: int | None = None) -> dict[str, int] | None:
        """Clean up by ``policy``; None where there is none."""
        return None if policy is None else self.collect_garbage(policy.most_bytes, policy.most_seconds, now=now)

    def sweep(self) -> int:
        """Delete what writes that died left behind: hidden folders and files beside the entries."""
        found = 0
        for parent in [f"units/version={VERSION}", "bundles", "snapshots"]:
            if self._has(parent):
                for x in self._fs.listStatus(self._path(f"{self.root}/{parent}")):
                    if x.getPath().getName().startswith((".", "_temporary")):
                        if x.isSymlink():
                            raise ValueError(f"{x.getPath()} is a link and is not followed")
                        found += self._fs.delete(x.getPath(), True)
        return found


def export(documents: DataFrame, folder: str) -> dict[str, int]:
    """Write ``path, content`` as files of a local folder, streaming; counts of written, pruned and kept.

    Equal files stay as they are, files of earlier runs that nothing names any
    more go, and nothing is written through a link.
    """
    folder = os.path.abspath(folder)
    counts = {"written": 0, "pruned": 0, "kept": 0}
    named = set()
    for r in documents.toLocalIterator():
        at = os.path.join(folder, r["path"])
        named.add(r["path"])
        if os.path.islink(at) or os.path.islink(os.path.dirname(at)):
            raise ValueError(f"{at} is a link and is not written through")
        os.makedirs(os.path.dirname(at), exist_ok=True)
        data = r["content"].encode()
        if os.path.exists(at):
            with open(at, "rb") as f:
                if f.read() == data:
                    counts["kept"] += 1
                    continue
        tmp = f"{at}.{uuid.uuid4().hex}.tmp"
        with open(tmp, "wb") as f:
            f.write(data)
        os.replace(tmp, at)
        counts["written"] += 1
    for part in ("entities", "sequences"):
        for name in sorted(os.listdir(os.path.join(folder, part))) if os.path.isdir(os.path.join(folder, part)) else []:
            if name.endswith((".mmd", ".meta.json")) and f"{part}/{name}" not in named:
                os.remove(os.path.join(folder, part, name))
                counts["pruned"] += 1
    return counts
