"""Processing only new or changed records (problem 5).

A manifest holds what each series' last successful run left processed: path,
checksum and, for stored batches, the batch that did it.  A run lists what is
current, anti-joins the listing with the manifest, writes its batch under its
own identifier (a repeated try overwrites it) and then commits the manifest.

``ManifestStore`` does this for one run at a time on shared storage;
``replay`` does it for all runs of a log in one set-based pass, with the same
three relations: listing, manifest, and what the anti-join leaves.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, fits

_RUN_ROW = 120
#: Parts of a series' log rows, by path.
_PARTS = 16


def clean_path(c: Column) -> Column:
    r"""A path without leading ``./`` and repeated ``/``, ``\`` written ``/``."""
    p = F.regexp_replace(F.translate(c, "\\", "/"), "/+", "/")
    return F.regexp_replace(p, "^(\\./)+", "")


def clean_log(log: DataFrame) -> DataFrame:
    """Usable log rows: known blob, path, series and times, one spelling."""
    return log.where("blob_sha is not null and display_path is not null and landed_at is not null and scanned_at is not null").select(
        F.xxhash64("repo", "source_root").alias("series"),
        clean_path(F.col("display_path")).alias("path"),
        F.lower("blob_sha").alias("blob"), "log_id", "scanned_at", "landed_at",
    )


def listing(log: DataFrame, moment: str) -> DataFrame:
    """What is current at ``moment``: ``series, path, blob``, one row a path."""
    seen = clean_log(log).where(F.col("landed_at") <= F.lit(moment).cast("timestamp_ntz"))
    best = F.max(F.struct("scanned_at", "log_id", "blob"))
    return seen.groupBy("series", "path").agg(best.alias("b")).select("series", "path", F.col("b.blob").alias("blob"))


def successful_runs(runs: DataFrame) -> DataFrame:
    """Intervals between successful runs: ``series, run_id, nth, lo, hi``.

    ``lo`` is null for a series' first run.  Equal starts go by ``run_id``; the
    later of them finds nothing new.
    """
    by = Window.partitionBy("series").orderBy("started_at", "run_id")
    good = runs.where("outcome = 'succeeded' and started_at is not null").select(F.xxhash64("repo", "source_root").alias("series"), "run_id", "started_at")
    return good.select("series", "run_id", F.row_number().over(by).alias("nth"), F.lag("started_at").over(by).alias("lo"), F.col("started_at").alias("hi"))


def assign_runs(log: DataFrame, runs: DataFrame) -> DataFrame:
    """Each log row with the first successful run that could read it, and its ``part``.

    Rows of a path share a part of their series, so whoever groups by series,
    part and path needs no other exchange than the one by series and part.  Rows
    after a last run have no run and drop.
    """
    spans = successful_runs(runs)
    days = F.sequence(F.to_date("lo"), F.to_date("hi"))
    closed = spans.where("lo is not null and lo < hi").withColumn("day", F.explode(days))
    first = spans.where("nth = 1").select("series", F.col("run_id").alias("r1"), F.col("hi").alias("h1"))
    if fits(closed, _RUN_ROW) and fits(first, _RUN_ROW):
        return _by_days(clean_log(log), first, closed).withColumn("part", F.lit(0))
    return _by_time(clean_log(log), spans)


def _by_days(rows: DataFrame, first: DataFrame, closed: DataFrame) -> DataFrame:
    """Runs by broadcast: a range join on ``lo < landed_at <= hi``.

    It is made an equi-join by cutting each interval into the days it covers;
    rows before a first run meet the open interval by the series alone.
    """
    rows = rows.withColumn("day", F.to_date("landed_at")).join(F.broadcast(first), ["series"])
    early = rows.where("landed_at <= h1").select("series", "path", "blob", "log_id", "scanned_at", F.col("r1").alias("run_id"), F.lit(1).alias("nth"))
    late = (
        rows.where("landed_at > h1").join(F.broadcast(closed), ["series", "day"])
        .where("landed_at > lo and landed_at <= hi")
        .select("series", "path", "blob", "log_id", "scanned_at", "run_id", "nth")
    )
    return early.unionByName(late)


def _by_time(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Runs by time: log rows and runs of a series in one order, from the latest on.

    The log moves once, narrow, and nothing but the runs is repeated, once for
    each part of a series.  The last run seen before a row is the first that
    could read it; of equal starts that is the one with the least ``nth``.
    """
    parts = F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1)))
    marks = spans.select("series", parts.alias("part"), F.col("hi").alias("at"), F.struct("nth", "run_id").alias("run"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(_PARTS)).cast("int"))
    both = rows.withColumnRenamed("landed_at", "at").unionByName(marks, allowMissingColumns=True)
    back = Window.partitionBy("series", "part").orderBy(F.desc("at"), F.col("run").isNull(), F.desc("run.nth")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("next", F.last("run", ignorenulls=True).over(back)).where("run is null and next is not null")
    return found.select("series", "part", "path", "blob", "log_id", "scanned_at", "next.run_id", "next.nth")


def listings(log: DataFrame, runs: DataFrame) -> DataFrame:
    """What each successful run lists: ``series, path, nth, run_id, blob, until``.

    Only paths with a row landed since the last run can differ from what the
    manifest holds, so a run's listing is kept to those; their blob is the best
    of all rows that the run or one before it could read.  ``until`` is the next
    run that lists the path, told here where the path's rows are in order.
    """
    by = Window.partitionBy("series", "part", "path").orderBy("nth")
    best = F.max(F.struct("scanned_at", "log_id", "blob"))
    touched = assign_runs(log, runs).groupBy("series", "part", "path", "nth", "run_id").agg(best.alias("b"))
    so_far = F.max("b").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return touched.select("series", "path", "nth", "run_id", so_far["blob"].alias("blob"), F.lead("nth").over(by).alias("until"))


def manifests(listed: DataFrame) -> DataFrame:
    """The manifest that each run finds: ``series, path, nth, blob``.

    A successful run commits every path it listed with its checksum, and the
    entry stands until the next run that lists the path replaces it; ``nth`` is
    that next run, the one that has to compare with it.  Failed runs commit
    nothing and have no listing.
    """
    return listed.where("until is not null").select("series", "path", F.col("until").alias("nth"), "blob")


def replay(log: DataFrame, runs: DataFrame) -> DataFrame:
    """What every successful run has to process: ``run_id, display_path, blob_sha``.

    The listing of every run is anti-joined with the manifest it finds, by path
    and checksum; ``run_id`` is the batch identifier under which a repeated run
    writes the same rows again.  Null blobs, paths or times are ignored,
    repeated rows change nothing, and empty tables give no rows.
    """
    listed = cut(listings(log, runs))
    pending = listed.join(manifests(listed), ["series", "path", "nth", "blob"], "left_anti")
    return pending.select("run_id", F.col("path").alias("display_path"), F.col("blob").alias("blob_sha"))


class ManifestStore:
    """Batches and manifest on shared storage, for one run at a time.

    ``root``/batches/batch=ID holds a run's records, ``root``/manifest/ID what it
    processed, ``root``/commits/N.json the N-th commit.  Only committed
    identifiers count, so a run that dies in between leaves nothing that a later
    one reads, and its repetition overwrites its own folders.  Of two runs that
    read the same manifest at the same time, one commits and the other fails.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _commits(self) -> dict[int, str]:
        """Batch identifiers by number of commit; a damaged commit has none."""
        at = self._path(f"{self.root}/commits")
        if not self._fs.exists(at):
            return {}
        names = sorted(n for x in self._fs.listStatus(at) if (n := x.getPath().getName()).endswith(".json"))
        out = {}
        for n in names:
            stream = self._fs.open(self._path(f"{self.root}/commits/{n}"))
            try:
                out[int(n[:-5])] = json.loads(bytes(stream.readAllBytes()) or b"null") or ""
            except ValueError:
                out[int(n[:-5])] = ""
            finally:
                stream.close()
        return out

    def committed(self) -> list[str]:
        """Identifiers of the committed batches, in order of commit."""
        return [x for _, x in sorted(self._commits().items()) if x]

    def manifest(self) -> DataFrame:
        """``key, size, checksum`` as of the last commit; the latest batch wins."""
        names = self.committed()
        if not names:
            return self.spark.createDataFrame([], "key string, size bigint, checksum string")
        parts = self.spark.read.parquet(*[f"{self.root}/manifest/{n}" for n in names])
        best = F.max(F.struct("nth", "size", "checksum"))
        return parts.groupBy("key").agg(best.alias("b")).select("key", "b.size", "b.checksum")

    def pending(self, files: DataFrame) -> DataFrame:
        """Rows of ``files`` (key, size, checksum, ...) that the manifest lacks.

        A null size or checksum equals a null one; null keys are ignored.
        """
        done = self.manifest().select(F.col("key").alias("_k"), F.col("size").alias("_s"), F.col("checksum").alias("_c"))
        return files.where("key is not null").join(
            done, (F.col("key") == F.col("_k")) & F.col("size").eqNullSafe(F.col("_s")) & F.col("checksum").eqNullSafe(F.col("_c")), "left_anti"
        )

    def run(self, batch_id: str, files: DataFrame, process=None, fail_before_commit: bool = False) -> bool:
        """Process what is pending under ``batch_id``; False if it was done before.

        The listing is evaluated once: what is pending is written first, and
        both the batch and the manifest are made from what was written.  A file
        that changes in the meantime is listed again by the next run.
        """
        commits = self._commits()
        if batch_id in commits.values():
            return False
        nth = max(commits, default=-1) + 1
        batch, staged = f"{self.root}/batches/batch={batch_id}", f"{self.root}/staged/{batch_id}"
        first = staged if process else batch
        self.pending(files).write.mode("overwrite").parquet(first)
        work = self.spark.read.parquet(first)
        if process:
            process(work).write.mode("overwrite").parquet(batch)
        work.select("key", "size", "checksum").withColumn("nth", F.lit(nth)).write.mode("overwrite").parquet(f"{self.root}/manifest/{batch_id}")
        if fail_before_commit:
            raise RuntimeError("stopped before the commit")
        self._commit(nth, batch_id)
        self._fs.delete(self._path(staged), True)
        return True

    def _commit(self, nth: int, batch_id: str) -> None:
        """Create the commit's file, which fails if another run has that number."""
        jvm_error = "already exists"
        try:
            out = self._fs.create(self._path(f"{self.root}/commits/{nth:09d}.json"), False)
        except Exception as e:  # noqa: BLE001
            if jvm_error not in str(e):
                raise
            raise RuntimeError(f"{batch_id} met the commit of another run; run it again") from e
        out.write(bytearray(json.dumps(batch_id).encode()))
        out.close()

    def records(self) -> DataFrame:
        """Records of all committed batches, with their ``batch``."""
        names = self.committed()
        frames = [self.spark.read.parquet(f"{self.root}/batches/batch={n}").withColumn("batch", F.lit(n)) for n in names]
        if not frames:
            return self.spark.createDataFrame([], "batch string")
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out
