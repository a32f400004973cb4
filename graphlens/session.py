"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import py_compile
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Most bytes that any broadcast of this library may hold, by estimate.
BROADCAST_BYTES = 64 << 20
#: Bytes of a part of Python work, where an input is cut anew.
PART_BYTES = 16 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application.

    As a zip through Spark's own file server, as ``--py-files`` would, so that
    it needs no installation and no shared path.  Compiled modules lie beside the
    sources: a worker of the same Python does not compile them again.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="graphlens-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "graphlens-package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    name = os.path.join("graphlens", os.path.relpath(full, root))
                    z.write(full, name)
                    z.write(py_compile.compile(full, os.path.join(folder, "module.pyc"), name, True, invalidation_mode=py_compile.PycInvalidationMode.UNCHECKED_HASH), name + "c")
    sc.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fits(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the counted rows of ``df`` fit ``limit`` bytes.

    ``row_bytes`` is the caller's upper estimate of one row in memory.  The
    count stops at the limit, so that a large frame is not read whole only to
    find out that it is large.
    """
    most = max(1, limit // row_bytes)
    return df.limit(most + 1).count() <= most


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast if its counted rows fit ``limit`` bytes.

    Beyond the limit the frame comes back unmarked, and Spark joins it by
    shuffle (with AQE's skew handling).
    """
    return F.broadcast(df) if fits(df, row_bytes, limit) else df


def spread(df: DataFrame) -> DataFrame:
    """Give Python work enough parts if its input is small.

    A small file of one row group would otherwise be worked through by a single
    core.  Inputs that a scan cuts into enough parts by itself are not moved.
    """
    spark = df.sparkSession
    ship(spark)
    cores = spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    if plan.executedPlan().nodeName() != "AdaptiveSparkPlan":  # no shuffle before: counting the parts of a scan runs nothing
        enough = df.rdd.getNumPartitions() >= cores
    else:
        enough = size >= cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() // 2
    return df if enough else df.repartition(max(2 * cores, size // PART_BYTES))


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder for checkpoints, as the cluster names it.

    ``spark.checkpoint.dir`` of the session wins.  Where the cluster names none,
    ``fallback`` is taken (tests, and local sessions of the command line); on a
    cluster there is no folder of our own that all executors would see.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if fallback is None and sc.master.startswith("local"):
            fallback = os.path.join(tempfile.gettempdir(), "graphlens-checkpoint")
        if fallback is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(fallback)
    return sc.getCheckpointDir()


_written: list = []


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    That cuts the lineage, survives lost executors, runs the plan once, and
    gives later joins the true size.  The folders are deleted when the session's
    process ends.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_forget, spark)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_counting(df: DataFrame, condition: Column | None = None) -> tuple[DataFrame, int]:
    """``cut``, and how many rows (that meet ``condition``) were written, counted on the way."""
    seen = Observation()
    one = F.lit(1) if condition is None else F.when(condition, 1)
    out = cut(df.observe(seen, F.count(one).alias("n")))
    return out, int(seen.get.get("n") or 0)


def cut_small(df: DataFrame, row_bytes: int = 400) -> tuple[DataFrame, int]:
    """``cut`` and the number of rows; marked for broadcast if they fit."""
    out, n = cut_counting(df)
    return (F.broadcast(out) if n * row_bytes <= BROADCAST_BYTES else out), n


def _forget(spark: SparkSession) -> None:
    """Delete what ``cut`` wrote, if the session still runs."""
    try:
        sc = spark.sparkContext
        for path in _written:
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001
        return  # the session has ended; the folder's owner cleans up
