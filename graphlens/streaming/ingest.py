"""Source files as a stream: each batch is parsed once and upserted by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scalars as S
from ..operators.parsing import parse_files


def upsert_batch(files: DataFrame, batch_id: int, store: str) -> None:
    """Parse what the store lacks and write it under the batch's own folder.

    A repeated batch overwrites its folder, so that a restart neither skips nor
    repeats a file.
    """
    spark = files.sparkSession
    keyed = files.withColumn("blob_sha", S.git_blob_sha1(F.coalesce("content", F.lit(b"")))).dropDuplicates(["path", "blob_sha"])
    try:
        done = spark.read.parquet(store).where(F.col("batch") < batch_id).select(F.col("file_path").alias("path"), "blob_sha").distinct()
        keyed = keyed.join(done, ["path", "blob_sha"], "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    rows = parse_files(keyed).join(keyed.select(F.col("path").alias("file_path"), "blob_sha"), "file_path")
    rows.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")


def stream(spark: SparkSession, folder: str, store: str, checkpoint: str) -> StreamingQuery:
    """Ingest Parquet files of (path, content) that arrive in ``folder``, then stop."""
    source = spark.readStream.schema("path string, content binary").parquet(folder)
    return source.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, k: upsert_batch(df, k, store)).start()
