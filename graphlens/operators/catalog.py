"""Catalogs of a snapshot: rows, digests, writing, reconciling, eviction."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import cut


def rows(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, kind, name, file, content_hash, edges_out, edges_in``: calls only, sorted, distinct."""
    calls = edges.where("kind = 'calls'").select("src", "dst").distinct()
    side = lambda key, other, name: calls.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(other)).alias(name))
    none = F.array().cast("array<string>")
    return atoms.select("id", "kind", "name", F.col("file_path").alias("file"), "content_hash").join(side("src", "dst", "edges_out"), "id", "left").join(side("dst", "src", "edges_in"), "id", "left").withColumns(
        {"edges_out": F.coalesce("edges_out", none), "edges_in": F.coalesce("edges_in", none)}
    )


#: An atom's own fields in its document, by the names there.
_FIELDS = (("id", "id"), ("kind", "kind"), ("name", "name"), ("file", "file_path"), ("line_start", "line_start"), ("line_end", "line_end"), ("signature", "signature"), ("doc", "doc"), ("content_hash", "content_hash"))


def entity_meta(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, meta``: an atom and its neighbours by kind of edge, as JSON.

    Fields that ``atoms`` lacks and null ones are left out; lists are sorted and
    distinct, and empty where there is no neighbour.
    """
    lists = (("callers", "calls", 1), ("callees", "calls", 0), ("children", "contains", 0), ("imports", "imports", 0), ("imported_by", "imports", 1), ("uses", "uses", 0), ("used_by", "uses", 1), ("implements", "implements", 0), ("implemented_by", "implements", 1))
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("o"), F.col("kind").alias("k"), F.lit(0).alias("d")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("o"), F.col("kind").alias("k"), F.lit(1).alias("d")))
    n = both.groupBy("id").agg(*(F.array_sort(F.collect_set(F.when((F.col("k") == k) & (F.col("d") == d), F.col("o")))).alias(name) for name, k, d in lists))
    none = F.array().cast("array<string>")
    own = [F.col(c).alias(name) for name, c in _FIELDS if c in atoms.columns]
    return atoms.join(n, "id", "left").select("id", F.to_json(F.struct(*own, *(F.coalesce(name, none).alias(name) for name, _, _ in lists))).alias("meta"))


# Colours of the kinds in an entity's own diagram, fill and stroke.
COLOURS = {
    "function": ("#e1f5fe", "#01579b"), "module": ("#f3e5f5", "#4a148c"), "struct": ("#e8f5e9", "#1b5e20"), "trait": ("#fff8e1", "#f57f17"), "impl": ("#fce4ec", "#880e4f"),
    "enum": ("#e8eaf6", "#283593"), "const": ("#fffde7", "#f9a825"), "static": ("#fffde7", "#f9a825"), "macro": ("#e0f2f1", "#004d40"),
}
_OTHER = ("#f5f5f5", "#424242")


def stars(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, text``: every entity with its callers and callees as a diagram of its own.

    An entity's lines are aggregated in order: its head, then what it calls, then
    what calls it.  A vertex with very many neighbours is one long text by nature.
    """
    one_line = lambda c: F.trim(F.translate(F.coalesce(c, F.lit("")), "\r\n", "  "))
    node = S.sanitize_id(F.col("id"))
    fill, stroke = F.lit(_OTHER[0]), F.lit(_OTHER[1])
    for kind, (a, b) in COLOURS.items():
        fill, stroke = F.when(F.col("kind") == kind, a).otherwise(fill), F.when(F.col("kind") == kind, b).otherwise(stroke)
    span = F.concat(F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string")) if "line_start" in atoms.columns else F.lit("")
    signature = one_line(F.col("signature")) if "signature" in atoms.columns else F.lit("")
    head = F.concat_ws(
        "\n", F.concat(F.lit("%% id: "), one_line(F.col("id"))), F.concat(F.lit("%% kind: "), one_line(F.col("kind"))), F.concat(F.lit("%% file: "), one_line(F.col("file_path")), span), F.concat(F.lit("%% content_hash: "), one_line(F.col("content_hash"))),
        F.when(signature != "", F.concat(F.lit("%% signature: "), signature)), F.lit("graph LR"), F.concat(F.lit("  classDef "), "kind", F.lit(" fill:"), fill, F.lit(",stroke:"), stroke),
        F.lit("  classDef function fill:#e1f5fe,stroke:#01579b"), F.lit("  classDef module fill:#f3e5f5,stroke:#4a148c"), F.concat(F.lit("  "), node, F.lit(":::"), "kind", F.lit("["), S.escape_flowchart(F.col("name")), F.lit("]")),
    )
    calls = edges.where("kind = 'calls'").select("src", "dst").distinct()
    label = lambda c: S.escape_flowchart(F.element_at(F.split(c, "::"), -1))
    to = F.concat(F.lit("  "), S.sanitize_id(F.col("src")), F.lit(" -- calls --> "), S.sanitize_id(F.col("dst")), F.lit(":::function["), label("dst"), F.lit("]"))
    by = F.concat(F.lit("  "), S.sanitize_id(F.col("src")), F.lit(":::function["), label("src"), F.lit("] -- calls --> "), S.sanitize_id(F.col("dst")))
    lines = calls.select(F.col("src").alias("id"), F.struct(F.lit(0).alias("part"), F.col("dst").alias("k"), to.alias("line")).alias("x")).unionByName(calls.select(F.col("dst").alias("id"), F.struct(F.lit(1).alias("part"), F.col("src").alias("k"), by.alias("line")).alias("x")))
    around = lines.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("body"))
    return atoms.join(around, "id", "left").select("id", F.concat_ws("\n", head, "body").alias("text"))


def documents(atoms: DataFrame, edges: DataFrame, overview: DataFrame, source_root: str, generated_at: str, sequences: DataFrame | None = None) -> DataFrame:
    """``path, content`` of a bundle: two documents an entity, sequences, the overview and the index.

    ``overview``: one row ``text``.  ``sequences``: file_path, fn_name, diagram;
    a diagram belongs to the function entity of that file and name.  The index
    is one document by nature.
    """
    base = S.filename_id(F.col("id"))
    parts = stars(atoms, edges).select(F.concat(F.lit("entities/"), base, F.lit(".mmd")).alias("path"), F.concat("text", F.lit("\n")).alias("content"))
    parts = parts.unionByName(entity_meta(atoms, edges).select(F.concat(F.lit("entities/"), base, F.lit(".meta.json")).alias("path"), F.col("meta").alias("content")))
    index = rows(atoms, edges)
    drawn = None
    if sequences is not None:
        fns = atoms.where("kind = 'function'").select("id", "file_path", S.qualified_fn_name(F.col("id")).alias("fn_name"))
        drawn = fns.join(sequences.select("file_path", "fn_name", "diagram"), ["file_path", "fn_name"]).select("id", "diagram")
        parts = parts.unionByName(drawn.select(F.concat(F.lit("sequences/"), base, F.lit(".mmd")).alias("path"), F.concat("diagram", F.lit("\n")).alias("content")))
        index = index.join(drawn.select("id", F.lit(True).alias("drawn")).distinct(), "id", "left")
    else:
        index = index.withColumn("drawn", F.lit(None).cast("boolean"))
    name = lambda folder, end: F.concat(F.lit(folder), base, F.lit(end))
    entry = F.to_json(F.struct("id", "kind", "name", "file", "content_hash", name("entities/", ".mmd").alias("mmd_path"), name("entities/", ".meta.json").alias("meta_path"), F.struct(F.col("edges_out").alias("out"), F.col("edges_in").alias("in")).alias("edges"), F.when(F.col("drawn"), name("sequences/", ".mmd")).alias("sequence_path")))
    quoted = lambda x: json.dumps(x, ensure_ascii=False)
    whole = index.agg(F.concat(F.lit('{"schema": 2, "entities": ['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", entry.alias("e")))), lambda x: x["e"]), ",\n"), F.lit(f'], "generated_at": {quoted(generated_at)}, "source_root": {quoted(source_root)}}}')).alias("content"))
    parts = parts.unionByName(whole.select(F.lit("index.json").alias("path"), "content"))
    return parts.unionByName(overview.select(F.lit("overview.mmd").alias("path"), F.concat("text", F.lit("\n")).alias("content")))


def digest(files: DataFrame, *keys: str) -> DataFrame:
    """``snapshot_id`` per group: ``wt-`` and 16 hex digits over sorted ``path:blob``, each ended by a zero byte.

    ``files``: path, blob and the keys.  An order-dependent hash needs its group
    in one place; the rows are two short strings a file, aggregated as such.
    """
    pair = F.struct("path", "blob")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: F.concat(x["path"], F.lit(":"), x["blob"], F.lit("\0"))), "")
    return files.groupBy(*keys).agg(F.concat(F.lit("wt-"), F.left(F.sha1(whole.cast("binary")), F.lit(16))).alias("snapshot_id"))


def running_total(df: DataFrame, order: list[str], value: str, name: str, descending: bool = False) -> DataFrame:
    """``df`` with the sum of ``value`` up to and including each row in ``order``.

    No window over the whole table: rows are range partitioned, summed within
    their partition, and get what the partitions before hold from one row each.
    """
    by = [F.desc(c) if descending else F.asc(c) for c in order]
    part = cut(df.repartitionByRange(*by).withColumn("_p", F.spark_partition_id()))
    sums = sorted((r["_p"], r["s"] or 0) for r in part.groupBy("_p").agg(F.sum(value).alias("s")).collect())
    base, total = [], 0
    for p, s in sums:
        base += [F.lit(p), F.lit(total).cast("bigint")]
        total += s
    inner = F.sum(value).over(Window.partitionBy("_p").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    before = F.create_map(*base)[F.col("_p")] if base else F.lit(0)
    return part.withColumn(name, (before + inner).cast("bigint")).drop("_p")


def evicted(entries: DataFrame, cap: int, older_than: int | None = None, now: int = 0) -> DataFrame:
    """Entries to evict: those over age, then oldest first until ``cap`` holds.

    ``entries``: key, size, mtime (null sizes count as 0).  An entry goes while
    it and all newer ones together are larger than the cap.
    """
    e = entries.select("key", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"), "mtime")
    old = e.limit(0)
    if older_than is not None:
        old = e.where(now - F.col("mtime") > older_than)
        e = e.where(~(now - F.col("mtime") > older_than))
    kept = running_total(e, ["mtime", "key"], "size", "remaining", descending=True)
    return old.select("key", "size").unionByName(kept.where(F.col("remaining") > cap).select("key", "size"))


def totals(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """One row: entries and bytes before, evicted entries and bytes after."""
    flagged = entries.select("key", F.coalesce("size", F.lit(0)).cast("bigint").alias("size")).join(gone.select("key", F.lit(True).alias("out")), "key", "left")
    return flagged.agg(F.count(F.lit(1)).alias("entries"), F.sum("size").alias("bytes_before"), F.count("out").alias("evicted"), F.sum(F.when(F.col("out").isNull(), F.col("size")).otherwise(0)).alias("bytes_after"))


def write(catalog: DataFrame, root: str, snapshot: str, force: bool = False) -> bool:
    """Write a snapshot's catalog once; True if it was written.

    A snapshot that exists is a hit.  An empty catalog never replaces one with
    rows.  The commit protocol of the file system makes the folder whole or absent.
    """
    spark = catalog.sparkSession
    path = f"{root}/snapshot={snapshot}"
    there = exists(spark, path)
    if there and not force:
        return False
    if there and catalog.isEmpty() and not spark.read.parquet(path).isEmpty():
        raise ValueError("an empty catalog does not replace one with rows")
    catalog.write.mode("overwrite").parquet(path)
    return True


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read(spark: SparkSession, root: str, snapshot: str) -> DataFrame:
    return spark.read.parquet(f"{root}/snapshot={snapshot}")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Entities of an ``index.json`` as rows; missing fields are empty."""
    schema = "entities array<struct<id string, kind string, name string, file string, content_hash string, edges struct<out array<string>>>>"
    e = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("entities").alias("e"))
    blank = lambda c: F.coalesce(F.col(f"e.{c}"), F.lit("")).alias(c)
    return e.select("e.id", blank("kind"), blank("name"), blank("file"), blank("content_hash"), F.coalesce("e.edges.out", F.array().cast("array<string>")).alias("edges_out"))


def orphans(existing: DataFrame, keep: DataFrame) -> DataFrame:
    """Keys of ``existing`` that ``keep`` lacks."""
    return existing.select("key").join(keep.select("key"), "key", "left_anti")


def changed_entries(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows of ``new`` (key, hash) that are not in ``old`` with the same hash."""
    return new.join(old.select("key", F.col("hash").alias("_h")), (new["key"] == old["key"]) & new["hash"].eqNullSafe(F.col("_h")), "left_anti")
