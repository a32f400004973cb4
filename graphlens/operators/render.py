"""Diagram text from node and edge relations; a thin ordered aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def mermaid_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``part, k, line`` of a flowchart.  nodes: id, label (kind); edges: src, dst (label, dotted)."""
    kind = F.col("kind") if "kind" in nodes.columns else F.lit("")
    label = S.escape_flowchart(F.col("label"))
    n = nodes.select(F.lit(1).alias("part"), F.col("id").alias("k"), F.concat(F.lit("    "), S.node_shape(kind, S.sanitize_id(F.col("id")), label)).alias("line"))
    text = F.col("label").cast("string") if "label" in edges.columns else F.lit(None).cast("string")
    arrow = F.when(F.col("dotted"), "-.->") if "dotted" in edges.columns else F.when(F.lit(False), "")
    mid = F.when(text.isNotNull(), F.concat(F.lit('|"'), S.escape_flowchart(text), F.lit('"|'))).otherwise("")
    e = edges.select(F.lit(2).alias("part"), F.concat_ws(" ", "src", "dst").alias("k"), F.concat(F.lit("    "), S.sanitize_id(F.col("src")), F.lit(" "), F.coalesce(arrow, F.lit("-->")), mid, F.lit(" "), S.sanitize_id(F.col("dst"))).alias("line"))
    return n.unionByName(e)


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The same relations as lines of DOT."""
    esc = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    n = nodes.select(F.lit(1).alias("part"), F.col("id").alias("k"), F.concat(F.lit("    "), S.sanitize_id(F.col("id")), F.lit(' [label="'), esc(F.col("label")), F.lit('"];')).alias("line"))
    text = F.col("label").cast("string") if "label" in edges.columns else F.lit(None).cast("string")
    dotted = F.col("dotted") if "dotted" in edges.columns else F.lit(False)
    attrs = F.concat_ws(", ", F.when(text.isNotNull(), F.concat(F.lit('label="'), esc(text), F.lit('"'))), F.when(dotted, "style=dotted"))
    e = edges.select(F.lit(2).alias("part"), F.concat_ws(" ", "src", "dst").alias("k"), F.concat(F.lit("    "), S.sanitize_id(F.col("src")), F.lit(" -> "), S.sanitize_id(F.col("dst")), F.when(attrs != "", F.concat(F.lit(" ["), attrs, F.lit("]"))).otherwise(""), F.lit(";")).alias("line"))
    return n.unionByName(e)


def document(lines: DataFrame, head: str, foot: str = "") -> DataFrame:
    """One row ``text``; meant for views that a person can read."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "k", "line"))), lambda x: x["line"]), "\n")
    return lines.agg(F.concat(F.lit(head + "\n"), body, F.lit("\n" + foot if foot else "")).alias("text"))


def mermaid(nodes: DataFrame, edges: DataFrame, direction: str = "LR") -> DataFrame:
    return document(mermaid_lines(nodes, edges), f"graph {direction}")


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return document(dot_lines(nodes, edges), "digraph g {", "}")


# Classes of a graph's nodes, fill and stroke.
CLASSES = {"fileNode": ("#FFFACD", "#DAA520"), "functionNode": ("#87CEEB", "#4682B4"), "classNode": ("#DDA0DD", "#8A2BE2"), "dependencyNode": ("#90EE90", "#2E8B57")}
_LAST = "\uffff"


def dependency_id(head: Column) -> Column:
    return F.concat(F.lit("dep_"), S.sanitize_id(head))


def graph_lines(nodes: DataFrame, edges: DataFrame, group_depth: int = 2, fmt: str = "mermaid") -> DataFrame:
    """``part, k, line`` of a knowledge graph with directories and files as nested groups.

    ``nodes``: id, label, cls (a name of ``CLASSES``), file_path, line_start.
    ``edges``: src, label, dst (ids of nodes).  ``k`` is the place in the tree:
    a directory's folders come before its files, and its end after both.
    """
    dot = fmt == "dot"
    nodes = nodes.withColumn("node", F.when(F.col("cls") == "dependencyNode", dependency_id(F.col("label"))).otherwise(S.sanitize_id(F.col("id"))))
    esc = (lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))) if dot else S.escape_flowchart
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    if dot:
        colour = F.create_map(*(F.lit(x) for k, (a, b) in CLASSES.items() for x in (k, f'style=filled, fillcolor="{a}", color="{b}"')))
        shape = F.when(F.col("cls") == "dependencyNode", "ellipse").when(F.col("cls") == "functionNode", "box").otherwise("component")
        node = text(F.col("node"), ' [label="', esc(F.col("label")), '", shape=', shape, ", ", colour[F.col("cls")], "];")
    else:
        pair = lambda a, b: text(F.col("node"), a, esc(F.col("label")), b)
        node = F.concat(F.when(F.col("cls") == "functionNode", pair('("', '")')).when(F.col("cls") == "dependencyNode", pair('(["', '"])')).otherwise(pair('["', '"]')), F.lit(":::"), F.col("cls"))
    folders = F.slice(F.split("file_path", "/"), F.lit(1), F.greatest(F.size(F.split("file_path", "/")) - 1, F.lit(0)))
    n = nodes.withColumn("line", node).withColumn("dirs", F.slice(folders, 1, max(group_depth, 0)))
    inside = n.where("file_path is not null").withColumn("level", F.size("dirs")).withColumn("at", F.concat(F.transform("dirs", lambda d: F.concat(F.lit("0"), d)), F.array(F.concat(F.lit("1"), "file_path"))))
    has = inside.where("cls <> 'fileNode'").select("file_path").distinct().withColumn("grouped", F.lit(True))
    inside = inside.join(has, "file_path", "left")
    pad = lambda k: F.repeat(F.lit("    "), k)
    extra = F.coalesce("grouped", F.lit(False)).cast("int")
    place = F.when(F.col("cls") == "fileNode", F.array(F.lit("1"))).otherwise(F.array(F.lit("2"), F.lpad(F.col("line_start").cast("string"), 10, "0"), F.col("id")))
    rows = inside.select(F.lit(1).alias("part"), F.concat("at", place).alias("k"), F.concat(pad(F.col("level") + 1 + extra), "line").alias("line"))
    group = lambda name, label: text("subgraph cluster_", name, ' { label="', label, '";') if dot else text("subgraph ", name, '["', label, '"]')
    end = "}" if dot else "end"
    files = inside.where("grouped").select("file_path", "at", "level").distinct()
    rows = rows.unionByName(files.select(F.lit(1).alias("part"), F.col("at").alias("k"), F.concat(pad(F.col("level") + 1), group(text("file_", S.sanitize_id(F.col("file_path"))), esc(F.col("file_path")))).alias("line")))
    rows = rows.unionByName(files.select(F.lit(1).alias("part"), F.concat("at", F.array(F.lit(_LAST))).alias("k"), F.concat(pad(F.col("level") + 1), F.lit(end)).alias("line")))
    dirs = inside.where("level > 0").select(F.explode(F.transform(F.sequence(F.lit(1), F.col("level")), lambda k: F.slice("dirs", F.lit(1), k))).alias("d")).distinct()
    path, key = F.array_join("d", "/"), F.transform("d", lambda x: F.concat(F.lit("0"), x))
    rows = rows.unionByName(dirs.select(F.lit(1).alias("part"), key.alias("k"), F.concat(pad(F.size("d")), group(text("dir_", S.sanitize_id(path)), text(esc(path), "/"))).alias("line")))
    rows = rows.unionByName(dirs.select(F.lit(1).alias("part"), F.concat(key, F.array(F.lit(_LAST))).alias("k"), F.concat(pad(F.size("d")), F.lit(end)).alias("line")))
    rows = rows.unionByName(n.where("file_path is null").select(F.lit(2).alias("part"), F.array("label").alias("k"), F.concat(F.lit("    "), "line").alias("line")))
    e = edges.join(nodes.select(F.col("id").alias("src"), F.col("node").alias("a")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("node").alias("b")), "dst").select("a", "label", "b").distinct()
    arrow = text("    ", F.col("a"), " -> ", F.col("b"), ' [label="', F.col("label"), '"];') if dot else text("    ", F.col("a"), ' --"', F.col("label"), '"--> ', F.col("b"))
    return rows.unionByName(e.select(F.lit(3).alias("part"), F.array("a", "label", "b").alias("k"), arrow.alias("line")))


def graph_head(files: int, items: int, deps: int, cut_off: int, fmt: str = "mermaid") -> str:
    """The first lines of that graph."""
    mark = "//" if fmt == "dot" else "%%"
    out = ["digraph g {" if fmt == "dot" else "graph TD", f"    {mark} graph: {files} files, {items} items, {deps} external deps"]
    if cut_off:
        out.append(f"    {mark} truncated {cut_off} lower-ranked items (raise --max-nodes, narrow --kinds, or use --format dot)")
    if fmt != "dot":
        out += [f"    classDef {k} fill:{a},stroke:{b},stroke-width:2px,color:#000" for k, (a, b) in CLASSES.items()]
    return "\n".join(out)
