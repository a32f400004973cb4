"""The library's front: from source files to a resolved graph and its views.

    files = sources.files.files(spark, root)
    g = engine.analyze(files)
    nodes, edges = engine.project(g)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import schema
from .functions import scalars as S
from .operators import catalog, diff, graph, parsing, render, resolve, sequence, traverse
from .session import cut


@dataclass
class Analysis(graph.CodeGraph):
    """A resolved graph with what the parser found besides."""

    rows: DataFrame | None = None


def analyze(files: DataFrame, kept: DataFrame | None = None) -> Analysis:
    """Parse ``files`` (path, content) and resolve calls, impls, imports and types.

    ``kept``: parsed rows of an earlier run with ``blob_sha``; unchanged files
    are taken from there.
    """
    if kept is not None:
        same, todo = parsing.incremental(files, kept)
        rows = cut(same.drop("blob_sha").unionByName(parsing.parse_files(todo)))
    else:
        rows = cut(parsing.parse_files(files))
    return resolved(rows)


def resolved(rows: DataFrame) -> Analysis:
    """The whole graph of parsed rows.

    Edges keep the order of a sequential run: those of the parser by path and
    place, then those of each pass by their caller's path and place.
    """
    atoms = cut(graph.upsert(parsing.atoms_of(rows)).drop("seq_first"))
    inner, sites, imports = parsing.edges_of(rows), parsing.call_sites_of(rows), parsing.imports_of(rows)
    calls, externs = resolve.resolve_calls(atoms, inner, sites, imports)
    externs = cut(externs)
    modules = atoms.where("kind = 'module'").select("id", "file_path")
    items = atoms.where("kind <> 'module' and parent is null").select("file_path", "scope", "name")
    types = atoms.where(F.col("kind").isin(*resolve.TYPE_KINDS))
    tree = cut(resolve.module_tree(atoms))
    uses = resolve.type_targets(parsing.type_refs_of(rows), types, tree, cut(resolve.rust_reexports(imports, tree))).select(F.col("atom_id").alias("src"), F.col("target").alias("dst"))
    plain = lambda df, kind: df.select("src", "dst", F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("array<int>").alias("sites"))
    passes = [calls, plain(resolve.implement_edges(atoms, inner), "implements"), plain(resolve.import_edges(imports, modules, items), "imports"), plain(uses, "uses")]
    late = None
    for n, e in enumerate(passes, 1):
        e = e.withColumn("phase", F.lit(n))
        late = e if late is None else late.unionByName(e)
    # Of one caller the calls come as it first makes them, all else by its target.
    place = atoms.select(F.col("id").alias("src"), F.col("seq.path").alias("path"), F.col("seq.pos").alias("at"))
    order = F.struct("phase", "path", (F.col("at") * F.lit(65536).cast("bigint") + F.coalesce(F.try_element_at("sites", F.lit(1)), F.lit(0))).alias("pos"))
    late = late.join(place, "src", "left").withColumn("seq", order).select("src", "dst", "kind", "role", "sites", "seq")
    blank = {c: F.lit("") for c in ("file_path", "doc", "content_hash", "scope")} | {c: F.lit(0) for c in ("line_start", "line_end")} | {"parent": F.lit(None).cast("string"), "seq": F.lit(None).cast(atoms.schema["seq"].dataType)}
    all_atoms = atoms.unionByName(externs.withColumns(blank).select(*atoms.columns))
    early = inner.withColumn("seq", F.struct("seq.phase", "seq.path", F.col("seq.pos").cast("bigint").alias("pos")))
    return Analysis(cut(all_atoms), cut(early.unionByName(late)), sites, rows)


def project(g: graph.CodeGraph) -> tuple[DataFrame, DataFrame]:
    n = graph.project_nodes(g.atoms)
    label = F.concat("crate", F.lit(" — "), F.col("modules").cast("string"), F.lit(" mod, "), F.col("functions").cast("string"), F.lit(" fn, "), F.col("structs").cast("string"), F.lit(" struct"))
    e = graph.project_edges(g.atoms, g.edges)
    return n.select(F.col("crate").alias("id"), label.alias("label"), "modules", "functions", "structs"), e.select(F.col("src_crate").alias("src"), F.col("dst_crate").alias("dst"), F.concat(F.col("calls").cast("string"), F.lit(" calls")).alias("label"), "calls")


def overview(g: graph.CodeGraph) -> tuple[DataFrame, DataFrame]:
    n = graph.overview_nodes(g.atoms, g.edges)
    short = (F.col("structs") == 0) & (F.col("traits") == 0)
    text = F.concat("label", F.lit(" ("), F.col("functions").cast("string"), F.lit(" fn"), F.when(short, "").otherwise(F.concat(F.lit(", "), F.col("structs").cast("string"), F.lit(" struct, "), F.col("traits").cast("string"), F.lit(" trait"))), F.lit(")"))
    e = graph.overview_edges(g.atoms, g.edges).select(F.concat(F.lit("code:"), "src_file").alias("src"), F.concat(F.lit("code:"), "dst_file").alias("dst"), F.col("calls").cast("string").alias("label"), "calls")
    return n.withColumn("label", text), e


def module(g: graph.CodeGraph, target: str) -> tuple[DataFrame, DataFrame]:
    path = resolve.lookup(g.atoms, target, "module").removeprefix("code:")
    inner = [graph.module_calls(g.atoms, g.edges, path, w) for w in ("intra", "outgoing", "incoming")]
    e = inner[0].unionByName(inner[1]).unionByName(inner[2])
    ids = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    inside = g.atoms.where((F.col("file_path") == path) & (F.col("kind") != "module"))
    n = inside.unionByName(g.atoms.join(ids, "id", "left_semi").where(F.col("file_path") != path).select(*g.atoms.columns))
    return n.select("id", F.concat(S.short_kind(F.col("kind")), F.lit(" "), "name").alias("label"), "kind"), e


def function(g: graph.CodeGraph, target: str) -> tuple[DataFrame, DataFrame]:
    entity = resolve.lookup(g.atoms, target)
    e = g.edges.where((F.col("kind") == "calls") & ((F.col("src") == entity) | (F.col("dst") == entity))).select("src", "dst")
    return _named(g, e, entity), e


def impact(g: graph.CodeGraph, target: str, hops: int = 3) -> tuple[DataFrame, DataFrame]:
    entity = resolve.lookup(g.atoms, target)
    e, _ = traverse.impact(g.edges.where("kind = 'calls'").select("src", "dst", "seq"), entity, hops)
    return _named(g, e, entity), e


def _named(g: graph.CodeGraph, e: DataFrame, entity: str) -> DataFrame:
    ids = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).unionByName(e.sparkSession.createDataFrame([(entity,)], "id string")).distinct()
    return ids.join(g.atoms.select("id", "name", "kind"), "id", "left").select("id", F.coalesce("name", F.lit("?")).alias("label"), F.coalesce("kind", F.lit("")).alias("kind"))


def flow(g: graph.CodeGraph, target: str, depth: int = 3, external: str = "near") -> dict[str, DataFrame]:
    """Nodes, labelled edges, leaves, cycle and skipped counts from ``target``."""
    entity = resolve.lookup(g.atoms, target)
    merged = cut(graph.merged_sites(g.edges))
    got = traverse.flow(merged, g.atoms.select("id", "kind"), entity, depth, external)
    labels = graph.edge_labels(merged, g.call_sites)
    edges = got["edges"].withColumnRenamed("label", "kind").join(labels, ["src", "dst"], "left")
    words = F.when(F.col("kind") == "recursive", "recursive").when(F.col("kind") == "cycle", "cycle (depth limit)").otherwise(F.col("label"))
    walked = got["walks"].select(F.col("node").alias("caller_id")).distinct()
    leaves = graph.unresolved_leaves(merged, g.call_sites).join(walked, "caller_id", "left_semi")
    skipped = got["walks"].join(graph.skipped_sites(merged, g.call_sites).withColumnRenamed("caller_id", "node"), "node").agg(F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"))
    drawn = edges.select("src", "dst", words.alias("label"), (F.col("kind") != "call").alias("dotted")).unionByName(leaves.select(F.col("caller_id").alias("src"), F.col("id").alias("dst"), "label", F.lit(True).alias("dotted")))
    nodes = got["nodes"].join(g.atoms.select("id", "name", "kind"), "id", "left").select("id", F.coalesce("name", F.lit("?")).alias("label"), "kind").unionByName(leaves.select("id", F.col("name").alias("label"), F.lit("unresolved").alias("kind")))
    return {"nodes": nodes, "edges": drawn, "cycle": got["cycle"], "skipped": skipped}


# Names that select kinds of edges, and what is drawn by default.
EDGE_NAMES = {"calls": "calls", "imports": "imports", "references": "references", "uses": "references", "implements": "implements", "defines": "defines", "contains": "defines", "extern": "depends on", "deps": "depends on"}
GRAPH_KINDS = ("function", "struct", "enum", "trait", "type_alias")
GRAPH_EDGES = ("calls", "imports", "references", "implements", "depends on")


def _candidates(g: graph.CodeGraph, kinds: tuple[str, ...], include_private: bool) -> DataFrame:
    d = graph.degrees(g.atoms, g.edges)
    a = g.atoms.where((F.col("kind") != "module") & (F.col("kind") != "extern") & (F.col("file_path") != "") & F.col("kind").isin(*kinds)).join(d, "id")
    if include_private:
        return a
    return a.where(S.is_public(F.col("signature"), F.col("name"), F.col("file_path")) | (F.col("cross_degree") > 0))


def knowledge_graph(g: graph.CodeGraph, max_nodes: int = 150, kinds: tuple[str, ...] = GRAPH_KINDS, edges: tuple[str, ...] = GRAPH_EDGES, include_private: bool = False) -> tuple[DataFrame, DataFrame]:
    """The best connected items within a node budget, their files and dependencies, and typed edges.

    nodes: id, label, cls, file_path, line_start; edges: src, label, dst.
    Dependencies come on top of the budget.  ``edges``: names as drawn, see
    ``EDGE_NAMES``.
    """
    kept = cut(graph.budget_best(_candidates(g, kinds, include_private), max_nodes).select("id", "rank").join(g.atoms, "id"))
    start = F.col("line_start") if "line_start" in kept.columns else F.lit(0)
    items = kept.select("id", S.item_label(F.col("kind"), F.col("name"), F.col("parent"), F.col("file_path")).alias("label"), F.when(F.col("kind") == "function", "functionNode").otherwise("classNode").alias("cls"), "file_path", start.alias("line_start"))
    held = kept.select("file_path").distinct()
    files = held.select(F.concat(F.lit("code:"), "file_path").alias("id"), S.basename(F.col("file_path")).alias("label"), F.lit("fileNode").alias("cls"), "file_path", F.lit(0).alias("line_start"))
    nodes = items.unionByName(files)
    found = graph.typed_edges(nodes, g.edges).where("src <> dst and label in ('calls', 'references')").where(F.col("label").isin(*edges))
    place = kept.select("id", "file_path", "kind", "name", "parent")
    ends = lambda e: e.join(place.select(F.col("id").alias("src")), "src", "left_semi").join(place.select(F.col("id").alias("dst")), "dst", "left_semi")
    if "implements" in edges:
        types = place.where(F.col("parent").isNull() & F.col("kind").isin(*resolve.TYPE_KINDS))
        found = found.unionByName(ends(graph.implement_owners(g.atoms, g.edges, types)).select("src", F.lit("implements").alias("label"), "dst")).unionByName(ends(graph.dispatches(g.atoms, g.edges)).select("src", F.lit("dispatches to").alias("label"), "dst"))
    if "defines" in edges:
        found = found.unionByName(place.select(F.concat(F.lit("code:"), "file_path").alias("src"), F.lit("defines").alias("label"), F.col("id").alias("dst")))
    found = cut(found.distinct())
    if "imports" in edges:
        at = lambda c, n: place.select(F.col("id").alias(c), F.col("file_path").alias(n))
        linked = found.join(at("src", "src_file"), "src").join(at("dst", "dst_file"), "dst").select("src_file", "dst_file")
        modules = g.atoms.where("kind = 'module'").select("id", "file_path").join(held, "file_path", "left_semi")
        imports = g.edges.where("kind = 'imports' and src <> dst").join(modules.select(F.col("id").alias("src"), F.col("file_path").alias("src_file")), "src").join(modules.select(F.col("id").alias("dst"), F.col("file_path").alias("dst_file")), "dst").select("src_file", "dst_file")
        found = found.unionByName(graph.suppressed_imports(imports, linked).select(F.concat(F.lit("code:"), "src_file").alias("src"), F.lit("imports").alias("label"), F.concat(F.lit("code:"), "dst_file").alias("dst")))
    if "depends on" in edges:
        deps = cut(graph.dependencies(g.atoms, g.edges).join(held, "file_path", "left_semi"))
        entity = F.concat(F.lit("dep:"), "head")
        nodes = nodes.unionByName(deps.select(entity.alias("id"), F.col("head").alias("label"), F.lit("dependencyNode").alias("cls"), F.lit(None).cast("string").alias("file_path"), F.lit(0).alias("line_start")).distinct())
        found = found.unionByName(deps.select(F.concat(F.lit("code:"), "file_path").alias("src"), F.lit("depends on").alias("label"), entity.alias("dst")))
    return nodes, found


def graph_text(g: graph.CodeGraph, max_nodes: int = 150, kinds: tuple[str, ...] = GRAPH_KINDS, edges: tuple[str, ...] = GRAPH_EDGES, group_depth: int = 2, include_private: bool = False, fmt: str = "mermaid") -> str:
    """The knowledge graph as a diagram with nested groups; what did not fit is counted."""
    nodes, found = knowledge_graph(g, max_nodes, kinds, edges, include_private)
    nodes = cut(nodes)
    n = {r["cls"]: r["n"] for r in nodes.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()}
    items = n.get("functionNode", 0) + n.get("classNode", 0)
    head = render.graph_head(n.get("fileNode", 0), items, n.get("dependencyNode", 0), _candidates(g, kinds, include_private).count() - items, fmt)
    return render.document(render.graph_lines(nodes, found, group_depth, fmt), head, "}" if fmt == "dot" else "").first()["text"]


def sequences(files: DataFrame, target: str | None = None, most: int = sequence.MAX_DEPTH) -> DataFrame:
    """``fn_id, diagram`` of every function, or of the one called ``target``."""
    s = sequence.steps(files, most)
    if target:
        s = s.where((F.col("fn_id") == target) | (F.col("fn_name") == target) | F.endswith("fn_id", F.lit("::" + target)))
    return sequence.text(s)


def documents(g: graph.CodeGraph, source_root: str, generated_at: str, files: DataFrame | None = None) -> DataFrame:
    """``path, content`` of a bundle; with ``files`` also the sequences of their functions."""
    drawn = None
    if files is not None:
        fn = sequences(files).select(F.col("fn_id").alias("id"), "diagram").join(g.atoms.select("id", "file_path"), "id")
        drawn = fn.select("file_path", S.qualified_fn_name(F.col("id")).alias("fn_name"), "diagram")
    n, e = overview(g)
    return catalog.documents(g.atoms.where("kind <> 'extern'"), g.edges, render.mermaid(n, e), source_root, generated_at, drawn)


def bundle(g: graph.CodeGraph, root: str, snapshot: str, force: bool = False) -> bool:
    return catalog.write(catalog.rows(g.atoms, g.edges), root, snapshot, force)


def compare(spark, root: str, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """(changes, blast radius) of two bundled snapshots."""
    a, b = catalog.read(spark, root, old), catalog.read(spark, root, new)
    c = cut(diff.changes(a.select("id", "content_hash"), b.select("id", "content_hash")))
    edges = b.select(F.col("id").alias("src"), F.explode("edges_out").alias("dst")).unionByName(a.select(F.col("id").alias("src"), F.explode("edges_out").alias("dst")))
    return c, diff.blast_radius(c, edges)


def difference_text(spark, root: str, old: str, new: str) -> str:
    """The differences of two bundled snapshots as a flowchart."""
    a, b = catalog.read(spark, root, old), catalog.read(spark, root, new)
    c, _ = compare(spark, root, old, new)
    about = b.select("id", "kind", "name", "file").unionByName(a.join(b.select("id"), "id", "left_anti").select("id", "kind", "name", "file"))
    edges = b.select(F.col("id").alias("src"), F.explode("edges_out").alias("dst"))
    return render.document(diff.lines(c.join(about, "id", "left"), edges), diff.head(old, new)).first()["text"]


def text(nodes: DataFrame, edges: DataFrame, fmt: str = "mermaid") -> str:
    df = render.dot(nodes, edges) if fmt == "dot" else render.mermaid(nodes, edges)
    return df.first()["text"]
