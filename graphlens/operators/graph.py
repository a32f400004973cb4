"""The code graph as DataFrames: accessors, upsert, roll-ups, degrees, budgets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars as S
from ..session import cut


@dataclass
class CodeGraph:
    """``atoms``, ``edges`` (a bag) and ``call_sites``; see ``schema`` for columns."""

    atoms: DataFrame
    edges: DataFrame
    call_sites: DataFrame | None = None

    def atoms_by_kind(self, *kinds: str) -> DataFrame:
        return self.atoms.where(F.col("kind").isin(*kinds))

    def atoms_in_file(self, path: str) -> DataFrame:
        return self.atoms.where(F.col("file_path") == path)

    def items_in_order(self, path: str) -> DataFrame:
        """The items of a file by line, then by id."""
        return self.atoms_in_file(path).where("kind <> 'module'").orderBy("line_start", "id")

    def atom(self, entity: str) -> DataFrame:
        return self.atoms.where(F.col("id") == entity)

    def edges_from(self, entity: str, kind: str | None = None) -> DataFrame:
        e = self.edges.where(F.col("src") == entity)
        return e.where(F.col("kind") == kind) if kind else e

    def edges_to(self, entity: str, kind: str | None = None) -> DataFrame:
        e = self.edges.where(F.col("dst") == entity)
        return e.where(F.col("kind") == kind) if kind else e

    def children_of(self, entity: str) -> DataFrame:
        return self.edges_from(entity, "contains").select("dst")

    def has_call_edge(self, src: str, dst: str) -> bool:
        return not self.edges.where((F.col("src") == src) & (F.col("dst") == dst) & (F.col("kind") == "calls")).isEmpty()


def upsert(atoms: DataFrame, *key: str) -> DataFrame:
    """The last atom of each key by ``seq``, at the place of the first (``seq_first``).

    Null keys form a group of their own; equal ``seq`` goes by the content hash.
    """
    by = Window.partitionBy(*(key or ("id",)))
    last = F.row_number().over(by.orderBy(F.desc("seq"), F.desc("content_hash")))
    return atoms.withColumn("_n", last).withColumn("seq_first", F.min("seq").over(by)).where("_n = 1").drop("_n")


def _ends(edges: DataFrame, vertices: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``edges`` with columns of both ends as ``src_x``, ``dst_x``; dangling ones drop."""
    out = edges
    for side in ("src", "dst"):
        v = vertices.select(F.col("id").alias(side), *(F.col(c).alias(f"{side}_{n}") for n, c in columns.items()))
        out = out.join(v, side)
    return out


def project_nodes(atoms: DataFrame) -> DataFrame:
    """Per crate: ``modules, functions, structs``; atoms without a crate are left out."""
    crate = S.crate_name(F.col("file_path"))
    return atoms.select(crate.alias("crate"), "kind").where("crate <> ''").groupBy("crate").agg(
        F.count_if(F.col("kind") == "module").alias("modules"), F.count_if(F.col("kind") == "function").alias("functions"),
        F.count_if(F.col("kind").isin(*schema.STRUCT_KINDS)).alias("structs"),
    )


def project_edges(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls between crates, counted as a bag: ``src_crate, dst_crate, calls``."""
    v = atoms.where(F.col("kind").isin("function", *schema.STRUCT_KINDS)).select("id", "kind", S.crate_name(F.col("file_path")).alias("crate"))
    both = _ends(edges.where("kind = 'calls'").select("src", "dst"), v, {"crate": "crate", "kind": "kind"})
    return both.where("src_kind = 'function' and src_crate <> dst_crate").groupBy("src_crate", "dst_crate").agg(F.count(F.lit(1)).alias("calls"))


def overview_nodes(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """Per module: ``functions, structs, traits`` among children, and methods one level down."""
    kids = edges.where("kind = 'contains'").select("src", "dst")
    item = atoms.select(F.col("id").alias("dst"), F.col("kind").alias("k"))
    direct = kids.join(item, "dst").select(F.col("src").alias("id"), "dst", "k")
    held = direct.where("k in ('impl', 'struct')").select("id", F.col("dst").alias("src"))
    grand = held.join(kids, "src").join(item, "dst").where("k = 'function'").select("id", "dst", F.lit("method").alias("k"))
    counts = direct.unionByName(grand).groupBy("id").agg(
        F.count_if(F.col("k").isin("function", "method")).alias("functions"), F.count_if(F.col("k") == "struct").alias("structs"), F.count_if(F.col("k") == "trait").alias("traits")
    )
    m = atoms.where("kind = 'module'").select("id", "name", "file_path")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return m.join(counts, "id", "left").select("id", S.display_name(F.col("name"), F.col("file_path")).alias("label"), zero("functions"), zero("structs"), zero("traits"))


def overview_edges(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls between functions of different files: ``src_file, dst_file, calls``."""
    v = atoms.where("kind = 'function'").select("id", "file_path")
    both = _ends(edges.where("kind = 'calls'").select("src", "dst"), v, {"file": "file_path"})
    return both.where("src_file <> dst_file").groupBy("src_file", "dst_file").agg(F.count(F.lit(1)).alias("calls"))


def module_items(atoms: DataFrame, file_path: str) -> DataFrame:
    return atoms.where((F.col("file_path") == file_path) & (F.col("kind") != "module")).select("id", S.short_kind(F.col("kind")).alias("kind"), "name")


def module_calls(atoms: DataFrame, edges: DataFrame, file_path: str, which: str) -> DataFrame:
    """Distinct calls of one file: ``which`` is intra, outgoing or incoming."""
    inside = atoms.where(F.col("file_path") == file_path).select("id")
    known = atoms.select("id")
    e = edges.where("kind = 'calls'").select("src", "dst")
    if which == "intra":
        out = e.join(inside.withColumnRenamed("id", "src"), "src", "left_semi").join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi")
    else:
        near, far = ("src", "dst") if which == "outgoing" else ("dst", "src")
        out = e.join(inside.withColumnRenamed("id", near), near, "left_semi").join(inside.withColumnRenamed("id", far), far, "left_anti").join(known.withColumnRenamed("id", far), far, "left_semi")
    return out.select("src", "dst").distinct()


def function_neighbours(atoms: DataFrame, edges: DataFrame, entity: str, which: str) -> DataFrame:
    """Direct callers or callees of a function with their names; a bag."""
    mine, other = ("dst", "src") if which == "callers" else ("src", "dst")
    e = edges.where((F.col("kind") == "calls") & (F.col(mine) == entity)).select(F.col(other).alias("id"))
    return e.join(atoms.select("id", "name"), "id")


def merged_sites(edges: DataFrame) -> DataFrame:
    """Parallel calls as one edge with all their ranks, sorted and distinct."""
    return edges.where("kind = 'calls'").groupBy("src", "dst").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("sites", F.array().cast("array<int>")))))).alias("sites"), F.min("seq").alias("seq")
    )


def group_sites(sites: DataFrame) -> DataFrame:
    """Bound call sites (src, dst, rank, seq) as edges with sorted ranks."""
    return sites.groupBy("src", "dst").agg(F.array_sort(F.collect_list("rank")).alias("sites"), F.min("seq").alias("seq")).select(
        "src", "dst", F.lit("calls").alias("kind"), F.lit(None).cast("string").alias("role"), "sites", "seq"
    )


def site_label(n: str = "n", rank: str = "rank", flags: str = "flags"):
    """``3 await alt loop x2`` from the first site's rank and flags and the count."""
    word = lambda bit, w: F.when(S.has_flag(F.col(flags), bit), w)
    return F.concat_ws(" ", (F.col(rank) + 1).cast("string"), word(schema.AWAIT, "await"), word(schema.CONDITIONAL, "alt"), word(schema.REPEATED, "loop"), F.when(F.col(n) > 1, F.concat(F.lit("x"), F.col(n).cast("string"))))


def edge_labels(merged: DataFrame, sites: DataFrame) -> DataFrame:
    """``src, dst, label`` of merged edges; null where an edge has no ranks."""
    one = merged.select("src", "dst", F.explode("sites").alias("rank")).join(sites.select(F.col("caller_id").alias("src"), "rank", "flags").distinct(), ["src", "rank"], "left")
    by = one.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rank", F.coalesce("flags", F.lit(0)).alias("flags"))).alias("m"))
    return by.select("src", "dst", "n", "m.rank", "m.flags").select("src", "dst", site_label().alias("label"))


def unresolved_leaves(merged: DataFrame, sites: DataFrame) -> DataFrame:
    """Sites that no edge claims, by caller and name: ``id, caller_id, name, label``.

    Names of the skip list are left out here and counted by ``skipped_sites``.
    """
    return _unclaimed(merged, sites).where(~S.split_call(F.col("name"))[1].isin(*schema.SKIP_CALLS)).groupBy("caller_id", "name").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("rank", "flags")).alias("m")
    ).select("caller_id", "name", "n", "m.rank", "m.flags").select(F.concat(F.lit("unresolved::"), "caller_id", F.lit("::"), "name").alias("id"), "caller_id", "name", site_label().alias("label"))


def _unclaimed(merged: DataFrame, sites: DataFrame) -> DataFrame:
    claimed = merged.select(F.col("src").alias("caller_id"), F.explode("sites").alias("rank")).distinct()
    return sites.join(claimed, ["caller_id", "rank"], "left_anti")


def skipped_sites(merged: DataFrame, sites: DataFrame) -> DataFrame:
    """Unclaimed sites with a skipped name per caller: ``caller_id, skipped``."""
    return _unclaimed(merged, sites).where(S.split_call(F.col("name"))[1].isin(*schema.SKIP_CALLS)).groupBy("caller_id").agg(F.count(F.lit(1)).alias("skipped"))


def degrees(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, degree, cross_degree`` over calls and uses in both directions, as a bag.

    Edges with an external end are left out; atoms without edges have zeros.
    """
    v = atoms.where("kind <> 'extern'").select("id", "file_path")
    both = _ends(edges.where("kind in ('calls', 'uses')").select("src", "dst"), v, {"file": "file_path"})
    cross = (F.col("src_file") != F.col("dst_file")).cast("int").alias("x")
    sides = both.select(F.col("src").alias("id"), cross).unionAll(both.select(F.col("dst").alias("id"), cross))
    d = sides.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("x").alias("cross_degree"))
    return v.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("cross_degree", F.lit(0)).alias("cross_degree"))


def degree_rank(atoms: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """The ``most`` best connected atoms with their ``rank``: a top-k report.

    The limit is a heap per partition and a merge, so that the window that
    numbers the rows sees ``most`` rows and not the graph.
    """
    order = [F.desc("cross_degree"), F.desc("degree"), F.asc("id")]
    top = degrees(atoms, edges).join(atoms.select("id", "file_path"), "id").orderBy(*order).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def budget_best(items: DataFrame, budget: int) -> DataFrame:
    """``id, file_path, rank`` of the best connected items that fit a node budget, over all items.

    ``items``: id, file_path, degree, cross_degree.  The prefix lies within the
    first ``budget`` ranks; if it leaves one place, the best item of all further
    ranks whose file is already in takes it.
    """
    order = [F.desc("cross_degree"), F.desc("degree"), F.asc("id")]
    items = cut(items.select("id", "file_path", "degree", "cross_degree"))
    top = items.orderBy(*order).limit(budget).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    kept = cut(budget_fill(top.select("id", "file_path", "rank"), budget))
    used = kept.count() + kept.select("file_path").distinct().count()
    if used != budget - 1:
        return kept
    later = items.join(F.broadcast(kept.select("file_path").distinct()), "file_path", "left_semi").join(F.broadcast(kept.select("id")), "id", "left_anti")
    x = later.orderBy(*order).first()
    if x is None:
        return kept
    c, d = F.col("cross_degree"), F.col("degree")
    ahead = items.where((c > x["cross_degree"]) | (c == x["cross_degree"]) & ((d > x["degree"]) | (d == x["degree"]) & (F.col("id") < x["id"]))).count()
    return kept.unionByName(items.sparkSession.createDataFrame([(x["id"], x["file_path"], ahead + 1)], kept.schema))


def budget_fill(ranked: DataFrame, budget: int) -> DataFrame:
    """Items that fit a node budget in order of rank; a new file costs one more.

    Costs are one or two, so a prefix fits, and after it at most the first item
    whose file is already in, if one place is left.  ``ranked``: id, file_path,
    rank.  The windows hold all of it: ``budget_best`` takes a whole graph.
    Returns the accepted rows.
    """
    one = Window.partitionBy("file_path").orderBy("rank")
    all_ = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    cost = ranked.withColumn("cost", F.lit(1) + (F.row_number().over(one) == 1).cast("int")).withColumn("total", F.sum("cost").over(all_))
    prefix = cost.withColumn("in", F.col("total") <= budget)
    whole = Window.partitionBy(F.lit(1))
    state = prefix.withColumn("used", F.max(F.when(F.col("in"), F.col("total"))).over(whole)).withColumn("file_in", F.max("in").over(Window.partitionBy("file_path")))
    extra = F.min(F.when(~F.col("in") & F.col("file_in") & (F.coalesce("used", F.lit(0)) == budget - 1), F.col("rank"))).over(whole)
    return state.withColumn("extra", extra).where("in or rank = extra").drop("cost", "total", "in", "used", "file_in", "extra")


def extern_dependencies(atoms: DataFrame) -> DataFrame:
    """Per dependency named by external atoms: in how many files.  ``head, files``."""
    first = F.substring_index(F.col("signature"), "::", 1)
    ext = atoms.where("kind = 'extern' and signature is not null").select(first.alias("head"), "file_path")
    return ext.where(S.is_dependency_name(F.col("head"))).groupBy("head").agg(F.countDistinct("file_path").alias("files"))


def suppressed_imports(imports: DataFrame, item_edges: DataFrame) -> DataFrame:
    """Import edges between files that no item edge links in that direction.

    Both: ``src_file, dst_file``.
    """
    return imports.distinct().join(item_edges.distinct(), ["src_file", "dst_file"], "left_anti")


def typed_edges(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (src, label, dst) of a graph view: calls, references, defines, ..."""
    label = F.create_map(*(F.lit(x) for x in ("calls", "calls", "uses", "references", "contains", "defines", "implements", "implements", "imports", "imports")))
    known = atoms.select("id")
    e = edges.where(F.col("kind").isin("calls", "uses", "contains", "implements", "imports"))
    e = e.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return e.select("src", label[F.col("kind")].alias("label"), "dst").distinct()


def dependencies(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """``file_path, head``: which files call into which dependency outside the graph."""
    ext = atoms.where("kind = 'extern' and signature is not null").select(F.col("id").alias("dst"), F.substring_index("signature", "::", 1).alias("head")).where(S.is_dependency_name(F.col("head")))
    by = atoms.where("kind = 'function' and file_path <> ''").select(F.col("id").alias("src"), "file_path")
    return edges.where("kind = 'calls'").select("src", "dst").join(ext, "dst").join(by, "src").select("file_path", "head").distinct()


def implement_owners(atoms: DataFrame, edges: DataFrame, types: DataFrame) -> DataFrame:
    """``src, dst``: from the implementing type to the trait, drawn instead of from the impl.

    ``types``: id, name, file_path of the types that may own an impl.  The type
    is looked for in the impl's file, then in the files that it imports, then
    anywhere; each place decides if it has exactly one, and the next is asked
    only if it has none.
    """
    impl = atoms.where((F.col("kind") == "impl") & (F.instr("name", " for ") > 0)).select(F.col("id").alias("impl_id"), F.col("file_path").alias("file"), F.element_at(F.split(S.strip_generics(F.substring("name", F.instr("name", " for ") + 5, F.lit(1 << 30))), "::"), -1).alias("t"))
    of = types.select(F.col("id").alias("type_id"), F.col("name").alias("t"), F.col("file_path").alias("type_file"))
    one = [F.count(F.lit(1)).alias("n"), F.min("type_id").alias("type_id")]
    here = of.groupBy("t", F.col("type_file").alias("file")).agg(*one)
    anywhere = of.groupBy("t").agg(F.count(F.lit(1)).alias("n_any"), F.min("type_id").alias("any"))
    files = atoms.where("kind = 'module'").select("id", "file_path")
    imported = edges.where("kind = 'imports'").select("src", "dst").distinct().join(files.select(F.col("id").alias("src"), F.col("file_path").alias("file")), "src").join(files.select(F.col("id").alias("dst"), F.col("file_path").alias("type_file")), "dst").select("file", "type_file")
    near = impl.join(imported, "file").join(here.withColumnRenamed("file", "type_file"), ["t", "type_file"]).groupBy("impl_id").agg(F.sum("n").alias("n_near"), F.min("type_id").alias("near"))
    found = impl.join(here.select("t", "file", F.col("n").alias("n_here"), F.col("type_id").alias("here")), ["t", "file"], "left").join(near, "impl_id", "left").join(anywhere, "t", "left")
    pick = F.when(F.col("n_here").isNotNull(), F.when(F.col("n_here") == 1, F.col("here"))).when(F.col("n_near").isNotNull(), F.when(F.col("n_near") == 1, F.col("near"))).when(F.col("n_any") == 1, F.col("any"))
    owner = found.select("impl_id", pick.alias("owner")).where("owner is not null")
    return edges.where("kind = 'implements'").select(F.col("src").alias("impl_id"), "dst").join(owner, "impl_id").select(F.col("owner").alias("src"), "dst").distinct()


def dispatches(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """``src, dst``: from a trait's method to the methods that implement it."""
    fns = atoms.where("kind = 'function'").select("id")
    return edges.where("kind = 'implements'").select(F.col("dst").alias("src"), F.col("src").alias("dst")).join(fns.withColumnRenamed("id", "src"), "src", "left_semi").join(fns.withColumnRenamed("id", "dst"), "dst", "left_semi").distinct()
