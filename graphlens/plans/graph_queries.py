"""Queries of the code graph over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import catalog, diff, graph, parsing, render, resolve, sequence, traverse
from ..session import table
from . import projections as P

_FILE = "crates/ASIA/src/NATION_2.rs"
_ROOT = "000000"
_BUDGET = 60
_Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- roll-ups ------------------------------------------------------------------
@query("""with a as (select *, row_number() over (partition by file_id, id order by seq desc, content_hash desc) n from atoms)
select case when file_path like 'crates/%' then split_part(file_path, '/', 2) else split_part(file_path, '/', 1) end crate,
  count(*) filter (kind = 'module') modules, count(*) filter (kind = 'function') functions,
  count(*) filter (kind in ('struct', 'enum', 'trait', 'type_alias', 'union', 'impl')) structs from a where n = 1 group by 1 having crate <> ''""")
def project_nodes(spark, d):
    return graph.project_nodes(graph.upsert(table(spark, d, "atoms"), "file_id", "id"))


@query(f"with {P.TRADE} select a.crate src_crate, b.crate dst_crate, count(*) calls from e join v a on a.id = src join v b on b.id = dst where a.crate <> b.crate group by all")
def project_edges(spark, d):
    return graph.project_edges(P.trade_vertices(spark, d), P.trade_edges(spark, d))


@query("""with c as (select c_custkey, 'N'||c_nationkey id, case c_mktsegment when 'BUILDING' then 'struct' when 'MACHINERY' then 'trait' else 'impl' end k from customer)
select 'N'||n_nationkey id, n_name as label, coalesce(fn, 0) functions, coalesce(st, 0) structs, coalesce(tr, 0) traits from nation
left join (select id, count(*) filter (k = 'struct') st, count(*) filter (k = 'trait') tr from c group by 1) a on a.id = 'N'||n_nationkey
left join (select c.id, count(*) fn from c join orders on o_custkey = c_custkey where k in ('impl', 'struct') group by 1) b on b.id = 'N'||n_nationkey""")
def overview_nodes(spark, d):
    return graph.overview_nodes(P.nest_atoms(spark, d), P.nest_edges(spark, d))


@query(f"with {P.TRADE} select a.file_path src_file, b.file_path dst_file, count(*) calls from e join v a on a.id = src join v b on b.id = dst where a.file_path <> b.file_path group by all")
def overview_edges(spark, d):
    return graph.overview_edges(P.trade_vertices(spark, d), P.trade_edges(spark, d))


@query(f"with {P.TRADE} select id, 'fn' kind, id as name from v where file_path = '{_FILE}'")
def module_items(spark, d):
    return graph.module_items(P.trade_vertices(spark, d), _FILE)


def _module(which: str):
    def f(spark, d):
        return graph.module_calls(P.trade_vertices(spark, d), P.trade_edges(spark, d), _FILE, which)

    f.__name__ = f"module_{which}"
    a, b = {"intra": ("=", "="), "outgoing": ("=", "<>"), "incoming": ("<>", "=")}[which]
    return query(f"with {P.TRADE} select src, dst from e join v a on a.id = src join v b on b.id = dst where a.file_path {a} '{_FILE}' and b.file_path {b} '{_FILE}'")(f)


for _w in ("intra", "outgoing", "incoming"):
    _module(_w)


@query(f"with {P.TRADE} select id, id as name from e join v on id = src where dst = 'S1'")
def function_callers(spark, d):
    return graph.function_neighbours(P.trade_vertices(spark, d), P.trade_edges(spark, d), "S1", "callers")


@query(f"with {P.TRADE} select id, id as name from e join v on id = dst where src = 'C1'")
def function_callees(spark, d):
    return graph.function_neighbours(P.trade_vertices(spark, d), P.trade_edges(spark, d), "C1", "callees")


_DEGREE = f"""{P.TRADE}, bo as (select src, dst, (a.file_path <> b.file_path)::int x from e join v a on a.id = src join v b on b.id = dst),
dg as (select v.id, v.file_path, coalesce(degree, 0) degree, coalesce(cross_degree, 0) cross_degree from v left join (
  select id, count(*) degree, sum(x)::bigint cross_degree from (select src id, x from bo union all select dst, x from bo) group by 1) q on q.id = v.id),
top as (select *, row_number() over (order by cross_degree desc, degree desc, id) rank from dg)"""


@query(f"with {_DEGREE} select id, degree, cross_degree from dg")
def degree(spark, d):
    return graph.degrees(P.trade_vertices(spark, d), P.trade_edges(spark, d))


@query(f"with {_DEGREE} select id, degree, cross_degree, file_path, rank from top where rank <= 100")
def degree_rank(spark, d):
    return graph.degree_rank(P.trade_vertices(spark, d), P.trade_edges(spark, d), 100)


@query(f"""with {_DEGREE}, c as (select *, 1 + (row_number() over (partition by file_path order by rank) = 1)::int cost from top),
t as (select *, sum(cost) over (order by rank) total from c), u as (select *, total <= {_BUDGET} ok, bool_or(total <= {_BUDGET}) over (partition by file_path) fi, max(case when total <= {_BUDGET} then total end) over () used from t),
x as (select min(rank) r from u where not ok and fi and used = {_BUDGET} - 1) select id, file_path, rank from u where ok or rank = (select r from x)""")
def budget_fill(spark, d):
    v = P.trade_vertices(spark, d)
    return graph.budget_best(graph.degrees(v, P.trade_edges(spark, d)).join(v.select("id", "file_path"), "id"), _BUDGET)


@query("""select split_part(signature, '::', 1) head, count(distinct file_path) files from atoms where kind = 'extern' and signature is not null
and regexp_matches(head, '^[a-z]') and head not in ('std','core','alloc','self','super','crate','u8','u16','u32','u64','u128','usize','i8','i16','i32','i64','i128','isize','f32','f64','bool','char','str') group by 1""")
def extern_deps(spark, d):
    return graph.extern_dependencies(table(spark, d, "atoms"))


@query(f"""with {P.TRADE}, w as (select id from v union select 'N'||n_nationkey from nation),
x as (select src, 'calls' as label, dst from e union select 'N'||c_nationkey, 'defines', 'C'||c_custkey from customer)
select src, label, dst from x where src in (select id from w) and dst in (select id from w)""")
def graph_typed_edges(spark, d):
    atoms = P.trade_vertices(spark, d).select("id").unionByName(P.nest_atoms(spark, d).where("kind = 'module'").select("id")).distinct()
    edges = P.trade_edges(spark, d).unionByName(P.nest_edges(spark, d).where("src like 'N%'"))
    return graph.typed_edges(atoms, edges)


@query(f"""with {P.EVENTS}, fe as (select distinct a.file_path sf, b.file_path df from e join v a on a.id = src join v b on b.id = dst where seq % 2 = 0),
im as (select distinct a.file_path sf, b.file_path df from e join v a on a.id = src join v b on b.id = dst where seq % 2 = 1)
select sf src_file, df dst_file from im anti join fe using (sf, df)""")
def import_suppression(spark, d):
    v = P.event_vertices(spark, d).select("id", "file_path")
    e = P.event_edges(spark, d).join(v.select(F.col("id").alias("src"), F.col("file_path").alias("src_file")), "src").join(v.select(F.col("id").alias("dst"), F.col("file_path").alias("dst_file")), "dst")
    return graph.suppressed_imports(e.where("seq % 2 = 1").select("src_file", "dst_file"), e.where("seq % 2 = 0").select("src_file", "dst_file"))


@query("""select file_id, id, name, kind, seq, seq_first from (select *, row_number() over (partition by file_id, id order by seq desc, content_hash desc) n, min(seq) over (partition by file_id, id) seq_first from atoms) where n = 1""")
def atom_upsert(spark, d):
    return graph.upsert(table(spark, d, "atoms"), "file_id", "id").select("file_id", "id", "name", "kind", "seq", "seq_first")


@query("select id, name, file_path, seq from atoms where kind in ('trait', 'enum')")
def atoms_by_kind(spark, d):
    return graph.CodeGraph(table(spark, d, "atoms"), P.trade_edges(spark, d)).atoms_by_kind("trait", "enum").select("id", "name", "file_path", "seq")


# -- call sites and traversals ----------------------------------------------------
@query(f"with {P.EVENTS} select src caller_id, rank, name, seq from s")
def call_ranks(spark, d):
    return P.event_sites(spark, d).select("caller_id", "rank", "name", "seq")


@query(f"with {P.EVENTS} select src, dst, string_agg(rank::varchar, ',' order by rank) sites from s where dst is not null group by all")
def edge_sites(spark, d):
    return P.event_edges(spark, d).select("src", "dst", F.array_join(F.col("sites").cast("array<string>"), ",").alias("sites"))


_LABEL = "concat_ws(' ', (rank + 1)::varchar, case when flags & 1 <> 0 then 'await' end, case when flags & 2 <> 0 then 'alt' end, case when flags & 4 <> 0 then 'loop' end, case when n > 1 then 'x'||n end)"


@query(f"with {P.EVENTS}, q as (select src, dst, count(*) n, min(rank) rank, arg_min(flags, rank) flags from s where dst is not null group by all) select src, dst, {_LABEL} as label from q")
def site_labels(spark, d):
    sites = P.event_sites(spark, d)
    return graph.edge_labels(graph.merged_sites(P.event_edges(spark, d)), sites)


@query(f"with {P.EVENTS}, q as (select src, name, count(*) n, min(rank) rank, arg_min(flags, rank) flags from s where dst is null and name <> 'push' group by all) select 'unresolved::'||src||'::'||name id, src caller_id, name, {_LABEL} as label from q")
def flow_leaves(spark, d):
    return graph.unresolved_leaves(graph.merged_sites(P.event_edges(spark, d)), P.event_sites(spark, d))


def _level(k: int, near: str, far: str, t: str) -> str:
    """One unrolled level of the breadth-first walk as SQL."""
    seen = " union all ".join(f"select node from {t}f{j}" for j in range(k))
    return f"""{t}x{k} as (select f.node, f.pos, f.path, e.{far} m, e.seq from {t}f{k - 1} f join e on e.{near} = f.node where e.{far} <> '{_ROOT}' and not list_contains(f.path, e.{far})),
{t}f{k} as (select m node, row_number() over (order by pos, seq) pos, list_append(path, m) path from (select *, row_number() over (partition by m order by pos, seq) n from {t}x{k} where m not in ({seen})) where n = 1)"""


def _bfs(reverse: bool, t: str) -> str:
    near, far = ("dst", "src") if reverse else ("src", "dst")
    return f"{t}f0 as (select '{_ROOT}' node, 1::bigint pos, ['{_ROOT}'] path), " + ", ".join(_level(k, near, far, t) for k in (1, 2, 3))


_BACK, _ON = _bfs(True, "b"), _bfs(False, "o")
_EDGES = lambda t: " union ".join(f"select {'m src, node dst' if t == 'b' else 'node src, m dst'} from {t}x{k}" for k in (1, 2, 3))
_NODES = lambda t: " union ".join(f"select node id from {t}f{k}" for k in (0, 1, 2, 3))


@query(f"with {P.EVENTS}, {_BACK}, {_ON} {_EDGES('b')} union {_EDGES('o')}")
def impact_edges(spark, d):
    return traverse.impact(P.event_edges(spark, d), _ROOT)[0]


@query(f"with {P.EVENTS}, {_BACK}, {_ON} {_NODES('b')} union {_NODES('o')}")
def impact_nodes(spark, d):
    return traverse.impact(P.event_edges(spark, d), _ROOT)[1]


@query(f"with {P.EVENTS}, {_BACK} {_NODES('b')}")
def reverse_reachable(spark, d):
    return traverse.bounded_bfs(P.event_edges(spark, d), _ROOT, 3, reverse=True)[1].select("id")


_FLOW = f"""{P.EVENTS}, adj as (select src, dst, ext from e join v on v.id = dst),
w0 as (select '{_ROOT}' node, ['{_ROOT}'] path),
y1 as (select node, path, dst m, ext, list_contains(path, dst) back from w0 join adj on src = node),
w1 as (select m node, list_append(path, m) path from y1 where not back and not ext),
y2 as (select node, path, dst m, ext, list_contains(path, dst) back from w1 join adj on src = node where not ext),
w2 as (select m node, list_append(path, m) path from y2 where not back and not ext),
y3 as (select node, path, dst m, ext, list_contains(path, dst) back from w2 join adj on src = node where not ext),
w3 as (select m node, list_append(path, m) path from y3 where not back and not ext),
dr as (select node src, m dst, case when back then 'recursive' else 'call' end as label, list_append(path, m) k, path, 0 late from (select * from y1 union all select * from y2 union all select * from y3)),
lm as (select node src, min(dst) dst, 'cycle' as label, path k, path, 1 late from w3 join e on e.src = node where list_contains(path, dst) group by node, path),
al as (select * from dr union all select * from lm)"""


@query(f"with {_FLOW} select src, dst, label from (select *, row_number() over (partition by src, dst order by k, late) n from al) where n = 1")
def flow_edges(spark, d):
    return traverse.flow(P.event_edges(spark, d), P.event_vertices(spark, d), _ROOT)["edges"]


@query(f"with {_FLOW} select dst id from dr where label = 'call' union select '{_ROOT}'")
def flow_nodes(spark, d):
    return traverse.flow(P.event_edges(spark, d), P.event_vertices(spark, d), _ROOT)["nodes"]


@query(f"with {_FLOW} select distinct unnest(list_append(path, dst)) id from dr where label = 'recursive'")
def flow_cycle_nodes(spark, d):
    return traverse.flow(P.event_edges(spark, d), P.event_vertices(spark, d), _ROOT)["cycle"]


@query(f"with {_FLOW}, wk as (select node from w0 union all select node from w1 union all select node from w2) select node, count(*) walks, sum(coalesce(k, 0))::bigint skipped from wk left join (select src, count(*) k from s where dst is null and name = 'push' group by 1) q on q.src = node group by 1")
def flow_skipped(spark, d):
    w = traverse.flow(P.event_edges(spark, d), P.event_vertices(spark, d), _ROOT)["walks"]
    k = graph.skipped_sites(graph.merged_sites(P.event_edges(spark, d)), P.event_sites(spark, d)).withColumnRenamed("caller_id", "node")
    return w.join(k, "node", "left").groupBy("node").agg(F.count(F.lit(1)).alias("walks"), F.sum(F.coalesce("skipped", F.lit(0))).alias("skipped"))


@query(f"""with recursive {P.EVENTS}, nx as (select src, arg_min(dst, (seq, dst)) nxt from e where src <> '{_ROOT}' group by 1),
w(step, id, path) as (select 0, '000001', ['000001'] union all select step + 1, nxt, list_append(path, nxt) from w join nx on nx.src = w.id where not list_contains(path, nxt)) select step, id from w""")
def call_path(spark, d):
    return traverse.shortest_path(P.event_edges(spark, d), "000001", _ROOT)


# -- resolution ----------------------------------------------------------------------
def _decided(spark, d):
    sites = P.code_sites(spark, d)
    return resolve.decide_calls(P.code_atoms(spark, d), P.code_edges(sites), sites, P.code_imports(spark, d))


def _resolved(spark, d):
    sites = P.code_sites(spark, d)
    return resolve.resolve_calls(P.code_atoms(spark, d), P.code_edges(sites), sites, P.code_imports(spark, d))


@query(f"with recursive {P.CODE} select caller caller_id, prefix, fn, target, reason from rs")
def resolve_calls(spark, d):
    return _decided(spark, d).drop("lang")


@query(f"with recursive {P.CODE} select reason, count(*) n from rs group by 1")
def resolve_reasons(spark, d):
    return _decided(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"with recursive {P.CODE}, al as (select caller src, target dst, rank from sx where target is not null union all select caller, entity, rank from ex) select src, dst, string_agg(rank::varchar, ',' order by rank) sites from al group by all")
def resolved_edges(spark, d):
    return _resolved(spark, d)[0].select("src", "dst", F.array_join(F.col("sites").cast("array<string>"), ",").alias("sites"))


@query(f"with recursive {P.CODE} select distinct entity id, 'extern' kind, fn as name, prefix||'::'||fn signature from ex")
def extern_atoms(spark, d):
    return _resolved(spark, d)[1]


@query(f"with {P.FILE_IMPORTS} select 'code:'||src src, 'code:'||dst dst from ie where dst is not null and src <> dst")
def import_edges(spark, d):
    return resolve.import_edges(*P.file_imports(spark, d))


@query(f"""with {P.ENTITY_FILES}, i as (select repo||'/'||file importer, repo root, split_part(path, '/', -1) wanted from ep), c as (select repo||'/'||file file, repo root, split_part(path, '/', -1) b from ep),
k as (select i.importer, i.wanted, count(c.file) n, min(c.file) one, count(*) filter (c.root = i.root) ns, min(c.file) filter (c.root = i.root) mine from i left join c on c.b = i.wanted group by all)
select importer, wanted, case when n = 1 then one when ns = 1 then mine end target, n viable from k""")
def resolve_imports_suffix(spark, d):
    f = P.entity_files(spark, d)
    name = F.concat("repo", F.lit("/"), "file")
    imports = f.select(name.alias("importer"), S.basename(F.col("path")).alias("wanted"), F.col("repo").alias("root"))
    return resolve.suffix_imports(imports, f.select(name.alias("file"), "path", F.col("repo").alias("root")))


@query("""with i as (select 'code:'||p_partkey impl_id, p_brand t, 'crate'||(p_partkey % 3) c from part), t as (select distinct 'T'||s_suppkey id, 'Brand#'||(s_suppkey % 5 + 1)||(s_suppkey % 7 + 1) t, 'crate'||(s_suppkey % 3) c from supplier),
k as (select impl_id, count(*) n, count(*) filter (i.c = t.c) ns, min(id) one, min(id) filter (i.c = t.c) mine from i join t using (t) group by 1)
select impl_id, case when ns = 1 then mine else one end trait_id from k where ns = 1 or ns = 0 and n = 1""")
def implements_pairs(spark, d):
    impls = table(spark, d, "part").select(F.concat(F.lit("code:"), "p_partkey").alias("id"), F.concat(F.lit("kit::"), "p_brand", F.lit("<T> for Part")).alias("name"), F.concat(F.lit("crate"), F.col("p_partkey") % 3, F.lit("/src/a.rs")).alias("file_path"))
    traits = table(spark, d, "supplier").select(F.concat(F.lit("T"), "s_suppkey").alias("id"), F.concat(F.lit("Brand#"), F.col("s_suppkey") % 5 + 1, F.col("s_suppkey") % 7 + 1).alias("name"), F.concat(F.lit("crate"), F.col("s_suppkey") % 3, F.lit("/src/b.rs")).alias("file_path"))
    return resolve.implements(impls, traits)


@query("""with r as (select 'F'||p_partkey a, p_brand t, 'crate'||(p_partkey % 3)||'/src/f'||(p_partkey % 11)||'.rs' f, p_partkey % 3 c from part),
t as (select 'T'||s_suppkey id, 'Brand#'||(s_suppkey % 5 + 1)||(s_suppkey % 7 + 1) t, 'crate'||(s_suppkey % 3)||'/src/f'||(s_suppkey % 11)||'.rs' f, s_suppkey % 3 c from supplier),
k as (select a, count(*) n, count(*) filter (r.f = t.f) nf, count(*) filter (r.c = t.c) nc, min(id) one, min(id) filter (r.f = t.f) mf, min(id) filter (r.c = t.c) mc from r join t using (t) group by 1)
select a atom_id, case when nf = 1 then mf when nc = 1 then mc else one end target from k where nf = 1 or nf = 0 and (nc = 1 or nc = 0 and n = 1)""")
def type_refs(spark, d):
    path = lambda c: F.concat(F.lit("crate"), F.col(c) % 3, F.lit("/src/f"), F.col(c) % 11, F.lit(".rs"))
    refs = table(spark, d, "part").select(F.concat(F.lit("F"), "p_partkey").alias("atom_id"), F.col("p_brand").alias("written"), path("p_partkey").alias("file_path"))
    types = table(spark, d, "supplier").select(F.concat(F.lit("T"), "s_suppkey").alias("id"), F.concat(F.lit("Brand#"), F.col("s_suppkey") % 5 + 1, F.col("s_suppkey") % 7 + 1).alias("name"), path("s_suppkey").alias("file_path"))
    return resolve.type_targets(refs, types)


@query(f"""with recursive {P.EVENTS}, rx as (select src, dst from e where seq % 5 = 1), df as (select id from v where right(id, 1) in ('3', '7')),
c(m, t, h) as (select src, src, 0 from e union select c.m, rx.dst, h + 1 from c join rx on rx.src = c.t where c.t not in (select id from df) and h < 6)
select distinct 'k' krate, m as module, 'x' as name, 'D'||t target from c where t in (select id from df)""")
def reexport_closure(spark, d):
    edges = P.event_edges(spark, d)
    again = edges.where("seq % 5 = 1").select(F.lit("k").alias("krate"), F.col("src").alias("module"), F.lit("x").alias("name"), F.col("dst").alias("to_module"), F.lit("x").alias("to_name"))
    defined = P.event_vertices(spark, d).where(F.right("id", F.lit(1)).isin("3", "7")).select(F.lit("k").alias("krate"), F.col("id").alias("module"), F.lit("x").alias("name"), F.concat(F.lit("D"), "id").alias("target"))
    return resolve.module_members(edges.select(F.lit("k").alias("krate"), F.col("src").alias("module"), F.lit("x").alias("name")), defined, again)


_MODULES = f"""{P.ENTITY_FILES}, r0 as (select repo, left(file, length(file) - 3) r from ef where file like '%.rs'), r1 as (select distinct repo k, case when r like 'src/%' then substr(r, 5) else r end r from r0),
md as (select distinct k, case when r in ('lib', 'main', 'mod') then '' else replace(case when r like '%/mod' then left(r, -4) else r end, '/', '::') end p from r1)"""


@query(f"""with {_MODULES}, want as (select distinct k krate, 'crate::'||p||case when length(p) % 2 = 0 then '' else '::missing' end path, p||case when length(p) % 2 = 0 then '' else '::missing' end w from md where p <> ''),
g as (select krate, path, w, array_to_string(l[1:n], '::') p from (select *, string_split(w, '::') l from want), unnest(range(1, len(l) + 1)) u(n))
select g.krate, path, case when bool_and(md.p is not null) then w end as module from g left join md on md.k = g.krate and md.p = g.p group by g.krate, path, w""")
def module_path_exists(spark, d):
    f = P.entity_files(spark, d).where("file like '%.rs'")
    rel = F.regexp_replace(F.regexp_replace("file", r"\.rs$", ""), "^src/", "")
    atoms = f.select(F.concat("repo", F.lit("/src/"), rel, F.lit(".rs")).alias("file_path"), F.lit("").alias("scope"))
    tree = resolve.module_tree(atoms)
    want = tree.where("path <> ''").select("krate", F.lit("").alias("here"), F.concat(F.lit("crate::"), "path", F.when(F.length("path") % 2 == 0, "").otherwise("::missing")).alias("path"), F.lit(False).alias("apart"))
    return resolve.resolve_paths(want, tree).select("krate", "path", "module")


# -- differences, storage, catalogs ------------------------------------------------
@query(f"with {P.SNAPSHOTS} select change_type, id, from_id from ch where change_type <> 'renamed'")
def diff_changes(spark, d):
    return diff.changes(*P.document_snapshots(spark, d)).where("change_type <> 'renamed'")


@query(f"with {P.SNAPSHOTS} select from_id, id from ch where change_type = 'renamed'")
def diff_renames(spark, d):
    return diff.changes(*P.document_snapshots(spark, d)).where("change_type = 'renamed'").select("from_id", "id")


@query(f"with {P.SNAPSHOTS} select change_type, count(*) n from ch group by 1")
def diff_counts(spark, d):
    return diff.counts(diff.changes(*P.document_snapshots(spark, d)))


@query(f"with {P.SNAPSHOTS}, lk as (select distinct a.b src, b.b dst from t a join t b on b.doc_id = a.doc_id + 10) select src, dst from lk where src in (select id from ch) and dst in (select id from ch)")
def diff_blast_radius(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.concat(F.lit("code:"), F.coalesce("source", F.lit("none")), F.lit("::function::"), "doc_id").alias("b"))
    links = t.select(F.col("b").alias("src"), (F.col("doc_id") + 10).alias("doc_id")).join(t.withColumnRenamed("b", "dst"), "doc_id")
    return diff.blast_radius(diff.changes(*P.document_snapshots(spark, d)), links)


_KEPT = "k as (select doc_id::varchar as key, coalesce(n_chars, 0) size, sum(coalesce(n_chars, 0)) over (order by doc_id desc, doc_id::varchar desc rows unbounded preceding) rest from documents)"


@query(f"with {_KEPT} select key, size from k where rest > (select sum(n_chars) // 2 from documents)")
def gc_evicted(spark, d):
    s = P.storage(spark, d)
    cap = (s.agg(F.sum("size")).first()[0] or 0) // 2
    return catalog.evicted(s, cap)


@query(f"with {_KEPT}, c as (select sum(n_chars) // 2 c from documents) select count(*) entries, sum(size)::bigint bytes_before, count(*) filter (rest > c) evicted, sum(case when rest > c then 0 else size end)::bigint bytes_after from k, c")
def gc_totals(spark, d):
    s = P.storage(spark, d)
    cap = (s.agg(F.sum("size")).first()[0] or 0) // 2
    return catalog.totals(s, catalog.evicted(s, cap))


@query(r"select repo, 'wt-'||left(sha1(string_agg(replace(display_path, '\', '/')||':'||blob_sha||chr(0), '' order by replace(display_path, '\', '/'), blob_sha)), 16) snapshot_id from parse_inputs group by 1")
def snapshot_digest(spark, d):
    f = table(spark, d, "parse_inputs").select("repo", F.translate("display_path", "\\", "/").alias("path"), F.col("blob_sha").alias("blob"))
    return catalog.digest(f, "repo")


@query(f"with {P.TRADE} select v.id, v.file_path as file, coalesce(o, '') edges_out, coalesce(i, '') edges_in from v left join (select src, string_agg(dst, ',' order by dst) o from e group by 1) a on a.src = v.id left join (select dst, string_agg(src, ',' order by src) i from e group by 1) b on b.dst = v.id")
def catalog_rows(spark, d):
    return catalog.rows(P.trade_vertices(spark, d), P.trade_edges(spark, d)).select("id", "file", F.array_join("edges_out", ",").alias("edges_out"), F.array_join("edges_in", ",").alias("edges_in"))


@query(f"""with {P.TRADE}, o as (select src, list_sort(list(distinct dst)) x from e group by 1), i as (select dst, list_sort(list(distinct src)) x from e group by 1)
select id, to_json(struct_pack(id := id, kind := 'function', name := id, file := file_path, content_hash := '', callers := coalesce(i.x, []), callees := coalesce(o.x, []), children := []::varchar[], imports := []::varchar[], imported_by := []::varchar[],
  uses := []::varchar[], used_by := []::varchar[], implements := []::varchar[], implemented_by := []::varchar[]))::varchar meta from v left join o on o.src = id left join i on i.dst = id""")
def catalog_meta(spark, d):
    return catalog.entity_meta(P.trade_vertices(spark, d), P.trade_edges(spark, d))


@query(f"""with {P.TRADE}, o as (select src, string_agg('  '||src||' -- calls --> '||dst||':::function['||dst||']', chr(10) order by dst) x from e group by 1), i as (select dst, string_agg('  '||src||':::function['||src||'] -- calls --> '||dst, chr(10) order by src) x from e group by 1)
select id, concat_ws(chr(10), '%% id: '||id, '%% kind: function', '%% file: '||file_path, '%% content_hash: ', 'graph LR', '  classDef function fill:#e1f5fe,stroke:#01579b', '  classDef function fill:#e1f5fe,stroke:#01579b', '  classDef module fill:#f3e5f5,stroke:#4a148c',
  '  '||id||':::function['||id||']', o.x, i.x) as text from v left join o on o.src = id left join i on i.dst = id""")
def entity_stars(spark, d):
    return catalog.stars(P.trade_vertices(spark, d), P.trade_edges(spark, d))


@query(f"with {P.SNAPSHOTS} select n.id from n join o using (id) where n.h = o.h")
def diff_unchanged(spark, d):
    return diff.unchanged(*P.document_snapshots(spark, d))


@query(f"""with {P.SNAPSHOTS}, lk as (select distinct a.b src, b.b dst from t a join t b on b.doc_id = a.doc_id + 10),
c0 as (select *, case change_type when 'added' then 1 when 'removed' then 2 when 'modified' then 3 else 4 end k from ch),
c1 as (select *, 'n'||(row_number() over (order by k, id) - 1) node, case when change_type = 'renamed' then regexp_replace(from_id, '^code:', '')||' ↪ '||regexp_replace(id, '^code:', '') else 'fn '||regexp_replace(id, '^.*::function::', '')||' (d)' end as label from c0),
ed as (select a.node||' --> '||b.node as line, src, dst from lk join c1 a on a.id = src join c1 b on b.id = dst)
select k part, '    %% '||change_type||' ('||count(*)||')' as line from c1 group by k, change_type union all select k, '    '||node||'["'||translate(label, '"', chr(39))||'"]:::'||change_type from c1
union all select 9, '    '||line from ed union all select 8, '    %% blast-radius edges (both ends changed)' where exists (select 1 from ed)""")
def diff_lines(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.concat(F.lit("code:"), F.coalesce("source", F.lit("none")), F.lit("::function::"), "doc_id").alias("b"))
    links = t.select(F.col("b").alias("src"), (F.col("doc_id") + 10).alias("doc_id")).join(t.withColumnRenamed("b", "dst"), "doc_id")
    c = diff.changes(*P.document_snapshots(spark, d))
    about = c.withColumns({"kind": F.lit("function"), "name": F.regexp_replace("id", "^.*::function::", ""), "file": F.lit("d")})
    return diff.lines(about, links).select("part", "line")


# -- sequences --------------------------------------------------------------------
@query(f"with {P.STEPS}, q as (select fn_id, p, min(o) o from (select fn_id, dst p, ord * 2 + 1 o from st union all select fn_id, 'self', ord * 2 from st) group by all) select fn_id, p participant, row_number() over (partition by fn_id order by o, p) - 1 place from q")
def sequence_participants(spark, d):
    return sequence.participants(P.dialogue_steps(spark, d))


_LINE = """'    '||'self'||case when aw then '-)' else '->>' end||case dst when 'click' then 'n_click' else dst end||': '||replace(replace(replace(replace(case when length(l) > 32 then left(l, 32)||'...' else l end, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '#', '_')||case when aw then ' (await)' else '' end"""


@query(f"with {P.STEPS}, q as (select *, trim(regexp_replace(replace(props, '\"', ''''), '\\s+', ' ', 'g')) l from st) select fn_id, ord, {_LINE} as line from q")
def sequence_steps(spark, d):
    return sequence.lines(P.dialogue_steps(spark, d))


@query(f"""with {P.STEPS}, q as (select *, trim(regexp_replace(replace(props, '"', ''''), '\\s+', ' ', 'g')) l from st),
p0 as (select fn_id, p, min(o) o from (select fn_id, dst p, ord * 2 + 1 o from st union all select fn_id, 'self', ord * 2 from st) group by all),
p as (select fn_id, p, row_number() over (partition by fn_id order by o, p) n from p0)
select fn_id, 'sequenceDiagram' || chr(10) || '    autonumber' || chr(10) || a || chr(10) || b diagram from (select fn_id, string_agg('    participant '||case p when 'click' then 'n_click' else p end||' as '||p, chr(10) order by n) a from p group by 1) join (select fn_id, string_agg({_LINE}, chr(10) order by ord) b from q group by 1) using (fn_id)""")
def sequence_text(spark, d):
    return sequence.text(P.dialogue_steps(spark, d))


@query(f"""with {P.STEPS}, ev as (select st.*, event_id % 3 k from st join (select user_id::varchar fn_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 ord from events) using (fn_id, ord)),
q as (select *, trim(regexp_replace(translate(props, '"', chr(39)), '\\s+', ' ', 'g')) l from ev)
select fn_id, ord * 3 ord, '    '||case k when 0 then 'loop ' else 'alt ' end||dst as line from q where k < 2 union all select fn_id, ord * 3 + 2, '    end' from q where k < 2 union all select fn_id, ord * 3 + 1, case when k < 2 then '    ' else '' end||{_LINE} from q""")
def sequence_blocks(spark, d):
    return sequence.lines(P.nested_steps(spark, d))


@query()
def sequence_sources(spark, d):
    return sequence.steps(P.source_files(spark, d))


# -- parsing and the whole graph ------------------------------------------------------
def _parsed(spark, d):
    return parsing.parse_files(P.source_files(spark, d))


@query()
def parse_rust_atoms(spark, d):
    return parsing.atoms_of(_parsed(spark, d)).where("file_path like '%.rs'")


@query()
def parse_python_atoms(spark, d):
    return parsing.atoms_of(_parsed(spark, d)).where("file_path like '%.py'")


@query()
def parse_dart_atoms(spark, d):
    return parsing.atoms_of(_parsed(spark, d)).where("file_path like '%.dart'")


@query()
def parse_call_sites(spark, d):
    return parsing.call_sites_of(_parsed(spark, d))


@query()
def parse_imports(spark, d):
    return parsing.imports_of(_parsed(spark, d))


@query()
def parse_report(spark, d):
    return parsing.parse_report(_parsed(spark, d))


def _module_files(spark, d):
    """One row per path of a repo: the first file by id, as a module of its own tree."""
    p = table(spark, d, "parse_inputs").select("repo", "file_id", F.regexp_replace(F.translate("display_path", "\\", "/"), r"^(\./)+", "").alias("path"), "content")
    best = p.groupBy("repo", "path").agg(F.min(F.struct("file_id", "content")).alias("b"))
    return best.select(F.concat("repo", F.lit("/"), "path").alias("path"), "b.content")


def _whole(spark, d):
    from ..engine import resolved
    from ..session import cut

    return resolved(cut(parsing.parse_files(_module_files(spark, d))))


@query()
def resolved_sources(spark, d):
    """The whole graph of the sources, one module a path of its repo: edges of every kind."""
    return _whole(spark, d).edges.select("src", "dst", "kind", F.array_join(F.col("sites").cast("array<string>"), ",").alias("sites"))


@query(r"""with a as (select repo, replace(file, '\', '/') file from index_entities), r as (select distinct repo, left(file, -3) r from a where file like '%.rs'), x as (select repo, case when r like 'src/%' then substr(r, 5) else r end r, r like 'src/%' or r like '%/src/%' own from r)
select distinct case when r like '%/src/%' then repo||'/'||left(r, instr(r, '/src/') - 1) when own then repo else '' end krate, case when rel in ('lib', 'main', 'mod') then '' else replace(case when rel like '%/mod' then left(rel, -4) else rel end, '/', '::') end as path
from (select *, case when r like '%/src/%' then substr(r, instr(r, '/src/') + 5) when own then r else repo||'/'||r end rel from x)""")
def module_tree(spark, d):
    f = P.entity_files(spark, d)
    return resolve.module_tree(f.select(F.concat("repo", F.lit("/"), "file").alias("file_path"), F.lit("").alias("scope")))


@query("""with f as (select min(file_path) f from atoms where file_path <> '') select id, name, line_start, row_number() over (order by line_start, id, seq) place from atoms where file_path = (select f from f) and kind <> 'module'""")
def items_in_order(spark, d):
    from pyspark.sql import Window

    atoms = table(spark, d, "atoms")
    first = atoms.where("file_path <> ''").agg(F.min("file_path")).first()[0] or ""
    items = graph.CodeGraph(atoms, P.trade_edges(spark, d)).items_in_order(first)
    return items.select("id", "name", "line_start", F.row_number().over(Window.partitionBy("file_path").orderBy("line_start", "id", "seq")).alias("place"))


@query(f"""with {P.TRADE} select src, dst from e where src = 'C1'""")
def edges_from(spark, d):
    return graph.CodeGraph(P.trade_vertices(spark, d), P.trade_edges(spark, d)).edges_from("C1", "calls").select("src", "dst")


@query("select 'C'||c_custkey dst from customer where c_nationkey = 3")
def children_of(spark, d):
    return graph.CodeGraph(P.nest_atoms(spark, d), P.nest_edges(spark, d)).children_of("N3")


_KNOWN = f"""{P.EVENTS}, vv as (select * from v where not ext), bo as (select src, dst, a.file_path <> b.file_path x from e join vv a on a.id = src join vv b on b.id = dst),
dg as (select vv.id, file_path, coalesce(d, 0) d, coalesce(c, 0) c from vv left join (select id, count(*) d, sum(x::int) c from (select src id, x from bo union all select dst, x from bo) group by 1) q on q.id = vv.id),
tp as (select *, row_number() over (order by c desc, d desc, id) rank from dg), co as (select *, 1 + (row_number() over (partition by file_path order by rank) = 1)::int cost from tp), tt as (select *, sum(cost) over (order by rank) total from co),
uu as (select *, total <= {_BUDGET} ok, bool_or(total <= {_BUDGET}) over (partition by file_path) fi, max(case when total <= {_BUDGET} then total end) over () used from tt), xx as (select min(rank) r from uu where not ok and fi and used = {_BUDGET} - 1),
kp as (select id, file_path, split_part(file_path, '/', -1) base from uu where ok or rank = (select r from xx)),
ed as (select distinct src, 'calls' as label, dst from e where src <> dst and src in (select id from kp) and dst in (select id from kp)
  union all select distinct 'code:'||kp.file_path, 'depends on', 'dep:dep'||right(e.dst, 2) from e join vv on vv.id = e.src join v x on x.id = e.dst and x.ext join kp on kp.file_path = vv.file_path)"""


def _known(spark, d):
    from .. import engine

    v = P.event_vertices(spark, d).withColumns({"signature": F.when(F.col("kind") == "extern", F.concat(F.lit("dep"), F.right("id", F.lit(2)), F.lit("::f"))).otherwise("pub fn"), "parent": F.lit(None).cast("string")})
    return engine.knowledge_graph(graph.CodeGraph(v, P.event_edges(spark, d)), _BUDGET)


@query(f"with {_KNOWN} select src, label, dst from ed")
def knowledge_graph(spark, d):
    return _known(spark, d)[1]


@query(f"with {_KNOWN} select id, 'f'||id::int||'()' as label, 'functionNode' cls, file_path from kp union all select distinct 'code:'||file_path, base, 'fileNode', file_path from kp union all select distinct dst, dst[5:], 'dependencyNode', null from ed where label = 'depends on'")
def knowledge_nodes(spark, d):
    return _known(spark, d)[0].drop("line_start")


@query(f"""with {_KNOWN}, sx as (select *, '_'||id s from kp), fl as (select distinct file_path p, regexp_replace(file_path, '[^A-Za-z0-9_]', '_', 'g')||'_H'||left(sha256(file_path), 8) s, base, split_part(file_path, '/', 2) c from kp),
fn as (select *, 'code_'||regexp_replace(p, '[^A-Za-z0-9_]', '_', 'g')||'_H'||left(sha256('code:'||p), 8) n from fl), dp as (select distinct dst, dst[5:] head from ed where label = 'depends on'),
nm as (select id, s from sx union all select 'code:'||p, n from fn union all select dst, 'dep_'||head from dp)
select distinct 1 part, '    subgraph dir_crates["crates/"]' as line from kp union all select 1, '    end' where exists (select 1 from kp)
union all select distinct 1, '        subgraph dir_crates_'||c||'_H'||left(sha256('crates/'||c), 8)||'["crates/'||c||'/"]' from fn union all select 1, '        end' from (select distinct c from fn)
union all select 1, '            subgraph file_'||s||'["'||p||'"]' from fn union all select 1, '            end' from fn union all select 1, '                '||n||'["'||base||'"]:::fileNode' from fn
union all select 1, '                '||s||'("f'||id::int||'()"):::functionNode' from sx union all select 2, '    dep_'||head||'(["'||head||'"]):::dependencyNode' from dp
union all select 3, '    '||a.s||' --"'||label||'"--> '||b.s from (select distinct * from ed) x join nm a on a.id = x.src join nm b on b.id = x.dst""")
def graph_lines(spark, d):
    return render.graph_lines(*_known(spark, d)).select("part", "line")


@query("""with t as (select 'T'||s_suppkey id, 'Brand#'||(s_suppkey % 5 + 1)||(s_suppkey % 7 + 1) as name, 'm'||(s_suppkey % 13) f from supplier), i as (select 'I'||p_partkey id, p_brand as name, 'm'||(p_partkey % 17) f from part),
im as (select distinct 'm'||(o_custkey % 17) a, 'm'||(o_custkey % 13) b from orders where o_orderkey % 40 = 0), tr as (select 'I'||p_partkey src, 'R'||(p_partkey % 9) dst from part),
k as (select i.id, count(t.id) filter (t.f = i.f) nh, min(t.id) filter (t.f = i.f) h, count(t.id) filter (im.b is not null) nn, min(t.id) filter (im.b is not null) n, count(t.id) na, min(t.id) a from i left join t on t.name = i.name left join im on im.a = i.f and im.b = t.f group by 1)
select distinct case when nh > 0 then h when nn > 0 then n else a end src, dst from k join tr on tr.src = k.id where nh = 1 or nh = 0 and (nn = 1 or nn = 0 and na = 1)""")
def implement_owners(spark, d):
    s, p = F.col("s_suppkey"), F.col("p_partkey")
    null = F.lit(None).cast("string")
    types = table(spark, d, "supplier").select(F.concat(F.lit("T"), s).alias("id"), F.concat(F.lit("Brand#"), s % 5 + 1, s % 7 + 1).alias("name"), F.concat(F.lit("m"), s % 13).alias("file_path"))
    impls = table(spark, d, "part").select(F.concat(F.lit("I"), p).alias("id"), F.lit("impl").alias("kind"), F.concat(F.lit("Tr"), p % 9, F.lit(" for kit::"), "p_brand", F.lit("<X>")).alias("name"), F.concat(F.lit("m"), p % 17).alias("file_path"), null.alias("signature"))
    files = spark.range(17).select(F.concat(F.lit("code:m"), "id").alias("id"), F.lit("module").alias("kind"), F.concat(F.lit("m"), "id").alias("name"), F.concat(F.lit("m"), "id").alias("file_path"), null.alias("signature"))
    c = F.col("o_custkey")
    imports = table(spark, d, "orders").where("o_orderkey % 40 = 0").select(F.concat(F.lit("code:m"), c % 17).alias("src"), F.concat(F.lit("code:m"), c % 13).alias("dst"), F.lit("imports").alias("kind"))
    made = table(spark, d, "part").select(F.concat(F.lit("I"), p).alias("src"), F.concat(F.lit("R"), p % 9).alias("dst"), F.lit("implements").alias("kind"))
    return graph.implement_owners(impls.unionByName(files), imports.unionByName(made), types)


@query(f"""with {P.EVENTS}, {_BACK}, {_ON}, im as ({_EDGES('b')} union {_EDGES('o')}), nd as ({_NODES('b')} union {_NODES('o')})
select 'digraph g {{'||chr(10)||coalesce((select string_agg('    _'||id||' [label="'||id||'"];', chr(10) order by id) from nd), '')||coalesce(chr(10)||(select string_agg('    _'||src||' -> _'||dst||';', chr(10) order by src, dst) from im), '')||chr(10)||'}}' as text""")
def dot_impact(spark, d):
    e, n = traverse.impact(P.event_edges(spark, d), _ROOT)
    return render.dot(n.withColumn("label", F.col("id")), e)


@query(r"""with p as (select file_id, replace(display_path, '\', '/') path from parse_inputs) select file_id, path, case split_part(path, '.', -1) when 'rs' then 'rust' when 'py' then 'python' else 'dart' end lang from p
where split_part(path, '.', -1) in ('rs', 'py', 'dart') and not regexp_matches(path, '\.(g|freezed|mocks|gr)\.dart$')
and not regexp_matches(path, '(^|/)(target|node_modules|\.git|__pycache__|venv|dist|build|vendor|\.[^/.][^/]*)/')""")
def walk_files(spark, d):
    return parsing.scan_filter(P.source_paths(spark, d))


@query(f"""with {P.TRADE}, u as (select *, row_number() over (partition by file_id, id order by seq desc, content_hash desc) n from atoms),
nd as (select case when file_path like 'crates/%' then split_part(file_path, '/', 2) else split_part(file_path, '/', 1) end id, count(*) filter (kind = 'module')||' mod, '||count(*) filter (kind = 'function')||' fn, '||count(*) filter (kind in ('struct', 'enum', 'trait', 'type_alias', 'union', 'impl'))||' struct' t from u where n = 1 group by 1 having id <> ''),
ed as (select a.crate src, b.crate dst, count(*) n from e join v a on a.id = src join v b on b.id = dst where a.crate <> b.crate group by all),
sf as (select id, case when regexp_matches(id, '[^A-Za-z0-9_]') then regexp_replace(id, '[^A-Za-z0-9_]', '_', 'g')||'_H'||left(sha256(id), 8) else id end s from (select id from nd union select src from ed union select dst from ed))
select 'graph LR'||chr(10)||(select string_agg('    '||s||'["'||id||' — '||t||'"]', chr(10) order by id) from nd join sf using (id))||chr(10)||(select string_agg('    '||a.s||' -->|"'||n||' calls"| '||b.s, chr(10) order by src||' '||dst) from ed join sf a on a.id = src join sf b on b.id = dst) as text""")
def mermaid_project(spark, d):
    n = graph.project_nodes(graph.upsert(table(spark, d, "atoms"), "file_id", "id")).select(F.col("crate").alias("id"), F.format_string("%s — %d mod, %d fn, %d struct", "crate", "modules", "functions", "structs").alias("label"))
    e = graph.project_edges(P.trade_vertices(spark, d), P.trade_edges(spark, d)).select(F.col("src_crate").alias("src"), F.col("dst_crate").alias("dst"), F.concat(F.col("calls").cast("string"), F.lit(" calls")).alias("label"))
    return render.mermaid(n, e)


QUERIES = _Q
