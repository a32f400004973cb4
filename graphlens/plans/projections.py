"""The test tables as code graphs, in Spark and as SQL.

Each projection has a builder and a ``WITH`` clause that gives the same rows, so
that every operator can be compared with plain SQL on any scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..session import table


# -- trade: customers call suppliers ---------------------------------------
def trade_vertices(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = n.select("n_nationkey", F.concat(F.lit("crates/"), "r_name", F.lit("/src/"), "n_name", F.lit(".rs")).alias("file_path"))
    c = table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.col("c_nationkey").alias("n_nationkey"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.col("s_nationkey").alias("n_nationkey"))
    return c.unionByName(s).join(places, "n_nationkey").select("id", F.lit("function").alias("kind"), F.col("id").alias("name"), "file_path", F.lit("").alias("content_hash"))


def trade_edges(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_suppkey")
    return o.join(li, "k").select(F.concat(F.lit("C"), "o_custkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("dst")).distinct().withColumn("kind", F.lit("calls"))


TRADE = """v as (select id, 'crates/'||r_name||'/src/'||n_name||'.rs' file_path, r_name crate from (
  select 'C'||c_custkey id, c_nationkey k from customer union all select 'S'||s_suppkey, s_nationkey from supplier)
  join nation on n_nationkey = k join region on r_regionkey = n_regionkey),
e as (select distinct 'C'||o_custkey src, 'S'||l_suppkey dst from orders join lineitem on l_orderkey = o_orderkey)"""


# -- events: a cyclic graph with call sites ---------------------------------
def event_sites(spark: SparkSession, d: str) -> DataFrame:
    """caller_id, rank, flags, name, dst (null if unbound), seq."""
    from ..operators.parsing import call_ranks

    e = table(spark, d, "events").where("event_type = 'error'").select("event_id", "ts", F.col("user_id").alias("u"))
    nxt = F.lead("u").over(Window.partitionBy(F.col("event_id") % 64).orderBy("ts", "event_id"))
    s = e.withColumn("v", nxt).where("v is not null")
    s = call_ranks(s.withColumns({"caller_id": _vid("u"), "at": F.struct("ts", "event_id")}))
    bound = F.col("event_id") % 4 != 0
    name = F.when(bound, F.concat(F.lit("f"), "v")).when(F.col("v") % 7 == 0, "push").otherwise(F.concat(F.lit("g"), "v"))
    return s.select("caller_id", "rank", (F.col("event_id") % 8).cast("int").alias("flags"), name.alias("name"), F.when(bound, _vid("v")).alias("dst"), F.col("event_id").alias("seq"))


def _vid(c: str):
    return F.lpad(F.col(c).cast("string"), 6, "0")


def event_edges(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.graph import group_sites

    return group_sites(event_sites(spark, d).where("dst is not null").select(F.col("caller_id").alias("src"), "dst", "rank", "seq"))


def event_vertices(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "events").where("event_type = 'error'").select("user_id").distinct()
    path = F.concat(F.lit("crates/c"), F.col("user_id") % 5, F.lit("/src/m"), F.col("user_id") % 15, F.lit(".rs"))
    kind = F.when(F.col("user_id") % 10 == 9, "extern").otherwise("function")
    return u.select(_vid("user_id").alias("id"), kind.alias("kind"), F.concat(F.lit("f"), "user_id").alias("name"), path.alias("file_path"))


EVENTS = """er as (select event_id, ts, user_id u, lead(user_id) over (partition by event_id % 64 order by ts, event_id) v from events where event_type = 'error'),
s as (select lpad(u::varchar, 6, '0') src, row_number() over (partition by u order by ts, event_id) - 1 rank, event_id % 8 flags,
  case when event_id % 4 <> 0 then 'f'||v when v % 7 = 0 then 'push' else 'g'||v end as name, case when event_id % 4 <> 0 then lpad(v::varchar, 6, '0') end dst, event_id seq
  from er where v is not null),
e as (select src, dst, min(seq) seq from s where dst is not null group by all),
v as (select distinct lpad(user_id::varchar, 6, '0') id, user_id % 10 = 9 ext, 'crates/c'||(user_id % 5)||'/src/m'||(user_id % 15)||'.rs' file_path from events where event_type = 'error')"""


# -- parts: functions of three languages, and sites that name them in every way ------
def _part_functions(p: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    lang = F.when(k % 4 < 2, "rs").when(k % 4 == 2, "py").otherwise("dart")
    module = F.when(lang == "rs", F.concat(F.lit("m"), k % 11)).when(lang == "py", F.concat(F.lit("n"), k % 9)).otherwise(F.concat(F.lit("d"), k % 23))
    path = F.when(lang == "rs", F.concat(F.lit("k"), k % 7, F.lit("/src/"), module, F.lit(".rs"))).when(lang == "py", F.concat(F.lit("p"), k % 6, F.lit("/g"), k % 8, F.lit("/"), module, F.lit(".py"))).otherwise(F.concat(F.lit("lib/"), module, F.lit(".dart")))
    name = F.when(k % 5 == 0, F.concat(F.lit("h"), k % 40)).otherwise(F.concat(F.lit("f"), k % 900))
    parent = F.when(k % 3 == 0, F.concat(F.lit("T"), k % 60, F.when(k % 2 == 0, "<U>").otherwise("")))
    return p.select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.lit("function").alias("kind"), name.alias("name"), path.alias("file_path"), F.lit("").alias("scope"), parent.alias("parent"), k.alias("k"), lang.alias("lang"), module.alias("module"))


def code_atoms(spark: SparkSession, d: str) -> DataFrame:
    return _part_functions(table(spark, d, "part"))


def code_sites(spark: SparkSession, d: str) -> DataFrame:
    """caller_id, name, rank, flags, is_method and ``aim``, the function that the name was made from."""
    parts = table(spark, d, "part")
    n = parts.count()
    o, s = F.col("l_orderkey"), F.col("l_suppkey")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct().withColumn("k", 1 + (o * 31 + s) % n)
    t = _part_functions(parts).select("k", "name", "module", "lang", F.regexp_replace(F.coalesce("parent", F.lit("T61")), "<U>", "").alias("owner"))
    form, pre = s % 8, F.lit("::")
    package = F.when((F.col("lang") == "py") & (F.col("k") % 2 == 0), F.concat(F.lit("g"), F.col("k") % 8)).otherwise(F.col("module"))
    name = (
        F.when(form == 0, F.col("name")).when(form == 1, F.concat(package, pre, "name")).when(form == 2, F.concat(F.lit("crate::"), "module", pre, "name")).when(form == 3, F.concat("owner", pre, "name"))
        .when(form == 4, F.concat(F.lit("ext"), F.col("k") % 50, pre, "name")).when(form == 5, F.concat(F.lit("super::"), "module", pre, "name")).when(form == 6, F.concat(F.lit("self::"), "name")).otherwise(F.lit("push"))
    )
    site = F.concat(F.lit("P"), "l_partkey")
    return li.join(t, "k").select(site.alias("caller_id"), name.alias("name"), (o % 1000).cast("int").alias("rank"), (s % 2 * 8).cast("int").alias("flags"), F.lit(False).alias("is_method"), F.concat(F.lit("P"), "k").alias("aim"), o.alias("o"))


def code_edges(sites: DataFrame) -> DataFrame:
    """A tenth of the sites as if the parser had linked them."""
    return sites.where("o % 10 = 0 and caller_id <> aim").select(F.col("caller_id").alias("src"), F.col("aim").alias("dst"), F.lit("calls").alias("kind")).distinct()


def code_imports(spark: SparkSession, d: str) -> DataFrame:
    """Globs that Rust modules name again, and names that Python packages do, in chains."""
    s = F.col("s_suppkey")
    rust = table(spark, d, "supplier").select(
        F.concat(F.lit("k"), s % 7, F.lit("/src/m"), s % 11, F.lit(".rs")).alias("file_path"), F.lit("").alias("local"), F.concat(F.lit("crate::m"), (s * 3 + 1) % 11).alias("target"), F.lit(True).alias("is_glob"), F.lit(True).alias("is_public"), F.lit(False).alias("is_inner"), s.cast("int").alias("pos"))
    k = F.col("k")
    to = F.when(k % 5 == 1, F.concat(F.lit("..g"), (k + 1) % 8)).otherwise(F.concat(F.lit("."), "module"))
    py = _part_functions(table(spark, d, "part")).where("lang = 'py' and k % 5 < 3").select(
        F.concat(F.lit("p"), k % 6, F.lit("/g"), k % 8, F.lit("/__init__.py")).alias("file_path"), F.col("name").alias("local"), F.concat(to, F.lit("::"), "name").alias("target"), F.lit(False).alias("is_glob"), F.lit(False).alias("is_public"), F.lit(False).alias("is_inner"), k.cast("int").alias("pos"))
    return rust.unionByName(py)


_SKIPPED = ", ".join(f"'{x}'" for x in schema.SKIP_CALLS)
CODE = f"""f as (select 'P'||k id, k, name, lang, module, replace(parent, '<U>', '') as owner, path, case lang when 'rs' then 'k'||(k % 7) when 'py' then 'p'||(k % 6) else '' end crate from (
  select *, case lang when 'rs' then 'k'||(k % 7)||'/src/'||module||'.rs' when 'py' then 'p'||(k % 6)||'/g'||(k % 8)||'/'||module||'.py' else 'lib/'||module||'.dart' end path from (
  select *, case lang when 'rs' then 'm'||(k % 11) when 'py' then 'n'||(k % 9) else 'd'||(k % 23) end module from (
  select p_partkey k, case when p_partkey % 4 < 2 then 'rs' when p_partkey % 4 = 2 then 'py' else 'dart' end lang, case when p_partkey % 5 = 0 then 'h'||(p_partkey % 40) else 'f'||(p_partkey % 900) end as name,
    case when p_partkey % 3 = 0 then 'T'||(p_partkey % 60)||case when p_partkey % 2 = 0 then '<U>' else '' end end parent from part)))),
li as (select *, 1 + (l_orderkey * 31 + l_suppkey) % (select count(*) from part) k from (select distinct l_orderkey, l_partkey, l_suppkey from lineitem)),
s as (select 'P'||l_partkey caller, l_orderkey % 1000 rank, l_suppkey % 2 = 1 typed, 'P'||f.k aim, l_orderkey o, case l_suppkey % 8 when 0 then null when 1 then case when lang = 'py' and f.k % 2 = 0 then 'g'||(f.k % 8) else module end
    when 2 then 'crate::'||module when 3 then coalesce(owner, 'T61') when 4 then 'ext'||(f.k % 50) when 5 then 'super::'||module when 6 then 'self' end prefix, case when l_suppkey % 8 = 7 then 'push' else name end fn from li join f on f.k = li.k),
lk as (select distinct caller, aim from s where o % 10 = 0 and caller <> aim),
rx as (select distinct 'k'||(s_suppkey % 7) krate, 'm'||(s_suppkey % 11) m, 'm'||((s_suppkey * 3 + 1) % 11) m2 from supplier),
pk as (select package, name, to_prefix from (select 'g'||(k % 8) package, name, case when k % 5 = 1 then 'g'||((k + 1) % 8) else module end to_prefix, row_number() over (partition by k % 8, name order by 'p'||(k % 6)||'/g'||(k % 8)||'/__init__.py', k) n from f where lang = 'py' and k % 5 < 3) where n = 1),
q0 as (select distinct caller, prefix, fn, split_part(prefix, '::', -1) as last from s where fn not in ({_SKIPPED}) or exists (select 1 from f where f.owner = split_part(s.prefix, '::', -1) and f.name = s.fn)),
q as (select row_number() over (order by caller, prefix, fn) q, q0.*, c.lang, c.crate, c.path, case when c.lang = 'rs' then case when prefix like '%::%' then last when prefix = 'self' then c.module end end m1 from q0 join f c on c.id = caller),
fd as (select * from f where owner is null),
md as (select distinct crate, module from f where lang = 'rs'),
cl(crate, m1, fn, m, h) as (select distinct q.crate, m1, fn, m1, 0 from q join md on md.crate = q.crate and md.module = m1
  union select cl.crate, m1, fn, m2, h + 1 from cl join rx on rx.krate = cl.crate and rx.m = cl.m join md on md.crate = cl.crate and md.module = rx.m2 where h < 6 and not exists (select 1 from fd where fd.lang = 'rs' and fd.crate = cl.crate and fd.module = cl.m and fd.name = cl.fn)),
mm as (select distinct cl.crate, m1, fn, fd.id from cl join fd on fd.lang = 'rs' and fd.crate = cl.crate and fd.module = cl.m and fd.name = cl.fn),
e1 as (select q.q, count(mm.id) had, count(mm.id) filter (mm.id <> q.caller and lk.aim is null) n, min(mm.id) filter (mm.id <> q.caller and lk.aim is null) one from q join md on md.crate = q.crate and md.module = q.m1
  left join mm on mm.crate = q.crate and mm.m1 = q.m1 and mm.fn = q.fn left join lk on lk.caller = q.caller and lk.aim = mm.id group by 1),
r(q, caller, lang, crate, last, fn, h) as (select q, caller, lang, crate, last, fn, 0 from q where prefix is not null and last not in ('crate', 'self', 'super', 'Self')
  union all select q, caller, lang, crate, to_prefix, fn, h + 1 from r join pk on pk.package = r.last and pk.name = r.fn where lang = 'py' and h < 4),
by_ as (select r.q, r.h, 3 stage, f.id, f.crate = r.crate same from r join f on f.owner = r.last and f.name = r.fn and f.lang = r.lang and f.id <> r.caller anti join lk on lk.caller = r.caller and lk.aim = f.id
  union all select r.q, r.h, 4, f.id, f.crate = r.crate from r join fd f on f.module = r.last and f.name = r.fn and f.lang = r.lang and f.id <> r.caller anti join lk on lk.caller = r.caller and lk.aim = f.id),
ba as (select q, h, stage, case when count(*) filter (same) = 1 then min(id) filter (same) when count(*) filter (same) = 0 and count(*) = 1 then min(id) end pick from by_ group by all),
b1 as (select r.q, r.h, exists (select 1 from f where f.owner = r.last and f.name = r.fn) owned, a3.q is not null d3, a3.pick p3, a4.q is not null d4, a4.pick p4 from r left join ba a3 on a3.q = r.q and a3.h = r.h and a3.stage = 3 left join ba a4 on a4.q = r.q and a4.h = r.h and a4.stage = 4),
b2 as (select *, row_number() over (partition by q order by case when d3 or d4 then h else 100 - h end) w from b1),
nb as (select q.q, case when exists (select 1 from fd where fd.name = q.fn and fd.path = q.path) then null when count(f.id) = 1 then min(f.id) end pick
  from q left join fd f on f.name = q.fn and f.lang = q.lang and f.crate = q.crate and f.id <> q.caller and not exists (select 1 from lk where lk.caller = q.caller and lk.aim = f.id) where prefix is null group by q.q, q.fn, q.path),
rs as (select q.caller, q.prefix, q.fn, case when e1.n = 1 then e1.one when e1.q is not null then null when q.prefix is null then nb.pick when b2.d3 then p3 when b2.d4 then p4 end target,
  case when e1.n = 1 then 'exact' when e1.q is not null then 'ambiguous' when q.prefix is null then case when nb.pick is null then 'unresolved' else 'bare' end
    when b2.d3 then case when p3 is null then 'ambiguous' else 'owner' end when b2.d4 then case when p4 is null then 'ambiguous' else 'module' end when b2.owned then 'ambiguous' else 'unresolved' end reason
  from q left join e1 on e1.q = q.q left join nb on nb.q = q.q left join b2 on b2.q = q.q and b2.w = 1),
sx as (select s.*, rs.target, rs.reason from s join rs on rs.caller = s.caller and rs.prefix is not distinct from s.prefix and rs.fn = s.fn),
ex as (select sx.*, 'extern:'||prefix||'::'||fn entity from sx join f c on c.id = sx.caller where reason = 'unresolved' and not typed and prefix is not null and split_part(prefix, '::', 1) not in ('crate', 'self', 'super', 'Self', '')
  and (c.lang <> 'dart' or exists (select 1 from f where f.owner = split_part(prefix, '::', 1))))"""


# -- containment: nations hold customers, customers hold orders ----------------
def nest_atoms(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.lit("module").alias("kind"), F.col("n_name").alias("name"), F.concat(F.lit("src/"), "n_name", F.lit(".rs")).alias("file_path"))
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "struct").when(F.col("c_mktsegment") == "MACHINERY", "trait").otherwise("impl")
    c = table(spark, d, "customer").join(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("C"), "c_custkey").alias("id"), kind.alias("kind"), F.col("c_name").alias("name"), F.concat(F.lit("src/"), "n_name", F.lit(".rs")).alias("file_path"))
    o = table(spark, d, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("id"), F.lit("function").alias("kind"), F.concat(F.lit("m"), F.col("o_orderkey") % 10).alias("name"), F.lit("").alias("file_path"))
    return n.unionByName(c).unionByName(o)


def nest_edges(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.concat(F.lit("N"), "c_nationkey").alias("src"), F.concat(F.lit("C"), "c_custkey").alias("dst"))
    o = table(spark, d, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("src"), F.concat(F.lit("O"), "o_orderkey").alias("dst"))
    return c.unionByName(o).withColumn("kind", F.lit("contains"))


# -- two snapshots of documents -------------------------------------------------
def document_snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.coalesce("source", F.lit("none")).alias("source"))
    base = F.concat(F.lit("code:"), "source", F.lit("::function::"), "doc_id")
    old = t.where("doc_id % 10 <> 0").select(base.alias("id"), F.sha2("text", 256).alias("content_hash"))
    new_id = F.when(F.col("doc_id") % 7 == 0, F.concat(base, F.lit("_v2"))).otherwise(base)
    new_hash = F.when(F.col("doc_id") % 13 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256))
    return old, t.where("doc_id % 10 <> 1").select(new_id.alias("id"), new_hash.alias("content_hash"))


SNAPSHOTS = """t as (select doc_id, text, 'code:'||coalesce(source, 'none')||'::function::'||doc_id b from documents where text is not null),
o as (select b id, sha256(text) h from t where doc_id % 10 <> 0),
n as (select case when doc_id % 7 = 0 then b||'_v2' else b end id, case when doc_id % 13 = 0 then sha256(text||'x') else sha256(text) end h from t where doc_id % 10 <> 1),
m as (select coalesce(n.id, o.id) id, o.id oid, n.id nid, o.h oh, n.h nh from o full join n on o.id = n.id),
g as (select oid, oh, row_number() over (partition by oh order by oid) k from m where nid is null),
a as (select nid, nh, row_number() over (partition by nh order by nid) k from m where oid is null),
ch as (select 'modified' change_type, id, null::varchar from_id from m where oid is not null and nid is not null and oh <> nh
  union all select case when oid is null then 'added' when nid is null then 'removed' else 'renamed' end, coalesce(nid, oid), case when nid is not null then oid end
  from g full join a on oh = nh and g.k = a.k)"""


# -- dialogues: a user's events as ordered steps -----------------------------------
def dialogue_steps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").cast("string").alias("fn_id"), place.alias("ord"), F.lit(0).alias("depth"), F.lit("call").alias("op"), F.lit("self").alias("src"), F.col("event_type").alias("dst"), F.col("props").alias("label"), (F.col("event_id") % 3 == 2).alias("is_await"))


def nested_steps(spark: SparkSession, d: str) -> DataFrame:
    """The same dialogue with every third call in a loop and every third in an alternative."""
    s = dialogue_steps(spark, d).join(table(spark, d, "events").select(F.col("user_id").cast("string").alias("fn_id"), "ts", "event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("ord")), ["fn_id", "ord"])
    k = F.col("event_id") % 3
    none, null = F.lit(""), F.lit(None).cast("string")
    row = lambda n, depth, op, src, dst, label, wait: F.struct(F.lit(n).alias("n"), depth.alias("depth"), op.alias("op"), src.alias("src"), dst.alias("dst"), label.alias("label"), wait.alias("is_await"))
    inside = (k < 2).cast("int")
    call = row(1, inside, F.lit("call"), F.lit("self"), F.col("dst"), F.col("label"), F.col("is_await"))
    block = F.array(row(0, F.lit(0), F.when(k == 0, "loop").otherwise("alt"), null, null, F.col("dst"), F.lit(False)), call, row(2, F.lit(0), F.lit("end"), null, null, none, F.lit(False)))
    each = s.select("fn_id", F.col("ord").alias("o"), F.explode(F.when(k < 2, block).otherwise(F.array(call))).alias("x"))
    return each.select("fn_id", (F.col("o") * 3 + F.col("x.n")).alias("ord"), "x.depth", "x.op", "x.src", "x.dst", "x.label", "x.is_await")


STEPS = """st as (select user_id::varchar fn_id, row_number() over (partition by user_id order by ts, event_id) - 1 ord, event_type dst, props, event_id % 3 = 2 aw from events)"""


# -- storage: documents as cached entries ---------------------------------------------
def storage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime"))


# -- entities: files and paths of the index --------------------------------------------
def entity_files(spark: SparkSession, d: str) -> DataFrame:
    """repo, file (spelt with /), path without extension; distinct."""
    f = F.translate("file", "\\", "/")
    return table(spark, d, "index_entities").select("repo", f.alias("file")).distinct().withColumn("path", F.regexp_replace("file", r"\.[^./]*$", ""))


ENTITY_FILES = r"""ef as (select distinct repo, replace(file, '\', '/') file from index_entities),
ep as (select repo, file, regexp_replace(file, '\.[^./]*$', '') path from ef)"""


def file_imports(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(imports, modules): every file names the next of its directory and language, as its language would."""
    every = F.when(F.length("file") % 3 == 0, ".rs").when(F.length("file") % 3 == 1, ".py").otherwise(".dart")
    f = entity_files(spark, d).select(F.concat("repo", F.lit("/"), F.regexp_replace("file", r"\.[^./]*$", ""), every).alias("file_path"), "repo")
    ext, base = F.element_at(F.split("file_path", r"\."), -1), F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.[^.]*$", "")
    f = f.select("file_path", "repo", ext.alias("ext"), base.alias("base"), F.left("file_path", F.length("file_path") - F.length(F.element_at(F.split("file_path", "/"), -1)) - 1).alias("folder"))
    nxt = F.lead("base").over(Window.partitionBy("folder", "ext").orderBy("file_path"))
    near = F.length("file_path") % 2 == 0
    up = F.concat(F.element_at(F.split("folder", "/"), -1))
    target = F.when(F.col("ext") == "rs", F.concat(F.lit("super::"), "next")).when(F.col("ext") == "py", F.when(near, F.concat(F.lit("."), "next")).otherwise(F.concat(up, F.lit("."), "next"))).otherwise(F.concat(F.when(near, "").otherwise(F.concat(F.lit("package:kit/"), up, F.lit("/"))), "next", F.lit(".dart")))
    named = f.withColumn("next", nxt).where("next is not null and ext in ('rs', 'py', 'dart')").select(F.concat(F.lit("code:"), "file_path").alias("module_id"), "file_path", F.lit("").alias("local"), target.alias("target"), F.lit(True).alias("is_glob"), F.lit(False).alias("is_public"), F.lit(False).alias("is_inner"), F.lit(0).alias("pos"))
    return named, f.select(F.concat(F.lit("code:"), "file_path").alias("id"), "file_path")


FILE_IMPORTS = r"""ef as (select distinct repo||'/'||regexp_replace(file, '\.[^./]*$', '')||case length(file) % 3 when 0 then '.rs' when 1 then '.py' else '.dart' end p, repo from (select repo, replace(file, '\', '/') file from index_entities)),
fi as (select p, repo, split_part(p, '.', -1) ext, regexp_replace(split_part(p, '/', -1), '\.[^.]*$', '') base, left(p, length(p) - length(split_part(p, '/', -1)) - 1) folder from ef),
fm as (select *, case when ext = 'rs' then case when instr(p, '/src/') > 0 then left(p, instr(p, '/src/') - 1) else '' end end krate,
  case when ext = 'rs' then left(case when instr(p, '/src/') > 0 then substr(p, instr(p, '/src/') + 5) else p end, -3) end rel from fi),
mo as (select *, case when rel in ('lib', 'main', 'mod') then '' else replace(case when rel like '%/mod' then left(rel, -4) else rel end, '/', '::') end here from fm),
im as (select * from (select *, lead(base) over (partition by folder, ext order by p) nxt, length(p) % 2 = 0 near, split_part(folder, '/', -1) up from mo) where nxt is not null),
ru as (select i.p, i.krate, case when i.here like '%::%' then left(i.here, length(i.here) - length(split_part(i.here, '::', -1)) - 2) else '' end par, i.nxt from im i where ext = 'rs' and here <> ''),
rw as (select ru.*, case when par = '' then nxt else par||'::'||nxt end want from ru),
rh as (select rw.p src, mo.p dst from rw join mo on mo.ext = 'rs' and mo.krate = rw.krate and mo.here = rw.want
  union select rw.p, mo.p from rw join mo on mo.ext = 'rs' and mo.krate = rw.krate and mo.here = rw.par where not exists (select 1 from mo x where x.ext = 'rs' and x.krate = rw.krate and x.here = rw.want)),
dt as (select p, repo, regexp_replace(replace(left(p, -3), '/', '.'), '(^|\.)__init__$', '') dotted from fi where ext = 'py'),
pw as (select p, repo, near, case when near then replace(folder, '/', '.')||'.'||nxt else up||'.'||nxt end want from im where ext = 'py'),
pc as (select pw.p src, pw.repo, dt.p dst, dt.repo = pw.repo same from pw join dt on dt.dotted = pw.want or not near and ends_with(dt.dotted, '.'||pw.want)),
dw as (select p, near, case when near then folder else up end||'/'||nxt||'.dart' want from im where ext = 'dart'),
dc as (select dw.p src, fi.p dst from dw join fi on fi.ext = 'dart' and (fi.p = dw.want or not near and ends_with(fi.p, '/'||dw.want))),
ie as (select src, dst from rh union select src, case when count(*) = 1 then min(dst) when count(*) filter (same) = 1 then min(dst) filter (same) end from pc group by src union select src, case when count(*) = 1 then min(dst) end from dc group by src)"""


def source_files(spark: SparkSession, d: str) -> DataFrame:
    """path, content of the sources, paths made unique by their file id."""
    p = table(spark, d, "parse_inputs")
    return p.select(F.concat("repo", F.lit("/"), "file_id", F.lit("/"), F.translate("display_path", "\\", "/")).alias("path"), "content")


def source_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parse_inputs").select("file_id", F.translate("display_path", "\\", "/").alias("path"))

