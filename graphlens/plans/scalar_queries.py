"""Scalar functions over names, paths and texts of the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars as S
from ..session import table


def _entities(spark, d):
    return table(spark, d, "index_entities").select("id", "kind", "name", F.translate("file", "\\", "/").alias("path"))


def _docs(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", "text")


def scalar_sanitize_id(spark, d):
    return _entities(spark, d).select("id").distinct().select("id", S.sanitize_id(F.col("id")).alias("safe"))


def scalar_filename_id(spark, d):
    return _entities(spark, d).select("id").distinct().select("id", S.filename_id(F.col("id")).alias("file_name"))


def scalar_escape_flow(spark, d):
    return _docs(spark, d).select("doc_id", S.escape_flowchart(F.col("text")).alias("escaped"))


def scalar_escape_seq(spark, d):
    return _docs(spark, d).select("doc_id", S.escape_sequence(F.col("text")).alias("escaped"))


def scalar_crate_root(spark, d):
    return _entities(spark, d).select("path").distinct().select("path", S.crate_root(F.col("path")).alias("root"), S.crate_name(F.col("path")).alias("crate"))


def scalar_module_name(spark, d):
    return _entities(spark, d).select("path").distinct().select("path", S.file_module_name(F.col("path")).alias("module"), S.lang_of(F.col("path")).alias("lang"), S.stem(F.col("path")).alias("stem"))


def scalar_split_call(spark, d):
    prefix, last = S.split_call(F.col("id"))
    return _entities(spark, d).select("id").distinct().select("id", prefix.alias("prefix"), last.alias("last"))


def scalar_mod_pos(spark, d):
    k, m, t = S.rust_module(F.col("path"))
    return _entities(spark, d).select("path").distinct().select("path", k.alias("krate"), m.alias("module"), t.alias("target"))


def scalar_hashes(spark, d):
    return _docs(spark, d).select("doc_id", S.item_hash(F.col("text")).alias("item"), S.git_blob_sha1(F.col("text").cast("binary")).alias("blob"))


def scalar_cap_label(spark, d):
    plain = F.regexp_replace(F.col("text"), r"[^\x21-\x7e\n ]", "?")
    return _docs(spark, d).select("doc_id", S.cap_at(plain, 24).alias("participant"), S.cap_at(plain, 32).alias("label"))


def scalar_labels(spark, d):
    e = _entities(spark, d).distinct()
    return e.select("id", "path", "name", "kind", S.entity_label(F.col("kind"), F.col("name"), F.col("path"), F.col("id")).alias("label"), S.name_from_id(F.col("id"), F.col("kind")).alias("from_id"), S.short_kind(F.col("kind")).alias("short"))


def scalar_sizes(spark, d):
    n = table(spark, d, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, ("", "K", "m", "G", "d", "x"))), (F.col("p_partkey") % 6 + 1).cast("int"))).alias("t"))
    return n.select("p_partkey", "t", S.parse_size(F.col("t")).alias("bytes"), S.parse_duration(F.col("t")).alias("seconds"))


def scalar_atom_labels(spark, d):
    """Names of atoms as views write them; parents with a trait put before every third."""
    n, parent, path = F.col("name"), F.col("parent"), F.col("file_path")
    impl = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("kit::Run<T> for "), parent)).otherwise(parent)
    return table(spark, d, "atoms").select(
        "seq", S.qualified_fn_name(F.col("id")).alias("fn_name"), S.item_label(F.col("kind"), n, parent, path).alias("item"), S.impl_owner_type(impl).alias("owner"), S.is_type_name(n).alias("is_type"),
        S.is_public(F.coalesce("signature", F.lit("")), n, path).alias("is_public"), S.display_name(S.stem(path), path).alias("shown"),
    )


def scalar_module_paths(spark, d):
    _, m, _ = S.rust_module(F.col("path"))
    p = _entities(spark, d).select("path").distinct().select("path", m.alias("m"), F.regexp_replace("path", r"\.rs$", ".py").alias("py"))
    return p.select("path", S.parent_module(F.col("m")).alias("parent"), S.join_module(F.col("m"), S.stem(F.col("path"))).alias("child"), S.python_dotted(F.col("py")).alias("dotted"))


def scalar_text_forms(spark, d):
    t = F.concat(F.when(F.col("doc_id") % 3 == 0, "\ufeff").otherwise(""), F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".\r")), F.lit(", "), F.lit(",\r\n\t")))
    return _docs(spark, d).select("doc_id", S.normalize_eol(t).alias("eol"), S.escape_controls(F.replace(t, F.lit("a"), F.lit("\\"))).alias("controls"), S.clamp_u16(F.col("doc_id") * 97).alias("clamped"))


QUERIES = {f.__name__: f for f in (
    scalar_sanitize_id, scalar_filename_id, scalar_escape_flow, scalar_escape_seq, scalar_crate_root, scalar_module_name,
    scalar_split_call, scalar_mod_pos, scalar_hashes, scalar_cap_label, scalar_labels, scalar_sizes, scalar_atom_labels, scalar_module_paths, scalar_text_forms,
)}

_WORDS = ", ".join(f"'{w.lower()}'" for w in schema.RESERVED)
_PATHS = r"with p as (select distinct replace(file, '\', '/') path from index_entities), b as (select path, split_part(path, '/', -1) b from p), q as (select path, b, case when contains(b, '.') then split_part(b, '.', -1) else '' end x from b)"
_DOCS = "from documents where text is not null"


def _cap(n: int) -> str:
    return f"case when length(o) > {n} then left(o, {n})||'...' else o end"


def _controls(x: str) -> str:
    """Control characters but the tab as a backslash, x and two hex digits."""
    for code in [*range(0x20), 0x7F]:
        if code != 9:
            x = f"replace({x}, chr({code}), '\\x{code:02x}')"
    return x


SQL = {
    "scalar_sanitize_id": rf"""with i as (select distinct id, regexp_replace(id, '[^A-Za-z0-9_]', '_', 'g') s from index_entities),
j as (select id, case when regexp_matches(s, '^[0-9]') then '_'||s else s end s from i), k as (select id, case when lower(s) in ({_WORDS}) then 'n_'||s else s end s from j)
select id, case when id = '' then '_' when regexp_matches(id, '[^A-Za-z0-9_]') then s||'_H'||left(sha256(id), 8) else s end safe from k""",
    "scalar_filename_id": r"""with i as (select distinct id, regexp_replace(id, '[^A-Za-z0-9._-]', '_', 'g') s from index_entities)
select id, case when regexp_matches(s, '[A-Z]') then lower(s)||'_H'||left(sha256(id), 6) else s end file_name from i""",
    "scalar_escape_flow": f"select doc_id, translate(replace(replace(text, '\"', '&quot;'), ']', '&rsqb;'), chr(10)||chr(13), '  ') escaped {_DOCS}",
    "scalar_escape_seq": f"select doc_id, translate(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '#', '_'), chr(10)||chr(13), '  ') escaped {_DOCS}",
    "scalar_crate_root": _PATHS + r""" select path, case when path = '' then null when x = 'dart' then '' when x = 'py' then case when contains(path, '/') then split_part(path, '/', 1) else '' end
when contains(path, '/src/') then left(path, instr(path, '/src/') - 1) when path like 'src/%' then '' else path end root, case when path like 'crates/%' then split_part(path, '/', 2) else split_part(path, '/', 1) end crate from q""",
    "scalar_module_name": _PATHS + r""", r as (select *, case when contains(b, '.') then left(b, length(b) - length(x) - 1) else b end st from q)
select path, case when st in ('mod', '__init__') then case when contains(path, '/') then split_part(path, '/', -2) else '' end else st end as module, x lang, st stem from r""",
    "scalar_split_call": "select distinct id, case when contains(id, '::') then left(id, length(id) - length(split_part(id, '::', -1)) - 2) end prefix, split_part(id, '::', -1) as last from index_entities",
    "scalar_mod_pos": _PATHS + r""", r as (select path, left(path, length(path) - 3) r from p where path like '%.rs'),
s as (select path, case when instr(r, '/src/') > 0 then left(r, instr(r, '/src/') - 1) else '' end k, case when instr(r, '/src/') > 0 then substr(r, instr(r, '/src/') + 5) when r like 'src/%' then substr(r, 5) else r end r from r),
l as (select path, k, string_split(r, '/') l from s), m as (select path, k, l, case when l[-1] = 'mod' then l[:-2] else l end t from l)
select p.path, k krate, case when len(t) = 1 and t[1] in ('lib', 'main') then '' else array_to_string(t, '::') end as module, l[1] in ('bin', 'tests', 'benches', 'examples') or (len(l) = 1 and l[1] = 'main') target from p left join m on m.path = p.path""",
    "scalar_hashes": f"select doc_id, 'sha256:'||sha256(text) item, sha1(encode('blob '||octet_length(encode(text))) || '\\x00'::blob || encode(text)) as blob {_DOCS}",
    "scalar_cap_label": r"""with q as (select doc_id, trim(regexp_replace(replace(regexp_replace(text, '[^\x21-\x7e\n ]', '?', 'g'), '"', ''''), '\s+', ' ', 'g')) o """ + _DOCS + f") select doc_id, {_cap(24)} participant, {_cap(32)} as label from q",
    "scalar_labels": r"""with e as (select distinct id, kind, name, replace(file, '\', '/') path from index_entities)
select id, path, name, kind, case when name = '' then id else case kind when 'function' then 'fn ' when 'module' then 'mod ' when '' then '' else kind||' ' end||name||case when path = '' then '' else ' ('||path||')' end end as label,
case when kind = '' or not contains(id, '::'||kind||'::') then '' else substr(id, instr(id, '::'||kind||'::') + length(kind) + 4) end from_id,
case kind when 'function' then 'fn' when 'type_alias' then 'type' when 'module' then '?' when 'union' then '?' else kind end short from e""",
    "scalar_sizes": r"""with n as (select p_partkey, p_size||['', 'K', 'm', 'G', 'd', 'x'][p_partkey % 6 + 1] t, p_size::bigint z, p_partkey % 6 u from part)
select p_partkey, t, case u when 0 then z when 1 then z * 1024 when 2 then z * 1048576 when 3 then z * 1073741824 end bytes, case u when 0 then z when 2 then z * 60 when 4 then z * 86400 end as seconds from n""",
    "scalar_atom_labels": r"""with a as (select *, split_part(file_path, '/', -1) b, case when seq % 3 = 0 then 'kit::Run<T> for '||parent else parent end im from atoms), s as (select *, regexp_replace(b, '\.[^.]*$', '') st from a)
select seq, case when contains(id, '::function::') then substr(id, instr(id, '::function::') + 12) end fn_name, case when kind = 'function' then case when parent is null then name||'()' else trim(split_part(parent, '<', 1))||'::'||name||'()' end
  when kind = 'struct' and not ends_with(file_path, '.rs') then 'class '||name when kind = 'type_alias' then 'type '||name else kind||' '||name end item, case when contains(im, ' for ') then trim(substr(im, instr(im, ' for ') + 5)) end as owner,
  regexp_matches(name, '^\p{Lu}') is_type, case when ends_with(file_path, '.rs') then starts_with(ltrim(coalesce(signature, '')), 'pub') else not starts_with(name, '_') end is_public, case when st in ('mod', '__init__', 'lib', 'main', 'index') then file_path else st end shown from s""",
    "scalar_module_paths": _PATHS + r""", r as (select path, left(path, length(path) - 3) r, regexp_replace(b, '\.[^.]*$', '') st from b), s as (select path, st, r whole, case when instr(r, '/src/') > 0 then substr(r, instr(r, '/src/') + 5) when r like 'src/%' then substr(r, 5) else r end r from r),
m as (select path, st, whole, case when r in ('lib', 'main', 'mod') then '' else replace(case when r like '%/mod' then left(r, -4) else r end, '/', '::') end m from s)
select path, case when m = '' then null when contains(m, '::') then left(m, length(m) - length(split_part(m, '::', -1)) - 2) else '' end parent, case when m = '' then st else m||'::'||st end child, replace(regexp_replace(whole, '(^|/)__init__$', ''), '/', '.') dotted from m""",
    "scalar_text_forms": r"""with t as (select doc_id, case when doc_id % 3 = 0 then chr(65279) else '' end||replace(replace(text, '. ', '.'||chr(13)), ', ', ','||chr(13)||chr(10)||chr(9)) t from documents where text is not null),
e as (select doc_id, t, replace(replace(replace(regexp_replace(t, '^'||chr(65279), ''), chr(13)||chr(10), chr(1)), chr(13), chr(10)), chr(1), chr(13)||chr(10)) eol, replace(replace(t, 'a', '\'), '\', '\\') x from t) select doc_id, eol, """ + _controls("x") + """ controls, least(doc_id * 97, 65535) clamped from e""",
}
