"""Scalar functions of the graph as Column expressions; no Python in the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema


def _after_last(c: Column, sep: str) -> Column:
    return F.substring_index(c, sep, -1)


def split_call(name: Column) -> tuple[Column, Column]:
    """(prefix or null, last name) of a call name, cut at the last ``::``."""
    last = _after_last(name, "::")
    return F.when(F.instr(name, "::") > 0, F.left(name, F.length(name) - F.length(last) - 2)), last


def strip_generics(c: Column) -> Column:
    """What stands before the first ``<``, trimmed."""
    return F.trim(F.substring_index(c, "<", 1))


def basename(path: Column) -> Column:
    return _after_last(path, "/")


def lang_of(path: Column) -> Column:
    """The extension of the base name, empty without one."""
    b = basename(path)
    return F.when(F.instr(b, ".") > 0, _after_last(b, ".")).otherwise("")


def stem(path: Column) -> Column:
    """The base name without its extension."""
    b = basename(path)
    return F.when(F.instr(b, ".") > 0, F.left(b, F.length(b) - F.length(_after_last(b, ".")) - 1)).otherwise(b)


def file_module_name(path: Column) -> Column:
    """The module a file stands for; ``mod`` and ``__init__`` take the directory's name."""
    s = stem(path)
    up = F.when(F.instr(path, "/") > 0, F.substring_index(F.left(path, F.length(path) - F.length(basename(path)) - 1), "/", -1)).otherwise("")
    return F.when(s.isin("mod", "__init__"), up).otherwise(s)


def crate_root(path: Column) -> Column:
    """The unit within which names are looked up first; null for an empty path."""
    ext = lang_of(path)
    first = F.substring_index(path, "/", 1)
    return (
        F.when((path == "") | path.isNull(), F.lit(None).cast("string")).when(ext == "dart", "")
        .when(ext == "py", F.when(F.instr(path, "/") > 0, first).otherwise(""))
        .when(F.instr(path, "/src/") > 0, F.left(path, F.instr(path, "/src/") - 1))
        .when(F.startswith(path, F.lit("src/")), "").otherwise(path)
    )


def crate_name(path: Column) -> Column:
    """``crates/X/...`` gives X, any other path its first segment."""
    return F.when(F.startswith(path, F.lit("crates/")), F.split_part(path, F.lit("/"), F.lit(2))).otherwise(F.split_part(path, F.lit("/"), F.lit(1)))


def impl_owner_type(name: Column) -> Column:
    """The type of ``Trait for Type``; null without `` for ``."""
    return F.when(F.instr(name, " for ") > 0, F.trim(F.substring(name, F.instr(name, " for ") + 5, F.lit(1 << 30))))


def rust_module(path: Column) -> tuple[Column, Column, Column]:
    """(crate, ``::`` path, separate target) of a Rust file; nulls for others."""
    rel0 = F.left(path, F.length(path) - 3)
    at = F.instr(rel0, "/src/")
    krate = F.when(at > 0, F.left(rel0, at - 1)).otherwise("")
    rel = F.when(at > 0, F.substring(rel0, at + 5, F.lit(1 << 30))).when(F.startswith(rel0, F.lit("src/")), F.substring(rel0, 5, 1 << 30)).otherwise(rel0)
    segs = F.split(rel, "/")
    head, n = F.element_at(segs, 1), F.size(segs)
    target = head.isin("bin", "tests", "benches", "examples") | ((n == 1) & (head == "main"))
    short = F.when(F.element_at(segs, -1) == "mod", F.slice(segs, 1, F.greatest(n - 1, F.lit(0)))).otherwise(segs)
    mod = F.when((F.size(short) == 1) & F.element_at(short, 1).isin("lib", "main"), "").otherwise(F.array_join(short, "::"))
    rust = F.endswith(path, F.lit(".rs"))
    return F.when(rust, krate), F.when(rust, mod), F.when(rust, target)


def join_module(base: Column, seg: Column) -> Column:
    return F.when(base == "", seg).when(seg == "", base).otherwise(F.concat(base, F.lit("::"), seg))


def parent_module(path: Column) -> Column:
    """The parent of a module path; null at the root."""
    last = _after_last(path, "::")
    return F.when(path == "", F.lit(None).cast("string")).when(F.instr(path, "::") > 0, F.left(path, F.length(path) - F.length(last) - 2)).otherwise("")


def python_dotted(path: Column) -> Column:
    """A Python path with dots, ``__init__`` folded into its package."""
    p = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", "")
    return F.when(F.endswith(path, F.lit(".py")), F.replace(p, F.lit("/"), F.lit(".")))


def sha256_prefix(c: Column, n: int) -> Column:
    return F.left(F.sha2(c, 256), F.lit(n))


def sanitize_id(c: Column) -> Column:
    """An id that diagrams accept; a hash keeps changed names apart."""
    s = F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
    s1 = F.when(s.rlike("^[0-9]"), F.concat(F.lit("_"), s)).otherwise(s)
    s2 = F.when(F.lower(s1).isin(*(w.lower() for w in schema.RESERVED)), F.concat(F.lit("n_"), s1)).otherwise(s1)
    return F.when(c == "", "_").when(c.rlike("[^A-Za-z0-9_]"), F.concat(s2, F.lit("_H"), sha256_prefix(c, 8))).otherwise(s2)


def filename_id(c: Column) -> Column:
    """An id as a file name; upper case is folded and told apart by a hash."""
    s = F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")
    return F.when(s.rlike("[A-Z]"), F.concat(F.lower(s), F.lit("_H"), sha256_prefix(c, 6))).otherwise(s)


def escape_flowchart(c: Column) -> Column:
    return F.translate(F.replace(F.replace(c, F.lit('"'), F.lit("&quot;")), F.lit("]"), F.lit("&rsqb;")), "\n\r", "  ")


def escape_sequence(c: Column) -> Column:
    e = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("#", "_")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return F.translate(e, "\n\r", "  ")


def cap_at(c: Column, most: int) -> Column:
    """One line without double quotes, cut to ``most`` characters and ``...``."""
    one = F.trim(F.regexp_replace(F.translate(c, '"', "'"), r"\s+", " "))
    return F.when(F.char_length(one) > most, F.concat(F.left(one, F.lit(most)), F.lit("..."))).otherwise(one)


def item_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def git_blob_sha1(content: Column) -> Column:
    """The blob id that git gives a content."""
    head = F.concat(F.lit("blob "), F.octet_length(content).cast("string")).cast("binary")
    return F.sha1(F.concat(head, F.lit(b"\x00"), content))


def normalize_eol(text: Column) -> Column:
    """Bare carriage returns as line feeds, a leading mark removed."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r(?!\n)", "\n")


def escape_controls(c: Column) -> Column:
    """Backslashes doubled and control characters but the tab as ``\\xHH``."""
    e = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for code in [*range(0x20), 0x7F]:
        if code != 9:
            e = F.replace(e, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    return e


def display_name(name: Column, path: Column) -> Column:
    """A module's name, or its path where many share the name."""
    return F.when(name.isin("mod", "__init__", "lib", "main", "index"), path).otherwise(name)


def short_kind(kind: Column) -> Column:
    e = F.lit("?")
    for k, w in schema.SHORT_KINDS.items():
        e = F.when(kind == k, w).otherwise(e)
    return e


def entity_label(kind: Column, name: Column, file: Column, entity: Column) -> Column:
    k = F.when(kind == "function", "fn").when(kind == "module", "mod").otherwise(kind)
    base = F.when(k == "", name).otherwise(F.concat(k, F.lit(" "), name))
    return F.when(name == "", entity).when(file == "", base).otherwise(F.concat(base, F.lit(" ("), file, F.lit(")")))


def name_from_id(entity: Column, kind: Column) -> Column:
    mark = F.concat(F.lit("::"), kind, F.lit("::"))
    pos = F.call_function("instr", entity, mark)
    return F.when((kind == "") | (pos == 0), "").otherwise(F.substring(entity, pos + F.length(mark), F.lit(1 << 30)))


def qualified_fn_name(entity: Column) -> Column:
    return F.when(F.instr(entity, "::function::") > 0, F.substring(entity, F.instr(entity, "::function::") + 12, F.lit(1 << 30)))


def item_label(kind: Column, name: Column, parent: Column, path: Column) -> Column:
    """``Owner::f()``, ``class X`` outside Rust, ``type X`` or ``kind X``."""
    fn = F.when(parent.isNotNull(), F.concat(strip_generics(parent), F.lit("::"), name, F.lit("()"))).otherwise(F.concat(name, F.lit("()")))
    shown = F.when((kind == "struct") & ~F.endswith(path, F.lit(".rs")), "class").when(kind == "type_alias", "type").otherwise(kind)
    return F.when(kind == "function", fn).otherwise(F.concat(shown, F.lit(" "), name))


def node_shape(kind: Column, node: Column, label: Column) -> Column:
    c = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    return (
        F.when(kind.isin("struct", "enum", "type_alias"), c(node, "(", label, ")")).when(kind == "trait", c(node, "{{", label, "}}"))
        .when(kind == "impl", c(node, "[/", label, "/]")).when(kind.isin("const", "static"), c(node, "[(", label, ")]"))
        .when(kind == "macro", c(node, "[[", label, "]]")).otherwise(c(node, '["', label, '"]'))
    )


def is_public(signature: Column, name: Column, path: Column) -> Column:
    return F.when(F.endswith(path, F.lit(".rs")), F.startswith(F.ltrim(signature), F.lit("pub"))).otherwise(~F.startswith(name, F.lit("_")))


def is_dependency_name(head: Column) -> Column:
    return head.rlike("^[a-z]") & ~head.isin(*schema.NO_DEPENDENCY)


def is_type_name(name: Column) -> Column:
    return name.rlike(r"^\p{Lu}")


def parse_csv(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), F.trim), lambda x: x != "")


def parse_size(c: Column) -> Column:
    """Bytes of ``10``, ``10K``, ``10M`` or ``10G``; null for anything else."""
    return _number(c, {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}, "[kKmMgG]?")


def parse_duration(c: Column) -> Column:
    """Seconds of ``10`` or ``10`` with s, m, h, d or w; null for anything else."""
    return _number(c, {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}, "[smhdw]?")


def _number(c: Column, units: dict[str, int], unit: str) -> Column:
    t = F.trim(c)
    n = F.regexp_extract(t, r"^(\d+)", 1).try_cast("bigint")
    u = F.lower(F.right(t, F.lit(1)))
    factor = F.lit(1).cast("bigint")
    for k, v in units.items():
        factor = F.when(u == k, F.lit(v).cast("bigint")).otherwise(factor)
    return F.when(t.rlike(rf"^\d+{unit}$"), n * factor)


def summary_comment(fmt: str, files: Column, atoms: Column, edges: Column) -> Column:
    mark = "//" if fmt == "dot" else "%%"
    return F.concat(F.lit(f"{mark} analyzed "), files.cast("string"), F.lit(" files, "), atoms.cast("string"), F.lit(" atoms, "), edges.cast("string"), F.lit(" cross-module edges"))


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0


def clamp_u16(c: Column) -> Column:
    return F.least(c, F.lit(65535))
