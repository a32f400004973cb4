"""Source files to atoms, edges and call sites: the one table function of the core.

Files that fail give an error row and never end a job.  Results depend on the
content and path alone, so they can be kept by content hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import parse, schema
from ..functions import scalars as S
from ..parse.base import TYPED, Item, Lines, Unit
from ..session import spread

_OUT = "file_path string, what string, id string, kind string, name string, line_start int, line_end int, doc string, signature string, content_hash string, parent string, scope string, pos int, target string, rank int, flags int, is_method boolean, extra string"
_TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
_ARROW = pa.schema([(c, _TYPES[t]) for c, t in (x.split() for x in _OUT.split(", "))])


def _row(path: str, pos: int, what: str, id=None, kind=None, name=None, line_start=None, line_end=None, doc=None, signature=None, content_hash=None, parent=None, scope=None, target=None, rank=None, flags=None, is_method=None, extra=None) -> tuple:  # noqa: A002
    """A row of ``_OUT``."""
    return path, what, id, kind, name, line_start, line_end, doc, signature, content_hash, parent, scope, pos, target, rank, flags, is_method, extra


def _item_id(path: str, it: Item) -> str:
    scope = f"{it.scope}::" if it.scope else ""
    if it.kind == "function" and it.parent:
        return f"code:{path}::function::{scope}{it.parent}::{it.name}"
    return f"code:{path}::{it.kind}::{scope}{it.name}"


def _imports(unit: Unit, language: str) -> dict[str, str]:
    """Local names to the paths they stand for, as the language's calls use them."""
    out = {}
    for local, path, glob, public in unit.imports:
        if language == "python" and glob and local:
            out[local] = path.rsplit(".", 1)[-1]
        elif language == "python" and local:
            module, _, name = path.rpartition("::")
            out[local] = f"{module.strip('.').rsplit('.', 1)[-1]}::{name}" if module.strip(".") else name
        elif language == "dart" and local:
            stem = path.rsplit("/", 1)[-1].removesuffix(".dart")
            out[local] = stem if glob else f"{stem}::{local}"
        elif language == "rust" and local and not glob and not public:
            out[local] = path
    return out


def _receiver(it: Item, unit: Unit, recv: str, wide: dict[str, str | None]) -> str | None:
    """The declared type of a method call's receiver; ``wide``: types of names anywhere in the file."""
    if recv in it.local:
        return it.local[recv]
    if recv in wide:
        return wide[recv]
    if recv.startswith(("self.", "this.")):
        owner = (it.parent or "").rsplit(" for ", 1)[-1].split("<")[0].strip()
        return unit.fields.get(owner, {}).get(recv.split(".", 1)[1])
    return None


def _call(it: Item, unit: Unit, names: dict[str, str], wide: dict[str, str | None], language: str, name: str, flags: int, method: bool) -> tuple[str, int, bool]:
    """A recorded call as it is looked up: (name, flags, only a method name)."""
    if not method:
        if name.endswith("!"):
            return name[:-1], flags, False
        head, _, rest = name.partition("::")
        if head in names:
            return (f"{names[head]}::{rest}" if rest else names[head]), flags, False
        return name, flags, False
    recv, _, last = name.rpartition(".")
    owner = (it.parent or "").rsplit(" for ", 1)[-1].split("<")[0].strip()
    if recv in ("self", "this", "Self", "cls") and owner:
        return f"{owner}::{last}", flags, False
    if kind := _receiver(it, unit, recv, wide):
        head, _, rest = kind.partition("::")
        kind = f"{names[head]}::{rest}" if rest and head in names else names.get(kind, kind)
        return f"{kind}::{last}", flags | TYPED, False
    if language == "python" and recv in names and "::" not in names[recv]:
        return f"{names[recv]}::{last}", flags, False
    if language == "dart" and recv in names:
        return f"{names[recv].split('::')[-1]}::{last}", flags, False
    if recv[:1].isupper() and "." not in recv:
        return f"{recv}::{last}", flags, False
    return last, flags, True


def _outward(scope: str) -> Iterator[str]:
    """A scope and all that enclose it."""
    while scope:
        yield scope
        scope = scope.rpartition("::")[0]
    yield ""


def unit_rows(path: str, content: bytes | None) -> list[tuple]:
    """Every row of one file in order; an unreadable file gives one error row.

    Names are looked up in maps of the file that are filled once, so that the
    time grows with the file and not with the square of a class.
    """
    language = parse.LANGUAGES.get(parse.extension(path), ("", None))[0]
    if not language:
        return []
    unit, text = parse.parse_file(path, content)
    rows: list[tuple] = []
    add = rows.append
    if unit.errors and not unit.items and unit.errors[0][1] == "not UTF-8":
        return [_row(path, 0, "error", name=unit.errors[0][1], extra="first")]
    lines = Lines(text)
    module = f"code:{path}"
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    add(_row(path, 0, "atom", module, "module", stem, 1, max(1, len(lines.starts)), "", "", hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(), None, ""))
    for n, (at, what) in enumerate(unit.errors):
        add(_row(path, len(rows), "error", module, name=what, line_start=lines.of(at), extra=None if n else "first"))
    names = _imports(unit, language)
    wide = unit.names() if language == "dart" else {}  # Dart types a name through the whole file
    for n, (local, target, glob, public) in enumerate(unit.imports):
        add(_row(path, len(rows), "import", module, name=local, target=target, rank=n, extra=("glob " if glob else "") + ("public " if public else "") + ("inner" if n in unit.inner_imports else "")))
    owners = {it.name: _item_id(path, it) for it in unit.items if it.kind in ("struct", "trait", "impl", "enum") and not it.inner}
    free: dict[tuple[str, str], str] = {}
    siblings: dict[str, dict[str, str]] = {}
    made: list[tuple[Item, str]] = []
    for it in unit.items:
        if it.kind == "constructor" or it.inner and language == "python":
            continue
        entity = _item_id(path, it)
        made.append((it, entity))
        if it.kind != "function" or not it.parent:
            free[it.scope or "", it.name] = entity
        if it.parent:
            siblings.setdefault(it.parent, {})[it.name] = entity
    for it, entity in made:
        end = it.end if it.end >= 0 else it.name_at + len(it.name)
        body = text[it.start : end]
        sig = " ".join(text[it.start : it.body if it.body > 0 else end].split("\n", 1)[0].split())
        add(_row(path, len(rows), "atom", entity, it.kind, it.name, lines.of(it.start), lines.of(max(end - 1, it.start)), it.doc or "", sig.rstrip(" {:"), "sha256:" + hashlib.sha256(body.encode("utf-8", "replace")).hexdigest(), it.parent, it.scope))
        if it.parent and it.parent in owners:
            add(_row(path, len(rows), "edge", owners[it.parent], "contains", target=entity))
        elif not it.parent and not it.scope:
            add(_row(path, len(rows), "edge", module, "contains", target=entity))
        for n, written in enumerate(dict.fromkeys(it.types)):
            head, _, rest = written.partition("::")
            full = (f"{names[head]}::{rest}" if rest else names[head]) if head in names else written
            add(_row(path, len(rows), "type", entity, name=full, rank=n, scope=it.scope))
        for base in it.bases:
            add(_row(path, len(rows), "base", entity, name=base))
        beside = siblings.get(it.parent or "", {}) if it.parent else {}
        owner = (it.parent or "").rsplit(" for ", 1)[-1].split("<")[0].strip()
        local: dict[str, list[int]] = {}
        for rank, (name, _, flags, method) in enumerate(sorted(it.calls, key=lambda c: c[1])):
            called, flags, only = _call(it, unit, names, wide, language, name, flags, method)
            rank = min(rank, 65535)
            add(_row(path, len(rows), "call", entity, name=called, rank=rank, flags=flags, is_method=only))
            if only:
                continue
            prefix, _, last = called.rpartition("::")
            to = beside.get(last) if it.parent and prefix in ("", "Self", owner) else None
            if to is None and not prefix:
                to = next((free[s, last] for s in _outward(it.scope or "") if (s, last) in free), None)
            if to and to != entity:
                local.setdefault(to, []).append(rank)
        for to, ranks in local.items():
            add(_row(path, len(rows), "edge", entity, "calls", target=to, extra=",".join(map(str, ranks))))
    return rows


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

    for b in batches:
        rows: list[tuple] = []
        for path, content in zip(b.column("path"), b.column("content")):
            rows += unit_rows(path.as_py(), content.as_py())
            if len(rows) >= 20_000:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)


def parse_files(files: DataFrame) -> DataFrame:
    """Raw rows of ``files`` (path, content): atoms, edges, calls, imports, types, errors.

    Null paths and unknown extensions give nothing; null content is empty.
    """
    return spread(files.where("path is not null").select("path", "content")).mapInArrow(_run, _OUT)


def atoms_of(rows: DataFrame) -> DataFrame:
    return rows.where("what = 'atom'").select("id", "kind", "name", "file_path", "line_start", "line_end", "doc", "signature", "content_hash", "parent", "scope", _seq(rows))


def _seq(rows: DataFrame):
    """What orders rows as a sequential scan meets them: by path, then by place in the file.

    ``phase`` 0 is what the parser finds; what later passes add comes after it.
    """
    return F.struct(F.lit(0).alias("phase"), F.col("file_path").alias("path"), "pos").alias("seq")


def edges_of(rows: DataFrame) -> DataFrame:
    ranks = F.when(F.col("extra").isNotNull(), F.transform(F.split("extra", ","), lambda x: x.cast("int")))
    return rows.where("what = 'edge'").select(F.col("id").alias("src"), F.col("target").alias("dst"), "kind", F.lit(None).cast("string").alias("role"), ranks.alias("sites"), _seq(rows))


def call_sites_of(rows: DataFrame) -> DataFrame:
    return rows.where("what = 'call'").select(F.col("id").alias("caller_id"), "name", "rank", "flags", "is_method")


def imports_of(rows: DataFrame) -> DataFrame:
    return rows.where("what = 'import'").select(F.col("id").alias("module_id"), "file_path", F.col("name").alias("local"), "target", F.contains("extra", F.lit("glob")).alias("is_glob"), F.contains("extra", F.lit("public")).alias("is_public"), F.contains("extra", F.lit("inner")).alias("is_inner"), F.col("rank").alias("pos"))


def type_refs_of(rows: DataFrame) -> DataFrame:
    return rows.where("what = 'type'").select(F.col("id").alias("atom_id"), "file_path", "scope", F.col("name").alias("written"), F.col("rank").alias("pos"))


def call_ranks(sites: DataFrame) -> DataFrame:
    """Ranks from places: sites (caller_id, at, ...) numbered from 0 by ``at``."""
    return sites.withColumn("rank", F.row_number().over(Window.partitionBy("caller_id").orderBy("at")) - 1)


def scan_filter(files: DataFrame, exclude: tuple[str, ...] = (), include_generated: bool = False) -> DataFrame:
    """Files that a scan reads: ``path, lang``, by directory, extension and suffix.

    Excluded are the usual build and vendor directories, those that begin with a
    dot, those of ``exclude``, and generated Dart files unless wanted.
    """
    dirs = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    bad = F.exists(dirs, lambda d: d.isin(*schema.EXCLUDED_DIRS, *exclude) | (F.startswith(d, F.lit(".")) & (d != ".")))
    lang = F.when(S.lang_of(F.col("path")) == "rs", "rust").when(S.lang_of(F.col("path")) == "py", "python").when(S.lang_of(F.col("path")) == "dart", "dart")
    out = files.where(~bad).withColumn("lang", lang).where("lang is not null")
    if not include_generated:
        out = out.where(~F.col("path").rlike(r"\.(?:g|freezed|mocks|gr)\.dart$"))
    return out


def parse_report(rows: DataFrame) -> DataFrame:
    """One row: files, atoms, edges, failures.

    A file has one module atom, and the first row of one that has none is its
    error; so files need no shuffle to be counted.
    """
    what, kind = F.col("what"), F.col("kind")
    return rows.agg(
        F.count_if((what == "atom") & (kind == "module")).alias("files"), F.count_if(what == "atom").alias("atoms"),
        F.count_if(what == "edge").alias("edges"), F.count_if((what == "error") & (F.col("extra") == "first")).alias("failures"),
    )


def incremental(files: DataFrame, kept: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(rows of unchanged files, files that must be parsed) by path and blob hash.

    ``kept``: rows of earlier runs with ``blob_sha``.  A damaged or missing store
    is given as None and makes every file new.
    """
    keyed = files.withColumn("blob_sha", S.git_blob_sha1(F.coalesce("content", F.lit(b""))))
    if kept is None:
        return parse_files(files.limit(0)).withColumn("blob_sha", F.lit("")), keyed
    have = kept.select(F.col("file_path").alias("path"), "blob_sha").distinct()
    same = keyed.select("path", "blob_sha").join(have, ["path", "blob_sha"], "left_semi")
    return kept.join(same.withColumnRenamed("path", "file_path"), ["file_path", "blob_sha"], "left_semi"), keyed.join(have, ["path", "blob_sha"], "left_anti")
