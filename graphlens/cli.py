"""Command line: ``python -m graphlens.cli VIEW PATH [--target T] ...``.

Exit codes: 0 done, 1 failed, 2 wrong use.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import engine
from .functions import scalars as S
from .operators import catalog, diff, parsing, sequence, store
from .session import checkpoint_dir
from .sources import files as tree
from .sources import git

VIEWS = ("project", "overview", "module", "function", "impact", "flow", "graph", "sequence", "walk", "bundle", "index", "diff", "gc")
NEEDS_TARGET = ("module", "function", "impact", "flow")


def _list(text: str) -> tuple[str, ...]:
    return tuple(x for x in (y.strip() for y in text.split(",")) if x)


def _edges(text: str) -> tuple[str, ...]:
    try:
        return tuple(dict.fromkeys(engine.EDGE_NAMES[x] for x in _list(text)))
    except KeyError as e:
        raise argparse.ArgumentTypeError(f"no kind of edge is called {e}") from e


def _positive(text: str) -> int:
    if not text.isdecimal() or int(text) < 1:
        raise argparse.ArgumentTypeError(f"{text!r} is no positive number")
    return int(text)


def _size(text: str) -> int:
    unit = {"": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}
    number, end = (text[:-1], text[-1:].upper()) if text[-1:].isalpha() else (text, "")
    if not number.isdecimal() or end not in unit:
        raise argparse.ArgumentTypeError(f"{text!r} is no size")
    return int(number) * unit[end]


def _age(text: str) -> int:
    unit = {"s": 1, "m": 60, "h": 3600, "d": 86400}
    if not text[:-1].isdecimal() or text[-1:] not in unit:
        raise argparse.ArgumentTypeError(f"{text!r} is no age such as 30d")
    return int(text[:-1]) * unit[text[-1]]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphlens")
    p.add_argument("view", choices=VIEWS)
    p.add_argument("path", help="a source tree; for diff OLD..NEW, for gc a store")
    p.add_argument("--target")
    p.add_argument("--ref", help="read a git revision instead of the files; of a subdirectory if the path is one")
    p.add_argument("--repo", default=".", help="for diff: where a revision that the store lacks is read")
    p.add_argument("--exclude", default="", type=_list, help="directories, separated by commas")
    p.add_argument("--include-generated", action="store_true")
    p.add_argument("--format", choices=("mermaid", "dot", "json"), default="mermaid")
    p.add_argument("--out", help="a file; for bundle and sequence a folder")
    p.add_argument("--depth", type=_positive, default=3)
    p.add_argument("--external", choices=("near", "always", "never"), default="near")
    p.add_argument("--max-nodes", type=_positive, default=150)
    p.add_argument("--kinds", type=_list, default=engine.GRAPH_KINDS)
    p.add_argument("--edges", type=_edges, default=engine.GRAPH_EDGES)
    p.add_argument("--group-depth", type=int, default=2)
    p.add_argument("--include-private", action="store_true")
    p.add_argument("--block-depth", type=_positive, default=sequence.MAX_DEPTH, help="nesting that a sequence shows")
    p.add_argument("--store", default="graphlens-store")
    p.add_argument("--no-store", action="store_true", help="neither read nor keep parsed units")
    p.add_argument("--force", action="store_true")
    p.add_argument("--with-sequences", action="store_true")
    p.add_argument("--allow-empty", action="store_true")
    p.add_argument("--max-size", type=_size, default=1 << 30)
    p.add_argument("--older-than", type=_age)
    p.add_argument("--dry-run", action="store_true")
    return p


def _files(spark: SparkSession, a: argparse.Namespace):
    if a.ref:
        spark.dataSource.register(git.GitSource)
        below = git.subdirectory(a.path)
        raw = spark.read.format("graphlens_git").option("repo", a.path).option("ref", a.ref).option("prefix", f"{below}/" if below else "").load()
        return tree.scan_filter(raw.select("path", "content"), a.exclude, a.include_generated)
    return tree.files(spark, a.path, a.exclude, a.include_generated)


def _indexed(spark: SparkSession, a: argparse.Namespace, files) -> tuple[engine.Analysis, store.Store | None]:
    """The graph of ``files``, with units taken from and kept in the store."""
    if a.no_store:
        return engine.analyze(files), None
    kept = store.Store(spark, a.store)
    have = kept.units()
    keyed = files.select("path", "content").withColumn("blob_sha", S.git_blob_sha1(F.coalesce("content", F.lit(b""))))
    todo = keyed if have is None else keyed.join(have.select(F.col("file_path").alias("path"), "blob_sha").distinct(), ["path", "blob_sha"], "left_anti")
    if not todo.isEmpty():
        kept.put_units(parsing.parse_files(todo), todo.select("path", "blob_sha"))
    have = kept.units()
    return (engine.analyze(files) if have is None else engine.analyze(files, have)), kept


def _snapshot(spark: SparkSession, a: argparse.Namespace, files) -> str:
    if a.ref:
        return git.snapshot_id(a.path, a.ref)
    return catalog.digest(files.select("path", S.git_blob_sha1(F.coalesce("content", F.lit(b""))).alias("blob"))).first()["snapshot_id"]


def _index(spark: SparkSession, a: argparse.Namespace) -> tuple[str, bool]:
    """(snapshot, whether it was written); what the store has is not parsed again."""
    files = _files(spark, a)
    snapshot, root = _snapshot(spark, a, files), f"{a.store}/snapshots"
    if not a.force and catalog.exists(spark, f"{root}/snapshot={snapshot}"):
        return snapshot, False
    g, kept = _indexed(spark, a, files)
    written = engine.bundle(g, root, snapshot, a.force)
    if kept is not None:
        kept.auto_collect(store.Policy.from_env())
    return snapshot, written


def _diff(spark: SparkSession, a: argparse.Namespace) -> str:
    old, dots, new = a.path.partition("..")
    if not dots or not old or not new:
        raise ValueError("diff needs OLD..NEW")
    root, ids = f"{a.store}/snapshots", []
    for ref in (old, new):
        if catalog.exists(spark, f"{root}/snapshot={ref}"):
            ids.append(ref)
        else:  # a revision that is not indexed yet
            ids.append(_index(spark, argparse.Namespace(**{**vars(a), "path": a.repo, "ref": ref, "force": False}))[0])
    if a.format != "json":
        return engine.difference_text(spark, root, *ids)
    changed, radius = engine.compare(spark, root, *ids)
    out = {"from": ids[0], "to": ids[1], "changes": [r.asDict() for r in changed.orderBy("change_type", "id").toLocalIterator()], "counts": {r["change_type"]: r["n"] for r in diff.counts(changed).collect()}, "edges": [r.asDict() for r in radius.orderBy("src", "dst").toLocalIterator()]}
    return json.dumps(out, indent=2, ensure_ascii=False)


def _bundle(spark: SparkSession, a: argparse.Namespace) -> str:
    files = _files(spark, a)
    g, _ = _indexed(spark, a, files)
    now = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    docs = engine.documents(g, os.path.abspath(a.path), now, files if a.with_sequences else None)
    kept = store.Store(spark, a.store)
    name = _snapshot(spark, a, files) if a.ref else "worktree"
    counts = kept.put_bundle(name, docs, a.allow_empty)
    if a.out:
        counts = store.export(kept.bundle(name), a.out)
    return json.dumps({"bundle": name} | counts)


def _sequences(spark: SparkSession, a: argparse.Namespace) -> str:
    drawn = engine.sequences(_files(spark, a), a.target, a.block_depth)
    if a.out and not a.target:
        named = drawn.select(F.concat(F.lit("sequences/"), S.filename_id(F.col("fn_id")), F.lit(".mmd")).alias("path"), F.concat("diagram", F.lit("\n")).alias("content"))
        text, a.out = json.dumps(store.export(named, a.out)), None
        return text
    return "\n\n".join(f"%% {r['fn_id']}\n{r['diagram']}" for r in drawn.orderBy("fn_id").toLocalIterator())


def _summary(g: engine.Analysis, fmt: str) -> str:
    """What was read, as a comment that a diagram's reader skips."""
    r = parsing.parse_report(g.rows)
    crossing = g.edges.where("seq.phase > 0").count()
    return r.select(S.summary_comment(fmt, F.col("files"), F.col("atoms"), F.lit(crossing)).alias("s")).first()["s"]


def run(a: argparse.Namespace, spark: SparkSession) -> str:
    """The text a command prints."""
    if a.view in NEEDS_TARGET and not a.target:
        raise ValueError(f"{a.view} needs --target")
    if a.view == "diff":
        return _diff(spark, a)
    if a.view == "gc":
        return json.dumps(store.Store(spark, a.path).collect_garbage(a.max_size, a.older_than, a.dry_run))
    if a.view == "index":
        snapshot, written = _index(spark, a)
        return f"{snapshot}\t{'written' if written else 'kept'}"
    if a.view == "bundle":
        text, a.out = _bundle(spark, a), None
        return text
    if a.view == "sequence":
        return _sequences(spark, a)
    files = _files(spark, a)
    if a.view == "walk":
        return "\n".join(f"{r['lang']}\t{r['path']}" for r in files.select("lang", "path").orderBy("path").toLocalIterator())
    g = engine.analyze(files)
    if a.view == "flow":
        f = engine.flow(g, a.target, a.depth, a.external)
        text = engine.text(f["nodes"], f["edges"], a.format)
    elif a.view == "graph":
        text = engine.graph_text(g, a.max_nodes, a.kinds, a.edges, a.group_depth, a.include_private, a.format)
    elif a.view in ("project", "overview"):
        text = engine.text(*getattr(engine, a.view)(g), a.format)
    else:
        text = engine.text(*getattr(engine, a.view)(g, a.target), a.format)
    summary = _summary(g, a.format)
    if a.out:
        print(summary, file=sys.stderr)
        return text
    return f"{text}\n{summary}"


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("graphlens").getOrCreate()
    checkpoint_dir(spark)
    try:
        out = run(a, spark)
        if a.out:
            with open(a.out, "w", encoding="utf-8") as f:
                f.write(out + "\n")
        else:
            print(out)
    except (ValueError, LookupError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
