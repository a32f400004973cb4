"""Core operators on small tables: properties, nulls, ties, empty input."""

import datetime as dt
import hashlib
import json
import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from graphlens import engine
from graphlens.operators import catalog, diff, graph, incremental, parsing, resolve, sequence, snapshots, traverse
from graphlens.plans import graph_queries
from graphlens.sources import files as tree
from graphlens.sources import git
from graphlens.streaming import ingest

T = lambda d, h=0: dt.datetime(2025, 1, d, h)
ENT = "snapshot_id string, id string, content_hash string, edges_out array<string>, repo string"
SNAP = "snapshot_id string, repo string, source_root string, n_entities bigint, taken_at timestamp_ntz, delivered_at timestamp_ntz"


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_snapshot_changes(spark):
    e = spark.createDataFrame(
        [
            ("s1", "a", "sha256:AA", ["x", "y"], "other"), ("s1", "a", "aa", ["x", "y"], None), ("s1", "b", None, None, "r"), ("s1", "d\\e", "d", [], "r"),
            ("s2", "a", "aa", ["y", "x", "x"], "r"), ("s2", "b", "bb", [], "r"), ("s2", "c", "", ["p\\q"], "r"), ("s2", "d/e", "D", None, "r"),
            ("s3", "a", "ab", ["x", "y"], "r"),  # incomplete
            ("s4", "a", "ab", ["x", "y"], "r"), ("s4", "c", "cc", ["p/q"], "r"), ("s4", "b", "bb", ["new"], "r"),
            ("s5", "a", "ab", ["x", "y"], "r"), ("s5", "d/e", "d", None, "r"), (None, "z", "z", None, "r"), ("s5", None, "z", None, "r"),
        ],
        ENT,
    )
    s = spark.createDataFrame([("s2", "r", "p", 4, T(2), T(9)), ("s1", "r", "p", 3, T(1), T(1)), ("s1", "r", "p", 3, T(1), T(5)), ("s3", "r", "p", 9, T(3), T(3)), ("s4", "r", "p", 3, T(4), T(4)), ("s5", "r", "p", 2, T(5), T(5)), ("s9", "r", None, 2, T(5), T(5))], SNAP)
    assert rows(snapshots.snapshot_changes(e, s)) == {
        ("s2", "c", "added"), ("s4", "a", "changed"), ("s4", "b", "changed"), ("s4", "d/e", "removed"),
        ("s5", "b", "removed"), ("s5", "c", "removed"), ("s5", "d/e", "added"),
    }
    assert snapshots.snapshot_changes(e.limit(0), s).count() == 0
    assert snapshots.snapshot_changes(e, s.limit(0)).count() == 0


LOG = "log_id bigint, repo string, source_root string, display_path string, blob_sha string, scanned_at timestamp_ntz, landed_at timestamp_ntz"
RUN = "run_id bigint, repo string, source_root string, outcome string, started_at timestamp_ntz"


def _log(rng, n=300):
    paths = ["a.rs", "./a.rs", "lib//b.py", "lib\\b.py", "c.dart"]
    out = []
    for i in range(n):
        at = dt.datetime(2025, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 20))
        out.append((i, rng.choice("rs"), "p", rng.choice(paths), rng.choice(["A1", "a1", "b2", None]), at, at + dt.timedelta(hours=rng.choice([0, 1, 90]))))
    return out + out[:20]


def test_replay_is_what_one_run_after_another_finds(spark, tmp_path):
    rng = random.Random(12)
    log = _log(rng, 120)
    runs = [(k, "r", "p", rng.choice(["succeeded", "succeeded", "failed", None]), dt.datetime(2025, 1, 1) + dt.timedelta(hours=40 * k + 7)) for k in range(8)]
    d, r = spark.createDataFrame(log, LOG), spark.createDataFrame(runs, RUN)
    store, want = incremental.ManifestStore(spark, str(tmp_path / "m")), set()
    for run_id, _, _, outcome, at in runs:
        found = incremental.listing(d.where("repo = 'r'"), str(at)).select(F.col("path").alias("key"), F.lit(None).cast("bigint").alias("size"), F.col("blob").alias("checksum"))
        if outcome != "succeeded":
            with pytest.raises(RuntimeError):
                store.run(f"b{run_id}", found, fail_before_commit=True)
            continue
        assert store.run(f"b{run_id}", found) and not store.run(f"b{run_id}", found)
        want |= {(run_id, x["key"], x["checksum"]) for x in store.records().where(F.col("batch") == f"b{run_id}").collect()}
    assert rows(incremental.replay(d, r)) == want and len(want) > 3


def test_a_series_beyond_a_broadcast_is_split(spark, monkeypatch):
    rng = random.Random(13)
    d = spark.createDataFrame(_log(rng, 300), LOG)
    r = spark.createDataFrame([(k, rng.choice("rs"), "p", "succeeded", dt.datetime(2025, 1, 1) + dt.timedelta(hours=9 * k)) for k in range(40)], RUN)
    want = rows(incremental.replay(d, r))
    monkeypatch.setattr(incremental, "fits", lambda *a: False)
    assert rows(incremental.replay(d, r)) == want and want


def test_a_batch_and_its_manifest_come_from_one_evaluation(spark, tmp_path):
    store = incremental.ManifestStore(spark, str(tmp_path / "m"))
    moving = spark.range(4).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(1).cast("bigint").alias("size"), F.uuid().alias("checksum"))
    store.run("a", moving, process=lambda w: w.withColumn("n", F.length("key")))
    assert rows(store.records().select("key", "checksum")) == rows(store.manifest().select("key", "checksum"))


def test_two_runs_that_read_one_manifest_do_not_both_commit(spark, tmp_path):
    store = incremental.ManifestStore(spark, str(tmp_path / "m"))
    f = spark.createDataFrame([("k", 1, "c")], "key string, size bigint, checksum string")

    def late(w):
        if not store.committed():
            incremental.ManifestStore(spark, store.root).run("other", f)
        return w

    with pytest.raises(RuntimeError, match="run it again"):
        store.run("first", f, process=late)
    assert store.committed() == ["other"] and store.run("first", f) and store.records().count() == 1


def _current(log, series, moment):
    best = {}
    for i, r, s, p, b, at, land in log:
        if (r, s) == series and b and land <= moment:
            key = p.replace("\\", "/").replace("//", "/").removeprefix("./")
            best[key] = max(best.get(key, (at, i, b.lower())), (at, i, b.lower()))
    return {k: v[2] for k, v in best.items()}


def test_replay_equals_brute_force(spark):
    rng = random.Random(3)
    log = _log(rng)
    runs = [(k, rng.choice("rs"), "p", rng.choice(["succeeded", "failed", None, "succeeded"]), dt.datetime(2025, 1, 2) + dt.timedelta(hours=rng.randrange(24 * 25))) for k in range(30)]
    runs.append((99, "r", "p", "succeeded", runs[0][4]))
    want = set()
    for series in (("r", "p"), ("s", "p")):
        before = {}
        for run in sorted((x for x in runs if x[1:3] == series and x[3] == "succeeded"), key=lambda x: (x[4], x[0])):
            now = _current(log, series, run[4])
            want |= {(run[0], p, b) for p, b in now.items() if before.get(p) != b}
            before = now
    got = incremental.replay(spark.createDataFrame(log, LOG), spark.createDataFrame(runs, RUN))
    assert rows(got) == want and got.count() == len(want)
    assert incremental.replay(spark.createDataFrame([], LOG), spark.createDataFrame(runs, RUN)).count() == 0


def test_runs_beyond_a_broadcast_move_the_log_once(spark, monkeypatch):
    rng = random.Random(14)
    log, start = _log(rng, 400), dt.datetime(2025, 1, 2)
    runs = [(k, rng.choice("rs"), "p", rng.choice(["succeeded", "succeeded", "failed"]), start + dt.timedelta(hours=rng.randrange(24 * 25))) for k in range(40)]
    runs += [(100 + k, r, "p", "succeeded", at) for k, (_, r, _, _, at) in enumerate(runs[:8])]
    runs += [(200 + k, row[1], "p", "succeeded", row[6]) for k, row in enumerate(log[:8])]
    want = set()
    for series in (("r", "p"), ("s", "p")):
        before = {}
        for run in sorted((x for x in runs if x[1:3] == series and x[3] == "succeeded"), key=lambda x: (x[4], x[0])):
            now = _current(log, series, run[4])
            want |= {(run[0], p, b) for p, b in now.items() if before.get(p) != b}
            before = now
    d, r = spark.createDataFrame(log, LOG), spark.createDataFrame(runs, RUN)
    assert rows(incremental.replay(d, r)) == want
    monkeypatch.setattr(incremental, "fits", lambda *a: False)
    got = incremental.replay(d, r)
    assert rows(got) == want and got.count() == len(want)
    plan = incremental.listings(d, r)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Scan ExistingRDD[log_id") == 1 and plan.count("Exchange hashpartitioning") == 2


def test_manifest_survives_failures_and_agrees_with_replay(spark, tmp_path):
    log = spark.createDataFrame([r for r in _log(random.Random(5), 80) if r[1] == "r"], LOG)
    moments = [(1, "2025-01-05 00:00:00"), (2, "2025-01-09 00:00:00"), (3, "2025-01-20 00:00:00")]
    runs = spark.createDataFrame([(k, "r", "p", "succeeded", dt.datetime.fromisoformat(m)) for k, m in moments], RUN)
    store = incremental.ManifestStore(spark, f"file://{tmp_path}/store")
    for k, m in moments:
        files = incremental.listing(log, m).select(F.col("path").alias("key"), F.lit(1).cast("bigint").alias("size"), F.col("blob").alias("checksum"))
        with pytest.raises(RuntimeError):
            store.run(f"b{k}", files, fail_before_commit=True)
        assert store.run(f"b{k}", files) and not store.run(f"b{k}", files)
    done = {(int(r["batch"][1:]), r["key"], r["checksum"]) for r in store.records().collect()}
    assert done == rows(incremental.replay(log, runs))
    assert store.committed() == ["b1", "b2", "b3"]


def test_upsert_keeps_the_last_by_seq(spark):
    a = spark.createDataFrame([("x", "n1", 1, "h"), ("x", "n2", 5, "h"), ("y", None, 2, None), ("x", "n3", 5, "z")], "id string, name string, seq bigint, content_hash string")
    assert rows(graph.upsert(a).select("id", "name", "seq", "seq_first")) == {("x", "n3", 5, 1), ("y", None, 2, 2)}


def test_budget_fill_equals_the_greedy_loop(spark):
    rng = random.Random(11)
    for _ in range(12):
        n, budget = rng.randrange(1, 30), rng.randrange(1, 25)
        items = [(f"i{k}", f"f{rng.randrange(8)}", k + 1) for k in range(n)]
        used, files, want = 0, set(), set()
        for i, f, _k in items:
            cost = 1 + (f not in files)
            if used + cost <= budget:
                used += cost
                files.add(f)
                want.add(i)
        got = graph.budget_fill(spark.createDataFrame(items, "id string, file_path string, rank int"), budget)
        assert {r["id"] for r in got.collect()} == want


def test_eviction_equals_the_loop(spark):
    rng = random.Random(2)
    e = [(f"k{i}", rng.choice([None, 1, 5, 30]), rng.randrange(40)) for i in range(50)]
    size = {k: s or 0 for k, s, _ in e}
    left, want = sum(size.values()), set()
    for k, _, _m in sorted(e, key=lambda x: (x[2], x[0])):
        if left > 100:
            left -= size[k]
            want.add(k)
    got = catalog.evicted(spark.createDataFrame(e, "key string, size bigint, mtime bigint"), 100)
    assert {r["key"] for r in got.collect()} == want


def _walk(edges, root, hops, reverse):
    adj = {}
    for s, d, q in sorted(edges, key=lambda x: x[2]):
        a, b = (d, s) if reverse else (s, d)
        adj.setdefault(a, []).append(b)
    parent, frontier, out, seen = {root: None}, [root], set(), {root}
    for _ in range(hops):
        nxt = []
        for n in frontier:
            path, p = set(), n
            while p is not None:
                path.add(p)
                p = parent[p]
            for m in adj.get(n, []):
                if m == root or m in path:
                    continue
                out.add((m, n) if reverse else (n, m))
                if m not in seen:
                    seen.add(m)
                    parent[m] = n
                    nxt.append(m)
        frontier = nxt
    return out, seen


@pytest.mark.parametrize("seed", [1, 2])
def test_bfs_equals_the_walk(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(40)})
    e = [(a, b, k) for k, (a, b) in enumerate(rng.sample(pairs, len(pairs)))]
    df = spark.createDataFrame(e, "src string, dst string, seq bigint")
    for reverse in (False, True):
        edges, nodes = traverse.bounded_bfs(df, "n0", 3, reverse)
        want_e, want_n = _walk(e, "n0", 3, reverse)
        assert rows(edges) == want_e and {r["id"] for r in nodes.collect()} == want_n
    assert traverse.bounded_bfs(df, "missing", 3)[0].count() == 0


def test_diff_identity_and_renames(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "3"), ("e", None), ("f", "")], "id string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("c2", "3"), ("e", None), ("g", "")], "id string, content_hash string")
    got = rows(diff.changes(old, new))
    assert got == {("modified", "b", None), ("renamed", "c2", "c"), ("removed", "d", None), ("removed", "f", None), ("added", "g", None)}
    n = {r["change_type"]: r["n"] for r in diff.counts(diff.changes(old, new)).collect()}
    assert old.count() == n["removed"] + n["renamed"] + n["modified"] + 2


A_RS = """//! Alpha.
use crate::beta::{first, Helper};
/// A store of things.
pub struct Store { inner: Helper }
pub trait Run { fn run(&self); }
impl Run for Store { fn run(&self) { self.step(); } }
impl Store {
    pub fn step(&self) { self.inner.assist(); missing::thing(); }
    pub async fn go(&self) { if ready() { self.step(); } for x in 0..3 { first(x).await; } }
}
pub fn ready() -> bool { let s: Store = make(); s.step(); true }
fn make() -> Store { todo!() }
"""
B_RS = """pub struct Helper;
impl Helper { pub fn assist(&self) { second(1) } }
pub fn first(x: u8) { second(x) }
pub fn second(x: u8) { third(x) }
fn third(x: u8) { if x > 3 { fourth() } }
fn fourth() {}
"""
PY = """from .util import helper as h
import other
class Base:
    def run(self):
        '''Runs the thing.'''
        return h(1)
class Child(Base):
    def go(self, x: Base):
        x.run()
        self.run2()
    def run2(self): other.call()
"""


@pytest.fixture(scope="module")
def analysis(spark):
    src = [("src/alpha.rs", A_RS), ("src/beta.rs", B_RS), ("pkg/main.py", PY), ("pkg/util.py", "def helper(x):\n    return x\n"), ("other.py", "def call(): pass\n"), ("lib/a.dart", "import 'b.dart';\nint f() => g();\n"), ("lib/b.dart", "int g() => 1;\n"), ("bad.rs", None)]
    return engine.analyze(spark.createDataFrame([(p, (t or "fn f( {").encode()) for p, t in src], "path string, content binary"))


def test_golden_edges(analysis):
    short = lambda x: x.replace("code:", "").replace("::function::", "#")
    calls = {(short(r["src"]), short(r["dst"])) for r in analysis.edges.where("kind = 'calls'").collect()}
    assert {
        ("src/alpha.rs#Store::step", "src/beta.rs#Helper::assist"), ("src/alpha.rs#Store::go", "src/beta.rs#first"), ("src/alpha.rs#Store::go", "src/alpha.rs#Store::step"),
        ("src/alpha.rs#ready", "src/alpha.rs#Store::step"), ("src/beta.rs#first", "src/beta.rs#second"), ("src/beta.rs#second", "src/beta.rs#third"),
        ("src/alpha.rs#Store::step", "extern:missing::thing"), ("pkg/main.py#Base::run", "pkg/util.py#helper"), ("pkg/main.py#Child::go", "pkg/main.py#Base::run"),
        ("pkg/main.py#Child::go", "pkg/main.py#Child::run2"), ("pkg/main.py#Child::run2", "other.py#call"), ("lib/a.dart#f", "lib/b.dart#g"),
    } <= calls, calls
    assert not any(a.endswith(".rs") and b.endswith(".py") for a, b in calls)
    kinds = rows(analysis.edges.where("kind = 'imports'").select("src", "dst"))
    assert {("code:src/alpha.rs", "code:src/beta.rs"), ("code:pkg/main.py", "code:pkg/util.py"), ("code:pkg/main.py", "code:other.py"), ("code:lib/a.dart", "code:lib/b.dart")} <= kinds
    assert ("code:src/alpha.rs::impl::Run for Store", "code:src/alpha.rs::trait::Run") in rows(analysis.edges.where("kind = 'implements'").select("src", "dst"))


def test_flags_and_failures(analysis):
    site = {r["name"]: r["flags"] for r in analysis.call_sites.where("caller_id like '%::go' and caller_id like '%alpha%'").collect()}
    assert site["crate::beta::first"] == 5 and site["Store::step" if "Store::step" in site else "Run for Store::step"] & 2
    assert parsing.parse_report(analysis.rows).first()["failures"] == 1


def test_views(analysis):
    assert "graph LR" in engine.text(*engine.project(analysis))
    assert "digraph" in engine.text(*engine.overview(analysis), "dot")
    nodes, edges = engine.impact(analysis, "second")
    assert ("code:src/beta.rs::function::second", "code:src/beta.rs::function::third") in rows(edges)
    f = engine.flow(analysis, "ready")
    assert f["edges"].count() > 0 and f["nodes"].count() > 0
    kn, ke = engine.knowledge_graph(analysis, 60, include_private=True)
    drawn = {(r["src"].replace("code:", ""), r["label"], r["dst"].replace("code:", "")) for r in ke.collect()}
    assert {("src/alpha.rs::struct::Store", "implements", "src/alpha.rs::trait::Run"), ("src/alpha.rs::function::Run::run", "dispatches to", "src/alpha.rs::function::Run for Store::run"), ("src/alpha.rs", "depends on", "dep:missing"), ("lib/a.dart::function::f", "calls", "lib/b.dart::function::g")} <= drawn, drawn
    assert not any(x == ("lib/a.dart", "imports", "lib/b.dart") for x in drawn)  # an item edge says it already
    for fmt, first, last in (("mermaid", "graph TD", ""), ("dot", "digraph g {", "}")):
        text = engine.graph_text(analysis, 40, fmt=fmt)
        assert text.startswith(first) and text.endswith(last) and text.count("subgraph") == text.count("\n" + " " * 4 + ("}" if fmt == "dot" else "end")) + sum(text.count("\n" + " " * k + ("}" if fmt == "dot" else "end")) for k in (8, 12))
        assert "depends on" in text and "missing" in text
    assert engine.module(analysis, "src/beta.rs")[1].count() > 2
    assert engine.function(analysis, "third")[1].count() == 2
    with pytest.raises(LookupError):
        resolve.lookup(analysis.atoms, "nowhere")


def test_every_call_is_an_edge_a_leaf_or_counted(analysis):
    merged = graph.merged_sites(analysis.edges)
    claimed = merged.select(F.col("src").alias("caller_id"), F.explode("sites").alias("rank")).distinct()
    total = analysis.call_sites.count()
    linked = analysis.call_sites.join(claimed, ["caller_id", "rank"], "left_semi").count()
    leaves = graph._unclaimed(merged, analysis.call_sites)
    assert total == linked + leaves.count()


def test_sequence(spark):
    src = "fn f(p: &P) { a(); if x { p.go().await; } else { b(); } while y { } for z in q { c(); } panic!(); }"
    s = sequence.steps(spark.createDataFrame([("a.rs", src.encode())], "path string, content binary"))
    ops = [(r["op"], r["label"], r["depth"]) for r in s.orderBy("ord").collect()]
    assert [o[0] for o in ops] == ["call", "alt", "call", "else", "call", "end", "loop", "call", "end"]
    assert [o[2] for o in ops] == [0, 0, 1, 0, 1, 0, 0, 1, 0]
    text = sequence.text(s).first()["diagram"]
    assert "self-)p: go (await)" in text and text.startswith("sequenceDiagram\n    autonumber\n    participant self as self")


def _told(path, src):
    return [(r[6], r[7]) for r in sequence.file_steps(path, src.encode()) if r[4] == "call"]


def test_steps_go_to_the_root_of_their_receiver():
    assert _told("a.rs", "fn f(a: A) { x::y::zed(); a.b.go(); self.p.q(); Self::z(); foo().bar(); (a).k(); \"s\".len(); m::n!(h()); }") == [("x", "zed"), ("a", "go"), ("self", "q"), ("self", "z"), ("self", "foo"), ("foo", "bar"), ("a", "k"), ("self", "len"), ("self", "m::n!"), ("self", "h")]
    assert _told("a.dart", "void f(A b) { b..x()..y(); b.c.go(); b?.z(); StringBuffer()..write(build()); }") == [("b", "x"), ("b", "y"), ("b", "go"), ("b", "z"), ("self", "StringBuffer"), ("StringBuffer", "write"), ("self", "build")]
    assert _told("a.py", "def f(a):\n    a.b.go()\n    self.p.q()\n    ', '.join(a)\n") == [("a", "go"), ("self", "q"), ("self", "join")]


def test_only_quiet_macros_and_wrappers_are_no_steps():
    assert _told("a.rs", "fn f() { assert_eq!(a(), 1); debug_assert_ne!(1, 2); matches!(b(), X); todo!(); println!(\"{}\", c()); vec![d()]; out.write(1); out.format(2); Some(e()); x.ok(); m::Ok(1); }") == [
        ("self", "a"), ("self", "b"), ("self", "println!"), ("self", "c"), ("self", "vec!"), ("self", "d"), ("out", "write"), ("out", "format"), ("self", "e"), ("x", "ok"), ("m", "Ok")]
    assert _told("a.py", "def f(s):\n    print(2)\n    s.format(1)\n    Ok(3)\n") == [("self", "print"), ("s", "format"), ("self", "Ok")]


def test_functions_are_listed_in_the_order_of_their_source(spark):
    src = spark.createDataFrame([("a.py", b"def b(): pass\ndef a(): pass\nclass C:\n    def a(self): x()\ndef b(): y()\n")], "path string, content binary")
    assert [r["fn_name"] for r in sequence.list_functions(src).orderBy("place").collect()] == ["b", "a", "C::a"]
    assert [r[7] for r in sequence.file_steps("a.py", b"def b(): x()\ndef b(): y()\n")] == ["x"]  # the first of one name counts


IMPORTS = "file_path string, module_id string, local string, target string, is_glob boolean, is_public boolean, is_inner boolean, pos int"


def _graph(spark, files):
    return engine.analyze(spark.createDataFrame([(p, t.encode()) for p, t in files], "path string, content binary"))


def _calls(g):
    short = lambda x: x.replace("code:", "").replace("::function::", "#")
    return {(short(r["src"]), short(r["dst"])) for r in g.edges.where("kind = 'calls'").collect()}


def test_rust_paths_and_reexports(spark):
    g = _graph(spark, [
        ("c/src/lib.rs", "pub mod a;\npub mod b;\nmod main2;\n"), ("c/src/a/mod.rs", "pub use self::deep::inner as outer;\npub use crate::b::*;\npub mod deep;\npub fn twin() {}\n"),
        ("c/src/a/deep.rs", "pub fn inner() {}\npub fn twin() {}\n"), ("c/src/b.rs", "pub fn star() {}\nmod sub { pub fn low() { super::star(); } }\n"),
        ("c/src/main2.rs", "use crate::a;\nfn f() { a::outer(); crate::a::star(); crate::a::twin(); a::nowhere(); crate::b::sub::low(); serde::load(); }\n"),
        ("c/src/bin/tool.rs", "fn main() { c::a::outer(); rand::a::outer(); std::a::outer(); }\n"),
    ])
    got = _calls(g)
    assert {("c/src/main2.rs#f", "c/src/a/deep.rs#inner"), ("c/src/main2.rs#f", "c/src/b.rs#star"), ("c/src/main2.rs#f", "c/src/a/mod.rs#twin"), ("c/src/main2.rs#f", "c/src/b.rs#sub::low"), ("c/src/b.rs#sub::low", "c/src/b.rs#star"),
            ("c/src/main2.rs#f", "extern:serde::load"), ("c/src/bin/tool.rs#main", "c/src/a/deep.rs#inner")} <= got, got
    assert not any("nowhere" in d or d == "c/src/a/deep.rs#twin" for _, d in got)


def test_python_reexports_go_four_hops(spark):
    chain = [(f"p{k}/__init__.py", f"from .p{k + 1} import f\n") for k in range(6)]
    g = _graph(spark, [*chain, ("x/p4.py", "def f(): pass\n"), ("x/p9.py", "def f(): pass\n"), ("m0.py", "from p0 import f\ndef a(): f()\n"), ("q/__init__.py", "from .p4 import f\n"), ("n.py", "from q import f\ndef b(): f()\n")])
    assert ("n.py#b", "x/p4.py#f") in _calls(g) and ("m0.py#a", "x/p4.py#f") in _calls(g)


def test_a_question_is_not_answered_by_its_caller_or_what_is_linked(spark):
    atoms = [("f1", "run", "a/src/x.rs", None), ("f2", "run", "a/src/y.rs", None), ("f3", "go", "a/src/z.rs", None), ("m1", "act", "a/src/x.rs", "T<U>"), ("m2", "act", "b/src/x.rs", "T")]
    a = spark.createDataFrame([(i, "function", n, p, "", o) for i, n, p, o in atoms], "id string, kind string, name string, file_path string, scope string, parent string")
    sites = spark.createDataFrame([("f3", "run", 0, 0, False), ("f1", "run", 1, 0, False), ("f3", "T::act", 2, 0, False), ("m2", "T::act", 3, 0, False), ("f3", "new", 4, 0, False), ("f3", "ext::call", 5, 0, False), ("f3", "Vec::make", 6, 8, False)], "caller_id string, name string, rank int, flags int, is_method boolean")
    none = spark.createDataFrame([], "src string, dst string, kind string, sites array<int>")
    linked = spark.createDataFrame([("f3", "f2", "calls", [9])], "src string, dst string, kind string, sites array<int>")
    say = lambda e: {(r["caller_id"], r["fn"]): (r["target"], r["reason"]) for r in resolve.decide_calls(a, e, sites).collect()}
    assert say(none) == {("f3", "run"): (None, "unresolved"), ("f1", "run"): (None, "unresolved"), ("f3", "act"): ("m1", "owner"), ("m2", "act"): ("m1", "owner"), ("f3", "call"): (None, "unresolved"), ("f3", "make"): (None, "unresolved")}
    assert say(linked)["f3", "run"] == ("f1", "bare")
    edges, externs = resolve.resolve_calls(a, none, sites)
    assert rows(externs.select("id")) == {("extern:ext::call",)} and rows(edges.select("src", "dst")) == {("f3", "m1"), ("m2", "m1"), ("f3", "extern:ext::call")}
    assert resolve.decide_calls(a.limit(0), none, sites.limit(0)).count() == 0


def test_bounds_type_their_parameters(spark):
    src = "pub trait Store { fn get(&self); }\npub struct Disk;\nimpl Disk { fn read(&self) {} }\n"
    use = "use crate::st::{Store, Disk};\nstruct W<S: Store> { s: S }\nimpl<S> W<S> where S: Store { fn a(&self) { self.s.get(); } }\nfn f<T: Clone + Store>(a: T) { a.get() }\nfn g(o: Option<Disk>) { if let Some(d) = o { d.read(); } }\nfn h(o: &Option<Disk>) { let Some(d) = o else { return }; d.read(); }\n"
    g = _graph(spark, [("src/st.rs", src), ("src/u.rs", use)])
    sites = {(r["caller_id"].rsplit("::", 1)[-1], r["name"]) for r in g.call_sites.collect()}
    assert {("f", "crate::st::Store::get"), ("g", "crate::st::Disk::read"), ("h", "crate::st::Disk::read")} <= sites, sites
    assert {("src/u.rs#f", "src/st.rs#Store::get"), ("src/u.rs#g", "src/st.rs#Disk::read"), ("src/u.rs#W<S>::a", "src/st.rs#Store::get")} <= _calls(g), _calls(g)


def test_dart_types_a_name_through_its_file():
    src = b"Helper h = Helper();\nfinal k = Kit.make();\nvoid f(Tool t) { h.go(); k.run(); both.x(); }\nclass A { Left both = Left(); void m() { t.use(); } }\nclass B { Right both = Right(); }\n"
    calls = {(r[2].rsplit("::", 1)[-1], r[4]) for r in parsing.unit_rows("a.dart", src) if r[1] == "call"}
    assert {("f", "Helper::go"), ("f", "Kit::run"), ("f", "x"), ("m", "Tool::use")} <= calls, calls


def test_inner_names_are_looked_up_outward(spark):
    g = _graph(spark, [("src/a.rs", "fn top() {}\nmod m { fn near() {} fn twin() {} mod n { fn f() { near(); top(); twin(); } fn twin() {} } }\nfn twin() {}\n")])
    assert {("src/a.rs#m::n::f", "src/a.rs#m::near"), ("src/a.rs#m::n::f", "src/a.rs#top"), ("src/a.rs#m::n::f", "src/a.rs#m::n::twin")} == _calls(g)


def test_a_large_class_takes_linear_time():
    import time

    took = []
    for n in (500, 4000):
        src = ("class A:\n" + "".join(f"    def m{k}(self): self.m{k + 1}()\n" for k in range(n))).encode()
        began = time.perf_counter()
        parsing.unit_rows("a.py", src)
        took.append(time.perf_counter() - began)
    assert took[1] < 20 * took[0]


def test_imports_of_every_language(spark):
    g = _graph(spark, [("pkg/__init__.py", ""), ("pkg/m.py", "from . import n\nfrom .n import x\nimport far.lib\n"), ("pkg/n.py", "x = 1\n"), ("src/far/lib.py", ""), ("d/a/b.dart", "import '../c.dart';\nimport 'package:kit/a/z.dart';\nimport '../../../up.dart';\n"), ("d/c.dart", ""), ("d/a/z.dart", ""),
                       ("k/src/lib.rs", "mod a;\nmod b;\n"), ("k/src/a.rs", "use crate::b::Thing;\nmod t { use super::*; }\n"), ("k/src/b.rs", "pub use crate::c::Thing;\n"), ("k/src/c.rs", "pub struct Thing;\n")])
    got = {(a[5:], b[5:]) for a, b in rows(g.edges.where("kind = 'imports'").select("src", "dst"))}
    assert got == {("pkg/m.py", "pkg/__init__.py"), ("pkg/m.py", "pkg/n.py"), ("pkg/m.py", "src/far/lib.py"), ("d/a/b.dart", "d/c.dart"), ("d/a/b.dart", "d/a/z.dart"), ("k/src/a.rs", "k/src/c.rs"), ("k/src/b.rs", "k/src/c.rs")}


def test_impact_follows_the_order_of_the_files(spark):
    rng = random.Random(4)
    names = [f"f{k}" for k in range(24)]
    files = [(f"src/{c}.rs", "".join(f"pub fn {n}() {{ " + " ".join(f"{m}();" for m in rng.sample(names, 2)) + " }\n" for n in names[k::4])) for k, c in enumerate("dacb")]
    g = _graph(spark, files)
    edges = [(r["src"], r["dst"], r["seq"]) for r in g.edges.where("kind = 'calls'").collect()]
    root = next(s for s, _, _ in sorted(edges))
    assert sorted({e[2]["path"] for e in edges}) == sorted(p for p, _ in files)
    for reverse in (False, True):
        e, n = traverse.bounded_bfs(g.edges.where("kind = 'calls'").select("src", "dst", "seq"), root, 3, reverse)
        want = _walk(edges, root, 3, reverse)
        assert rows(e) == want[0] and {r["id"] for r in n.collect()} == want[1]


def test_differences_as_text(spark, tmp_path):
    cat = "id string, kind string, name string, file string, content_hash string, edges_out array<string>, edges_in array<string>"
    row = lambda i, h, out=(): (f"code:a.rs::function::{i}", "function", i, "a.rs", h, [f"code:a.rs::function::{x}" for x in out], [])
    old = spark.createDataFrame([row("a", "1"), row("b", "2"), row("c", "3"), row("e", "5")], cat)
    new = spark.createDataFrame([row("a", "9", ["d"]), row("d", "4"), row("c2", "3"), row("e", "5")], cat)
    catalog.write(old, str(tmp_path), "o")
    catalog.write(new, str(tmp_path), "n")
    text = engine.difference_text(spark, str(tmp_path), "o", "n").splitlines()
    assert text[0] == "graph TD" and "o → n" in text[1] and [x.strip() for x in text[6:]] == [
        "%% added (1)", 'n0["fn d (a.rs)"]:::added', "%% removed (1)", 'n1["fn b (a.rs)"]:::removed', "%% modified (1)", 'n2["fn a (a.rs)"]:::modified', "%% renamed (1)",
        'n3["a.rs::function::c ↪ a.rs::function::c2"]:::renamed', "%% blast-radius edges (both ends changed)", "n2 --> n0"]
    assert rows(diff.unchanged(old, new)) == {("code:a.rs::function::e",)}


def test_bundles_are_reconciled(spark, tmp_path, analysis):
    from graphlens.operators import store

    s = store.Store(spark, str(tmp_path / "s"))
    src = spark.createDataFrame([("src/beta.rs", B_RS.encode())], "path string, content binary")
    docs = engine.documents(analysis, "root", "2025-01-01T00:00:00Z", src)
    first = s.put_bundle("w", docs)
    assert first["written"] == docs.count() and first["pruned"] == first["kept"] == 0
    by = {r["path"]: r["content"] for r in s.bundle("w").collect()}
    assert any(p.startswith("sequences/") for p in by) and "graph LR" in next(c for p, c in by.items() if p.endswith(".mmd") and p.startswith("entities/"))
    import json

    index = json.loads(by["index.json"])
    assert index["schema"] == 2 and index["source_root"] == "root" and index["entities"] == sorted(index["entities"], key=lambda e: e["id"])
    again = s.put_bundle("w", engine.documents(analysis, "root", "2026-01-01T00:00:00Z", src))
    assert again == {"written": 0, "pruned": 0, "kept": len(by)}
    keep = [(p, c) for p, c in by.items() if not p.startswith("sequences/")]
    keep[0] = (keep[0][0], "changed")
    less = s.put_bundle("w", spark.createDataFrame(keep, "path string, content string"))
    assert less["written"] == 1 and less["pruned"] == len(by) - len(keep)
    assert {(r["path"], r["content"]) for r in s.bundle("w").collect()} == set(keep)
    assert s.put_bundle("w", docs.limit(0))["kept"] == len(keep)
    assert s.put_bundle("w", docs.limit(0), allow_empty=True)["pruned"] == len(keep) and s.bundle("w").count() == 0
    out = tmp_path / "out"
    assert store.export(docs, str(out))["written"] == len(by) and store.export(docs, str(out))["written"] == 0
    assert store.export(docs.where("path not like 'sequences/%'"), str(out))["pruned"] > 0
    (out / "overview.mmd").unlink()
    (out / "overview.mmd").symlink_to(tmp_path / "elsewhere")
    with pytest.raises(ValueError):
        store.export(docs, str(out))


def test_the_store_is_kept_small(spark, tmp_path):
    from graphlens.operators import store

    s = store.Store(spark, str(tmp_path / "s"))
    one = spark.createDataFrame([("a.mmd", "x" * 50)], "path string, content string")
    for k in range(3):
        s.put_bundle(f"b{k}", one)
        os.utime(tmp_path / "s/bundles" / f"b{k}", (1000 + k, 1000 + k))
    size = {r["key"]: r["size"] for r in s.entries().collect()}
    dry = s.collect_garbage(size["bundles/b2"], dry_run=True, now=2000)
    assert dry["evicted"] == 2 and len(size) == s.entries().count() == 3
    (tmp_path / "s/bundles/.tmp-x").mkdir()
    assert s.collect_garbage(10**9, older_than=998, now=2000) == {"entries": 3, "bytes_before": sum(size.values()), "evicted": 2, "bytes_after": size["bundles/b2"], "failed": 0}
    assert {r["key"] for r in s.entries().collect()} == {"bundles/b2"} and not (tmp_path / "s/bundles/.tmp-x").exists()
    assert store.Policy.from_env({"GRAPHLENS_AUTO_GC": "0"}) is None
    assert store.Policy.from_env({"GRAPHLENS_AUTO_GC_MAX_BYTES": "7", "GRAPHLENS_AUTO_GC_MAX_AGE_SECS": "x"}) == store.Policy(7, 30 * 86400)
    assert s.auto_collect(None) is None and s.auto_collect(store.Policy(0, 10**9), now=2000)["evicted"] == 1


def test_command_line(spark, tmp_path, capsys):
    from graphlens import cli

    src, st = tmp_path / "src", str(tmp_path / "st")
    src.mkdir()
    (src / "a.py").write_text("from b import g\ndef f(): g()\n")
    (src / "b.py").write_text("def g(): pass\n")

    def call(*args):
        code = cli.main([*args, "--store", st])
        return code, capsys.readouterr().out

    code, out = call("index", str(src))
    assert code == 0 and out.startswith("wt-") and "written" in out
    assert "kept" in call("index", str(src))[1]
    old = out.split("\t")[0]
    (src / "b.py").write_text("def g(): h()\ndef h(): pass\n")
    new = call("index", str(src))[1].split("\t")[0]
    code, out = call("diff", f"{old}..{new}")
    assert code == 0 and ":::added" in out and ":::modified" in out
    assert json.loads(call("diff", f"{old}..{new}", "--format", "json")[1])["counts"]["added"] == 1
    code, out = call("graph", str(src), "--kinds", "function", "--edges", "calls,deps", "--include-private")
    assert code == 0 and '--"calls"-->' in out and "%% analyzed 2 files" in out
    assert json.loads(call("bundle", str(src), "--with-sequences", "--out", str(tmp_path / "o"))[1])["written"] > 4 and (tmp_path / "o/index.json").exists()
    assert json.loads(call("sequence", str(src), "--out", str(tmp_path / "q"))[1])["written"] == 2
    assert "graph LR" in call("impact", str(src), "--target", "g")[1] and call("impact", str(src))[0] == 1
    assert json.loads(call("gc", st, "--max-size", "0", "--dry-run")[1])["evicted"] > 1 and json.loads(call("gc", st, "--max-size", "0")[1])["bytes_after"] == 0
    with pytest.raises(SystemExit) as e:
        cli.parser().parse_args(["graph", ".", "--edges", "nothing"])
    assert e.value.code == 2


def test_links_are_not_followed(spark, tmp_path):
    (tmp_path / "r/sub").mkdir(parents=True)
    (tmp_path / "r/a.g.dart").write_text("int f() => 1;\n")
    (tmp_path / "r/sub/b.rs").write_text("fn f() {}\n")
    assert tree.walk_safe(str(tmp_path / "r"))
    (tmp_path / "r/link.rs").symlink_to(tmp_path / "r/sub/b.rs")
    (tmp_path / "r/dir").symlink_to(tmp_path / "r/sub")
    assert rows(tree.walk(spark, str(tmp_path / "r"))) == {("rust", "sub/b.rs")}
    assert rows(tree.walk(spark, str(tmp_path / "r/a.g.dart"))) == {("dart", "a.g.dart")}
    with pytest.raises(ValueError):
        tree.walk_safe(str(tmp_path / "r"))


def test_git_source_and_files(spark, tmp_path):
    repo = tmp_path / "r"
    (repo / "src").mkdir(parents=True)
    (repo / "vendor").mkdir()
    (repo / "src/a.rs").write_text("fn f() {}\n")
    (repo / "vendor/b.rs").write_text("fn g() {}\n")
    (repo / "x.g.dart").write_text("int f() => 1;\n")
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "x")
    spark.dataSource.register(git.GitSource)
    got = spark.read.format("graphlens_git").option("repo", str(repo)).option("chunk", "1").load()
    assert {(r["path"], bytes(r["content"])) for r in got.collect()} == {("src/a.rs", b"fn f() {}\n"), ("vendor/b.rs", b"fn g() {}\n"), ("x.g.dart", b"int f() => 1;\n")}
    assert rows(tree.walk(spark, str(repo))) == {("rust", "src/a.rs")}
    assert git.tracked_files(str(repo)) == 3 and git.tracked_files(str(repo / "src")) == 1 and git.tracked_files(str(tmp_path)) == 0
    assert git.snapshot_id(str(repo), "HEAD") == git.revision(str(repo), "HEAD") and git.snapshot_id(str(repo / "src"), "HEAD").endswith("-" + hashlib.sha1(b"src").hexdigest()[:8])
    for bad in ("--output=x", "a..b", "x y", ""):
        assert not git.valid_ref(bad)
        with pytest.raises(ValueError):
            git.list_tree(str(repo), bad)


def test_incremental_parse(spark, tmp_path):
    f = lambda b: spark.createDataFrame([("a.rs", b"fn f() {}"), ("b.rs", b)], "path string, content binary")
    _, todo = parsing.incremental(f(b"fn g() {}"), None)
    kept = parsing.parse_files(todo).join(todo.select(F.col("path").alias("file_path"), "blob_sha"), "file_path")
    kept.write.parquet(str(tmp_path / "k"))
    same, todo = parsing.incremental(f(b"fn h() {}"), spark.read.parquet(str(tmp_path / "k")))
    assert {r["path"] for r in todo.collect()} == {"b.rs"} and {r["file_path"] for r in same.collect()} == {"a.rs"}


def test_stream(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    df = lambda *p: spark.createDataFrame([(x, b"fn f() {}") for x in p], "path string, content binary")
    df("a.rs").write.parquet(src)
    ingest.stream(spark, src, store, str(tmp_path / "ck")).awaitTermination()
    df("a.rs", "b.rs").write.mode("append").parquet(src)
    ingest.stream(spark, src, store, str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(store).where("what = 'atom' and kind = 'function'")
    assert sorted(r["file_path"] for r in got.collect()) == ["a.rs", "b.rs"]


def test_bundle_and_compare(analysis, spark, tmp_path):
    root = f"file://{tmp_path}"
    assert engine.bundle(analysis, root, "one") and not engine.bundle(analysis, root, "one")
    g2 = graph.CodeGraph(analysis.atoms.where("name <> 'fourth'"), analysis.edges)
    engine.bundle(g2, root, "two")
    changed, radius = engine.compare(spark, root, "one", "two")
    assert rows(changed.select("change_type", "id")) == {("removed", "code:src/beta.rs::function::fourth")}
    assert radius.count() == 0
    with pytest.raises(ValueError):
        catalog.write(catalog.rows(analysis.atoms.limit(0), analysis.edges), root, "one", force=True)


def test_shortest_path_is_whole(spark):
    line = [(f"n{k}", f"n{k + 1}", k) for k in range(45)] + [("n3", "x", 99), ("n45", "n45", 0)]
    df = spark.createDataFrame(line, "src string, dst string, seq bigint")
    whole = {(k, f"n{k}") for k in range(46)}
    assert rows(traverse.shortest_path(df, "n0", "r")) == whole  # ends where it meets itself
    assert rows(traverse.shortest_path(df, "n0", "n20")) == {(k, i) for k, i in whole if k <= 20}
    assert rows(traverse.shortest_path(df, "n20", "n20")) == {(0, "n20")}
    ring = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("d", "b", 1), ("d", None, 2)], "src string, dst string, seq bigint")
    assert rows(traverse.shortest_path(ring, "a", "r")) == {(0, "a"), (1, "b"), (2, "c"), (3, "d")}


def test_whole_graph_queries_link_the_files_of_a_crate(spark, tmp_path):
    files = [
        ("a/x", "src/lib.rs", "fn go() { crate::util::helper(); shared(); }\nfn take(s: Store) {}\n"), ("a/x", "src/util.rs", "pub fn helper() {}\npub fn shared() {}\npub struct Store;\n"),
        ("b/y", "src/util.rs", "pub fn helper() {}\npub fn shared() {}\npub struct Store;\n"), ("a/x", "./src/util.rs", "pub fn helper() {}\npub fn shared() {}\npub struct Store;\n"),
        ("c/z", "pkg/__init__.py", "from pkg.core import run as start\n"), ("c/z", "pkg/core.py", "def run():\n    pass\n"), ("c/z", "app.py", "import pkg\n\ndef main():\n    pkg.start()\n"),
    ]
    table = [(k, r, p, c.encode()) for k, (r, p, c) in enumerate(files)]
    spark.createDataFrame(table, "file_id bigint, repo string, display_path string, content binary").write.parquet(f"{tmp_path}/parse_inputs.parquet")
    edges = rows(graph_queries.resolved_sources(spark, str(tmp_path)))
    calls = {(a.rsplit("::", 1)[-1], b) for a, b, k, _ in edges if k == "calls" and not b.startswith("extern:")}
    assert {a for a, _ in calls} == {"go", "main"} and {b.split("::")[0] for a, b in calls if a == "go"} == {"code:a/x/src/util.rs"}
    assert {b.rsplit("::", 1)[-1] for _, b in calls} == {"helper", "shared", "run"}
    assert {b.split("::")[0] for _, b, k, _ in edges if k == "uses"} == {"code:a/x/src/util.rs"}
    assert {(a, b) for a, b, k, _ in edges if k == "imports"} == {("code:c/z/app.py", "code:c/z/pkg/__init__.py"), ("code:c/z/pkg/__init__.py", "code:c/z/pkg/core.py")}


def test_the_last_place_is_filled_from_any_rank(spark):
    # Two items of one file take 3 of 4 places; 300 items in files of their own follow, then one of the first file.
    items = [("a", "f", 9, 900), ("b", "f", 9, 900), *((f"n{k:03}", f"g{k}", 5, 500 - k) for k in range(300)), ("z", "f", 1, 1), ("zz", "f", 1, 0)]
    df = spark.createDataFrame(items, "id string, file_path string, degree int, cross_degree int")
    assert rows(graph.budget_best(df, 4)) == {("a", "f", 1), ("b", "f", 2), ("z", "f", 303)}
    assert rows(graph.budget_best(df, 5)) == {("a", "f", 1), ("b", "f", 2), ("n000", "g0", 3)}
    assert rows(graph.budget_best(df.limit(0), 5)) == set()
