"""Name resolution as staged joins.

Questions are made distinct first.  Candidates are reduced to a count and one
identifier per key before anything is joined with them, and what a question may
not choose (its own caller, what it is linked to already) is subtracted from
those.  So a name that very many sites call and very many files define makes one
row a question, not one a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars as S
from ..session import cut, cut_counting, cut_small

TYPE_KINDS = ("struct", "enum", "trait", "type_alias", "class", "union", "mixin", "extension")
#: Kinds whose names are never taken for a dependency.
LOCAL_TYPES = ("struct", "enum", "trait", "type_alias", "class", "union")
#: Steps along re-exports: of Rust modules, and of Python packages.
RUST_HOPS, PYTHON_HOPS = 6, 4


def _reduced(candidates: DataFrame, key: list[str], target: str = "target", group: str = "crate") -> tuple[DataFrame, DataFrame]:
    """(by key and group: n_same, one_same; by key: n, one)."""
    per = candidates.groupBy(*key, group).agg(F.count(F.lit(1)).alias("n_same"), F.min(target).alias("one_same"))
    return per, per.groupBy(*key).agg(F.sum("n_same").alias("n"), F.min("one_same").alias("one"))


def _asked_of(asked: DataFrame, candidates: DataFrame, key: list[str], target: str = "target", group: str = "crate") -> DataFrame:
    """``asked`` with n, one, n_same, one_same of its candidates; without any, n is 0."""
    per, total = _reduced(candidates, key, target, group)
    got = asked.join(total, key, "left").join(per, [*key, group], "left")
    return got.withColumns({"n": F.coalesce("n", F.lit(0)), "n_same": F.coalesce("n_same", F.lit(0))})


def same_first() -> Column:
    """The only candidate of the same crate; without any there, the only one at all."""
    return F.when(F.col("n_same") == 1, F.col("one_same")).when((F.col("n_same") == 0) & (F.col("n") == 1), F.col("one"))


def sole_first() -> Column:
    """The only candidate wherever it lies; of several the only one of the same root."""
    return F.when(F.col("n") == 1, F.col("one")).when(F.col("n_same") == 1, F.col("one_same"))


def _crate(path: Column) -> Column:
    """The crate of a file as a key that equals itself even where there is none."""
    return F.coalesce(S.crate_root(path), F.lit("\0"))


# -- Rust modules ------------------------------------------------------------------
def module_tree(atoms: DataFrame) -> DataFrame:
    """Distinct Rust modules (krate, path): every file, and every inline module down to an atom's scope."""
    k, p, _ = S.rust_module(F.col("file_path"))
    base = atoms.select(k.alias("krate"), p.alias("path"), F.coalesce("scope", F.lit("")).alias("scope")).where("krate is not null").distinct()
    segs = F.split("scope", "::")
    inline = F.when(F.col("scope") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(segs)), lambda n: F.array_join(F.slice(segs, F.lit(1), n), "::")))
    return base.select("krate", "path", F.explode(F.concat(F.array(F.lit("")), inline)).alias("inner")).select("krate", S.join_module(F.col("path"), F.col("inner")).alias("path")).distinct()


def _steps_down(start: Column, rest: Column) -> Column:
    """(cur, seen): where a path leads from ``start``, null if above the root, and the modules it names."""
    zero = F.struct(start.alias("cur"), F.array().cast("array<string>").alias("seen"))

    def step(acc: Column, seg: Column) -> Column:
        down = S.join_module(acc["cur"], seg)
        return F.when(seg == "self", acc).when(seg == "super", F.struct(S.parent_module(acc["cur"]).alias("cur"), acc["seen"].alias("seen"))).otherwise(
            F.struct(down.alias("cur"), F.concat(acc["seen"], F.array(down)).alias("seen"))
        )

    return F.aggregate(rest, zero, step)


def resolve_paths(paths: DataFrame, tree: DataFrame) -> DataFrame:
    """``krate, here, path, apart, module, guessed``: the module that a written path names.

    ``paths``: krate, here (the module it is written in), path, apart (whether
    the file is a target of its own, which may call the crate by its name).
    Every module on the way must exist; ``module`` is null otherwise.  A head
    that is no child module is guessed to be the crate's name in a file apart,
    if the next segment is a module of the root.
    """
    key = ["krate", "here", "path", "apart"]
    segs = F.split("path", "::")
    head, rest = F.element_at(segs, 1), F.slice(segs, F.lit(2), F.greatest(F.size(segs) - 1, F.lit(0)))
    plain = ~head.isin("crate", "self", "super")
    start = F.when(head == "crate", "").when(head == "self", F.col("here")).when(head == "super", S.parent_module(F.col("here"))).otherwise(S.join_module(F.col("here"), head))
    first = F.when(plain, F.array(S.join_module(F.col("here"), head))).otherwise(F.array().cast("array<string>"))
    may_guess = plain & F.col("apart") & ~head.isin("std", "core", "alloc") & (F.size(rest) > 0) & ~F.try_element_at(rest, F.lit(1)).isin("self", "super")
    ways = F.array(
        F.struct(F.lit(0).alias("way"), _steps_down(start, rest).alias("to"), first.alias("first")),
        F.struct(F.when(may_guess, 1).alias("way"), _steps_down(F.lit(""), rest).alias("to"), F.array().cast("array<string>").alias("first")),
    )
    each = paths.where("krate is not null and path is not null").select(*key).distinct().select(*key, plain.alias("plain"), F.explode(ways).alias("w")).where("w.way is not null")
    each = each.select(*key, "plain", "w.way", F.col("w.to.cur").alias("cur"), F.explode_outer(F.concat("w.first", "w.to.seen")).alias("p"), F.try_element_at("w.first", F.lit(1)).alias("child"))
    hit = each.join(tree.select("krate", F.col("path").alias("p"), F.lit(True).alias("there")), ["krate", "p"], "left")
    ok = F.col("p").isNull() | F.coalesce("there", F.lit(False))
    got = hit.groupBy(*key, "plain").agg(
        F.bool_and(F.when(F.col("way") == 0, ok)).alias("ok0"), F.bool_and(F.when(F.col("way") == 1, ok)).alias("ok1"),
        F.bool_or((F.col("way") == 0) & (F.col("p") == F.col("child")) & ok).alias("has_child"), F.max(F.when(F.col("way") == 0, F.col("cur"))).alias("m0"), F.max(F.when(F.col("way") == 1, F.col("cur"))).alias("m1"),
    )
    own = ~F.col("plain") | F.coalesce("has_child", F.lit(False))
    module = F.when(own, F.when(F.col("ok0"), F.col("m0"))).when(F.col("ok1"), F.col("m1"))
    return got.select(*key, module.alias("module"), (~own & F.coalesce("ok1", F.lit(False))).alias("guessed"))


def rust_reexports(imports: DataFrame, tree: DataFrame) -> DataFrame:
    """``krate, module, name, to_module, to_name``: what modules name again; null names for globs.

    ``imports``: file_path, local, target, is_glob, is_public, is_inner.
    """
    k, m, _ = S.rust_module(F.col("file_path"))
    pub = imports.where("is_public and not is_inner and file_path like '%.rs'").select(k.alias("krate"), m.alias("here"), "local", "target", "is_glob")
    last = F.element_at(F.split("target", "::"), -1)
    qualifier = F.when(F.col("is_glob"), F.col("target")).when(F.instr("target", "::") > 0, F.left("target", F.length("target") - F.length(last) - 2))
    pub = pub.select("krate", "here", qualifier.alias("path"), F.lit(False).alias("apart"), F.when(~F.col("is_glob"), F.col("local")).alias("name"), F.when(~F.col("is_glob"), last).alias("to_name")).where("path is not null")
    way = resolve_paths(pub, tree).where("module is not null").select("krate", "here", "path", F.col("module").alias("to_module"))
    return pub.join(way, ["krate", "here", "path"]).select("krate", F.col("here").alias("module"), "name", "to_module", "to_name").distinct()


def module_members(asked: DataFrame, definitions: DataFrame, reexports: DataFrame | None, hops: int = RUST_HOPS) -> DataFrame:
    """``krate, module, name, target``: what a module offers under a name.

    ``asked``: krate, module, name.  ``definitions``: krate, module, name,
    target.  ``reexports``: as ``rust_reexports``.  A definition hides what the
    module re-exports; otherwise re-exports, globs among them, are followed for
    at most ``hops`` steps, and all that is found counts.
    """
    key = ["krate", "module", "name"]
    front = asked.select(*key).distinct().select(*key, F.col("module").alias("m"), F.col("name").alias("n"))
    defs = definitions.select("krate", F.col("module").alias("m"), F.col("name").alias("n"), "target")
    if reexports is None:
        return front.join(defs, ["krate", "m", "n"]).select(*key, "target").distinct()
    named = reexports.where("name is not null").select("krate", F.col("module").alias("m"), F.col("name").alias("n"), F.col("to_module").alias("m2"), F.col("to_name").alias("n2"))
    globs = reexports.where("name is null").select("krate", F.col("module").alias("m"), F.col("to_module").alias("m2"))
    out, seen = None, front
    for hop in range(hops + 1):
        found = front.join(defs, ["krate", "m", "n"]).select(*key, "target")
        out = found if out is None else out.unionByName(found)
        if hop == hops:
            break
        left = front.join(defs.select("krate", "m", "n").distinct(), ["krate", "m", "n"], "left_anti")
        step = left.join(named, ["krate", "m", "n"]).select(*key, F.col("m2").alias("m"), F.col("n2").alias("n")).unionByName(left.join(globs, ["krate", "m"]).select(*key, F.col("m2").alias("m"), "n"))
        front, more = cut_counting(step.distinct().join(seen, [*key, "m", "n"], "left_anti"))
        if not more:
            break
        seen = seen.unionByName(front)
    return out.distinct()


# -- calls -------------------------------------------------------------------------
def package_reexports(imports: DataFrame) -> DataFrame:
    """``package, name, to_prefix, to_name``: what ``__init__.py`` files name again, the first one of a name.

    ``imports``: file_path, local, target, is_glob, pos.
    """
    module = F.element_at(F.split(F.substring_index("target", "::", 1), r"\."), -1)
    every = imports.where("(file_path = '__init__.py' or file_path like '%/__init__.py') and target like '%::%' and not is_glob").select(
        S.file_module_name(F.col("file_path")).alias("package"), F.col("local").alias("name"), F.struct("file_path", "pos", module.alias("m"), F.substring_index("target", "::", -1).alias("n")).alias("r")
    )
    return every.where("r.m <> ''").groupBy("package", "name").agg(F.min("r").alias("r")).select("package", "name", F.col("r.m").alias("to_prefix"), F.col("r.n").alias("to_name"))


def _functions(atoms: DataFrame) -> DataFrame:
    """Functions with all that decides between them; ``num`` stands for the id."""
    krate, mpath, apart = S.rust_module(F.col("file_path"))
    return cut(atoms.where("kind = 'function'").select(
        "id", "name", "file_path", krate.alias("krate"), S.join_module(mpath, F.coalesce("scope", F.lit(""))).alias("here"), apart.alias("apart"), S.lang_of(F.col("file_path")).alias("lang"), _crate(F.col("file_path")).alias("crate"),
        S.file_module_name(F.col("file_path")).alias("module"), F.element_at(F.split(S.strip_generics(F.coalesce(S.impl_owner_type(F.col("parent")), F.col("parent"))), "::"), -1).alias("owner"),
    ).withColumn("num", F.monotonically_increasing_id()))


_KEY = ["stage", "lang", "k1", "k2"]
EXACT, OWNER, MODULE, BARE = 1, 3, 4, 7


def decide_calls(atoms: DataFrame, edges: DataFrame, sites: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """``caller_id, lang, prefix, fn, target, reason`` of every distinct question of ``sites``.

    ``atoms`` and ``edges`` as parsed; ``sites``: caller_id, name, flags,
    is_method; ``imports``: file_path, local, target, is_glob, is_public,
    is_inner, pos.  The first stage that says something counts: exact Rust path,
    owner and method, free function by module, re-export of a Python package
    (which asks again), free function of the same crate by its bare name.
    Reasons: exact, owner, module, bare, ambiguous (something in the graph, but
    not one) and unresolved.  Names of the skip list are left out unless an owner
    in the graph has such a method.
    """
    fns = _functions(atoms)
    prefix, last = S.split_call(F.col("name"))
    caller = fns.select(F.col("id").alias("caller_id"), F.col("num").alias("caller"), "lang", "crate", "file_path", "krate", "here", "apart")
    qual = S.strip_generics(F.element_at(F.split("prefix", "::"), -1))
    raw = sites.where("not is_method").select("caller_id", prefix.alias("prefix"), last.alias("fn")).distinct().withColumn("qual", F.coalesce(qual, F.lit("")))
    owned = fns.where("owner is not null").select(F.col("owner").alias("qual"), F.col("name").alias("fn"), F.lit(True).alias("owned")).distinct()
    raw = raw.join(owned, ["qual", "fn"], "left").where(~F.col("fn").isin(*schema.SKIP_CALLS) | F.col("owned"))
    by_path = "lang = 'rs' and prefix is not null and prefix <> ''"
    asked, paths = cut_counting(raw.join(caller, "caller_id").withColumn("q", F.monotonically_increasing_id()), F.expr(by_path))

    # Candidates of all stages under one kind of key.
    free = fns.where("owner is null")
    cand = (
        fns.where("owner is not null").select(F.lit(OWNER).alias("stage"), "lang", F.col("owner").alias("k1"), F.col("name").alias("k2"), "num", "crate")
        .unionByName(free.select(F.lit(MODULE).alias("stage"), "lang", F.col("module").alias("k1"), F.col("name").alias("k2"), "num", "crate"))
        .unionByName(free.select(F.lit(BARE).alias("stage"), "lang", F.col("crate").alias("k1"), F.col("name").alias("k2"), "num", "crate"))
    )
    # Exact Rust paths: the module a prefix names, and what it offers under the name.
    exact = None
    rust = asked.where(by_path)
    if paths:
        tree, _ = cut_small(module_tree(atoms))
        named = rust.select("krate", "here", F.col("prefix").alias("path"), F.coalesce("apart", F.lit(False)).alias("apart"))
        ways, _ = cut_small(resolve_paths(named, tree).where("module is not null"))
        exact = cut(rust.join(ways.withColumnRenamed("path", "prefix"), ["krate", "here", "prefix", "apart"]).select("q", "caller", "crate", "guessed", "krate", F.col("module").alias("m"), "fn"))
        again, n = (None, 0) if imports is None else cut_small(rust_reexports(imports, tree))
        again = again if n else None
        defined = free.where("lang = 'rs'").select("krate", F.col("here").alias("module"), "name", F.col("num").alias("target"))
        found = module_members(exact.select("krate", F.col("m").alias("module"), F.col("fn").alias("name")), defined, again)
        place = lambda m: F.concat("krate", F.lit("\0"), m)
        cand = cand.unionByName(found.join(fns.select(F.col("num").alias("target"), "crate"), "target").select(F.lit(EXACT).alias("stage"), F.lit("rs").alias("lang"), place("module").alias("k1"), F.col("name").alias("k2"), F.col("target").alias("num"), "crate"))
    cand = cut(cand)
    count = [F.count(F.lit(1)).alias("n"), F.bit_xor("num").alias("x")]
    per = cand.groupBy(*_KEY, "crate").agg(*count)
    total = per.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"))
    # What a caller may not choose: itself and what it is linked to.
    num = fns.select(F.col("id").alias("i"), "num")
    linked = edges.where("kind = 'calls'").select("src", "dst").distinct().join(num.select(F.col("i").alias("src"), F.col("num").alias("caller")), "src").join(num.select(F.col("i").alias("dst"), "num"), "dst").select("caller", "num")
    gone = cut(linked.unionByName(fns.select(F.col("num").alias("caller"), "num")).distinct().join(cand, "num").groupBy("caller", *_KEY, "crate").agg(*count))
    off = gone.groupBy("caller", *_KEY).agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"))

    # Every question with the names it is asked again under.
    base = ["q", "caller", "crate", "lang", "file_path", "qual", "fn"]
    todo = asked.select(*base, F.lit(0).alias("hop"))
    packages, named_again = (None, 0) if imports is None else cut_counting(package_reexports(imports))
    if named_again:
        chain = _chains(packages, PYTHON_HOPS)
        todo = todo.unionByName(todo.where("lang = 'py'").drop("hop").join(chain, ["qual", "fn"]).select("q", "caller", "crate", "lang", "file_path", F.col("to_prefix").alias("qual"), F.col("to_name").alias("fn"), "hop"))
    named, ask = F.col("qual") != "", F.array(F.struct(F.lit(OWNER).alias("stage"), F.col("qual").alias("k1")), F.struct(F.lit(MODULE).alias("stage"), F.col("qual").alias("k1")))
    every = todo.select("q", "hop", "caller", "crate", "lang", F.col("fn").alias("k2"), F.explode(F.when(named, ask).otherwise(F.array(F.struct(F.lit(BARE).alias("stage"), F.col("crate").alias("k1"))))).alias("a")).select("q", "hop", "caller", "crate", "lang", "k2", "a.*")
    if exact is not None:
        every = every.unionByName(exact.select("q", F.lit(0).alias("hop"), "caller", "crate", F.lit(EXACT).alias("stage"), F.lit("rs").alias("lang"), F.concat("krate", F.lit("\0"), "m").alias("k1"), F.col("fn").alias("k2")))
    as_ = lambda df, s: df.select(*(c for c in df.columns if c not in ("n", "x")), F.col("n").alias("n" + s), F.col("x").alias("x" + s))
    r = every.join(as_(total, "_all"), _KEY).join(as_(per, "_same"), [*_KEY, "crate"], "left").join(as_(off, "_off"), ["caller", *_KEY], "left").join(as_(gone, "_off_same"), ["caller", *_KEY, "crate"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    n, same = F.col("n_all") - zero("n_off"), zero("n_same") - zero("n_off_same")
    x, xs = F.col("x_all").bitwiseXOR(zero("x_off")), zero("x_same").bitwiseXOR(zero("x_off_same"))
    r = r.select("q", "hop", "stage", n.alias("n"), F.when(same == 1, xs).when((same == 0) & (n == 1), x).alias("pick"))
    by_stage = [c for s in (EXACT, OWNER, MODULE, BARE) for c in (F.max(F.when(F.col("stage") == s, F.col("n"))).alias(f"n{s}"), F.max(F.when(F.col("stage") == s, F.col("pick"))).alias(f"p{s}"), F.max(F.when(F.col("stage") == s, True)).alias(f"had{s}"))]
    in_file = free.select(F.col("name").alias("fn"), "file_path", F.lit(True).alias("own_file")).distinct()
    said = todo.join(r.groupBy("q", "hop").agg(*by_stage), ["q", "hop"], "left").join(owned, ["qual", "fn"], "left").join(in_file, ["fn", "file_path"], "left")
    if exact is not None:
        said = said.join(exact.select("q", F.lit(0).alias("hop"), F.lit(True).alias("placed"), "guessed"), ["q", "hop"], "left")
    else:
        said = said.withColumns({"placed": F.lit(None).cast("boolean"), "guessed": F.lit(None).cast("boolean")})

    def found(pick: Column, reason: str) -> Column:
        return F.struct(pick.cast("bigint").alias("num"), F.lit(reason).alias("reason"))

    def outcome(s: int, name: str) -> Column:
        return F.when(F.col(f"p{s}").isNotNull(), found(F.col(f"p{s}"), name)).when(F.col(f"n{s}") > 0, unclear)

    none, unclear = found(F.lit(None), "unresolved"), found(F.lit(None), "ambiguous")
    exactly = F.when(F.col("n1") == 1, found(F.col("p1"), "exact")).when(F.col("placed") & (F.col("had1") | ~F.col("guessed")), unclear)
    by_name = F.when(F.col("own_file").isNull() & F.col("p7").isNotNull(), found(F.col("p7"), "bare")).otherwise(none)
    known = F.coalesce(exactly, F.when(F.col("qual").isin("crate", "self", "super", "Self"), none), F.when(F.col("qual") == "", by_name), outcome(OWNER, "owner"), outcome(MODULE, "module"))
    # The first name that says something decides, else what the last one leaves.
    said = said.withColumn("o", known).groupBy("q").agg(F.min(F.when(F.col("o").isNotNull(), F.struct("hop", "o"))).alias("first"), F.max(F.struct("hop", F.coalesce("owned", F.lit(False)).alias("owned"))).alias("end"))
    result = said.select("q", F.coalesce(F.col("first.o"), F.when(F.col("end.owned"), unclear).otherwise(none)).alias("o"))
    got = asked.select("q", "caller_id", "lang", "prefix", "fn").join(result, "q")
    return got.join(num.withColumnRenamed("i", "target"), got["o.num"] == num["num"], "left").select("caller_id", "lang", "prefix", "fn", "target", F.col("o.reason").alias("reason"))


def _chains(packages: DataFrame, hops: int) -> DataFrame:
    """``qual, fn, hop, to_prefix, to_name``: what each re-exported name stands for after 1, 2, ... steps."""
    one = packages.select(F.col("package").alias("qual"), F.col("name").alias("fn"), "to_prefix", "to_name")
    step = packages.select(F.col("package").alias("to_prefix"), F.col("name").alias("to_name"), F.col("to_prefix").alias("p2"), F.col("to_name").alias("n2"))
    level, out = one, one.withColumn("hop", F.lit(1))
    for hop in range(2, hops + 1):
        level = level.join(step, ["to_prefix", "to_name"]).select("qual", "fn", F.col("p2").alias("to_prefix"), F.col("n2").alias("to_name"))
        out = out.unionByName(level.withColumn("hop", F.lit(hop)))
    return out


def resolve_calls(atoms: DataFrame, edges: DataFrame, sites: DataFrame, imports: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Call sites across files: (new ``calls`` edges, external atoms).

    Arguments as for ``decide_calls``, ``sites`` with rank and flags.  An
    unresolved name with a qualifier that can't be local makes an external atom,
    unless the parser typed its receiver, the qualifier is a type of the graph,
    or it is a Dart class that owns no method here.  Runs once per graph: it
    does not see the edges that it makes.
    """
    decided = cut(decide_calls(atoms, edges, sites, imports))
    prefix, last = S.split_call(F.col("name"))
    s = sites.where("not is_method").select("caller_id", "rank", "flags", prefix.alias("prefix"), last.alias("fn"))
    both = s.join(decided, (s["caller_id"] == decided["caller_id"]) & s["prefix"].eqNullSafe(decided["prefix"]) & (s["fn"] == decided["fn"])).select(s["caller_id"], "lang", "rank", "flags", s["prefix"], s["fn"], "target", "reason")
    hits = both.where("target is not null").select("caller_id", "target", "rank")
    types = atoms.where(F.col("kind").isin(*LOCAL_TYPES)).select(F.col("name").alias("qual")).distinct()
    qual, head = S.strip_generics(F.element_at(F.split("prefix", "::"), -1)), F.substring_index("prefix", "::", 1)
    missing = both.where((F.col("reason") == "unresolved") & ~S.has_flag(F.col("flags"), schema.TYPED_RECEIVER) & F.col("prefix").isNotNull()).withColumns({"qual": qual, "head": head})
    missing = missing.where("head not in ('crate', 'self', 'super', 'Self', '')").join(types, "qual", "left_anti")
    owners = atoms.where("kind = 'function' and parent is not null").select(F.element_at(F.split(S.strip_generics(F.coalesce(S.impl_owner_type(F.col("parent")), F.col("parent"))), "::"), -1).alias("head"), F.lit(True).alias("known")).distinct()
    missing = missing.join(owners, "head", "left").where("known or lang <> 'dart'")
    path = F.concat("prefix", F.lit("::"), "fn")
    ext = cut(missing.select("caller_id", F.concat(F.lit("extern:"), path).alias("target"), "rank", "fn", path.alias("signature")))
    new = hits.unionByName(ext.select("caller_id", "target", "rank")).groupBy("caller_id", "target").agg(F.array_sort(F.collect_list("rank")).alias("sites")).select(
        F.col("caller_id").alias("src"), F.col("target").alias("dst"), F.lit("calls").alias("kind"), F.lit(None).cast("string").alias("role"), "sites"
    )
    return new, ext.select(F.col("target").alias("id"), F.lit(schema.EXTERN).alias("kind"), F.col("fn").alias("name"), "signature").distinct()


# -- traits, types, imports ------------------------------------------------------------
def implements(impls: DataFrame, traits: DataFrame) -> DataFrame:
    """``impl_id, trait_id`` by the trait's short name.

    ``impls``: id, name (``Trait for Type``), file_path.  ``traits``: id, name,
    file_path.  The same crate is preferred; several candidates give nothing.
    """
    short = S.strip_generics(F.element_at(F.split(F.substring_index("name", " for ", 1), "::"), -1))
    a = impls.where(F.instr("name", " for ") > 0).select(F.col("id").alias("impl_id"), short.alias("t"), _crate(F.col("file_path")).alias("crate"))
    b = traits.select(F.col("id").alias("target"), F.col("name").alias("t"), _crate(F.col("file_path")).alias("crate"))
    return _asked_of(a, b, ["t"]).select("impl_id", same_first().alias("trait_id")).where("trait_id is not null")


def implement_edges(atoms: DataFrame, contains: DataFrame) -> DataFrame:
    """``src, dst`` from impls to traits, and from their methods to the trait's by name."""
    pairs = implements(atoms.where("kind = 'impl'").select("id", "name", "file_path"), atoms.where("kind = 'trait'").select("id", "name", "file_path"))
    kids = contains.where("kind = 'contains'").join(atoms.where("kind = 'function'").select(F.col("id").alias("dst"), "name"), "dst").select("src", "dst", "name")
    a = pairs.join(kids.select(F.col("src").alias("impl_id"), F.col("dst").alias("a"), "name"), "impl_id")
    b = a.join(kids.select(F.col("src").alias("trait_id"), F.col("dst").alias("b"), "name"), ["trait_id", "name"])
    return pairs.select(F.col("impl_id").alias("src"), F.col("trait_id").alias("dst")).unionByName(b.select(F.col("a").alias("src"), F.col("b").alias("dst"))).distinct()


def type_targets(refs: DataFrame, types: DataFrame, tree: DataFrame | None = None, reexports: DataFrame | None = None) -> DataFrame:
    """``atom_id, target`` of written types: an exact Rust path, else same file, same crate, or sole.

    ``refs``: atom_id, written, file_path, scope.  ``types``: id, name,
    file_path, scope.  A path that names a module of the crate (``tree``)
    decides by what that module offers, and nothing else is looked at then.
    """
    krate, mpath, apart = S.rust_module(F.col("file_path"))
    r = refs.select("atom_id", "written", F.element_at(F.split("written", "::"), -1).alias("name"), F.col("file_path").alias("file"), _crate(F.col("file_path")).alias("crate"), S.lang_of(F.col("file_path")).alias("lang"), *((krate.alias("krate"), S.join_module(mpath, F.coalesce("scope", F.lit(""))).alias("here"), F.coalesce(apart, F.lit(False)).alias("apart")) if tree is not None else ())).distinct()
    found = None
    if tree is not None:
        r = cut(r.withColumn("path", F.when(F.instr("written", "::") > 0, F.left("written", F.length("written") - F.length("name") - 2))))
        placed = cut(r.join(resolve_paths(r, tree).where("module is not null"), ["krate", "here", "path", "apart"]).select("atom_id", "written", "krate", "module", "name"))
        defined = types.where("file_path like '%.rs'").select(krate.alias("krate"), S.join_module(mpath, F.coalesce("scope", F.lit(""))).alias("module"), "name", F.col("id").alias("target"))
        one = module_members(placed, defined, reexports).groupBy("krate", "module", "name").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target")).where("n = 1")
        found = placed.join(one, ["krate", "module", "name"]).select("atom_id", "target")
        r = r.join(placed.select("atom_id", "written"), ["atom_id", "written"], "left_anti")
    t = types.select(F.col("id").alias("target"), "name", F.col("file_path").alias("file"), _crate(F.col("file_path")).alias("crate"), S.lang_of(F.col("file_path")).alias("lang"))
    local = t.groupBy("name", "lang", "file").agg(F.count(F.lit(1)).alias("n_file"), F.min("target").alias("one_file"))
    c = _asked_of(r, t, ["name", "lang"]).join(local, ["name", "lang", "file"], "left")
    by_name = c.select("atom_id", F.when(F.col("n_file") == 1, F.col("one_file")).otherwise(same_first()).alias("target")).where("target is not null")
    every = by_name if found is None else by_name.unionByName(found)
    return every.where("target <> atom_id").distinct()


def suffix_imports(imports: DataFrame, files: DataFrame, sep: str = "/") -> DataFrame:
    """Imports to the one file whose path is or ends with what they want.

    ``imports``: importer, wanted, root.  ``files``: file, path (stripped),
    root.  The suffix test is an equi-join on the tails of all paths, counted
    per tail and root beforehand.  Returns importer, wanted, target (null
    without a single one), viable.
    """
    segs = F.split("path", sep)
    tails = F.transform(F.sequence(F.lit(1), F.size(segs)), lambda n: F.array_join(F.slice(segs, n, F.size(segs)), "/" if sep == "/" else "."))
    ends = files.select(F.col("file").alias("target"), F.col("root").alias("crate"), F.explode(tails).alias("wanted"))
    asked = imports.select("importer", "wanted", F.col("root").alias("crate")).distinct()
    return _asked_of(asked, ends, ["wanted"]).select("importer", "wanted", sole_first().alias("target"), F.col("n").alias("viable"))


def import_edges(imports: DataFrame, modules: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """``src, dst`` between module atoms, distinct and without self links.

    ``imports``: module_id, file_path, target, is_glob, is_public, is_inner,
    local, as parsed.  ``modules``: id, file_path.  ``items``: file_path, scope,
    name of the atoms that stand in no other.  A Rust path names a module of the
    crate, else an item of one, which re-exports may lead elsewhere; Python
    names an absolute module by its dotted path or the end of one, a relative
    one exactly, and of an imported name both the submodule and its package;
    Dart names a package path by its end or a relative file.
    """
    krate, mpath, apart = S.rust_module(F.col("file_path"))
    dims = cut(modules.select(
        F.col("id").alias("dst"), "file_path", S.lang_of(F.col("file_path")).alias("lang"), _crate(F.col("file_path")).alias("root"), krate.alias("krate"), mpath.alias("here"), F.coalesce(apart, F.lit(False)).alias("apart"), S.python_dotted(F.col("file_path")).alias("dotted"),
    ))
    by_file = dims.drop("dst").distinct()
    i = imports.where("not is_inner").select(F.col("module_id").alias("src"), "file_path", "target").distinct().join(by_file, "file_path")
    # Rust: the whole path, else an item of the module before it, else that module.
    files = dims.where("lang = 'rs'").select("dst", "krate", F.col("here").alias("module"), "file_path")
    defined = None
    scoped = files.select("file_path", F.lit("").alias("scope"))
    if items is not None:
        own = items.where("file_path like '%.rs'")
        scoped = scoped.unionByName(own.select("file_path", F.coalesce("scope", F.lit("")).alias("scope"))).distinct()
        defined = own.select(krate.alias("krate"), S.join_module(mpath, F.coalesce("scope", F.lit(""))).alias("module"), "name", F.col("file_path").alias("target")).distinct()
    tree, _ = cut_small(module_tree(scoped))
    places = scoped.select("file_path", krate.alias("krate"), S.join_module(mpath, F.col("scope")).alias("module")).distinct().join(files.select("file_path", "dst"), "file_path").select("krate", "module", "dst").distinct()
    last = F.element_at(F.split("target", "::"), -1)
    rust = cut(i.where("lang = 'rs'").select("src", "krate", "here", "apart", "target", last.alias("name"), F.when(F.instr("target", "::") > 0, F.left("target", F.length("target") - F.length(last) - 2)).alias("before")))
    both = rust.select("krate", "here", "apart", F.explode(F.array("target", "before")).alias("path"))
    ways = cut(resolve_paths(both, tree).where("module is not null"))
    key = ["krate", "here", "path", "apart"]
    whole = rust.withColumnRenamed("target", "path").join(ways, key).select("src", "krate", "module")
    rest = rust.join(ways.withColumnRenamed("path", "target"), ["krate", "here", "target", "apart"], "left_anti").withColumnRenamed("before", "path").join(ways, key).select("src", "krate", "module", "name", "guessed")
    out = whole.join(places, ["krate", "module"]).select("src", "dst")
    left = rest
    if defined is not None:
        rest = cut(rest)
        found = cut(module_members(rest, defined, rust_reexports(imports, tree)))
        out = out.unionByName(rest.join(found, ["krate", "module", "name"]).join(files.select(F.col("file_path").alias("target"), "dst"), "target").select("src", "dst"))
        left = rest.join(found.select("krate", "module", "name").distinct(), ["krate", "module", "name"], "left_anti")
    out = out.unionByName(left.where("not guessed").join(places, ["krate", "module"]).select("src", "dst"))
    # Python: the submodule of that name, and the module itself.
    mod, name = F.substring_index("target", "::", 1), F.when(F.instr("target", "::") > 0, F.substring_index("target", "::", -1))
    p = i.where("lang = 'py'").select("src", "file_path", "root", F.explode(F.array(mod, F.when(name.isNotNull(), F.concat(mod, F.when(F.endswith(mod, F.lit(".")), "").otherwise("."), name)))).alias("w")).where("w is not null").distinct()
    dots = F.length(F.regexp_extract("w", r"^(\.*)", 1))
    folder = F.slice(F.split("file_path", "/"), F.lit(1), F.size(F.split("file_path", "/")) - 1)
    up = F.slice(folder, F.lit(1), F.greatest(F.size(folder) - dots + 1, F.lit(0)))
    below = F.filter(F.split(F.ltrim("w", F.lit(".")), r"\."), lambda x: x != "")
    relative = F.when(F.size(folder) >= dots - 1, F.array_join(F.concat(up, below), "."))
    p = p.select("src", "root", (dots > 0).alias("near"), F.when(dots > 0, relative).otherwise(F.col("w")).alias("wanted")).where("wanted is not null and wanted <> ''")
    py = dims.where("lang = 'py'").select(F.col("dst").alias("file"), F.col("dotted").alias("path"), "root")
    far = suffix_imports(p.where("not near").withColumnRenamed("src", "importer"), py, r"\.")
    near = _asked_of(p.where("near").select("src", "wanted", F.col("root").alias("crate")), py.select(F.col("file").alias("target"), F.col("path").alias("wanted"), F.col("root").alias("crate")), ["wanted"])
    out = out.unionByName(far.select(F.col("importer").alias("src"), F.col("target").alias("dst"))).unionByName(near.select("src", sole_first().alias("dst")))
    # Dart: package paths by their end, relative ones against the importer's directory.
    d = i.where("lang = 'dart' and target not like 'dart:%'")
    package = F.startswith("target", F.lit("package:"))
    zero = F.struct(folder.alias("at"), F.lit(True).alias("ok"))
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.struct(F.slice(acc["at"], F.lit(1), F.greatest(F.size(acc["at"]) - 1, F.lit(0))).alias("at"), (acc["ok"] & (F.size(acc["at"]) > 0)).alias("ok"))).otherwise(F.struct(F.concat(acc["at"], F.array(s)).alias("at"), acc["ok"].alias("ok")))
    joined = F.aggregate(F.split("target", "/"), zero, step)
    d = d.select("src", "root", package.alias("far"), F.when(package, F.when(F.instr("target", "/") > 0, F.regexp_replace("target", r"^package:[^/]*/", ""))).when(joined["ok"], F.array_join(joined["at"], "/")).alias("wanted")).where("wanted is not null and wanted <> ''")
    dart = dims.where("lang = 'dart'").select(F.col("dst").alias("file"), F.col("file_path").alias("path"), "root")
    far = suffix_imports(d.where("far").withColumnRenamed("src", "importer"), dart)
    near = d.where("not far").join(dart.select(F.col("file").alias("dst"), F.col("path").alias("wanted")), "wanted")
    out = out.unionByName(far.select(F.col("importer").alias("src"), F.col("target").alias("dst"))).unionByName(near.select("src", "dst"))
    return out.where("dst is not null and src <> dst").distinct()


# -- targets that a user names -----------------------------------------------------------
def lookup(atoms: DataFrame, target: str, kind: str = "function") -> str:
    """The id that a user's target names.

    Exact id first; then for functions ``Owner::name``, a name whose id holds
    the owner, for modules a path; then the exact name.  Several candidates are
    an error that names the first three; none is one too.
    """
    if not target:
        raise LookupError(f"a {kind} must be named")
    owner, _, name = target.rpartition("::")
    if kind == "module":
        hint = (F.col("file_path") == target) & F.lit("/" in target)
    else:
        hint = (F.col("name") == name) & F.contains("id", F.lit(owner)) if owner and name else F.lit(False)
    ranked = atoms.where(F.col("kind") == kind).select("id", F.when(F.col("id") == target, 0).when(hint, 1).when(F.col("name") == target, 2).alias("p")).where("p is not null")
    got = ranked.orderBy("p", "id").limit(5).collect()
    best = [r["id"] for r in got if r["p"] == got[0]["p"]] if got else []
    if len(best) == 1:
        return best[0]
    if not best:
        raise LookupError(f"no {kind} is called {target!r}")
    raise LookupError(f"{target!r} is ambiguous: " + ", ".join(best[:3]) + (", ..." if len(best) > 3 else ""))
