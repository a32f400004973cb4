"""Sequence views: ordered steps of a function, their participants and text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import parse
from ..functions import scalars as S
from ..parse.base import AWAIT, Item
from ..session import spread
from .parsing import _item_id

STEPS = "fn_id string, fn_name string, ord int, depth int, op string, src string, dst string, label string, is_await boolean"
#: Nesting of blocks beyond which a single note stands for the rest.
MAX_DEPTH = 256
# Macros that only panic or test, and Rust's constructors that only wrap.
QUIET_MACROS = frozenset("assert assert_eq assert_ne debug_assert debug_assert_eq debug_assert_ne panic unreachable todo unimplemented matches".split())
WRAPPERS = frozenset("Some None Ok Err".split())


def _call_step(name: str, method: bool, root: str, rust: bool) -> tuple[str, str] | None:
    """(participant, label) of a call; None for one that is no step."""
    if method:
        return root or "self", name.rpartition(".")[2]
    if name.endswith("!"):
        return None if name[:-1] in QUIET_MACROS else ("self", name)
    head, _, last = name.rpartition("::")
    if rust and not head and name in WRAPPERS:
        return None
    root = head.split("::", 1)[0]
    return ("self" if root in ("", "Self") else root), last


def _steps(it: Item, entity: str, most: int, rust: bool) -> list[tuple]:
    """A function's steps; blocks without any call are dropped."""
    rows: list[list] = []
    opened: list[int] = []
    deep = False
    for e in it.events:
        if e[0] == "call":
            name, _, flags, method = it.calls[e[1]]
            if step := _call_step(name, method, e[2], rust):
                rows.append(["call", *step, bool(flags & AWAIT), len(opened)])
        elif e[0] == "end":
            if not opened:
                continue
            at = opened.pop()
            if at < 0:
                continue
            joined = rows[at][0] == "else"  # it took the end of the block that it joined
            if not (seen := any(r[0] in ("call", "note") for r in rows[at:])):
                del rows[at:]
            if seen or joined:
                rows.append(["end", None, "", False, len(opened)])
        else:
            if len(opened) >= most:
                if not deep:
                    rows.append(["note", None, "...depth limit...", False, len(opened)])
                    deep = True
                opened.append(-1)
                continue
            op, label = e[0], e[1]
            joins = op == "else" and rows and rows[-1][0] == "end" and rows[-1][4] == len(opened)
            if joins:
                rows.pop()
                opened.append(len(rows))
                rows.append(["else", None, label, False, len(opened) - 1])
            else:
                opened.append(len(rows))
                rows.append(["alt" if op == "else" else op, None, label, False, len(opened) - 1])
    out, depth = [], 0
    for k, (op, to, label, wait, _) in enumerate(rows):
        if op == "end":
            depth -= 1
        level = depth - (op == "else")
        out.append((entity, it.name, k, max(level, 0), op, "self" if op == "call" else None, to, label, wait))
        if op in ("loop", "alt"):
            depth += 1
    while depth > 0:
        depth -= 1
        out.append((entity, it.name, len(out), depth, "end", None, None, "", False))
    return out


def file_steps(path: str, content: bytes | None, most: int = MAX_DEPTH) -> list[tuple]:
    unit, _ = parse.parse_file(path, content)
    first: dict[str, Item] = {}
    for it in unit.items:
        if it.kind == "function":
            first.setdefault(_item_id(path, it), it)  # of several with one id the first counts
    rust = parse.extension(path) == "rs"
    return [row for entity, it in first.items() for row in _steps(it, entity, most, rust)]


def _over_files(files: DataFrame, rows_of: Callable[[str, bytes | None], list[tuple]], out: str) -> DataFrame:
    types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(c, types[t]) for c, t in (x.split() for x in out.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for p, c in zip(b.column("path"), b.column("content")) for r in rows_of(p.as_py(), c.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return spread(files.where("path is not null").select("path", "content")).mapInArrow(run, out)


def steps(files: DataFrame, most: int = MAX_DEPTH) -> DataFrame:
    """Steps of every function of ``files`` (path, content); files that fail give what could be read."""
    return _over_files(files, lambda p, c: file_steps(p, c, most), STEPS)


def list_functions(files: DataFrame) -> DataFrame:
    """``file_path, place, fn_id, fn_name``: every function in the order of its source, with or without steps."""

    def listed(path: str, content: bytes | None) -> list[tuple]:
        unit, _ = parse.parse_file(path, content)
        found = dict.fromkeys((_item_id(path, it), f"{it.parent}::{it.name}" if it.parent else it.name) for it in sorted(unit.items, key=lambda x: x.name_at) if it.kind == "function")
        return [(path, k, entity, name) for k, (entity, name) in enumerate(found)]

    return _over_files(files, listed, "file_path string, place int, fn_id string, fn_name string")


def participants(step: DataFrame) -> DataFrame:
    """``fn_id, participant, place``: lifelines by first appearance, 0 first."""
    ends = step.where("op = 'call'").select("fn_id", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("src").alias("p")), F.struct(F.lit(1).alias("k"), F.col("dst").alias("p")))).alias("e"), "ord")
    first = ends.where("e.p is not null").groupBy("fn_id", F.col("e.p").alias("participant")).agg(F.min(F.struct("ord", "e.k")).alias("at"))
    return first.select("fn_id", "participant", (F.row_number().over(Window.partitionBy("fn_id").orderBy("at", "participant")) - 1).alias("place"))


def lines(step: DataFrame) -> DataFrame:
    """``fn_id, ord, line``: a step as diagram text, indented by its depth."""
    arrow = F.when(F.col("is_await"), "-)").otherwise("->>")
    label = S.escape_sequence(S.cap_at(F.col("label"), 32))
    wait = F.when(F.col("is_await"), " (await)").otherwise("")
    text = (
        F.when(F.col("op") == "call", F.concat(S.sanitize_id(F.col("src")), arrow, S.sanitize_id(F.col("dst")), F.lit(": "), label, wait))
        .when(F.col("op") == "note", F.concat(F.lit("Note over self: "), label)).when(F.col("op") == "end", "end")
        .otherwise(F.rtrim(F.concat("op", F.lit(" "), label)))
    )
    return step.select("fn_id", "ord", F.concat(F.repeat(F.lit("    "), F.col("depth") + 1), text).alias("line"))


def text(step: DataFrame) -> DataFrame:
    """``fn_id, diagram``: participants, then steps, of every function with a step."""
    p = participants(step).select("fn_id", F.lit(0).alias("part"), F.col("place").alias("ord"), F.concat(F.lit("    participant "), S.sanitize_id(F.col("participant")), F.lit(" as "), S.escape_sequence(S.cap_at(F.col("participant"), 24))).alias("line"))
    body = lines(step).select("fn_id", F.lit(1).alias("part"), "ord", "line")
    joined = p.unionByName(body).groupBy("fn_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "ord", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return joined.select("fn_id", F.concat(F.lit("sequenceDiagram\n    autonumber\n"), "body").alias("diagram"))
