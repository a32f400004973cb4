"""What the three language parsers share: decoding, tokens, errors, records.

A parser is recursive descent over declarations and statements and climbs
precedences in expressions.  An error is recorded, the parser then skips to a
place where a statement or declaration can begin (panic mode) and goes on, so
that one file gives all its errors and every item that still can be read.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

#: More Python frames than a parser lays on each other for one character of text.
FRAMES = 24

AWAIT, CONDITIONAL, REPEATED, TYPED = 1, 2, 4, 8

_LINE_END = re.compile(r"\r\n|\n|\r")


class SyntaxFailure(Exception):
    """An error at a token; ``at`` is a character offset."""

    def __init__(self, at: int, what: str):
        super().__init__(what)
        self.at, self.what = at, what


@dataclass
class Item:
    """A declaration.  ``name_at``, ``start``, ``end`` are offsets."""

    kind: str
    name: str
    name_at: int
    start: int
    end: int = -1
    body: int = -1
    doc: str | None = None
    parent: str | None = None
    scope: str = ""
    params: tuple[str, ...] = ()
    bases: tuple[str, ...] = ()
    is_method: bool = False
    types: list[str] = field(default_factory=list)
    calls: list[tuple[str, int, int, bool]] = field(default_factory=list)  # name, offset, flags, is_method
    local: dict[str, str | None] = field(default_factory=dict)  # declared types of names
    held: dict[str, str | None] = field(default_factory=dict)  # what the optional values among them hold
    inner: bool = False  # inside a function
    events: list[tuple] = field(default_factory=list)  # calls and the blocks around them, in order


@dataclass
class Unit:
    """The result of one file."""

    errors: list[tuple[int, str]] = field(default_factory=list)
    items: list[Item] = field(default_factory=list)
    imports: list[tuple[str, str, bool, bool]] = field(default_factory=list)  # local name, path, glob, public
    inner_imports: set[int] = field(default_factory=set)  # places of those that stand in an inner module or a block
    fields: dict[str, dict[str, str]] = field(default_factory=dict)

    def names(self) -> dict[str, str | None]:
        """Every name of the file that has one declared type only; others have none."""
        out: dict[str, str | None] = {}
        for types in (*self.fields.values(), *(it.local for it in self.items)):
            for name, ty in types.items():
                if ty:
                    out[name] = ty if out.get(name, ty) == ty else None
        return out


def decode(content: bytes | None) -> str | None:
    """The text of a file without a leading mark; None if it is not UTF-8."""
    if content is None:
        return ""
    try:
        text = bytes(content).decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text[1:] if text.startswith("﻿") else text


def decode_leniently(content: bytes | None) -> str:
    """The text of a file however it is encoded, for looking at it only."""
    if content is None:
        return ""
    content = bytes(content)
    for mark, name in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            return content[2:].decode(name, "replace")
    text = content.decode("utf-8", "replace")
    return text[1:] if text.startswith("﻿") else text


def unify(text: str) -> str:
    """Every line end as a single LF."""
    return _LINE_END.sub("\n", text) if "\r" in text else text


@contextmanager
def room_for(text: str) -> Iterator[None]:
    """Let a parser go as deep as ``text`` can be nested.

    Python's frames lie on the heap, so that only the limit stands in the way;
    what they take grows with the nesting and is given back.
    """
    old = sys.getrecursionlimit()
    sys.setrecursionlimit(min(2**31 - 1, old + FRAMES * len(text)))
    try:
        yield
    finally:
        sys.setrecursionlimit(old)


class Lines:
    """Offsets to 1-based lines; the text has LF ends only."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def of(self, at: int) -> int:
        return bisect_right(self.starts, at)


#: Kinds of tokens that are values by themselves.
LITERALS = frozenset(("lit", "num", "str", "fstr", "bytes", "None", "True", "False", "true", "false", "null"))


class Parser:
    """Cursor over tokens ``kinds``, ``texts``, ``ats`` (ending in ``eof``)."""

    def __init__(self, text: str):
        self.text = text
        self.unit = Unit()
        self.kinds: list[str] = []
        self.texts: list[str] = []
        self.ats: list[int] = []
        self.i = 0
        self.functions: list[Item] = []
        self.flags: list[int] = []

    def fail(self, what: str, at: int | None = None):
        k = self.kinds[self.i]
        raise SyntaxFailure(self.ats[self.i] if at is None else at, f"{what}, found {'the end' if k == 'eof' else self.texts[self.i][:20]!r}")

    def note(self, e: SyntaxFailure) -> None:
        self.unit.errors.append((e.at, e.what))

    def expect(self, kind: str) -> int:
        if self.kinds[self.i] != kind:
            self.fail(f"expected {kind}")
        self.i += 1
        return self.i - 1

    def accept(self, kind: str) -> bool:
        if self.kinds[self.i] == kind:
            self.i += 1
            return True
        return False

    def call(self, name: str, at: int, is_method: bool, first: int = -1) -> None:
        """Record a call of the innermost function; ``first``: the token that a method's receiver begins with."""
        if self.functions:
            self.functions[-1].calls.append((name, at, self.flags[-1], is_method))
            self.functions[-1].events.append(("call", len(self.functions[-1].calls) - 1, self.root_of(first) if first >= 0 else ""))

    def root_of(self, first: int) -> str:
        """The leftmost name of a receiver; a literal is a value of the function itself."""
        kinds = self.kinds
        while kinds[first] in ("(", "-", "!", "*", "&", "await", "new", "const"):
            first += 1
        if kinds[first] in LITERALS:
            return "self"
        name = self.texts[first]
        while kinds[first + 1] == "::" and kinds[first + 2] in ("id", "self", "super", "crate"):
            first += 2
            name += "::" + self.texts[first]
        return name + "!" if kinds[first + 1] == "!" and kinds[first + 2] in ("(", "[", "{") else name

    def awaited(self, before: int) -> None:
        """Mark the last call recorded since ``before`` calls as awaited."""
        if self.functions and len(self.functions[-1].calls) > before:
            n, at, flags, m = self.functions[-1].calls[-1]
            self.functions[-1].calls[-1] = (n, at, flags | AWAIT, m)

    def calls_so_far(self) -> int:
        return len(self.functions[-1].calls) if self.functions else 0

    def enter(self, item: Item) -> None:
        self.functions.append(item)
        self.flags.append(0)

    def leave(self) -> None:
        self.functions.pop()
        self.flags.pop()

    def under(self, flag: int, parse, *args):
        """Parse with ``flag`` set on every call inside."""
        if not self.flags:
            return parse(*args) if args else parse()
        old, fn = self.flags[-1], self.functions[-1]
        self.flags[-1] |= flag
        fn.events.append((*self.block_label(flag), self.i))
        try:
            return parse(*args) if args else parse()  # a plain call takes no C stack
        finally:
            fn.events.append(("end",))
            if self.flags:
                self.flags[-1] = old

    def block_label(self, flag: int) -> tuple[str, str]:
        """(loop, alt or else, the words from its keyword on) of a block that begins here."""
        k = self.i - 1
        if self.texts[k] in ("else", ":") and k and (self.texts[k] == "else" or self.texts[k - 1] == "else"):
            return "else", ""
        while k > max(0, self.i - 60) and self.texts[k] not in ("if", "elif", "while", "for", "loop", "match", "switch", "case", "except", "on", "catch"):
            if self.texts[k] in (";", "{", "}", "=>", "nl"):
                break
            k -= 1
        words = self.text[self.ats[k + 1] : self.ats[self.i]] if self.i < len(self.ats) else ""
        other = flag == CONDITIONAL and (self.texts[k] in ("elif", "except", "catch", "on", "case") or k and self.texts[k - 1] == "else")
        return ("else" if other else "loop" if flag == REPEATED else "alt"), " ".join(words.split()).rstrip("{:) ").strip()
