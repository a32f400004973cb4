"""Dart 3: tokens, declarations, statements and expressions."""

from __future__ import annotations

import re

from .base import CONDITIONAL, REPEATED, Item, Parser, SyntaxFailure, Unit
from .rust import _doc_text

# Fixed values of the language.
RESERVED = frozenset(
    "assert break case catch class const continue default do else enum extends false final finally for if in is new null rethrow return "
    "super switch this throw true try var void while with".split()
)
BUILT_IN = frozenset(
    "abstract as covariant deferred dynamic export extension external factory Function get implements import interface late library mixin "
    "operator part required set static typedef".split()
)
_PUNCT = [">>>=", "<<=", ">>=", ">>>", "??=", "...?", "?..", "...", "..", "?.", "??", "=>", "==", "!=", "<=", ">=", "&&", "||", "++", "--", "+=", "-=", "*=", "/=", "%=", "~/=", "^=", "&=", "|=", "<<", ">>", "~/", *"+-*/%^!&|=<>@.,;:#?~()[]{}"]
BINARY = {"??": 3, "||": 4, "&&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "is": 7, "as": 7, "|": 8, "^": 9, "&": 10, "<<": 11, ">>": 11, ">>>": 11, "+": 12, "-": 12, "*": 13, "/": 13, "%": 13, "~/": 13}
ASSIGN = frozenset("= += -= *= /= %= ~/= ^= &= |= <<= >>= >>>= ??=".split())
_OPERATORS = frozenset("< > <= >= == - + / ~/ * % | ^ & << >> >>> ~ []= []".split())
_TOKEN = re.compile(
    r"[ \t\n\x0b\x0c ﻿]*(?:"
    r"(?P<id>[A-Za-z_$][\w$]*+(?!['\"]))"
    r"|(?P<line>//[^\n]*)"
    r"|(?P<block>/\*)"
    r"|(?P<rstr>r(?:'''.*?'''|\"\"\".*?\"\"\"|'[^'\n]*'|\"[^\"\n]*\"))"
    r"|(?P<q>'''|\"\"\"|'|\")"
    r"|(?P<name>[A-Za-z_$][\w$]*)"
    r"|(?P<num>0[xX][0-9a-fA-F_]+|(?:[0-9][0-9_]*)?\.[0-9][0-9_]*(?:[eE][+-]?[0-9_]+)?|[0-9][0-9_]*(?:[eE][+-]?[0-9_]+)?)"
    r"|(?P<p>[()\[\]{},;]|" + "|".join(re.escape(x) for x in sorted(_PUNCT, key=len, reverse=True)) + r")|(?P<end>\Z))",
    re.S | re.A,
)
_SPACE = re.compile(r"[ \t\n\x0b\x0c ﻿]*")
_STOP = {q: re.compile(r"\\.|\$\{|\$[A-Za-z_]|" + q + ("" if len(q) == 3 else r"|\n"), re.S) for q in ("'", '"', "'''", '"""')}
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_NAMES = frozenset(("id",))
_AFTER_TYPE_ARGS = frozenset("( ) ] } : ; , . ?. == != .. ?.. eof ? => & | &&".split()) | {"||"}
_DECL = frozenset("class enum mixin extension typedef import export library part abstract final const var void sealed base interface external late".split())


class DartParser(Parser):
    def __init__(self, text: str):
        super().__init__(text)
        self.docs: dict[int, str] = {}  # token -> documentation before it
        self.subs: dict[int, list[tuple[int, int]]] = {}  # string token -> parts in ${}
        self.owner: list[str] = []
        self.async_: list[bool] = [False]

    # -- tokens ---------------------------------------------------------
    def string_end(self, at: int, q: str, subs: list | None) -> int:
        """The end of a string whose text begins at ``at``; -1 without one."""
        text, stop = self.text, _STOP[q]
        while True:
            m = stop.search(text, at)
            if not m:
                return -1
            s = m[0]
            if s == q:
                return m.end()
            if s == "\n":
                return -1
            if s == "${":
                end = self.braces_end(m.end())
                if end < 0:
                    return -1
                if subs is not None:
                    subs.append((m.end(), end - 1))
                at = end
            else:
                at = m.end()

    def braces_end(self, at: int) -> int:
        """The end of a ``${`` part whose text begins at ``at``."""
        depth = 1
        text, n = self.text, len(self.text)
        while at < n:
            m = _TOKEN.match(text, at)
            if not m or m.lastgroup == "end":
                return -1
            g = m.lastgroup
            at = m.end()
            if g == "q":
                at = self.string_end(at, m[g], None)
                if at < 0:
                    return -1
            elif g == "block":
                k = text.find("*/", at)
                if k < 0:
                    return -1
                at = k + 2
            elif g == "p":
                if m[g] == "{":
                    depth += 1
                elif m[g] == "}":
                    depth -= 1
                    if not depth:
                        return at
        return -1

    def lex(self, at: int = 0, n: int | None = None) -> None:
        text = self.text
        n = len(text) if n is None else n
        kinds, texts, ats = self.kinds, self.texts, self.ats
        match = _TOKEN.match
        doc: list[str] | None = None
        doc_lines = False
        if at == 0 and text.startswith("#!"):
            at = text.find("\n") if "\n" in text else n
        while at < n:
            m = match(text, at, n)
            if not m:
                at = _SPACE.match(text, at, n).end()
                self.unit.errors.append((at, f"unknown character {text[at]!r}"))
                at += 1
                continue
            g, end = m.lastgroup, m.end()
            if g == "end":
                break
            at = m.start(g)
            word = text[at:end]
            if g == "line":
                if word.startswith("///"):
                    if doc is None or not doc_lines:
                        doc, doc_lines = [], True
                    doc.append(_doc_text(word))
                at = end
                continue
            if g == "block":
                depth, j = 1, end
                while depth:
                    k = re.compile(r"/\*|\*/").search(text, j)
                    if not k:
                        self.unit.errors.append((at, "unterminated block comment"))
                        j = n
                        break
                    depth += 1 if k[0] == "/*" else -1
                    j = k.end()
                if text.startswith("/**", at) and j - at > 4:
                    doc, doc_lines = [_doc_text(text[at:j])], False
                at = j
                continue
            if doc is not None:
                self.docs[len(kinds)] = "\n".join(doc)
                doc = None
            if g == "q":
                subs: list = []
                j = self.string_end(end, word, subs)
                if j < 0:
                    self.unit.errors.append((at, "unterminated string"))
                    if len(word) == 3:
                        break
                    j = text.find("\n", end)
                    j = n if j < 0 else j
                    subs = []
                if subs:
                    self.subs[len(kinds)] = subs
                kinds.append("str")
                word = text[at:j]
                end = j
            elif g == "rstr":
                kinds.append("str")
            elif g == "id" or g == "name":
                kinds.append(word if word in RESERVED else "id")
            elif g == "num":
                kinds.append("num")
                if text[end : end + 1].isalpha() or text[end : end + 1] == "_":
                    self.unit.errors.append((at, "bad number"))
            else:
                kinds.append(word)
            texts.append(word)
            ats.append(at)
            at = end
        for _ in range(3):
            kinds.append("eof")
            texts.append("")
            ats.append(n)

    def split(self, first: str) -> None:
        t = self.texts[self.i]
        i = self.i
        self.kinds[i : i + 1] = [first, t[len(first) :]]
        self.texts[i : i + 1] = [first, t[len(first) :]]
        self.ats[i : i + 1] = [self.ats[i], self.ats[i] + len(first)]
        self.docs = {k + (k > i): v for k, v in self.docs.items()}
        self.subs = {k + (k > i): v for k, v in self.subs.items()}

    def word(self, w: str, ahead: int = 0) -> bool:
        return self.texts[self.i + ahead] == w and self.kinds[self.i + ahead] == "id"

    def take(self, w: str) -> bool:
        if self.word(w):
            self.i += 1
            return True
        return False

    def name(self) -> int:
        return self.expect("id")

    # -- skipping types without parsing them ------------------------------
    def skip_group(self, i: int) -> int:
        """The token after a balanced group at ``i``; -1 if there is none."""
        kinds = self.kinds
        stack = []
        while True:
            k = kinds[i]
            if k in _CLOSE:
                stack.append(_CLOSE[k])
            elif k in (")", "]", "}"):
                if not stack or stack.pop() != k:
                    return -1
                if not stack:
                    return i + 1
            elif k == "eof":
                return -1
            i += 1

    def skip_type_args(self, i: int) -> int:
        """After ``<...>`` of types at ``i``; -1 if it is no such list."""
        kinds = self.kinds
        depth = 0
        while True:
            k = kinds[i]
            if k == "<":
                depth += 1
            elif k in (">", ">>", ">>>"):
                depth -= len(k)
                if depth <= 0:
                    return i + 1 if depth == 0 else -1
            elif k == "(":
                i = self.skip_group(i)
                if i < 0:
                    return -1
                continue
            elif k == ">=" and False:
                return -1
            elif k not in ("id", ",", ".", "?", "void", "extends", "@", "{", "}", "[", "]"):
                return -1
            i += 1

    def skip_type(self, i: int) -> int:
        kinds = self.kinds
        k = kinds[i]
        if k == "void":
            i += 1
        elif k == "id":
            i += 1
            if kinds[i] == "." and kinds[i + 1] == "id":
                i += 2
            if kinds[i] == "<":
                i = self.skip_type_args(i)
                if i < 0:
                    return -1
            elif self.texts[i - 1] == "Function" and kinds[i] == "(":
                i = self.skip_group(i)
                if i < 0:
                    return -1
        elif k == "(":
            i = self.skip_group(i)
            if i < 0:
                return -1
        else:
            return -1
        while True:
            if kinds[i] == "?":
                i += 1
            elif kinds[i] == "id" and self.texts[i] == "Function" and kinds[i + 1] in ("(", "<"):
                i += 1
                if kinds[i] == "<":
                    i = self.skip_type_args(i)
                    if i < 0:
                        return -1
                i = self.skip_group(i) if kinds[i] == "(" else -1
                if i < 0:
                    return -1
            else:
                return i

    # -- types ----------------------------------------------------------
    def type_(self) -> int:
        """A type; returns its first token."""
        first = self.i
        kinds = self.kinds
        k = kinds[self.i]
        if k == "void":
            self.i += 1
        elif k == "(":
            self.i += 1
            while kinds[self.i] != ")":
                if kinds[self.i] == "{":
                    self.i += 1
                    while kinds[self.i] != "}":
                        self.metadata()
                        self.type_()
                        self.name()
                        if not self.accept(","):
                            break
                    self.expect("}")
                else:
                    self.metadata()
                    self.type_()
                    self.accept("id")
                if not self.accept(","):
                    break
            self.expect(")")
        else:
            self.name()
            if kinds[self.i] == "." :
                self.i += 1
                self.name()
            if kinds[self.i] == "<":
                self.type_args()
            elif self.texts[self.i - 1] == "Function" and kinds[self.i] == "(":
                self.params()
        while True:
            if kinds[self.i] == "?":
                self.i += 1
            elif self.word("Function") and kinds[self.i + 1] in ("(", "<"):
                self.i += 1
                if kinds[self.i] == "<":
                    self.type_params()
                self.params()
            else:
                break
        return first

    def type_args(self) -> None:
        self.expect("<")
        while True:
            self.type_()
            if not self.accept(","):
                break
        self.closing_angle()

    def closing_angle(self) -> None:
        k = self.kinds[self.i]
        if k in (">>", ">>>", ">=", ">>=", ">>>="):
            self.split(">")
        self.expect(">")

    def type_params(self) -> None:
        self.expect("<")
        while True:
            self.metadata()
            self.name()
            if self.accept("extends"):
                self.type_()
            if not self.accept(","):
                break
        self.closing_angle()

    def type_name(self, i: int) -> str | None:
        return self.texts[i] if self.kinds[i] == "id" else None

    def type_idents(self, a: int, b: int) -> list[str]:
        return [self.texts[j] for j in range(a, b) if self.kinds[j] == "id" and self.texts[j][:1].isupper() and self.texts[j] != "Function"]

    # -- declarations -----------------------------------------------------
    def parse(self) -> Unit:
        self.lex()
        while self.kinds[self.i] != "eof":
            start = self.i
            try:
                self.declaration()
            except SyntaxFailure as e:
                self.note(e)
                self.resync(start, False)
            except RecursionError:
                self.unit.errors.append((self.ats[self.i], "nested too deeply"))
                break
        return self.unit

    def resync(self, start: int, inside: bool) -> None:
        if self.i == start and self.kinds[self.i] != "eof" and not (inside and self.kinds[self.i] == "}"):
            self.i += 1
        while (k := self.kinds[self.i]) != "eof":
            if k == ";":
                self.i += 1
                return
            if k == "}":
                if not inside:
                    self.i += 1
                return
            if self.texts[self.i] in _DECL and "\n" in self.text[self.ats[self.i - 1] : self.ats[self.i]]:
                return
            if k in _CLOSE:
                j = self.skip_group(self.i)
                if j < 0:
                    self.i += 1
                    continue
                self.i = j
                if k == "{":
                    return
            else:
                self.i += 1

    def metadata(self) -> str | None:
        """Annotations; the documentation before or among them, if any."""
        doc = self.docs.get(self.i)
        while self.kinds[self.i] == "@":
            self.i += 1
            self.name()
            while self.accept("."):
                if not self.accept("new"):
                    self.name()
            if self.kinds[self.i] == "<":
                self.type_args()
            if self.kinds[self.i] == "(" and self.ats[self.i] == self.ats[self.i - 1] + len(self.texts[self.i - 1]):
                self.arguments()
            doc = self.docs.get(self.i, doc)
        return doc

    def record(self, kind: str, tok: int, start: int, doc: str | None) -> Item:
        it = Item(kind, self.texts[tok], self.ats[tok], start, doc=doc, inner=bool(self.functions))
        it.parent = self.owner[-1] if self.owner and kind == "function" else None
        self.unit.items.append(it)
        return it

    def declaration(self) -> None:
        start = self.ats[self.i]
        doc = self.metadata()
        kinds = self.kinds
        w, nxt = self.texts[self.i], kinds[self.i + 1]
        if kinds[self.i] == "id":
            if w in ("import", "export") and nxt == "str":
                return self.directive()
            if w == "library" and nxt in ("id", ";"):
                self.i += 1
                if kinds[self.i] == "id":
                    self.dotted()
                self.expect(";")
                return None
            if w == "part" and nxt in ("str", "id"):
                self.i += 1
                if self.take("of"):
                    if kinds[self.i] == "str":
                        self.i += 1
                    else:
                        self.dotted()
                else:
                    self.expect("str")
                self.expect(";")
                return None
        j = self.i
        while self.texts[j] in ("abstract", "base", "interface", "final", "sealed", "mixin", "augment", "macro") and (kinds[j + 1] == "class" or self.texts[j + 1] in ("abstract", "base", "interface", "final", "sealed", "mixin") and kinds[j + 1] in ("id", "final")):
            j += 1
        if kinds[j] == "class":
            self.i = j
            return self.class_(doc, start)
        if self.texts[j] == "mixin" and kinds[j + 1] == "id":
            self.i = j
            return self.mixin(doc, start)
        if kinds[self.i] == "enum":
            return self.enum(doc, start)
        if kinds[self.i] == "id":
            if w == "extension" and (nxt in ("id", "<")):
                return self.extension(doc, start)
            if w == "typedef" and nxt in ("id", "void", "("):
                return self.typedef(doc, start)
        self.member(doc, start, None)
        return None

    def dotted(self) -> None:
        self.name()
        while self.accept("."):
            self.name()

    def directive(self) -> None:
        public = self.texts[self.i] == "export"
        self.i += 1
        uri = self.texts[self.expect("str")]
        while self.kinds[self.i] == "str":
            self.i += 1
        while self.accept("if"):
            self.expect("(")
            self.dotted()
            if self.accept("=="):
                self.expect("str")
            self.expect(")")
            self.expect("str")
        uri = uri.strip("'\"")
        self.take("deferred")
        alias, shown = "", []
        if self.take("as"):
            alias = self.texts[self.name()]
        while self.word("show") or self.word("hide"):
            show = self.texts[self.i] == "show"
            self.i += 1
            while True:
                n = self.texts[self.name()]
                if show:
                    shown.append(n)
                if not self.accept(","):
                    break
        self.expect(";")
        self.unit.imports.append((alias, uri, not shown, public))
        self.unit.imports.extend((n, uri, False, public) for n in shown)

    def types(self) -> list[str]:
        out = []
        while True:
            t = self.i
            self.type_()
            if n := self.type_name(t):
                out.append(n)
            if not self.accept(","):
                return out

    def class_(self, doc, start) -> None:
        self.expect("class")
        tok = self.name()
        it = self.record("struct", tok, start, doc)
        bases: list[str] = []
        if self.kinds[self.i] == "<":
            self.type_params()
        if self.accept("="):
            self.type_()
            self.expect("with")
            self.types()
            if self.take("implements"):
                self.types()
            self.expect(";")
            return
        if self.accept("extends"):
            t = self.i
            self.type_()
            bases += self.texts[t : t + 1]
        if self.accept("with"):
            bases += self.types()
        if self.take("implements"):
            bases += self.types()
        it.bases = tuple(bases)
        self.body(it)

    def mixin(self, doc, start) -> None:
        self.i += 1
        tok = self.name()
        it = self.record("trait", tok, start, doc)
        if self.kinds[self.i] == "<":
            self.type_params()
        bases: list[str] = []
        if self.take("on"):
            bases += self.types()
        if self.take("implements"):
            bases += self.types()
        it.bases = tuple(bases)
        self.body(it)

    def enum(self, doc, start) -> None:
        self.i += 1
        tok = self.name()
        it = self.record("enum", tok, start, doc)
        if self.kinds[self.i] == "<":
            self.type_params()
        if self.accept("with"):
            self.types()
        if self.take("implements"):
            it.bases = tuple(self.types())
        self.expect("{")
        while self.kinds[self.i] not in (";", "}"):
            self.metadata()
            self.name()
            if self.kinds[self.i] == "<":
                self.type_args()
            if self.accept("."):
                self.name()
            if self.kinds[self.i] == "(":
                self.arguments()
            if not self.accept(","):
                break
        if self.accept(";"):
            self.members(it)
        else:
            self.expect("}")
        it.end = self.ats[self.i - 1] + 1

    def extension(self, doc, start) -> None:
        self.i += 1
        typed = self.word("type") and self.kinds[self.i + 1] in ("id", "const")
        if typed:
            self.i += 1
            self.accept("const")
        tok = self.i
        if self.kinds[self.i] == "id" and not (self.word("on") and self.kinds[self.i + 1] != "id" and False):
            if not (self.word("on") and not typed and self.kinds[self.i + 1] == "id" and self.texts[self.i + 1] != "on"):
                self.i += 1
        it = self.record("struct" if typed else "impl", tok, start, doc)
        if self.kinds[self.i] == "<":
            self.type_params()
        if typed:
            if self.accept("."):
                self.name()
            self.params()
            if self.take("implements"):
                self.types()
        else:
            if not self.take("on"):
                self.fail("expected on")
            self.type_()
        self.body(it)

    def typedef(self, doc, start) -> None:
        self.i += 1
        if self.kinds[self.i] == "id" and self.kinds[self.i + 1] in ("=", "<") and (self.kinds[self.i + 1] == "=" or self.kinds[max(self.skip_type_args(self.i + 1), 0)] == "="):
            tok = self.name()
            self.record("type_alias", tok, start, doc)
            if self.kinds[self.i] == "<":
                self.type_params()
            self.expect("=")
            self.type_()
        else:
            if self.kinds[self.i + 1] not in ("(", "<") or self.kinds[max(self.skip_type(self.i), 0)] == "id":
                self.type_()
            tok = self.name()
            self.record("type_alias", tok, start, doc)
            if self.kinds[self.i] == "<":
                self.type_params()
            self.params()
        self.expect(";")

    def body(self, it: Item) -> None:
        open_at = self.ats[self.i]
        self.expect("{")
        self.members(it, open_at)
        it.end = self.ats[self.i - 1] + 1

    def members(self, it: Item, open_at: int | None = None) -> None:
        self.owner.append(it.name)
        try:
            while self.kinds[self.i] != "}":
                if self.kinds[self.i] == "eof":
                    self.fail("unclosed {", open_at)
                start = self.i
                try:
                    at = self.ats[self.i]
                    self.member(self.metadata(), at, it)
                except SyntaxFailure as e:
                    self.note(e)
                    self.resync(start, True)
            self.i += 1
        finally:
            self.owner.pop()

    def member(self, doc, start: int, owner: Item | None) -> None:
        """A function, constructor, accessor or variables, at any level."""
        kinds, texts = self.kinds, self.texts
        external = late = False
        while kinds[self.i] == "id" and texts[self.i] in ("external", "static", "abstract", "covariant", "late", "augment") and kinds[self.i + 1] in ("id", "void", "final", "const", "var", "("):
            if kinds[self.i + 1] == "(" and self.skip_type(self.i + 1) > 0 and kinds[self.skip_type(self.i + 1)] != "id":
                break
            external |= texts[self.i] in ("external", "abstract")
            late |= texts[self.i] == "late"
            if texts[self.i] in ("static", "abstract", "covariant") and owner is None:
                self.fail("modifier outside a class")
            self.i += 1
        k = kinds[self.i]
        if k in ("final", "const", "var"):
            if k == "const" and owner is not None and kinds[self.i + 1] == "id" and (texts[self.i + 1] == owner.name and kinds[self.i + 2] in ("(", ".") or texts[self.i + 1] == "factory"):
                self.i += 1
                return self.constructor(doc, start, owner, external)
            self.i += 1
            if kinds[self.i] in ("(", "[", "{") and owner is None and False:
                pass
            t = self.skip_type(self.i)
            if t > 0 and kinds[t] == "id" and k != "var":
                ty = self.i
                self.type_()
                self.field(owner, ty)
            elif t > 0 and kinds[t] == "id":
                self.fail("var with a type")
            return self.variables(owner, k == "final" or external or late or True)
        if k == "id" and owner is not None:
            if texts[self.i] == "factory" and kinds[self.i + 1] == "id":
                return self.constructor(doc, start, owner, external)
            if texts[self.i] == owner.name and (kinds[self.i + 1] == "(" or kinds[self.i + 1] == "." and kinds[self.i + 2] in ("id", "new") and kinds[self.i + 3] == "("):
                return self.constructor(doc, start, owner, external)
        if k not in ("id", "void", "("):
            self.fail("expected a declaration")
        # A type stands first if a name follows it.
        ty = None
        if not self.accessor_ahead(self.i):
            j = self.skip_type(self.i)
            if j > 0 and (kinds[j] == "id" or texts[j] == "operator"):
                ty = self.i
                self.type_()
        if self.accessor_ahead(self.i):
            w = texts[self.i]
            self.i += 1
            tok = self.i
            if w == "operator":
                self.operator()
            else:
                self.name()
            return self.function(tok, doc, start, ty, owner, external, w)
        tok = self.name()
        if kinds[self.i] in ("(", "<"):
            return self.function(tok, doc, start, ty, owner, external, "")
        if ty is None:
            self.fail("expected a declaration", self.ats[tok])
        self.i = tok
        self.field(owner, ty)
        return self.variables(owner, True)

    def field(self, owner: Item | None, ty: int) -> None:
        n = self.type_name(ty)
        if owner is not None:
            owner.types.extend(self.type_idents(ty, self.i))
        if n and n[:1].isupper() and self.kinds[self.i] == "id":
            self.unit.fields.setdefault(owner.name if owner else "", {})[self.texts[self.i]] = n

    def accessor_ahead(self, i: int) -> bool:
        if self.kinds[i] != "id":
            return False
        w, k = self.texts[i], self.kinds[i + 1]
        if w in ("get", "set"):
            return k == "id"
        return w == "operator" and self.texts[i + 1] in ("<", ">", "<=", ">=", "==", "-", "+", "/", "~/", "*", "%", "|", "^", "&", "<<", ">>", ">>>", "~", "[")

    def operator(self) -> None:
        if self.accept("["):
            self.expect("]")
            self.accept("=")
        elif self.texts[self.i] in _OPERATORS:
            self.i += 1
        else:
            self.fail("expected an operator")

    def variables(self, owner, initial: bool) -> None:
        while True:
            tok = self.name()
            if self.accept("="):
                v = self.i
                self.expr()
                made = self.texts[v]
                if made[:1].isupper() and self.kinds[v] == "id" and self.kinds[v + 1] in ("(", "."):  # T(..) or T.named(..)
                    self.unit.fields.setdefault(owner.name if isinstance(owner, Item) else "", {}).setdefault(self.texts[tok], made)
            if not self.accept(","):
                break
        self.expect(";")

    def constructor(self, doc, start, owner: Item, external: bool) -> None:
        factory = self.take("factory")
        tok = self.name()
        while self.accept("."):
            tok = self.i
            if not self.accept("new"):
                self.name()
        it = self.record("constructor", tok, start, doc)
        it.parent = owner.name
        it.params = self.params(it)
        self.enter(it)
        try:
            if self.accept(":"):
                while True:
                    if self.kinds[self.i] in ("super", "this") and self.kinds[self.i + 1] in ("(", ".") and (self.kinds[self.i + 1] == "(" or self.kinds[self.i + 3] == "("):
                        self.i += 1
                        if self.accept("."):
                            self.i += 1
                        self.arguments()
                    elif self.kinds[self.i] == "assert":
                        self.i += 1
                        self.arguments()
                    else:
                        if self.accept("this"):
                            self.expect(".")
                        self.name()
                        self.expect("=")
                        self.conditional_cascade()
                    if not self.accept(","):
                        break
            if factory and self.accept("="):
                self.type_()
                if self.accept("."):
                    self.name()
                self.expect(";")
            elif self.kinds[self.i] == ";":
                self.i += 1
            else:
                self.function_body(it)
        finally:
            self.leave()
        it.end = self.ats[self.i - 1] + 1

    def function(self, tok: int, doc, start, ty, owner, external: bool, accessor: str) -> None:
        it = self.record("function", tok, start, doc)
        it.is_method = owner is not None
        if ty is not None:
            it.types.extend(self.type_idents(ty, tok))
        if accessor != "get":
            if self.kinds[self.i] == "<":
                self.type_params()
            it.params = self.params(it)
        it.body = self.ats[self.i]
        self.enter(it)
        try:
            if self.kinds[self.i] == ";":
                if owner is None and not external:
                    self.fail("expected a body")
                self.i += 1
            else:
                self.function_body(it)
        finally:
            self.leave()
        it.end = self.ats[self.i - 1] + 1

    def function_body(self, it: Item | None, statement: bool = True) -> None:
        is_async = False
        if self.kinds[self.i] == "id" and self.texts[self.i] in ("async", "sync"):
            is_async = self.texts[self.i] == "async"
            self.i += 1
            star = self.accept("*")
            if not is_async and not star:
                self.fail("sync without *")
        self.async_.append(is_async)
        try:
            if self.accept("=>"):
                self.expr()
                if statement:
                    self.expect(";")
            elif self.kinds[self.i] == "{":
                self.block()
            elif statement and self.take("native"):
                self.accept("str")
                self.expect(";")
            else:
                self.fail("expected a body")
        finally:
            self.async_.pop()

    def params(self, it: Item | None = None) -> tuple[str, ...]:
        self.expect("(")
        names: list[str] = []
        kinds = self.kinds
        while kinds[self.i] != ")":
            if kinds[self.i] in ("[", "{"):
                end = _CLOSE[kinds[self.i]]
                self.i += 1
                if kinds[self.i] == end:
                    self.fail("expected a parameter")
                while kinds[self.i] != end:
                    self.param(names, it)
                    if not self.accept(","):
                        break
                self.expect(end)
                break
            self.param(names, it)
            if not self.accept(","):
                break
        self.expect(")")
        return tuple(names)

    def param(self, names: list[str], it: Item | None) -> None:
        self.metadata()
        kinds, texts = self.kinds, self.texts
        while kinds[self.i] == "id" and texts[self.i] in ("required", "covariant") and kinds[self.i + 1] in ("id", "final", "var", "const", "this", "super", "void", "(", "@"):
            self.i += 1
        self.accept("final") or self.accept("var") or self.accept("const")
        ty = self.i
        if kinds[self.i] not in ("this", "super"):
            j = self.skip_type(self.i)
            if j > 0 and (kinds[j] == "id" or kinds[j] in ("this", "super") and kinds[j + 1] == "."):
                self.type_()
            elif j > 0 and kinds[j] in (",", ")", "]", "}") and (kinds[self.i] != "id" or j > self.i + 1):
                self.type_()  # an unnamed parameter of a function type
                return
            else:
                ty = -1
        if kinds[self.i] in ("this", "super"):
            self.i += 1
            self.expect(".")
        tok = self.name()
        names.append(texts[tok])
        if it is not None and ty >= 0 and ty < tok:
            it.types.extend(self.type_idents(ty, tok))
            it.local[texts[tok]] = self.type_name(ty)
        if kinds[self.i] == "<":
            self.type_params()
        if kinds[self.i] == "(":
            self.params()
            self.accept("?")
        if kinds[self.i] in ("=", ":"):
            self.i += 1
            self.expr()

    # -- statements -------------------------------------------------------
    def block(self) -> None:
        open_at = self.ats[self.i]
        self.expect("{")
        while self.kinds[self.i] != "}":
            if self.kinds[self.i] == "eof":
                self.fail("unclosed {", open_at)
            start = self.i
            try:
                self.statement()
            except SyntaxFailure as e:
                self.note(e)
                self.resync(start, True)
        self.i += 1

    def statement(self) -> None:
        self.statement_()

    def statement_(self) -> None:
        kinds, texts = self.kinds, self.texts
        while kinds[self.i] == "id" and kinds[self.i + 1] == ":" and kinds[self.i + 2] != ":":
            self.i += 2
        k = kinds[self.i]
        if k == "{":
            return self.block()
        if k == ";":
            self.i += 1
            return None
        if k == "if":
            self.i += 1
            self.if_condition()
            self.under(CONDITIONAL, self.statement)
            if self.accept("else"):
                self.under(CONDITIONAL, self.statement)
            return None
        if k == "for" or k == "id" and texts[self.i] == "await" and kinds[self.i + 1] == "for":
            self.i += 1 + (k == "id")
            self.for_header()
            return self.under(REPEATED, self.statement)
        if k == "while":
            self.i += 1
            self.paren_expr()
            return self.under(REPEATED, self.statement)
        if k == "do":
            self.i += 1
            self.under(REPEATED, self.statement)
            self.expect("while")
            self.paren_expr()
            self.expect(";")
            return None
        if k == "switch":
            j = self.skip_group(self.i + 1)
            if j > 0 and kinds[j] == "{":
                return self.switch()
        if k == "try":
            self.i += 1
            self.block()
            any_ = False
            while self.word("on") or kinds[self.i] == "catch":
                any_ = True
                if self.take("on"):
                    self.type_()
                if self.accept("catch"):
                    self.expect("(")
                    self.name()
                    if self.accept(",") and kinds[self.i] != ")":
                        self.name()
                        self.accept(",")
                    self.expect(")")
                self.block()
            if self.accept("finally"):
                any_ = True
                self.block()
            if not any_:
                self.fail("try without catch")
            return None
        if k == "return":
            self.i += 1
            if kinds[self.i] != ";":
                self.expr()
            self.expect(";")
            return None
        if k in ("break", "continue"):
            self.i += 1
            self.accept("id")
            self.expect(";")
            return None
        if k == "rethrow":
            self.i += 1
            self.expect(";")
            return None
        if k == "assert":
            self.i += 1
            self.expect("(")
            self.expr()
            if self.accept(",") and kinds[self.i] != ")":
                self.expr()
                self.accept(",")
            self.expect(")")
            self.expect(";")
            return None
        if k == "id" and texts[self.i] == "yield" and kinds[self.i + 1] not in ("=", ".", "(", ";", "++", "--"):
            self.i += 1
            self.accept("*")
            self.expr()
            self.expect(";")
            return None
        if self.local_declaration():
            return None
        self.expr()
        self.expect(";")
        return None

    def local_declaration(self) -> bool:
        """A local function, variables or a pattern; False if none begins here."""
        kinds, texts = self.kinds, self.texts
        start = self.i
        at = self.ats[start]
        doc = self.metadata() if kinds[self.i] == "@" else self.docs.get(self.i)
        if kinds[self.i] == "id" and texts[self.i] == "late" and kinds[self.i + 1] in ("final", "var", "id"):
            self.i += 1
        k = kinds[self.i]
        if k == "const" and not (kinds[self.i + 1] == "id" and (kinds[self.i + 2] == "=" or self.skip_type(self.i + 1) > 0 and kinds[self.skip_type(self.i + 1)] == "id")):
            return False
        if k in ("final", "var", "const"):
            self.i += 1
            nk = kinds[self.i]
            if nk in ("(", "[", "{") or nk == "id" and kinds[self.i + 1] in ("(", "<", ".") and k != "const" and self.pattern_declared(self.i):
                j = self.skip_type(self.i) if nk == "(" else -1
                if not (j > 0 and kinds[j] == "id"):
                    self.pattern()
                    self.expect("=")
                    self.expr()
                    self.expect(";")
                    return True
            j = self.skip_type(self.i)
            ty = None
            if j > 0 and kinds[j] == "id":
                if k == "var":
                    self.fail("var with a type")
                ty = self.i
                self.type_()
            self.local_variables(ty)
            return True
        if k not in ("id", "void", "("):
            if self.i != start:
                self.fail("expected a declaration")
            return False
        if k == "id" and texts[self.i] == "await" and self.async_[-1]:
            return False
        j = self.skip_type(self.i)
        if j > 0 and kinds[j] == "id" and kinds[j + 1] in ("=", ";", ",", "(", "<", "in") and not (texts[j] in ("is", "as") and kinds[j] != "id"):
            if kinds[j + 1] in ("(", "<"):
                if kinds[self.i] == "id" and texts[self.i] in ("as",):
                    return False
                self.type_()
                tok = self.name()
                self.function(tok, doc, at, start, None, False, "")
                return True
            if texts[j] == "as" and False:
                return False
            ty = self.i
            self.type_()
            self.local_variables(ty)
            return True
        if k == "id" and kinds[self.i + 1] in ("(", "<"):
            # A local function without a type: name(params) body.
            g = self.i + 1
            if kinds[g] == "<":
                g = self.skip_type_args(g)
            if g > 0 and kinds[g] == "(":
                e = self.skip_group(g)
                if e > 0 and (kinds[e] in ("{", "=>") or kinds[e] == "id" and texts[e] in ("async", "sync") and kinds[e + 1] in ("{", "=>", "*")):
                    tok = self.name()
                    self.function(tok, doc, at, None, None, False, "")
                    return True
        if self.i != start and kinds[start] != "@":
            self.i = start
        return False

    def pattern_declared(self, i: int) -> bool:
        j = self.skip_type(i)
        if j > 0 and self.kinds[j] == "(":
            j = self.skip_group(j)
            return j > 0 and self.kinds[j] == "="
        return False

    def local_variables(self, ty: int | None) -> None:
        name = self.type_name(ty) if ty is not None else None
        while True:
            tok = self.name()
            v = self.i + 1
            if self.accept("="):
                self.expr()
                if name is None and self.kinds[v] == "id" and self.texts[v][:1].isupper() and self.kinds[v + 1] in ("(", "."):
                    name = self.texts[v]
            if name and name[:1].isupper() and self.functions:
                local = self.functions[-1].local
                local[self.texts[tok]] = name if local.get(self.texts[tok], name) == name else None
            if not self.accept(","):
                break
        self.expect(";")

    def paren_expr(self) -> None:
        self.expect("(")
        self.expr()
        self.expect(")")

    def if_condition(self) -> None:
        self.expect("(")
        self.expr()
        if self.accept("case"):
            self.pattern()
            if self.take("when"):
                self.expr()
        self.expect(")")

    def for_header(self) -> None:
        self.expect("(")
        self.for_parts()
        self.expect(")")

    def for_parts(self) -> None:
        kinds = self.kinds
        self.metadata()
        k = kinds[self.i]
        if k in ("final", "var"):
            self.i += 1
            if kinds[self.i] in ("(", "[", "{"):
                self.pattern()
                if self.accept("="):
                    self.expr()
                    return self.for_rest()
                self.expect("in")
                return self.expr()
            j = self.skip_type(self.i)
            if j > 0 and kinds[j] == "id":
                self.type_()
            return self.for_variables()
        j = self.skip_type(self.i)
        if j > 0 and kinds[j] == "id" and kinds[j + 1] in ("=", "in", ";", ","):
            self.type_()
            return self.for_variables()
        if k == "id" and kinds[self.i + 1] == "in":
            self.i += 2
            return self.expr()
        if kinds[self.i] != ";":
            self.exprs()
        return self.for_rest()

    def for_variables(self) -> None:
        self.name()
        if self.accept("in"):
            return self.expr()
        if self.accept("="):
            self.expr()
        while self.accept(","):
            self.name()
            if self.accept("="):
                self.expr()
        return self.for_rest()

    def for_rest(self) -> None:
        self.expect(";")
        if self.kinds[self.i] != ";":
            self.expr()
        self.expect(";")
        if self.kinds[self.i] != ")":
            self.exprs()

    def exprs(self) -> None:
        self.expr()
        while self.accept(","):
            self.expr()

    def switch(self) -> None:
        self.i += 1
        self.paren_expr()
        self.expect("{")
        kinds = self.kinds
        while kinds[self.i] != "}":
            while kinds[self.i] == "id" and kinds[self.i + 1] == ":":
                self.i += 2
            if self.accept("case"):
                self.pattern()
                if self.take("when"):
                    self.expr()
            elif not self.accept("default"):
                self.fail("expected case")
            self.expect(":")
            while kinds[self.i] not in ("case", "default", "}") and not (kinds[self.i] == "id" and kinds[self.i + 1] == ":" and kinds[self.i + 2] in ("case", "default")):
                if kinds[self.i] == "eof":
                    self.fail("unclosed {")
                self.under(CONDITIONAL, self.statement)
        self.i += 1

    # -- patterns ---------------------------------------------------------
    def pattern(self) -> None:
        self.pattern_and()
        while self.accept("||"):
            self.pattern_and()

    def pattern_and(self) -> None:
        self.pattern_unary()
        while self.accept("&&"):
            self.pattern_unary()

    def pattern_unary(self) -> None:
        kinds = self.kinds
        k = kinds[self.i]
        if k in ("==", "!=", "<", ">", "<=", ">=") and not (k == "<" and self.skip_type_args(self.i) > 0):
            self.i += 1
            self.binary(8)
        else:
            self.pattern_primary()
        while True:
            if kinds[self.i] in ("?", "!"):
                self.i += 1
            elif self.take("as"):
                self.type_()
            else:
                return

    def pattern_primary(self) -> None:
        kinds = self.kinds
        k = kinds[self.i]
        if k in ("final", "var"):
            self.i += 1
            j = self.skip_type(self.i)
            if j > 0 and kinds[j] == "id":
                self.type_()
            self.name()
            return
        if k == "<":
            self.type_args()
            k = kinds[self.i]
        if k == "(":
            self.i += 1
            self.pattern_fields(")")
        elif k == "[":
            self.i += 1
            while kinds[self.i] != "]":
                if self.accept("..."):
                    if kinds[self.i] not in (",", "]"):
                        self.pattern()
                else:
                    self.pattern()
                if not self.accept(","):
                    break
            self.expect("]")
        elif k == "{":
            self.i += 1
            while kinds[self.i] != "}":
                if not self.accept("..."):
                    self.binary(3)
                    self.expect(":")
                    self.pattern()
                if not self.accept(","):
                    break
            self.expect("}")
        elif k == "id":
            j = self.skip_type(self.i)
            if j > 0 and kinds[j] == "(" and self.texts[self.i] != "const":
                self.type_()
                self.i += 1
                self.pattern_fields(")")
            elif j > 0 and kinds[j] == "id" and self.texts[j] not in ("when", "as"):
                self.type_()
                self.name()
            else:
                self.binary(14)
        else:
            self.accept("const")
            self.binary(14)

    def pattern_fields(self, end: str) -> None:
        while self.kinds[self.i] != end:
            if self.accept(":"):
                self.pattern()
            else:
                if self.kinds[self.i] == "id" and self.kinds[self.i + 1] == ":":
                    self.i += 2
                self.pattern()
            if not self.accept(","):
                break
        self.expect(end)

    # -- expressions --------------------------------------------------------
    def expr(self) -> None:
        first = self.i
        self.conditional_cascade()
        kinds = self.kinds
        while kinds[self.i] in ("..", "?.."):
            self.i += 1
            self.cascade(first)

    def conditional_cascade(self) -> None:
        """An expression without cascades: throw, assignment, condition."""
        kinds = self.kinds
        if self.accept("throw"):
            return self.expr()
        self.binary(3)
        if kinds[self.i] == "?":
            self.i += 1
            self.under(CONDITIONAL, self.conditional_cascade)
            self.expect(":")
            self.under(CONDITIONAL, self.conditional_cascade)
        elif kinds[self.i] in ASSIGN:
            if kinds[self.i - 1] not in ("id", "]", "this") and not (kinds[self.i - 1] == "new"):
                self.fail("not assignable")
            self.i += 1
            self.conditional_cascade()
        return None

    def cascade(self, first: int) -> None:
        """A link of a cascade on the expression that begins at token ``first``."""
        kinds = self.kinds
        if kinds[self.i] == "[":
            self.i += 1
            self.expr()
            self.expect("]")
        else:
            tok = self.name()
            if kinds[self.i] == "(":
                self.call(f".{self.texts[tok]}", self.ats[tok], True, first)
        self.selectors(first)
        if kinds[self.i] in ASSIGN:
            self.i += 1
            self.conditional_cascade()

    def binary(self, least: int) -> None:
        self.unary()
        kinds = self.kinds
        while True:
            k = kinds[self.i]
            if k == "id" and self.texts[self.i] == "as":
                k = "as"
            p = BINARY.get(k)
            if p is None or p < least:
                break
            self.i += 1
            if k == "is" or k == "as":
                if k == "is":
                    self.accept("!")
                self.type_operand()
            else:
                self.binary(p + 1)

    def type_operand(self) -> None:
        """A type after is or as; a ``?`` that begins a condition stays."""
        kinds = self.kinds
        j = self.skip_type(self.i)
        if j > 0 and kinds[j - 1] == "?" and kinds[j] not in (")", "]", "}", ",", ";", "&&", "||", "eof", "?", "??", ":", "==", "!=", "=>", "."):
            self.type_nonnull()
        else:
            self.type_()

    def type_nonnull(self) -> None:
        if self.kinds[self.i] == "void":
            self.i += 1
            return
        self.name()
        if self.accept("."):
            self.name()
        if self.kinds[self.i] == "<":
            self.type_args()

    def unary(self) -> None:
        kinds = self.kinds
        k = kinds[self.i]
        if k in ("-", "!", "~", "++", "--"):
            self.i += 1
            self.unary()
            return
        if k == "id" and self.texts[self.i] == "await" and (self.async_[-1] and kinds[self.i + 1] not in (".", ";", ")", ",", "=") or kinds[self.i + 1] in ("id", "this", "super", "new", "const", "str", "num")):
            self.i += 1
            before = self.calls_so_far()
            self.unary()
            self.awaited(before)
            return
        first = self.i
        self.primary()
        self.selectors(first)
        if kinds[self.i] in ("++", "--"):
            self.i += 1

    def selectors(self, first: int) -> None:
        kinds = self.kinds
        while True:
            k = kinds[self.i]
            if k == "!":
                if kinds[self.i + 1] == "=" and self.ats[self.i + 1] == self.ats[self.i] + 1:
                    return
                self.i += 1
            elif k in (".", "?."):
                self.i += 1
                if kinds[self.i] in ("new", "class"):
                    self.i += 1
                elif kinds[self.i] == "(" and k == "?.":
                    self.arguments()
                else:
                    tok = self.name()
                    nk = kinds[self.i]
                    if nk == "(" or nk == "<" and (e := self.skip_type_args(self.i)) > 0 and kinds[e] == "(":
                        recv = self.texts[tok - 2] if kinds[tok - 2] in ("id", "this", "super") and kinds[tok - 3] not in (".", "?.") else ""
                        self.call(f"{recv}.{self.texts[tok]}", self.ats[tok], True, first)
            elif k == "[":
                self.i += 1
                self.expr()
                self.expect("]")
            elif k == "?" and kinds[self.i + 1] == "[":
                e = self.skip_group(self.i + 1)
                if e > 0 and kinds[e] == ":":
                    return
                self.i += 2
                self.expr()
                self.expect("]")
            elif k == "(":
                self.arguments()
            elif k == "<":
                e = self.skip_type_args(self.i)
                if e > 0 and kinds[e] in _AFTER_TYPE_ARGS and kinds[self.i - 1] == "id" and (kinds[e] == "(" or kinds[e] != "eof" and self.texts[self.i - 1][:1].isupper()):
                    self.type_args()
                else:
                    return
            else:
                return

    def arguments(self) -> None:
        self.expect("(")
        while self.kinds[self.i] != ")":
            if self.kinds[self.i] == "id" and self.kinds[self.i + 1] == ":":
                self.i += 2
            self.expr()
            if not self.accept(","):
                break
        self.expect(")")

    def lambda_ahead(self) -> bool:
        """At ``(`` or ``<``: whether a function expression begins."""
        j = self.i
        if self.kinds[j] == "<":
            j = self.skip_type_args(j)
            if j < 0 or self.kinds[j] != "(":
                return False
        j = self.skip_group(j)
        if j < 0:
            return False
        return self.kinds[j] in ("=>", "{") or self.kinds[j] == "id" and self.texts[j] in ("async", "sync") and self.kinds[j + 1] in ("=>", "{", "*")

    def primary(self) -> None:
        kinds = self.kinds
        k = kinds[self.i]
        if k == "str":
            self.strings()
        elif k in ("num", "true", "false", "null", "this"):
            self.i += 1
        elif k == "super":
            self.i += 1
            if kinds[self.i] not in (".", "[", "?.") and kinds[self.i] not in BINARY:
                self.fail("super alone")
        elif k == "id":
            tok = self.i
            self.i += 1
            nk = kinds[self.i]
            if nk == "(" or nk == "<" and (e := self.skip_type_args(self.i)) > 0 and kinds[e] == "(":
                self.call(self.texts[tok], self.ats[tok], False)
        elif k == "(":
            if self.lambda_ahead():
                return self.closure()
            self.i += 1
            count, comma, named = 0, False, False
            while kinds[self.i] != ")":
                if kinds[self.i] == "id" and kinds[self.i + 1] == ":":
                    self.i += 2
                    named = True
                self.expr()
                count += 1
                if not self.accept(","):
                    break
                comma = True
            self.expect(")")
        elif k == "[":
            self.i += 1
            self.elements("]")
        elif k == "{":
            self.i += 1
            self.elements("}")
        elif k == "<":
            if self.lambda_ahead():
                self.type_params()
                return self.closure()
            self.type_args()
            if kinds[self.i] not in ("[", "{"):
                self.fail("expected a literal")
            return self.primary()
        elif k in ("const", "new"):
            self.i += 1
            if kinds[self.i] in ("[", "{", "<"):
                return self.primary()
            self.type_nonnull()
            if self.accept("."):
                if not self.accept("new"):
                    self.name()
            self.call(self.texts[self.i - 1], self.ats[self.i - 1], False)
            self.arguments()
        elif k == "switch":
            self.i += 1
            self.paren_expr()
            self.expect("{")
            while kinds[self.i] != "}":
                self.pattern()
                if self.take("when"):
                    self.expr()
                self.expect("=>")
                self.under(CONDITIONAL, self.expr)
                if not self.accept(","):
                    break
            self.expect("}")
        elif k == "#":
            self.i += 1
            if self.texts[self.i] in _OPERATORS:
                self.i += 1
            elif kinds[self.i] == "void":
                self.i += 1
            else:
                self.dotted()
        elif k == "throw":
            self.i += 1
            self.expr()
        elif k == "void":
            self.i += 1
        else:
            self.fail("expected an expression")
        return None

    def closure(self) -> None:
        self.params()
        self.function_body(None, False)

    def strings(self) -> None:
        while self.kinds[self.i] == "str":
            for a, b in self.subs.get(self.i, ()):
                child = DartParser(self.text)
                child.functions, child.flags, child.async_, child.owner = self.functions, self.flags, self.async_, self.owner
                child.lex(a, b)
                if child.unit.errors:
                    self.unit.errors.extend(child.unit.errors)
                    continue
                child.expr()
                if child.kinds[child.i] != "eof":
                    child.fail("expected }")
                self.unit.errors.extend(child.unit.errors)
            self.i += 1

    def elements(self, end: str) -> None:
        open_at = self.ats[self.i - 1]
        while self.kinds[self.i] != end:
            if self.kinds[self.i] == "eof":
                self.fail(f"unclosed {end}", open_at)
            self.element()
            if not self.accept(","):
                break
        self.expect(end)

    def element(self) -> None:
        kinds = self.kinds
        k = kinds[self.i]
        if k in ("...", "...?"):
            self.i += 1
            self.expr()
        elif k == "if":
            self.i += 1
            self.if_condition()
            self.element()
            if self.accept("else"):
                self.element()
        elif k == "for" or k == "id" and self.texts[self.i] == "await" and kinds[self.i + 1] == "for":
            self.i += 1 + (k == "id")
            self.for_header()
            self.under(REPEATED, self.element)
        else:
            self.accept("?")
            self.expr()
            if self.accept(":"):
                self.accept("?")
                self.expr()


def parse(text: str) -> Unit:
    """Parse a Dart file's text (LF line ends)."""
    return DartParser(text).parse()
