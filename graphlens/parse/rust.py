"""Rust 2021: tokens, declarations, statements and expressions."""

from __future__ import annotations

import re

from .base import CONDITIONAL, REPEATED, Item, Parser, SyntaxFailure, Unit

# Fixed values of the language.
KEYWORDS = frozenset(
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return "
    "self Self static struct super trait true type unsafe use where while abstract become box do final macro override priv try typeof "
    "unsized virtual yield".split()
)
RESERVED = frozenset("abstract become box do final macro override priv try typeof unsized virtual yield".split())
_PUNCT = ["<<=", ">>=", "...", "..=", "::", "->", "=>", "==", "!=", "<=", ">=", "&&", "||", "+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<", ">>", "..", *"+-*/%^!&|=<>@.,;:#$?~()[]{}_"]
BINARY = {
    "*": 11, "/": 11, "%": 11, "+": 10, "-": 10, "<<": 9, ">>": 9, "&": 8, "^": 7, "|": 6, "==": 5, "!=": 5, "<": 5, ">": 5, "<=": 5, ">=": 5,
    "&&": 4, "||": 3, "..": 2, "..=": 2, "=": 1, "+=": 1, "-=": 1, "*=": 1, "/=": 1, "%=": 1, "^=": 1, "&=": 1, "|=": 1, "<<=": 1, ">>=": 1,
}
_COMPARE = frozenset(("==", "!=", "<", ">", "<=", ">="))

_ESC = r"\\(?:[nrt\\0'\"]|x[0-7][0-9a-fA-F]|u\{_*(?:[0-9a-fA-F]_*){1,6}\})"
_TOKEN = re.compile(
    r"[ \t\n\x0b\x0c\x85‎‏  ]*(?:"
    r"(?P<id>[^\W\d]\w*+(?![\"'#]))"
    r"|(?P<doc>///(?!/)[^\n]*|//![^\n]*)"
    r"|(?P<line>//[^\n]*)"
    r"|(?P<block>/\*)"
    r"|(?P<raw>(?:b|c)?r(?P<h>#*)\"(?:.*?)\"(?P=h))"
    r"|(?P<str>(?:b|c)?\"(?:[^\"\\]|\\.)*\")"
    rf"|(?P<char>b?'(?:[^'\\\n]|{_ESC})')"
    r"|(?P<life>'(?:r\#)?[^\W\d]\w*)"
    r"|(?P<rawid>r\#[^\W\d]\w*)"
    r"|(?P<name>[^\W\d]\w*)"
    r"|(?P<num>0x[0-9a-fA-F_]+\w*|0o[0-7_]+\w*|0b[01_]+\w*|[0-9][0-9_]*(?:\.(?![.\w])|\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9_]+)?\w*)"
    r"|(?P<p>[()\[\]{},;]|" + "|".join(re.escape(x) for x in sorted(_PUNCT, key=len, reverse=True)) + r")|(?P<end>\Z))",
    re.S,
)
_SPACE = re.compile(r"[ \t\n\x0b\x0c\x85‎‏  ]*")
_NUM = re.compile(r"(?:0x_*[0-9a-fA-F][0-9a-fA-F_]*|0o_*[0-7][0-7_]*|0b_*[01][01_]*|[0-9][0-9_]*)(?:[ui](?:8|16|32|64|128|size)|f32|f64)?|[0-9][0-9_]*(?:\.(?:[0-9][0-9_]*)?)?(?:[eE][+-]?_*[0-9][0-9_]*)?(?:f32|f64)?")
_STR_BAD = re.compile(r"\\(?:[nrt\\0'\"\n]|x[0-9a-fA-F]{2}|u\{_*(?:[0-9a-fA-F]_*){1,6}\})")
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_ITEM_START = frozenset("fn struct enum trait impl mod use const static type extern unsafe async pub union macro_rules".split())
_EXPR_END = frozenset((")", "]", "}", ",", ";", "=>", "eof", "else"))
_EXPR_START = frozenset(("id", "lit", "life", "(", "[", "{", "<", "<<", "-", "*", "!", "&", "&&", "|", "||", "::", "..", "..=", "_", "#", *"if match while loop for unsafe return break continue async move self Self super crate true false const static let".split()))


def _doc_text(raw: str) -> str:
    """A documentation comment without its marks."""
    if raw.startswith("/*"):
        body = raw[3:-2]
        return "\n".join(re.sub(r"^\s*\*(?!/) ?", "", x) if n else x.strip() for n, x in enumerate(body.split("\n"))).strip("\n")
    return raw[3:][1:] if raw[3:4] == " " else raw[3:]


# Traits whose bound says nothing about a value's own methods.
MARKERS = frozenset("Send Sync Sized Unpin Clone Copy Debug Default Eq PartialEq Ord PartialOrd Hash Display".split())


class RustParser(Parser):
    """One file; ``parse`` gives its ``Unit``."""

    def __init__(self, text: str):
        super().__init__(text)
        self.docs: dict[int, str] = {}
        self.scope: list[str] = []
        self.bound: dict[str, str] = {}  # generic parameters in scope and the trait that each is bound by
        self.owner: list[str] = []

    # -- tokens ---------------------------------------------------------
    def lex(self) -> None:
        text, n, at = self.text, len(self.text), 0
        kinds, texts, ats = self.kinds, self.texts, self.ats
        if text.startswith("#!") and not re.match(r"#!\s*\[", text):
            at = text.find("\n") if "\n" in text else n
        match = _TOKEN.match
        while at < n:
            m = match(text, at)
            if not m:
                at = _SPACE.match(text, at).end()
                c = text[at]
                self.unit.errors.append((at, f"unterminated {'string' if c == chr(34) else 'literal'}" if c in "\"'" else f"unknown character {c!r}"))
                if c == '"':
                    break
                at += 1
                continue
            g = m.lastgroup
            if g == "h":
                g = "raw"
            at, end = m.span(g)
            if g == "line":
                at = end
                continue
            if g == "end":
                break
            word = text[at:end]
            if g == "id":
                kinds.append("_" if word == "_" else word if word in KEYWORDS else "id")
            elif g == "name":
                kinds.append("_" if word == "_" else word if word in KEYWORDS else "id")
                nxt = text[end : end + 1]
                if (nxt == '"' or nxt == "'" and text[end + 2 : end + 3] == "'" or nxt == "#" and re.match(r"#+\"", text[end : end + 8])) and word != "_":
                    self.unit.errors.append((at, f"unknown literal prefix {word}"))
            elif g == "p":
                kinds.append(word)
            elif g == "block":
                depth, j = 1, end
                while depth:
                    k = re.compile(r"/\*|\*/").search(text, j)
                    if not k:
                        self.unit.errors.append((at, "unterminated block comment"))
                        j = n
                        break
                    depth += 1 if k[0] == "/*" else -1
                    j = k.end()
                word, at0, at = text[at:j], at, j
                if (word.startswith("/**") and not word.startswith("/***") and word != "/**/") or word.startswith("/*!"):
                    kinds.append("idoc" if word[2] == "!" else "doc")
                    texts.append(word)
                    ats.append(at0)
                continue
            elif g == "doc":
                kinds.append("idoc" if word[2] == "!" else "doc")
            elif g == "rawid":
                kinds.append("id")
                word = word[2:]
            elif g == "num":
                kinds.append("lit")
                if not _NUM.fullmatch(word):
                    self.unit.errors.append((at, f"bad number {word}"))
            elif g == "life":
                kinds.append("life")
            else:
                kinds.append("lit")
                if g == "str" and "\\" in word:
                    for e in re.finditer(r"\\.", word, re.S):
                        if not _STR_BAD.match(word, e.start()):
                            self.unit.errors.append((at + e.start(), "unknown escape"))
                            break
            texts.append(word)
            ats.append(at)
            at = end
        kinds.append("eof")
        texts.append("")
        ats.append(n)
        kinds.append("eof")
        texts.append("")
        ats.append(n)

    def split(self, first: str) -> None:
        """Let a token that begins with ``first`` be taken apart."""
        t = self.texts[self.i]
        self.kinds[self.i : self.i + 1] = [first, t[len(first) :]]
        self.texts[self.i : self.i + 1] = [first, t[len(first) :]]
        self.ats[self.i : self.i + 1] = [self.ats[self.i], self.ats[self.i] + len(first)]

    def closing_angle(self) -> None:
        k = self.kinds[self.i]
        if k != ">" and k[:1] == ">" and len(k) > 1:
            self.split(">")
        self.expect(">")

    def angle_ahead(self) -> bool:
        if self.kinds[self.i] == "<<":
            self.split("<")
        return self.kinds[self.i] == "<"

    # -- recovery -------------------------------------------------------
    def balanced(self) -> None:
        """Skip one token tree."""
        k = self.kinds[self.i]
        if k in _CLOSE:
            stack = [_CLOSE[k]]
            at = self.ats[self.i]
            self.i += 1
            while stack:
                k = self.kinds[self.i]
                if k == "eof":
                    self.fail("unclosed delimiter", at)
                if k in _CLOSE:
                    stack.append(_CLOSE[k])
                elif k in (")", "]", "}"):
                    if stack.pop() != k:
                        self.fail("mismatched delimiter")
                self.i += 1
        elif k in (")", "]", "}", "eof"):
            self.fail("expected a token")
        else:
            self.i += 1

    def resync(self, start: int, inside: bool) -> None:
        """Panic mode: skip to where an item or statement can begin."""
        if self.i == start:
            self.i += self.kinds[self.i] not in ("eof",) and not (inside and self.kinds[self.i] == "}")
        while (k := self.kinds[self.i]) != "eof":
            if k == ";":
                self.i += 1
                return
            if k == "}":
                if not inside:
                    self.i += 1
                return
            if k in _ITEM_START and "\n" in self.text[self.ats[self.i - 1] : self.ats[self.i]]:
                return
            if k in _CLOSE:
                try:
                    self.balanced()
                except SyntaxFailure:
                    return
                if k == "{":
                    return
            else:
                self.i += 1

    # -- items ----------------------------------------------------------
    def parse(self) -> Unit:
        self.lex()
        self.inner_attributes()
        while self.kinds[self.i] != "eof":
            start = self.i
            try:
                self.item("file")
            except SyntaxFailure as e:
                self.note(e)
                self.resync(start, False)
            except RecursionError:
                self.unit.errors.append((self.ats[self.i], "nested too deeply"))
                break
        return self.unit

    def inner_attributes(self) -> list[str]:
        docs = []
        while True:
            if self.kinds[self.i] == "idoc":
                docs.append(_doc_text(self.texts[self.i]))
                self.i += 1
            elif self.kinds[self.i] == "#" and self.kinds[self.i + 1] == "!":
                self.i += 2
                self.attribute_body()
            else:
                return docs

    def attribute_body(self) -> str | None:
        """``[path ...]``; the text of a ``doc = "..."``."""
        if self.kinds[self.i] != "[":
            self.fail("expected [")
        at = self.i
        self.balanced()
        t = self.texts[at + 1 : self.i - 1]
        if not t:
            self.fail("empty attribute")
        if len(t) == 3 and t[0] == "doc" and t[1] == "=":
            x = t[2]
            return re.sub(r"^r?(#*)\"|\"#*$", "", x)
        return None

    def outer_attributes(self) -> list[str]:
        docs = []
        kinds = self.kinds
        while True:
            k = kinds[self.i]
            if k == "doc":
                docs.append(_doc_text(self.texts[self.i]))
                self.i += 1
            elif k == "#" and kinds[self.i + 1] != "!":
                self.i += 1
                if (d := self.attribute_body()) is not None:
                    docs.append(d)
            elif k == "idoc" or k == "#":
                self.fail("inner attribute in the wrong place")
            else:
                return docs

    def visibility(self) -> bool:
        if self.kinds[self.i] == "crate" and self.kinds[self.i + 1] not in ("::",):
            return False
        if not self.accept("pub"):
            return False
        if self.kinds[self.i] == "(" and (self.kinds[self.i + 1] in ("crate", "self", "super") and self.kinds[self.i + 2] == ")" or self.kinds[self.i + 1] == "in"):
            self.i += 1
            if self.accept("in"):
                self.simple_path()
            else:
                self.i += 1
            self.expect(")")
        return True

    def simple_path(self) -> str:
        parts = []
        if self.accept("::"):
            parts.append("")
        while True:
            if self.kinds[self.i] not in ("id", "self", "super", "crate", "Self"):
                self.fail("expected a path")
            parts.append(self.texts[self.i])
            self.i += 1
            if not self.accept("::"):
                return "::".join(parts)

    def item(self, where: str) -> None:
        """One declaration; ``where``: file, impl, trait, extern or block."""
        start = self.i
        docs = self.outer_attributes()
        if self.kinds[self.i] in ("eof", "}"):
            self.fail("expected an item")
        at = self.ats[self.i]
        pub = self.visibility()
        k, nxt = self.kinds[self.i], self.kinds[self.i + 1]
        doc = "\n".join(docs) if docs else None
        if k == "id" and self.texts[self.i] in ("default", "safe") and nxt in ("fn", "const", "type", "unsafe", "async", "impl", "extern", "static"):
            self.i += 1
            k, nxt = self.kinds[self.i], self.kinds[self.i + 1]
        if k in ("fn", "async", "unsafe", "extern", "const"):
            j = self.i
            while self.kinds[j] in ("const", "async", "unsafe", "extern", "lit") and not (self.kinds[j] == "lit" and self.kinds[j - 1] != "extern"):
                j += 1
            if self.kinds[j] == "fn":
                mods = self.kinds[self.i : j]
                rank = [("const", "async", "unsafe", "extern").index(x) for x in mods if x != "lit"]
                if rank != sorted(set(rank)):
                    self.fail("qualifiers in the wrong order")
                self.i = j
                return self.function(doc, at, where)
        if k == "unsafe" and nxt in ("trait", "impl", "extern", "mod", "id"):
            self.i += 1
            k, nxt = self.kinds[self.i], self.kinds[self.i + 1]
        text = self.texts[self.i]
        if where in ("impl", "trait", "extern") and k not in ("const", "type", "static") and not (k in ("id", "self", "super", "crate", "::")):
            self.fail("expected an associated item")
        if k == "struct" or (k == "id" and text == "union" and nxt == "id"):
            return self.struct("struct" if k == "struct" else "union", doc, at)
        if k == "enum":
            return self.enum(doc, at)
        if k == "trait" or (k == "id" and text == "auto" and nxt == "trait"):
            return self.trait(doc, at)
        if k == "impl":
            return self.impl(doc, at)
        if k == "mod":
            return self.module(doc, at)
        if k == "use":
            self.i += 1
            before = len(self.unit.imports)
            self.use_tree("", pub)
            if where != "file" or self.scope:
                self.unit.inner_imports.update(range(before, len(self.unit.imports)))
            self.expect(";")
            return None
        if k == "const" or k == "static":
            self.i += 1
            self.accept("mut")
            name_at = self.i
            if not (k == "const" and self.accept("_")):
                self.expect("id")
            self.record(k, self.texts[name_at], name_at, at, doc)
            if self.angle_ahead():
                self.generics()
            if self.accept(":"):
                self.type_()
            elif where != "impl":
                self.fail("expected :")
            if self.accept("="):
                self.expr()
            elif where not in ("trait", "extern", "impl"):
                self.fail("expected =")
            self.expect(";")
            return None
        if k == "type":
            self.i += 1
            name_at = self.expect("id")
            self.record("type_alias", self.texts[name_at], name_at, at, doc)
            if self.angle_ahead():
                self.generics()
            if self.accept(":"):
                self.bounds()
            self.where_()
            if self.accept("="):
                self.type_()
                self.where_()
            elif where == "file":
                self.fail("expected =")
            self.expect(";")
            return None
        if k == "extern":
            if nxt == "crate":
                self.i += 2
                if self.kinds[self.i] not in ("id", "self"):
                    self.fail("expected a crate")
                self.i += 1
                if self.accept("as"):
                    if not self.accept("_"):
                        self.expect("id")
                self.expect(";")
                return None
            self.i += 1
            self.accept("lit")
            return self.members("extern")
        if k == "id" and text == "macro_rules" and nxt == "!":
            self.i += 2
            name_at = self.expect("id")
            self.record("macro", self.texts[name_at], name_at, at, doc)
            brace = self.kinds[self.i] == "{"
            if self.kinds[self.i] not in _CLOSE:
                self.fail("expected macro rules")
            self.balanced()
            if not brace:
                self.expect(";")
            return None
        if k in ("id", "self", "super", "crate", "::") and not pub:
            j = self.i
            self.simple_path()
            if self.kinds[self.i] == "!" and self.kinds[self.i + 1] in _CLOSE:
                self.i += 1
                brace = self.kinds[self.i] == "{"
                self.balanced()
                if not brace:
                    self.expect(";")
                return None
            self.i = j
        self.fail("expected an item")

    def record(self, kind: str, name: str, tok: int, start: int, doc: str | None) -> Item:
        it = Item(kind, name, self.ats[tok], start, doc=doc, scope="::".join(self.scope), inner=bool(self.functions))
        it.parent = self.owner[-1] if self.owner and kind in ("function",) else None
        self.unit.items.append(it)
        return it

    def function(self, doc: str | None, start: int, where: str) -> None:
        self.expect("fn")
        name = self.expect("id")
        it = self.record("function", self.texts[name], name, start, doc)
        it.is_method = where in ("impl", "trait")
        if where not in ("impl", "trait"):
            it.parent = None
        outer = self.bound
        own = self.bound = dict(outer) if where in ("impl", "trait") else {}
        try:
            self.rest_of_function(it, doc, where)
        finally:
            self.apply_bounds(own, it.local)
            self.bound = outer

    @staticmethod
    def apply_bounds(bound: dict[str, str], types: dict[str, str | None]) -> None:
        """A name typed by a generic parameter has the methods of the parameter's trait."""
        if bound:
            for name, ty in types.items():
                types[name] = bound.get(ty, ty)

    def rest_of_function(self, it: Item, doc: str | None, where: str) -> None:
        if self.angle_ahead():
            self.generics()
        self.expect("(")
        params = []
        first = True
        while self.kinds[self.i] != ")":
            self.outer_attributes()
            if first and where in ("impl", "trait") and self.self_param():
                params.append("self")
            elif self.accept("..."):
                pass
            elif where == "trait" and False:
                pass
            else:
                a = self.i
                self.pattern_no_alt()
                if self.kinds[self.i - 1] == "id":
                    params.append(self.texts[self.i - 1])
                self.expect(":")
                if not self.accept("..."):
                    ty = self.i
                    self.type_()
                    if self.i - 1 >= a and self.kinds[a] in ("id", "mut"):
                        local = self.texts[a + (self.kinds[a] == "mut")]
                        it.local[local] = self.type_name(ty)
                        it.held[local] = self.held_name(ty)
                        it.types.extend(self.type_idents(ty, self.i))
            first = False
            if not self.accept(","):
                break
        self.expect(")")
        it.params = tuple(params)
        if self.accept("->"):
            ty = self.i
            self.type_()
            it.types.extend(self.type_idents(ty, self.i))
        self.where_()
        it.body = self.ats[self.i]
        if self.kinds[self.i] == "{":
            self.enter(it)
            owner, self.owner = self.owner, self.owner
            try:
                inner = self.block(True)
                if inner:
                    it.doc = "\n".join(([doc] if doc else []) + inner)
            finally:
                self.leave()
                self.owner = owner
            if where == "extern":
                self.fail("function with a body in an extern block")
        else:
            if where in ("file", "block", "impl"):
                self.fail("expected a body")
            self.expect(";")
        it.end = self.ats[self.i - 1] + len(self.texts[self.i - 1])

    def self_param(self) -> bool:
        j = self.i
        kinds = self.kinds
        if kinds[j] == "&":
            j += 1
            if kinds[j] == "life":
                j += 1
        if kinds[j] == "mut":
            j += 1
        if kinds[j] != "self" or kinds[j + 1] == "::":
            return False
        self.i = j + 1
        if self.accept(":"):
            self.type_()
        return True

    def type_name(self, i: int) -> str | None:
        """The plain name of a type that starts at token ``i``."""
        k = self.kinds
        while k[i] in ("&", "&&", "life", "mut", "dyn", "impl"):
            i += 1
        if k[i] not in ("id", "Self"):
            return None
        name = self.texts[i]
        while k[i + 1] == "::" and k[i + 2] == "id":
            i += 2
            name += "::" + self.texts[i]
        if name in ("Arc", "Rc", "Box") and k[i + 1] == "<":
            return self.type_name(i + 2)
        return name

    def held_name(self, i: int) -> str | None:
        """The plain name of what an ``Option`` or ``Result`` that starts at token ``i`` holds."""
        while self.kinds[i] in ("&", "&&", "life", "mut"):
            i += 1
        return self.type_name(i + 2) if self.texts[i] in ("Option", "Result") and self.kinds[i + 1] == "<" else None

    def unwrapped(self, pat: int, value: int) -> None:
        """Type the name of ``Some(name) = value`` or ``Ok(name) = value``; both begin at the tokens given."""
        kinds, texts = self.kinds, self.texts
        if texts[pat] not in ("Some", "Ok") or kinds[pat + 1] != "(" or not self.functions:
            return
        at = pat + 2 + (kinds[pat + 2] == "mut")
        if kinds[at] != "id" or kinds[at + 1] != ")":
            return
        it = self.functions[-1]
        while kinds[value] in ("&", "mut"):
            value += 1
        alone = kinds[value] == "id" and kinds[value + 1] not in (".", "(", "::", "[", "?", "!")
        ty = it.held.get(texts[value]) if alone else self.constructed(value) if kinds[value] in ("id", "Self") else None
        if ty:
            it.local[texts[at]] = ty if it.local.get(texts[at], ty) == ty else None

    def type_idents(self, a: int, b: int) -> list[str]:
        out, j = [], a
        while j < b:
            if self.kinds[j] == "id":
                name = self.texts[j]
                while j + 2 < b and self.kinds[j + 1] == "::" and self.kinds[j + 2] == "id":
                    j += 2
                    name += "::" + self.texts[j]
                if name.rsplit("::", 1)[-1][:1].isupper():
                    out.append(name)
            j += 1
        return out

    def struct(self, kind: str, doc, at) -> None:
        self.i += 1
        name = self.expect("id")
        it = self.record(kind, self.texts[name], name, at, doc)
        self.bound = {}
        if self.angle_ahead():
            self.generics()
        self.where_()
        if self.kinds[self.i] == "{":
            self.fields(it)
            self.apply_bounds(self.bound, self.unit.fields.get(it.name, {}))
        elif self.kinds[self.i] == "(" and kind == "struct":
            self.tuple_fields(it)
            self.where_()
            self.expect(";")
        else:
            self.expect(";")
        it.end = self.ats[self.i - 1] + 1

    def fields(self, it: Item) -> None:
        self.expect("{")
        while self.kinds[self.i] != "}":
            self.outer_attributes()
            self.visibility()
            f = self.expect("id")
            self.expect(":")
            t = self.i
            self.type_()
            it.types.extend(self.type_idents(t, self.i))
            if n := self.type_name(t):
                self.unit.fields.setdefault(it.name, {})[self.texts[f]] = n
            if not self.accept(","):
                break
        self.expect("}")

    def tuple_fields(self, it: Item) -> None:
        self.expect("(")
        while self.kinds[self.i] != ")":
            self.outer_attributes()
            self.visibility()
            t = self.i
            self.type_()
            it.types.extend(self.type_idents(t, self.i))
            if not self.accept(","):
                break
        self.expect(")")

    def enum(self, doc, at) -> None:
        self.i += 1
        name = self.expect("id")
        it = self.record("enum", self.texts[name], name, at, doc)
        if self.angle_ahead():
            self.generics()
        self.where_()
        self.expect("{")
        while self.kinds[self.i] != "}":
            self.outer_attributes()
            self.visibility()
            self.expect("id")
            if self.kinds[self.i] == "{":
                self.fields(it)
            elif self.kinds[self.i] == "(":
                self.tuple_fields(it)
            if self.accept("="):
                self.expr()
            if not self.accept(","):
                break
        self.expect("}")
        it.end = self.ats[self.i - 1] + 1

    def trait(self, doc, at) -> None:
        if self.kinds[self.i] == "id":
            self.i += 1
        self.i += 1
        name = self.expect("id")
        it = self.record("trait", self.texts[name], name, at, doc)
        self.bound = {}
        if self.angle_ahead():
            self.generics()
        if self.accept(":"):
            b = self.i
            self.bounds()
            it.bases = tuple(self.type_idents(b, self.i))
        self.where_()
        self.owner.append(it.name)
        try:
            self.members("trait")
        finally:
            self.owner.pop()
        it.end = self.ats[self.i - 1] + 1

    def impl(self, doc, at) -> None:
        self.i += 1
        self.bound = {}
        if self.kinds[self.i] == "<" and (self.kinds[self.i + 1] in ("life", "id", ">", "const", "#")):
            self.generics()
        self.accept("const")
        self.accept("!")
        first = self.i
        self.type_()
        name, trait = self.text[self.ats[first] : self.ats[self.i - 1] + len(self.texts[self.i - 1])], None
        target = self.type_name(first)
        tok = first
        if self.accept("for"):
            trait = self.type_name(first)
            second = self.i
            self.type_()
            target = self.type_name(second)
            name += " for " + self.text[self.ats[second] : self.ats[self.i - 1] + len(self.texts[self.i - 1])]
        self.where_()
        it = self.record("impl", " ".join(name.split()), tok, at, doc)
        it.bases = (trait,) if trait else ()
        it.params = (target or "",)
        self.owner.append(it.name)
        try:
            self.members("impl")
        finally:
            self.owner.pop()
        it.end = self.ats[self.i - 1] + 1

    def members(self, where: str) -> None:
        open_at = self.ats[self.i]
        self.expect("{")
        self.inner_attributes()
        while self.kinds[self.i] != "}":
            if self.kinds[self.i] == "eof":
                self.fail("unclosed {", open_at)
            start = self.i
            try:
                self.item(where)
            except SyntaxFailure as e:
                self.note(e)
                self.resync(start, True)
        self.i += 1

    def module(self, doc, at) -> None:
        self.i += 1
        name = self.expect("id")
        if self.accept(";"):
            return
        self.scope.append(self.texts[name])
        owner, self.owner = self.owner, []
        try:
            self.expect("{")
            self.inner_attributes()
            while self.kinds[self.i] != "}":
                if self.kinds[self.i] == "eof":
                    self.fail("unclosed {")
                start = self.i
                try:
                    self.item("file")
                except SyntaxFailure as e:
                    self.note(e)
                    self.resync(start, True)
            self.i += 1
        finally:
            self.scope.pop()
            self.owner = owner

    def use_tree(self, prefix: str, pub: bool) -> None:
        path = prefix
        if self.accept("::"):
            pass
        while True:
            k = self.kinds[self.i]
            if k == "{":
                self.i += 1
                while self.kinds[self.i] != "}":
                    self.use_tree(path, pub)
                    if not self.accept(","):
                        break
                self.expect("}")
                return
            if k == "*":
                self.i += 1
                self.unit.imports.append(("", path, True, pub))
                return
            if k not in ("id", "self", "super", "crate", "Self"):
                self.fail("expected a path")
            name = self.texts[self.i]
            self.i += 1
            if name == "self" and path:
                local = path.rsplit("::", 1)[-1]
            else:
                path = f"{path}::{name}" if path else name
                local = name
            if self.accept("as"):
                local = self.texts[self.i]
                if not self.accept("_"):
                    self.expect("id")
            if not self.accept("::"):
                self.unit.imports.append((local, path, False, pub))
                return

    # -- types ----------------------------------------------------------
    def generics(self) -> None:
        self.expect("<")
        while self.kinds[self.i] != ">" and not self.kinds[self.i].startswith(">"):
            self.outer_attributes()
            if self.accept("life"):
                if self.accept(":"):
                    while self.accept("life"):
                        if not self.accept("+"):
                            break
            elif self.accept("const"):
                self.expect("id")
                self.expect(":")
                self.type_()
                if self.accept("="):
                    if self.kinds[self.i] == "{":
                        self.block()
                    else:
                        self.accept("-")
                        self.i += 1
            else:
                name = self.texts[self.expect("id")]
                if self.accept(":"):
                    self.bind(name, self.bounds())
                if self.accept("="):
                    self.type_()
            if not self.accept(","):
                break
        self.closing_angle()

    def bind(self, name: str, trait: str | None) -> None:
        """A parameter keeps its first bound that has methods of its own."""
        if trait:
            self.bound.setdefault(name, trait)

    def bounds(self) -> str | None:
        """The first bound that is no marker."""
        found = None
        while self.kinds[self.i] in ("id", "life", "?", "(", "for", "::", "<", "self", "super", "crate", "Self", "~", "async", "const", "use", "!"):
            if self.accept("life"):
                pass
            elif self.kinds[self.i] == "use":
                self.i += 1
                self.generic_args()
            else:
                paren = self.accept("(")
                self.accept("?")
                if self.accept("for"):
                    self.generics()
                self.accept("async")
                at = self.i
                self.path_type()
                if found is None and (name := self.type_name(at)) and name.rsplit("::", 1)[-1] not in MARKERS:
                    found = name
                if paren:
                    self.expect(")")
            if not self.accept("+"):
                break
            if self.kinds[self.i] == "+":
                self.fail("expected a bound")
        return found

    def where_(self) -> None:
        if not self.accept("where"):
            return
        while self.kinds[self.i] not in ("{", ";", "=", "eof"):
            if self.accept("life"):
                self.expect(":")
                while self.accept("life"):
                    if not self.accept("+"):
                        break
            else:
                if self.accept("for"):
                    self.generics()
                at = self.i
                self.type_()
                name = self.texts[at] if self.i == at + 1 else ""
                self.expect(":")
                self.bind(name, self.bounds())
            if not self.accept(","):
                break

    def type_(self, plus: bool = True) -> None:
        k = self.kinds[self.i]
        if k == "&&":
            self.split("&")
            k = "&"
        if k == "&":
            self.i += 1
            self.accept("life")
            self.accept("mut")
            self.type_(False)
        elif k == "*":
            self.i += 1
            if self.kinds[self.i] not in ("const", "mut"):
                self.fail("expected const or mut")
            self.i += 1
            self.type_(False)
        elif k == "(":
            self.i += 1
            while self.kinds[self.i] != ")":
                self.type_()
                if not self.accept(","):
                    break
            self.expect(")")
        elif k == "[":
            self.i += 1
            self.type_()
            if self.accept(";"):
                self.expr()
            self.expect("]")
        elif k in ("!", "_"):
            self.i += 1
        elif k in ("impl", "dyn"):
            self.i += 1
            self.bounds()
        elif k in ("fn", "unsafe", "extern", "for", "async"):
            if self.accept("for"):
                self.generics()
            if self.kinds[self.i] in ("fn", "unsafe", "extern", "async"):
                self.accept("async")
                self.accept("unsafe")
                if self.accept("extern"):
                    self.accept("lit")
                self.expect("fn")
                self.expect("(")
                while self.kinds[self.i] != ")":
                    self.outer_attributes()
                    if self.accept("..."):
                        break
                    if self.kinds[self.i] in ("id", "_") and self.kinds[self.i + 1] == ":":
                        self.i += 2
                    self.type_()
                    if not self.accept(","):
                        break
                self.expect(")")
                if self.accept("->"):
                    self.type_(False)
            else:
                self.path_type()
        elif k in ("id", "::", "<", "<<", "self", "super", "crate", "Self"):
            self.path_type()
            if self.kinds[self.i] == "!" and self.kinds[self.i + 1] in _CLOSE:
                self.i += 1
                self.balanced()
            elif plus and self.kinds[self.i] == "+" and self.kinds[self.i + 1] in ("life", "id", "?"):
                self.i += 1
                self.bounds()
        elif k == "life":
            self.bounds()
        else:
            self.fail("expected a type")

    def path_type(self) -> None:
        if self.angle_ahead():
            self.qualified()
            self.expect("::")
        else:
            self.accept("::")
        while True:
            if self.kinds[self.i] not in ("id", "self", "super", "crate", "Self"):
                self.fail("expected a type path")
            self.i += 1
            if self.kinds[self.i] == "::" and self.kinds[self.i + 1] in ("<", "<<", "("):
                self.i += 1
            if self.angle_ahead():
                self.generic_args()
            elif self.kinds[self.i] == "(":
                self.i += 1
                while self.kinds[self.i] != ")":
                    self.type_()
                    if not self.accept(","):
                        break
                self.expect(")")
                if self.accept("->"):
                    self.type_(False)
            if self.kinds[self.i] == "::" and self.kinds[self.i + 1] in ("id", "self", "super", "crate", "Self"):
                self.i += 1
                continue
            return

    def qualified(self) -> None:
        self.expect("<")
        self.type_()
        if self.accept("as"):
            self.path_type()
        self.closing_angle()

    def generic_args(self) -> None:
        self.expect("<")
        while not self.kinds[self.i].startswith(">"):
            k = self.kinds[self.i]
            if k == "life":
                self.i += 1
            elif k == "lit":
                self.i += 1
            elif k == "-":
                self.i += 1
                self.expect("lit")
            elif k == "{":
                self.block()
            elif k in ("true", "false"):
                self.i += 1
            else:
                self.type_()
                if self.accept("="):
                    if self.kinds[self.i] in ("lit", "{"):
                        self.expr_prefix(False)
                    else:
                        self.type_()
                elif self.accept(":"):
                    self.bounds()
            if not self.accept(","):
                break
        self.closing_angle()

    # -- patterns -------------------------------------------------------
    def pattern(self) -> None:
        self.accept("|")
        self.pattern_no_alt()
        while self.accept("|"):
            self.pattern_no_alt()

    def pattern_no_alt(self) -> None:
        k = self.kinds[self.i]
        if k == "&&":
            self.split("&")
            k = "&"
        if k == "_":
            self.i += 1
        elif k == "..":
            self.i += 1
            if self.kinds[self.i] == "lit":
                self.i += 1
        elif k == "..=":
            self.i += 1
            self.pattern_bound()
        elif k in ("lit", "-", "true", "false"):
            self.pattern_bound()
            self.range_rest()
        elif k == "&":
            self.i += 1
            self.accept("mut")
            self.pattern_no_alt()
        elif k in ("ref", "mut"):
            self.i += 1
            if k == "ref":
                self.accept("mut")
            if not self.accept("self"):
                self.expect("id")
            if self.accept("@"):
                self.pattern_no_alt()
        elif k == "(":
            self.i += 1
            self.pattern_list(")")
        elif k == "[":
            self.i += 1
            self.pattern_list("]")
        elif k == "const":
            self.i += 1
            self.block()
        elif k == "box":
            self.fail("reserved word")
        elif k in ("id", "self", "super", "crate", "Self", "::", "<"):
            simple = k == "id"
            if k == "id" and self.kinds[self.i + 1] == "@":
                self.i += 2
                self.pattern_no_alt()
            else:
                at = self.i
                self.expr_path()
                simple = simple and self.i == at + 1
                nk = self.kinds[self.i]
                if nk == "!" and self.kinds[self.i + 1] in _CLOSE:
                    self.i += 1
                    self.balanced()
                elif nk == "(":
                    self.i += 1
                    self.pattern_list(")")
                elif nk == "{":
                    self.i += 1
                    while self.kinds[self.i] != "}":
                        self.outer_attributes()
                        if self.accept(".."):
                            break
                        if self.kinds[self.i] in ("id", "lit") and self.kinds[self.i + 1] == ":":
                            self.i += 2
                            self.pattern()
                        else:
                            self.accept("ref")
                            self.accept("mut")
                            self.expect("id")
                        if not self.accept(","):
                            break
                    self.expect("}")
                else:
                    self.range_rest()
        else:
            self.fail("expected a pattern")

    def pattern_list(self, end: str) -> None:
        while self.kinds[self.i] != end:
            self.outer_attributes()
            self.pattern()
            if not self.accept(","):
                break
        self.expect(end)

    def pattern_bound(self) -> None:
        if self.accept("-"):
            self.expect("lit")
        elif self.kinds[self.i] in ("lit", "true", "false"):
            self.i += 1
        else:
            self.expr_path()

    def range_rest(self) -> None:
        if self.kinds[self.i] in ("..=", "...", ".."):
            self.i += 1
            if self.kinds[self.i] in ("lit", "-", "id", "self", "Self", "super", "crate", "::", "<"):
                self.pattern_bound()

    # -- statements -----------------------------------------------------
    def block(self, is_fn: bool = False) -> list[str]:
        """``{ ... }``; the inner documentation of a function's body."""
        open_at = self.ats[self.i]
        self.expect("{")
        inner = self.inner_attributes()
        kinds = self.kinds
        while kinds[self.i] != "}":
            if kinds[self.i] == "eof":
                self.fail("unclosed {", open_at)
            start = self.i
            try:
                self.statement()
            except SyntaxFailure as e:
                self.note(e)
                self.resync(start, True)
        self.i += 1
        return inner

    def statement(self) -> None:
        kinds = self.kinds
        k = kinds[self.i]
        if k == ";":
            self.i += 1
            return
        start = self.i
        if k in ("doc", "#", "idoc"):
            self.outer_attributes()
            k = kinds[self.i]
            if k == "}":
                self.fail("expected a statement after an attribute")
        nxt = kinds[self.i + 1]
        if k == "let":
            self.i += 1
            pat = self.i
            self.pattern()
            name = self.texts[pat + (kinds[pat] == "mut")] if kinds[pat] in ("id", "mut") else None
            ty = None
            if self.accept(":"):
                t = self.i
                self.type_()
                ty = self.type_name(t)
                if name and self.functions:
                    self.functions[-1].held[name] = self.held_name(t)
            if self.accept("="):
                v = self.i
                self.expr()
                self.unwrapped(pat, v)
                if ty is None and kinds[v] in ("id", "Self"):
                    ty = self.constructed(v)
                if kinds[self.i] == "else":
                    if kinds[self.i - 1] == "}":
                        self.fail("block before let-else")
                    self.i += 1
                    self.under(CONDITIONAL, self.block)
            if name and ty and self.functions:
                local = self.functions[-1].local
                local[name] = ty if local.get(name, ty) == ty else None
            self.expect(";")
            return
        text = self.texts[self.i]
        if (
            k in ("fn", "struct", "enum", "trait", "impl", "mod", "use", "pub", "type", "static")
            and not (k == "static" and nxt in ("||", "|", "move"))
            or k == "const" and nxt not in ("{", "||", "|", "move", "async")
            or k == "extern"
            or k == "unsafe" and nxt in ("fn", "impl", "trait", "extern")
            or k == "async" and nxt in ("fn", "unsafe")
            or k == "const" and nxt == "async" and kinds[self.i + 2] in ("fn", "unsafe")
            or k == "id" and (text == "macro_rules" and nxt == "!" or text == "union" and nxt == "id")
        ):
            self.i = start
            owner, self.owner = self.owner, []
            try:
                self.item("block")
            finally:
                self.owner = owner
            return
        if k in ("id", "self", "super", "crate", "::") and self.macro_ahead():
            pass
        before = self.i
        block_like = self.expr_statement()
        if kinds[self.i] == ";":
            self.i += 1
        elif kinds[self.i] != "}" and not block_like:
            if self.i == before:
                self.fail("expected a statement")
            self.fail("expected ; or }")

    def macro_ahead(self) -> bool:
        return False

    def constructed(self, i: int) -> str | None:
        """The type that ``T::f(..)`` or ``T { .. }`` at token ``i`` makes."""
        parts = [self.texts[i]]
        while self.kinds[i + 1] == "::" and self.kinds[i + 2] == "id":
            i += 2
            parts.append(self.texts[i])
        nxt = self.kinds[i + 1]
        if nxt == "{":
            return "::".join(parts)
        if nxt == "(" and len(parts) > 1 and parts[-2][:1].isupper():
            return "::".join(parts[:-1])
        return None

    def expr_statement(self) -> bool:
        """An expression as a statement; whether it ends by its own block."""
        k = self.kinds[self.i]
        label = k == "life" and self.kinds[self.i + 1] == ":"
        if label:
            k = self.kinds[self.i + 2]
        nxt = self.kinds[self.i + 1]
        if k in ("if", "match", "while", "loop", "for", "{") or k == "unsafe" and nxt == "{" or k == "const" and nxt == "{" or k == "async" and (nxt == "{" or nxt == "move" and self.kinds[self.i + 2] == "{"):
            before = self.calls_so_far()
            first = self.i
            self.expr_prefix(False)
            if self.kinds[self.i] in (".", "?"):
                self.postfix(False, before, first)
                self.binary_rest(0, False)
                return False
            return True
        if k in ("id", "self", "super", "crate", "::"):
            # A macro with braces ends its statement by itself.
            j = self.i
            if self.kinds[j] == "::":
                j += 1
            while self.kinds[j] in ("id", "self", "super", "crate") and self.kinds[j + 1] == "::":
                j += 2
            if self.kinds[j] == "id" and self.kinds[j + 1] == "!" and self.kinds[j + 2] == "{":
                self.call(self.text[self.ats[self.i] : self.ats[j]] + self.texts[j] + "!", self.ats[j], False)
                first, self.i = self.i, j + 2
                self.balanced()
                if self.kinds[self.i] in (".", "?"):
                    self.postfix(False, 0, first)
                    self.binary_rest(0, False)
                    return False
                return True
        self.expr()
        return False

    # -- expressions ----------------------------------------------------
    def expr(self, no_struct: bool = False) -> None:
        self.binary(0, no_struct)

    def binary(self, least: int, ns: bool) -> None:
        k = self.kinds[self.i]
        if k == ".." or k == "..=":
            self.i += 1
            if self.kinds[self.i] not in _EXPR_END and not (ns and self.kinds[self.i] == "{"):
                self.binary(3, ns)
            elif k == "..=":
                self.fail("range without an end")
        else:
            self.unary(ns)
        self.binary_rest(least, ns)

    def binary_rest(self, least: int, ns: bool) -> None:
        kinds = self.kinds
        compared = False
        while True:
            k = kinds[self.i]
            p = BINARY.get(k)
            if p is None or p < least or p == 0:
                return
            if p < max(least, 1):
                return
            self.i += 1
            if p == 1:
                self.binary(1, ns)
            elif p == 2:
                nk = kinds[self.i]
                if nk in _EXPR_START and not (ns and nk == "{"):
                    self.binary(3, ns)
                elif k == "..=":
                    self.fail("range without an end")
            else:
                if p == 5:
                    if compared:
                        self.fail("chained comparison")
                self.binary(p + 1, ns)
                if p == 5:
                    compared = True
                elif p < 5:
                    compared = False

    def unary(self, ns: bool) -> None:
        k = self.kinds[self.i]
        if k in ("-", "*", "!"):
            self.i += 1
            self.unary(ns)
            return
        if k == "&" or k == "&&":
            self.i += 1
            if self.kinds[self.i] == "id" and self.texts[self.i] == "raw" and self.kinds[self.i + 1] in ("const", "mut"):
                self.i += 2
            else:
                self.accept("mut")
            self.unary(ns)
            return
        before, first = self.calls_so_far(), self.i
        self.expr_prefix(ns)
        self.postfix(ns, before, first)
        while self.kinds[self.i] == "as":
            self.i += 1
            self.type_(False)

    def postfix(self, ns: bool, before: int, first: int) -> None:
        kinds = self.kinds
        while True:
            k = kinds[self.i]
            if k == "?":
                self.i += 1
            elif k == "(":
                self.arguments()
            elif k == "[":
                self.i += 1
                self.expr()
                self.expect("]")
            elif k == ".":
                self.i += 1
                k = kinds[self.i]
                if k == "await":
                    self.i += 1
                    self.awaited(before)
                elif k == "lit":
                    if not re.fullmatch(r"\d+(?:\.\d*)?", self.texts[self.i]):
                        self.fail("expected a field")
                    self.i += 1
                elif k == "id":
                    name = self.i
                    self.i += 1
                    if kinds[self.i] == "::":
                        self.i += 1
                        if not self.angle_ahead():
                            self.fail("expected type arguments")
                        self.generic_args()
                        if kinds[self.i] != "(":
                            self.fail("expected arguments")
                    if kinds[self.i] == "(":
                        recv = self.texts[name - 2] if kinds[name - 2] in ("id", "self") and kinds[name - 3] != "." and kinds[name - 3] != "::" else ""
                        if kinds[name - 2] == "id" and kinds[name - 3] == "." and kinds[name - 4] == "self" :
                            recv = "self." + self.texts[name - 2]
                        self.call(f"{recv}.{self.texts[name]}", self.ats[name], True, first)
                        self.arguments()
                else:
                    self.fail("expected a field or method")
            else:
                return

    def arguments(self) -> None:
        self.expect("(")
        while self.kinds[self.i] != ")":
            self.outer_attributes()
            self.expr()
            if not self.accept(","):
                break
        self.expect(")")

    def expr_path(self) -> str:
        parts = []
        if self.angle_ahead():
            self.qualified()
            self.expect("::")
        else:
            self.accept("::")
        while True:
            if self.kinds[self.i] not in ("id", "self", "super", "crate", "Self"):
                self.fail("expected a path")
            parts.append(self.texts[self.i])
            self.i += 1
            if self.kinds[self.i] != "::":
                return "::".join(parts)
            self.i += 1
            if self.angle_ahead():
                self.generic_args()
                if not self.accept("::"):
                    return "::".join(parts)

    def struct_literal_ahead(self) -> bool:
        k1, k2 = self.kinds[self.i + 1], self.kinds[self.i + 2]
        return k1 == "}" or k1 in ("..", "#") or k1 in ("id", "lit") and k2 in (":", ",", "}")

    def expr_prefix(self, ns: bool) -> None:
        kinds = self.kinds
        k = kinds[self.i]
        if k == "lit" or k == "true" or k == "false":
            self.i += 1
            return
        if k in ("id", "self", "Self", "super", "crate", "::", "<", "<<"):
            at = self.ats[self.i]
            path = self.expr_path()
            k = kinds[self.i]
            if k == "!" and kinds[self.i + 1] in _CLOSE:
                self.call(path + "!", at, False)
                self.i += 1
                first = self.i + 1
                self.balanced()
                self.macro_calls(first, self.i - 1)
            elif k == "(":
                self.call(path, at, False)
            elif k == "{" and not ns and self.struct_literal_ahead():
                self.i += 1
                while kinds[self.i] != "}":
                    self.outer_attributes()
                    if self.accept(".."):
                        if kinds[self.i] != "}":
                            self.expr()
                        break
                    if kinds[self.i] not in ("id", "lit"):
                        self.fail("expected a field")
                    self.i += 1
                    if self.accept(":"):
                        self.expr()
                    if not self.accept(","):
                        break
                self.expect("}")
            return
        if k == "(":
            self.i += 1
            self.inner_attributes()
            while kinds[self.i] != ")":
                self.outer_attributes()
                self.expr()
                if not self.accept(","):
                    break
            self.expect(")")
        elif k == "[":
            self.i += 1
            if kinds[self.i] != "]":
                self.outer_attributes()
                self.expr()
                if self.accept(";"):
                    self.expr()
                else:
                    while self.accept(","):
                        if kinds[self.i] == "]":
                            break
                        self.outer_attributes()
                        self.expr()
            self.expect("]")
        elif k == "{":
            self.block()
        elif k in ("unsafe", "const") and kinds[self.i + 1] == "{":
            self.i += 1
            self.block()
        elif k == "async" and (kinds[self.i + 1] == "{" or kinds[self.i + 1] == "move" and kinds[self.i + 2] == "{"):
            self.i += 1
            self.accept("move")
            self.block()
        elif k in ("|", "||", "move", "async", "static", "const") or k == "for" and kinds[self.i + 1] == "<":
            self.closure(ns)
        elif k == "if":
            self.if_()
        elif k == "match":
            self.match()
        elif k == "life":
            self.i += 1
            self.expect(":")
            if kinds[self.i] not in ("loop", "while", "for", "{"):
                self.fail("expected a loop")
            self.expr_prefix(ns)
        elif k == "loop":
            self.i += 1
            self.under(REPEATED, self.block)
        elif k == "while":
            self.i += 1
            self.condition()
            self.under(REPEATED, self.block)
        elif k == "for":
            self.i += 1
            self.pattern()
            self.expect("in")
            self.expr(True)
            self.under(REPEATED, self.block)
        elif k == "let" and self.conditional:
            self.i += 1
            pat = self.i
            self.pattern()
            self.expect("=")
            value = self.i
            self.binary(5, True)
            self.unwrapped(pat, value)
        elif k in ("return", "break", "continue"):
            self.i += 1
            if k != "return":
                self.accept("life")
            if k != "continue" and kinds[self.i] in _EXPR_START and not (ns and kinds[self.i] == "{"):
                self.expr(ns)
        elif k == "_":
            self.i += 1
        elif k == "#" or k == "doc":
            self.outer_attributes()
            self.expr_prefix(ns)
        else:
            self.fail("expected an expression")

    conditional = False

    def condition(self) -> None:
        old, self.conditional = self.conditional, True
        try:
            self.expr(True)
        finally:
            self.conditional = old

    def closure(self, ns: bool) -> None:
        if self.accept("for"):
            self.generics()
        self.accept("static")
        self.accept("const")
        self.accept("async")
        self.accept("move")
        if not self.accept("||"):
            self.expect("|")
            while self.kinds[self.i] != "|":
                self.outer_attributes()
                self.pattern_no_alt()
                if self.accept(":"):
                    self.type_()
                if not self.accept(","):
                    break
            self.expect("|")
        if self.accept("->"):
            self.type_(False)
            self.block()
        else:
            self.expr(ns)

    def if_(self) -> None:
        self.i += 1
        self.condition()
        self.under(CONDITIONAL, self.block)
        while self.accept("else"):
            if self.kinds[self.i] == "if":
                self.i += 1
                self.under(CONDITIONAL, self.condition)
                self.under(CONDITIONAL, self.block)
                continue
            self.under(CONDITIONAL, self.block)
            break

    def match(self) -> None:
        self.i += 1
        self.expr(True)
        open_at = self.ats[self.i]
        self.expect("{")
        self.inner_attributes()
        while self.kinds[self.i] != "}":
            if self.kinds[self.i] == "eof":
                self.fail("unclosed {", open_at)
            self.outer_attributes()
            self.pattern()
            if self.accept("if"):
                self.condition()
            self.expect("=>")
            block_like = self.under(CONDITIONAL, self.arm)
            if not self.accept(",") and self.kinds[self.i] != "}" and not block_like:
                self.fail("expected ,")
        self.i += 1

    def arm(self) -> bool:
        if self.kinds[self.i] == "{":
            self.block()
            if self.kinds[self.i] in (".", "?"):
                self.postfix(False, 0, -1)
                self.binary_rest(0, False)
                return False
            return True
        self.expr()
        return self.kinds[self.i - 1] == "}" and False

    def macro_calls(self, a: int, b: int) -> None:
        """Calls inside a macro's tokens: a path before ``(``."""
        j = a
        while j < b:
            if self.kinds[j] in ("id", "self", "Self", "crate", "super"):
                s = j
                name = self.texts[j]
                while j + 2 < b and self.kinds[j + 1] == "::" and self.kinds[j + 2] == "id":
                    j += 2
                    name += "::" + self.texts[j]
                if j + 1 < b and self.kinds[j + 1] == "(":
                    method = s > a and self.kinds[s - 1] == "."
                    self.call(f".{name}" if method else name, self.ats[s], method)
            j += 1


def parse(text: str) -> Unit:
    """Parse a Rust file's text (LF line ends)."""
    return RustParser(text).parse()
