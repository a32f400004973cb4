"""Python 3.13: tokens with indentation, statements and expressions."""

from __future__ import annotations

import re

from .base import CONDITIONAL, REPEATED, Item, Parser, SyntaxFailure, Unit

# Fixed values of the language.
KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is "
    "lambda nonlocal not or pass raise return try while with yield".split()
)
_PUNCT = ["**=", "//=", ">>=", "<<=", "...", "!=", "->", ":=", "==", "<=", ">=", "+=", "-=", "*=", "/=", "%=", "@=", "&=", "|=", "^=", "**", "//", "<<", ">>", *"+-*/%@&|^~<>()[]{},:.;="]
BINARY = {"or": 1, "and": 2, "<": 4, ">": 4, "==": 4, ">=": 4, "<=": 4, "!=": 4, "in": 4, "is": 4, "not": 4, "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "//": 10, "%": 10, "@": 10}
AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
_PREFIXES = frozenset("r u b br rb f fr rf".split()) | {""}
_TOKEN = re.compile(
    r"(?:[ \t\f]+|\\\n)*(?:"
    r"(?P<id>[^\W\d]\w*+(?!['\"]))"
    r"|(?P<nl>\n)"
    r"|(?P<comment>\#[^\n]*)"
    r"|(?P<str>(?:[A-Za-z]{1,2})?(?:'''|\"\"\"|'|\"))"
    r"|(?P<name>[^\W\d]\w*)"
    r"|(?P<num>0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+"
    r"|(?:[0-9](?:_?[0-9])*\.?(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?)"
    r"|(?P<p>[()\[\]{},;]|" + "|".join(re.escape(x) for x in sorted(_PUNCT, key=len, reverse=True)) + r")|(?P<end>\Z))"
)
_SPACE = re.compile(r"(?:[ \t\f]+|\\\n)*")
_INDENT = re.compile(r"[ \t\f]*")
_LEADING_ZERO = re.compile(r"0[0-9_]*[1-9][0-9_]*$")
_STOP = {q: re.compile(r"\\[\s\S]|" + q + ("" if len(q) == 3 else r"|\n")) for q in ("'", '"', "'''", '"""')}
_FSTOP = {q: re.compile(r"\\(?![{}])[\s\S]|\\|\{\{|\}\}|\{|\}|" + q + ("" if len(q) == 3 else r"|\n")) for q in ("'", '"', "'''", '"""')}
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_EXPR_END = frozenset((")", "]", "}", ",", ":", ";", "=", "nl", "eof", "for", "else", "if", "in", "async")) | AUGMENTED
_STATEMENT = frozenset("assert async break class continue def del for from global if import nonlocal pass raise return try while with".split())


class PythonParser(Parser):
    def __init__(self, text: str):
        super().__init__(text)
        self.subs: dict[int, list[tuple[int, int]]] = {}
        self.owner: list[tuple[str, str]] = []  # kind, name of enclosing definitions
        self.target = ""  # shape of the expression just parsed

    # -- tokens ---------------------------------------------------------
    def string_end(self, at: int, q: str, raw: bool) -> int:
        stop = _STOP[q]
        while True:
            m = stop.search(self.text, at)
            if not m or m[0] == "\n":
                return -1
            if m[0] == q:
                return m.end()
            at = m.end()

    def fstring_end(self, at: int, q: str, raw: bool, subs: list | None, spec: bool = False) -> int:
        """The end of an f-string's text, or with ``spec`` of a format spec."""
        text, stop = self.text, _FSTOP[q]
        while True:
            m = stop.search(text, at)
            if not m:
                return -1
            s = m[0]
            if s == q:
                return -1 if spec else m.end()
            if s == "\n":
                return -1
            if s == "}" or s == "}}" and spec:
                if spec:
                    return m.start()
                raise SyntaxFailure(m.start(), "single } in an f-string")
            if s == "{{" and spec:
                s, m_end = "{", m.start() + 1
            else:
                m_end = m.end()
            if s == "{":
                at = self.field_end(m_end, q, subs)
                if at < 0:
                    return -1
            else:
                at = m_end

    def field_end(self, at: int, q: str, subs: list | None) -> int:
        """After a replacement field whose expression begins at ``at``."""
        text, n = self.text, len(self.text)
        stack: list[str] = []
        start = at
        single = len(q) == 1
        while at < n:
            c = text[at]
            if c.isspace():
                at += 1
                continue
            if c == "#":
                k = text.find("\n", at)
                if k < 0 or single:
                    return -1
                at = k
                continue
            if not stack:
                if c == "}" or c == ":" or c == "!" and text[at + 1 : at + 2] != "=" or c == "=" and text[at + 1 : at + 2] != "=" and text[at - 1] not in "=!<>":
                    end = at
                    if c == "=":
                        at += 1
                        while text[at : at + 1].isspace():
                            at += 1
                        c = text[at : at + 1]
                    if subs is not None:
                        subs.append((start, end))
                    if c == "!":
                        if text[at + 1 : at + 2] not in ("r", "s", "a"):
                            raise SyntaxFailure(at, "bad conversion in an f-string")
                        at += 2
                        while text[at : at + 1] == " ":
                            at += 1
                        c = text[at : at + 1]
                    if c == ":":
                        at = self.fstring_end(at + 1, q, False, subs, True)
                        if at < 0:
                            return -1
                        c = text[at : at + 1]
                    return at + 1 if c == "}" else -1
            m = _TOKEN.match(text, at)
            if not m or m.lastgroup == "end":
                return -1
            g = m.lastgroup
            word = m[g]
            if g == "str":
                p = word.rstrip("'\"").lower()
                q2 = word[len(p) :]
                end = self.fstring_end(m.end(), q2, "r" in p, None) if "f" in p else self.string_end(m.end(), q2, "r" in p)
                if end < 0:
                    return -1
                at = end
                continue
            if g == "p" and not (word[0] in ":=" and not stack):
                if word in _CLOSE:
                    stack.append(_CLOSE[word])
                elif word in (")", "]", "}") and (not stack or stack.pop() != word):
                    return -1
            at = m.end()
        return -1

    def lex(self, at: int = 0, n: int | None = None, nested: bool = False) -> None:
        text = self.text
        n = len(text) if n is None else n
        kinds, texts, ats = self.kinds, self.texts, self.ats
        stack: list[str] = [")"] if nested else []
        opened: list[int] = [at] if nested else []
        indents = [(0, 0)]
        bol = not nested
        errors = self.unit.errors
        match = _TOKEN.match

        def add(k: str, w: str, a: int) -> None:
            kinds.append(k)
            texts.append(w)
            ats.append(a)

        while at < n:
            if bol:
                m = _INDENT.match(text, at)
                lead, at0 = m[0], m.end()
                c = text[at0 : at0 + 1]
                if c == "#":
                    k = text.find("\n", at0)
                    at = n if k < 0 or k >= n else k + 1
                    continue
                if c == "\n":
                    at = at0 + 1
                    continue
                if c == "" or at0 >= n:
                    at = n
                    break
                if c == "\\" and text[at0 + 1 : at0 + 2] == "\n" and not lead:
                    at = at0 + 2
                    continue
                bol = False
                lead = lead.rsplit("\f", 1)[-1]
                col, alt = len(lead.expandtabs(8)), len(lead.replace("\t", " "))
                if col > indents[-1][0]:
                    if alt <= indents[-1][1]:
                        errors.append((at0, "inconsistent use of tabs"))
                    indents.append((col, alt))
                    add("indent", "", at0)
                elif col < indents[-1][0]:
                    while col < indents[-1][0]:
                        indents.pop()
                        add("dedent", "", at0)
                    if col != indents[-1][0]:
                        errors.append((at0, "unindent does not match"))
                        indents.append((col, alt))
                        add("indent", "", at0)
                elif alt != indents[-1][1]:
                    errors.append((at0, "inconsistent use of tabs"))
                at = at0
            m = match(text, at, n)
            if not m:
                at = _SPACE.match(text, at, n).end()
                errors.append((at, f"unknown character {text[at]!r}"))
                at += 1
                continue
            g = m.lastgroup
            begin, end = m.span(g)
            if g == "end":
                if text[at:n].endswith("\\\n"):
                    errors.append((n, "unexpected end after a backslash"))
                break
            if g == "comment":
                at = end
                continue
            at = begin
            if g == "id" or g == "name":
                word = text[at:end]
                kinds.append(word if word in KEYWORDS else "id")
                texts.append(word)
                ats.append(at)
                at = end
                continue
            if g == "nl":
                if not stack:
                    add("nl", "", at)
                    bol = True
                at = end
                continue
            word = text[at:end]
            if g == "str":
                p = word.rstrip("'\"").lower()
                if p not in _PREFIXES:
                    # A name right before a string.
                    m2 = re.compile(r"\w+").match(text, at)
                    w2 = m2[0]
                    add(w2 if w2 in KEYWORDS else "id", w2, at)
                    at = m2.end()
                    continue
                q = word[len(p) :]
                subs: list = []
                try:
                    j = self.fstring_end(end, q, "r" in p, subs) if "f" in p else self.string_end(end, q, "r" in p)
                except SyntaxFailure as e:
                    self.note(e)
                    j, subs = -2, []
                if j < 0 or j > n:
                    if j != -2:
                        errors.append((at, "unterminated string"))
                    if len(q) == 3:
                        at = n
                        add("str", word, at)
                        break
                    k = text.find("\n", end)
                    j = n if k < 0 else min(k, n)
                if "b" in p and not text[at:j].isascii():
                    errors.append((at, "bytes with other than ASCII characters"))
                if subs:
                    self.subs[len(kinds)] = subs
                add("fstr" if "f" in p else "bytes" if "b" in p else "str", text[at:j], at)
                at = j
                continue
            if g == "num":
                nxt = text[end : end + 1]
                if nxt.isalnum() or nxt == "_":
                    w2 = re.compile(r"\w+").match(text, end)[0]
                    if w2 not in ("and", "or", "in", "is", "if", "else", "not", "for") or word[:2].lower() in ("0x", "0o", "0b") and False:
                        errors.append((at, "bad number"))
                if _LEADING_ZERO.match(word):
                    errors.append((at, "leading zeros in a number"))
                add("num", word, at)
            else:
                if word in _CLOSE:
                    stack.append(_CLOSE[word])
                    opened.append(at)
                elif word in (")", "]", "}"):
                    if not stack or len(stack) == 1 and nested:
                        errors.append((at, f"unmatched {word}"))
                        at = end
                        continue
                    if stack[-1] != word:
                        errors.append((at, f"{word} does not match"))
                    stack.pop()
                    opened.pop()
                kinds.append(word)
                texts.append(word)
                ats.append(at)
            at = end
        if stack and not nested:
            errors.append((opened[-1], "bracket was never closed"))
        if not nested:
            if kinds and kinds[-1] not in ("nl", "dedent", "indent") or kinds and kinds[-1] == "indent":
                add("nl", "", n)
            for _ in indents[1:]:
                add("dedent", "", n)
        for _ in range(4):
            add("eof", "", n)

    # -- recovery -------------------------------------------------------
    def resync(self, start: int) -> None:
        """Panic mode: skip to the end of the line and any block below it."""
        while self.kinds[self.i] not in ("nl", "eof"):
            if self.kinds[self.i] == "dedent" or self.kinds[self.i] in _STATEMENT and self.i > start and self.kinds[self.i - 1] == "nl":
                break
            self.i += 1
        if self.kinds[self.i] == "nl":
            self.i += 1
        if self.kinds[self.i] == "indent":
            level = 0
            while self.kinds[self.i] != "eof":
                level += {"indent": 1, "dedent": -1}.get(self.kinds[self.i], 0)
                self.i += 1
                if level == 0:
                    break
        if self.i == start and self.kinds[self.i] not in ("eof", "dedent"):
            self.i += 1

    # -- statements -----------------------------------------------------
    def parse(self) -> Unit:
        self.lex()
        while self.kinds[self.i] != "eof":
            start = self.i
            try:
                if self.kinds[self.i] in ("indent", "dedent"):
                    if self.kinds[self.i] == "indent":
                        self.i += 1
                        self.fail("unexpected indent", self.ats[self.i])
                    self.i += 1
                    continue
                self.statement()
            except SyntaxFailure as e:
                self.note(e)
                self.resync(start)
            except RecursionError:
                self.unit.errors.append((self.ats[self.i], "nested too deeply"))
                break
        return self.unit

    def statements(self) -> None:
        """The statements of an indented block."""
        self.expect("indent")
        while self.kinds[self.i] not in ("dedent", "eof"):
            start = self.i
            try:
                if self.kinds[self.i] == "indent":
                    self.i += 1
                    self.fail("unexpected indent", self.ats[self.i])
                self.statement()
            except SyntaxFailure as e:
                self.note(e)
                self.resync(start)
        self.accept("dedent")

    def block(self) -> None:
        if self.accept("nl"):
            if self.kinds[self.i] != "indent":
                self.fail("expected an indented block")
            self.statements()
        else:
            self.simple_line()

    def suite(self) -> None:
        self.expect(":")
        self.block()

    def simple_line(self) -> None:
        self.simple()
        while self.accept(";"):
            if self.kinds[self.i] in ("nl", "eof"):
                break
            self.simple()
        if self.kinds[self.i] == "eof":
            return
        self.expect("nl")

    def statement(self) -> None:
        kinds = self.kinds
        k = kinds[self.i]
        if k == "def":
            return self.function(None, self.ats[self.i])
        if k == "class":
            return self.class_(self.ats[self.i])
        if k == "@":
            start = self.ats[self.i]
            while self.accept("@"):
                self.named()
                self.expect("nl")
            if kinds[self.i] == "class":
                return self.class_(start)
            return self.function(None, start)
        if k == "if":
            self.i += 1
            self.named()
            self.under(CONDITIONAL, self.suite)
            while self.accept("elif"):
                self.named()
                self.under(CONDITIONAL, self.suite)
            if self.accept("else"):
                self.under(CONDITIONAL, self.suite)
            return None
        if k == "while":
            self.i += 1
            self.named()
            self.under(REPEATED, self.suite)
            if self.accept("else"):
                self.suite()
            return None
        if k == "for":
            return self.for_()
        if k == "try":
            return self.try_()
        if k == "with":
            return self.with_()
        if k == "async":
            if kinds[self.i + 1] == "def":
                return self.function(None, self.ats[self.i])
            self.i += 1
            if kinds[self.i] == "for":
                return self.for_()
            if kinds[self.i] == "with":
                return self.with_()
            self.fail("expected def, for or with")
        if k == "id" and self.texts[self.i] == "match" and self.match_ahead():
            return self.match()
        self.simple_line()
        return None

    def match_ahead(self) -> bool:
        """Whether ``match`` begins a statement: its line ends in a colon and a case follows."""
        if self.kinds[self.i + 1] in ("=", ".", ",", ")", ":", "nl", *AUGMENTED):
            return False
        j, depth = self.i + 1, 0
        while self.kinds[j] not in ("nl", "eof"):
            depth += (self.kinds[j] in _CLOSE) - (self.kinds[j] in (")", "]", "}"))
            j += 1
        return self.kinds[j - 1] == ":" and self.kinds[j + 1] == "indent" and self.texts[j + 2] == "case"

    def match(self) -> None:
        self.i += 1
        self.star_exprs()
        self.expect(":")
        self.expect("nl")
        self.expect("indent")
        while self.kinds[self.i] not in ("dedent", "eof"):
            if not (self.kinds[self.i] == "id" and self.texts[self.i] == "case"):
                self.fail("expected case")
            self.i += 1
            self.open_pattern()
            if self.accept("if"):
                self.named()
            self.under(CONDITIONAL, self.suite)
        self.accept("dedent")

    def open_pattern(self) -> None:
        while True:
            if self.accept("*"):
                self.expect("id")
            else:
                self.pattern()
            if not self.accept(","):
                return
            if self.kinds[self.i] in (":", "if"):
                return

    def pattern(self) -> None:
        while True:
            self.closed_pattern()
            if not self.accept("|"):
                break
        if self.accept("as"):
            self.expect("id")

    def closed_pattern(self) -> None:
        kinds = self.kinds
        k = kinds[self.i]
        if k in ("num", "-"):
            self.accept("-")
            self.expect("num")
            if kinds[self.i] in ("+", "-"):
                self.i += 1
                self.expect("num")
        elif k in ("str", "bytes"):
            while kinds[self.i] in ("str", "bytes"):
                self.i += 1
        elif k in ("None", "True", "False"):
            self.i += 1
        elif k == "id":
            self.i += 1
            while self.accept("."):
                self.expect("id")
            if self.accept("("):
                while kinds[self.i] != ")":
                    if kinds[self.i] == "id" and kinds[self.i + 1] == "=":
                        self.i += 2
                    self.pattern()
                    if not self.accept(","):
                        break
                self.expect(")")
        elif k in ("(", "["):
            self.i += 1
            end = _CLOSE[k]
            while kinds[self.i] != end:
                if self.accept("*"):
                    self.expect("id")
                else:
                    self.pattern()
                if not self.accept(","):
                    break
            self.expect(end)
        elif k == "{":
            self.i += 1
            while kinds[self.i] != "}":
                if self.accept("**"):
                    self.expect("id")
                else:
                    self.closed_pattern()
                    self.expect(":")
                    self.pattern()
                if not self.accept(","):
                    break
            self.expect("}")
        else:
            self.fail("expected a pattern")

    def for_(self) -> None:
        self.i += 1
        self.targets("in")
        self.expect("in")
        self.star_exprs()
        self.under(REPEATED, self.suite)
        if self.accept("else"):
            self.suite()

    def try_(self) -> None:
        self.i += 1
        self.suite()
        kinds = self.kinds
        handled = False
        starred = None
        while kinds[self.i] == "except":
            self.i += 1
            handled = True
            star = self.accept("*")
            if starred is not None and star != starred:
                self.fail("both except and except*")
            starred = star
            if kinds[self.i] != ":":
                self.expr()
                if self.accept("as"):
                    self.expect("id")
                elif kinds[self.i] == ",":
                    self.fail("several exceptions need parentheses")
            elif star:
                self.fail("expected an exception")
            self.under(CONDITIONAL, self.suite)
        if handled and self.accept("else"):
            self.suite()
        if self.accept("finally"):
            self.suite()
        elif not handled:
            self.fail("expected except or finally")

    def with_(self) -> None:
        self.i += 1
        kinds = self.kinds
        if kinds[self.i] == "(":
            # Parenthesised items, if a colon follows the closing bracket.
            j, depth = self.i, 0
            while kinds[j] != "eof":
                depth += (kinds[j] in _CLOSE) - (kinds[j] in (")", "]", "}"))
                j += 1
                if not depth:
                    break
            if kinds[j] == ":":
                self.i += 1
                while kinds[self.i] != ")":
                    if kinds[self.i] == "*" or True:
                        self.named()
                    if kinds[self.i] == "for":
                        self.comprehension()
                    if self.accept("as"):
                        self.target_one()
                    if not self.accept(","):
                        break
                self.expect(")")
                return self.suite()
        while True:
            self.expr()
            if self.accept("as"):
                self.target_one()
            if not self.accept(","):
                break
        return self.suite()

    def target_one(self) -> None:
        at = self.ats[self.i]
        self.target = ""
        self.binary(5)
        self.assignable(at)

    def assignable(self, at: int, deep: bool = True) -> None:
        if self.target not in ("name", "attr", "item", "tuple", "list", "star"):
            raise SyntaxFailure(at, f"cannot assign to {self.target or 'expression'}")

    def targets(self, end: str) -> None:
        while True:
            self.accept("*")
            self.target_one()
            if not self.accept(","):
                return
            if self.kinds[self.i] == end:
                return

    def record(self, kind: str, tok: int, start: int, doc: str | None) -> Item:
        it = Item(kind, self.texts[tok], self.ats[tok], start, doc=doc, inner=any(k == "def" for k, _ in self.owner))
        if kind == "function" and self.owner and self.owner[-1][0] == "class":
            it.parent, it.is_method = self.owner[-1][1], True
        self.unit.items.append(it)
        return it

    def docstring(self) -> str | None:
        """The text of a plain string that is the next statement by itself."""
        i = self.i
        if self.kinds[i] == ":":
            i += 1
        if self.kinds[i] == "nl":
            i += 1
            if self.kinds[i] != "indent":
                return None
            i += 1
        j, paren = i, 0
        while self.kinds[j] == "(":
            j += 1
            paren += 1
        parts = []
        while self.kinds[j] == "str":
            parts.append(self.texts[j])
            j += 1
        if not parts:
            return None
        for _ in range(paren):
            if self.kinds[j] != ")":
                return None
            j += 1
        if self.kinds[j] not in ("nl", ";", "eof"):
            return None
        return "".join(re.sub(r"^[rRuU]?('''|\"\"\"|'|\")([\s\S]*)\1$", r"\2", p) for p in parts)

    def function(self, doc, start: int) -> None:
        self.accept("async")
        self.expect("def")
        tok = self.expect("id")
        it = self.record("function", tok, start, doc)
        if self.kinds[self.i] == "[":
            self.type_params()
        self.expect("(")
        it.params = self.params(")", it)
        self.expect(")")
        if self.accept("->"):
            a = self.i
            self.named()
            it.types.extend(self.type_idents(a, self.i))
        it.body = self.ats[self.i]
        self.expect(":")
        it.doc = self.docstring()
        self.owner.append(("def", it.name))
        self.enter(it)
        try:
            self.block()
        finally:
            self.leave()
            self.owner.pop()
        it.end = self.ats[self.i - 1] if self.i else 0

    def type_params(self) -> None:
        self.expect("[")
        while self.kinds[self.i] != "]":
            self.accept("*") or self.accept("**")
            self.expect("id")
            if self.accept(":"):
                self.expr()
            if self.accept("="):
                self.accept("*")
                self.expr()
            if not self.accept(","):
                break
        self.expect("]")

    def type_idents(self, a: int, b: int) -> list[str]:
        out = []
        for j in range(a, b):
            if self.kinds[j] == "id" and self.texts[j][:1].isupper():
                out.append(self.texts[j])
            elif self.kinds[j] == "str":
                out.extend(re.findall(r"\b[A-Z]\w*", self.texts[j]))
        return out

    def params(self, end: str, it: Item | None) -> tuple[str, ...]:
        names: list[str] = []
        kinds = self.kinds
        default = star = slash = False
        lam = end == ":"
        while kinds[self.i] != end:
            if self.accept("/"):
                if slash or star or not names:
                    self.fail("misplaced /")
                slash = True
            elif self.accept("**"):
                names.append(self.texts[self.expect("id")])
                if not lam and self.accept(":"):
                    self.expr()
                self.accept(",")
                if kinds[self.i] != end:
                    self.fail("parameter after **")
                break
            elif self.accept("*"):
                if star:
                    self.fail("two * in parameters")
                star = True
                if kinds[self.i] == "id":
                    names.append(self.texts[self.expect("id")])
                    if not lam and self.accept(":"):
                        self.accept("*")
                        self.expr()
                elif kinds[self.i] == end or kinds[self.i] == "," and kinds[self.i + 1] in (end, "**"):
                    self.fail("parameters must follow *")
            else:
                tok = self.expect("id")
                names.append(self.texts[tok])
                if not lam and self.accept(":"):
                    a = self.i
                    self.expr()
                    if it is not None:
                        types = self.type_idents(a, self.i)
                        it.types.extend(types)
                        it.local[self.texts[tok]] = types[-1] if len(types) == 1 else None
                if self.accept("="):
                    default = True
                    self.expr()
                elif default and not star:
                    self.fail("parameter without a default after one with")
            if not self.accept(","):
                break
        if len(set(names)) != len(names) and False:
            self.fail("duplicate parameter")
        return tuple(names)

    def class_(self, start: int) -> None:
        self.expect("class")
        tok = self.expect("id")
        it = self.record("struct", tok, start, None)
        if self.kinds[self.i] == "[":
            self.type_params()
        if self.kinds[self.i] == "(":
            a = self.i + 1
            self.arguments()
            it.bases = tuple(self.texts[j] for j in range(a, self.i - 1) if self.kinds[j] == "id" and self.kinds[j + 1] in (",", ")", "["))
        it.body = self.ats[self.i]
        self.expect(":")
        it.doc = self.docstring()
        self.owner.append(("class", it.name))
        try:
            self.block()
        finally:
            self.owner.pop()
        it.end = self.ats[self.i - 1]

    def simple(self) -> None:
        kinds = self.kinds
        k = kinds[self.i]
        if k in ("pass", "break", "continue"):
            self.i += 1
        elif k == "return":
            self.i += 1
            if kinds[self.i] not in ("nl", ";", "eof"):
                self.star_exprs()
        elif k == "raise":
            self.i += 1
            if kinds[self.i] not in ("nl", ";", "eof"):
                self.expr()
                if self.accept("from"):
                    self.expr()
        elif k in ("global", "nonlocal"):
            self.i += 1
            while True:
                self.expect("id")
                if not self.accept(","):
                    break
        elif k == "del":
            self.i += 1
            self.targets("nl")
        elif k == "assert":
            self.i += 1
            self.expr()
            if self.accept(","):
                self.expr()
        elif k == "import":
            self.i += 1
            while True:
                path = self.dotted()
                alias = ""
                if self.accept("as"):
                    alias = self.texts[self.expect("id")]
                self.unit.imports.append((alias or path, path, True, False))
                if not self.accept(","):
                    break
        elif k == "from":
            self.from_()
        elif k == "id" and self.texts[self.i] == "type" and kinds[self.i + 1] == "id" and kinds[self.i + 2] in ("=", "["):
            self.i += 1
            tok = self.expect("id")
            self.record("type_alias", tok, self.ats[tok], None)
            if kinds[self.i] == "[":
                self.type_params()
            self.expect("=")
            self.expr()
        else:
            self.expression_statement()

    def dotted(self) -> str:
        name = self.texts[self.expect("id")]
        while self.accept("."):
            name += "." + self.texts[self.expect("id")]
        return name

    def from_(self) -> None:
        self.i += 1
        dots = ""
        while self.kinds[self.i] in (".", "..."):
            dots += self.texts[self.i]
            self.i += 1
        path = dots
        if self.kinds[self.i] != "import" or not dots:
            path += self.dotted()
        self.expect("import")
        if self.accept("*"):
            self.unit.imports.append(("", path, True, False))
            return
        paren = self.accept("(")
        while True:
            name = self.texts[self.expect("id")]
            alias = self.texts[self.expect("id")] if self.accept("as") else name
            self.unit.imports.append((alias, f"{path}::{name}", False, False))
            if not self.accept(","):
                break
            if paren and self.kinds[self.i] == ")":
                break
        if paren:
            self.expect(")")

    def expression_statement(self) -> None:
        kinds = self.kinds
        first, at = self.i, self.ats[self.i]
        self.star_exprs()
        k = kinds[self.i]
        if k == ":":
            if self.target not in ("name", "attr", "item"):
                self.fail("cannot annotate this")
            self.i += 1
            a = self.i
            self.expr()
            types = self.type_idents(a, self.i)
            self.typed(first, a - 1, types[-1] if len(types) == 1 else None)
            if self.accept("="):
                self.star_exprs()
        elif k in AUGMENTED:
            if self.target not in ("name", "attr", "item"):
                self.fail("cannot assign to this")
            self.i += 1
            self.star_exprs()
        else:
            last = first
            while kinds[self.i] == "=":
                self.assignable(at)
                self.i += 1
                at, last = self.ats[self.i], self.i
                self.star_exprs()
            if last > first and kinds[last] == "id" and self.texts[last][:1].isupper() and kinds[last + 1] == "(":
                self.typed(first, last - 1, self.texts[last])

    def typed(self, first: int, end: int, name: str | None) -> None:
        """Note the declared type of ``x`` or ``self.x``."""
        k = self.kinds[first:end]
        if name is None:
            return
        if k == ["id"]:
            if self.functions:
                local = self.functions[-1].local
                local[self.texts[first]] = name if local.get(self.texts[first], name) == name else None
            elif self.owner and self.owner[-1][0] == "class":
                self.unit.fields.setdefault(self.owner[-1][1], {})[self.texts[first]] = name
        elif k == ["id", ".", "id"] and self.texts[first] == "self" and self.functions and self.functions[-1].parent:
            self.unit.fields.setdefault(self.functions[-1].parent, {})[self.texts[first + 2]] = name

    # -- expressions ----------------------------------------------------
    def star_exprs(self) -> None:
        """Expressions with commas, stars and yields."""
        kinds = self.kinds
        if kinds[self.i] == "yield":
            return self.yield_()
        many = False
        ok = True
        while True:
            if self.accept("*"):
                self.binary(5)
                many = True
            else:
                self.named_free()
            ok = ok and self.target in ("name", "attr", "item", "tuple", "list", "star")
            if not self.accept(","):
                break
            many = True
            if kinds[self.i] in _EXPR_END and kinds[self.i] not in ("(",):
                break
        if many:
            self.target = "tuple" if ok else ""
        return None

    def named_free(self) -> None:
        """An expression; a bare walrus is an error at the statement level."""
        self.expr()

    def yield_(self) -> None:
        self.i += 1
        if self.accept("from"):
            self.expr()
        elif self.kinds[self.i] not in ("nl", ";", ")", "]", "}", "=", "eof"):
            self.star_exprs()
        self.target = "yield"

    def named(self) -> None:
        if self.kinds[self.i] == "id" and self.kinds[self.i + 1] == ":=":
            self.i += 2
            self.expr()
            self.target = "named"
        else:
            self.expr()

    def expr(self) -> None:
        kinds = self.kinds
        if kinds[self.i] == "lambda":
            self.i += 1
            self.params(":", None)
            self.expect(":")
            self.expr()
            self.target = "lambda"
        else:
            self.binary(1)
            if kinds[self.i] == "if":
                self.i += 1
                self.under(CONDITIONAL, lambda: self.binary(1))
                self.expect("else")
                self.under(CONDITIONAL, self.expr)
                self.target = "conditional"

    def binary(self, least: int) -> None:
        kinds = self.kinds
        if kinds[self.i] == "not":
            if least > 3:
                self.fail("misplaced not")
            self.i += 1
            self.binary(3)
            self.target = "operator"
        else:
            self.unary()
        while True:
            k = kinds[self.i]
            p = BINARY.get(k)
            if p is None or p < least:
                break
            if k == "not":
                if kinds[self.i + 1] != "in":
                    break
                self.i += 1
            self.i += 1
            if k == "is" and kinds[self.i] == "not":
                self.i += 1
            self.binary(p + 1)
            self.target = "operator"

    def unary(self) -> None:
        kinds = self.kinds
        if kinds[self.i] in ("-", "+", "~"):
            self.i += 1
            self.unary()
            self.target = "operator"
            return
        awaits = kinds[self.i] == "await"
        before = self.calls_so_far()
        if awaits:
            self.i += 1
        self.primary()
        if awaits:
            self.awaited(before)
            self.target = "await"
        if kinds[self.i] == "**":
            self.i += 1
            self.unary()
            self.target = "operator"

    def primary(self) -> None:
        kinds, texts = self.kinds, self.texts
        first = self.i
        chain = ""
        k = kinds[self.i]
        if k == "id":
            chain = texts[self.i]
            self.i += 1
            self.target = "name"
        elif k == "num" or k == "..." or k in ("None", "True", "False"):
            self.i += 1
            self.target = "literal"
        elif k in ("str", "fstr", "bytes"):
            self.strings()
            self.target = "literal"
        elif k == "(":
            self.paren()
        elif k == "[":
            self.list_()
        elif k == "{":
            self.braces()
        else:
            self.fail("expected an expression")
        while True:
            k = kinds[self.i]
            if k == ".":
                self.i += 1
                name = texts[self.expect("id")]
                chain = f"{chain}.{name}" if chain else f".{name}"
                self.target = "attr"
            elif k == "(":
                if chain:
                    self.call(chain, self.ats[self.i - 1] if "." in chain else self.ats[first], "." in chain, first if "." in chain else -1)
                self.arguments()
                chain = ""
                self.target = "call"
            elif k == "[":
                self.i += 1
                self.slices()
                self.expect("]")
                chain = ""
                self.target = "item"
            else:
                return

    def strings(self) -> None:
        kinds = self.kinds
        plain = bytes_ = False
        while kinds[self.i] in ("str", "fstr", "bytes"):
            bytes_ |= kinds[self.i] == "bytes"
            plain |= kinds[self.i] != "bytes"
            for a, b in self.subs.get(self.i, ()):
                if not self.text[a:b].strip():
                    self.fail("empty expression in an f-string")
                child = PythonParser(self.text)
                child.functions, child.flags, child.owner = self.functions, self.flags, self.owner
                child.lex(a, b, True)
                if not child.unit.errors:
                    child.star_named()
                    if child.kinds[child.i] != "eof":
                        child.fail("expected }")
                self.unit.errors.extend(child.unit.errors)
            self.i += 1
        if plain and bytes_:
            self.fail("cannot mix bytes and text")

    def star_named(self) -> None:
        if self.kinds[self.i] == "yield":
            return self.yield_()
        while True:
            if self.accept("*"):
                self.binary(5)
            else:
                self.named()
            if not self.accept(",") or self.kinds[self.i] in (")", "]", "}", "eof"):
                return None

    def slices(self) -> None:
        kinds = self.kinds
        if kinds[self.i] == "]":
            self.fail("expected an index")
        while kinds[self.i] != "]":
            if self.accept("*"):
                self.binary(5)
            else:
                if kinds[self.i] != ":":
                    self.named()
                if self.accept(":"):
                    if kinds[self.i] not in (":", "]", ","):
                        self.expr()
                    if self.accept(":") and kinds[self.i] not in ("]", ","):
                        self.expr()
            if not self.accept(","):
                break

    def arguments(self) -> None:
        self.expect("(")
        kinds = self.kinds
        keyword = double = False
        count = 0
        while kinds[self.i] != ")":
            if self.accept("**"):
                self.expr()
                double = True
            elif self.accept("*"):
                if double:
                    self.fail("unpacking after **")
                self.expr()
            elif kinds[self.i] == "id" and kinds[self.i + 1] == "=":
                self.i += 2
                self.expr()
                keyword = True
            else:
                at = self.ats[self.i]
                self.named()
                if kinds[self.i] in ("for", "async"):
                    self.comprehension()
                    if count or kinds[self.i] == "," and kinds[self.i + 1] != ")":
                        self.fail("generator needs parentheses")
                elif kinds[self.i] == "=":
                    self.fail("cannot assign to an expression")
                elif keyword or double:
                    self.fail("positional argument after keyword argument", at)
            count += 1
            if not self.accept(","):
                break
        self.expect(")")

    def comprehension(self) -> None:
        def clauses() -> None:
            while self.kinds[self.i] in ("for", "async"):
                if self.accept("async") and self.kinds[self.i] != "for":
                    self.fail("expected for")
                self.expect("for")
                self.targets("in")
                self.expect("in")
                self.binary(1)
                if self.kinds[self.i] == "if" and self.else_ahead():
                    self.i += 1
                    self.binary(1)
                    self.expect("else")
                    self.expr()
                while self.accept("if"):
                    if self.kinds[self.i] == "id" and self.kinds[self.i + 1] == ":=":
                        self.i += 2
                    self.binary(1)

        self.under(REPEATED, clauses)

    def else_ahead(self) -> bool:
        return False

    def paren(self) -> None:
        self.i += 1
        kinds = self.kinds
        if self.accept(")"):
            self.target = "tuple"
            return
        if kinds[self.i] == "yield":
            self.yield_()
            self.expect(")")
            self.target = "yield"
            return
        star = self.accept("*")
        if star:
            self.binary(5)
        else:
            self.named()
        ok = self.target in ("name", "attr", "item", "tuple", "list")
        if kinds[self.i] in ("for", "async"):
            self.comprehension()
            self.expect(")")
            self.target = "generator"
            return
        many = False
        while self.accept(","):
            many = True
            if kinds[self.i] == ")":
                break
            if self.accept("*"):
                self.binary(5)
            else:
                self.named()
            ok = ok and self.target in ("name", "attr", "item", "tuple", "list")
        if star and not many:
            self.fail("cannot use a starred expression here")
        self.expect(")")
        if many:
            self.target = "tuple" if ok else ""

    def list_(self) -> None:
        self.i += 1
        kinds = self.kinds
        ok = True
        first = True
        while kinds[self.i] != "]":
            if self.accept("*"):
                self.binary(5)
            else:
                self.named()
            ok = ok and self.target in ("name", "attr", "item", "tuple", "list")
            if first and kinds[self.i] in ("for", "async"):
                self.comprehension()
                ok = False
                break
            first = False
            if not self.accept(","):
                break
        self.expect("]")
        self.target = "list" if ok else ""

    def braces(self) -> None:
        self.i += 1
        kinds = self.kinds
        first, dict_ = True, None
        while kinds[self.i] != "}":
            if self.accept("**"):
                self.binary(5)
                pair = True
            elif self.accept("*"):
                self.binary(5)
                pair = False
            else:
                self.named()
                pair = self.accept(":")
                if pair:
                    self.expr()
            if dict_ is None:
                dict_ = pair
            elif dict_ != pair:
                self.fail("mixed set and dict")
            if first and kinds[self.i] in ("for", "async"):
                self.comprehension()
                break
            first = False
            if not self.accept(","):
                break
        self.expect("}")
        self.target = "literal"


def parse(text: str) -> Unit:
    """Parse a Python file's text (LF line ends)."""
    return PythonParser(text).parse()
