"""Sentence boundaries across languages and scripts (problem 8).

Abbreviations, sentence starters and collocations are learned without labels,
per language, by log-likelihood ratios over counts of the whole corpus; every
period is then classified by these statistics and the tokens beside it.  Blank
lines, headings, list items and fenced blocks bound units beforehand.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread

#: Thresholds of the log-likelihood ratios.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 25.0, 7.88
#: Log-likelihood that what follows an abbreviation's period must give.
EVIDENCE = 2.0
#: Keys that a worker counts before it hands partial counts on.
_FLUSH = 300_000
#: Most learned rows that every worker holds; beyond it they are joined to the tokens that ask for them.
MAX_HELD = 500_000
#: Parts of a word's requests in that join.
_SALT = 8

_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}ー々"
_OPEN = "\"'“”„‚‘’«»‹›「『（(［[{〈《【*_`"
_CLOSE = "\"'”’“«»‹›」』）)］]}〉》】*_`"
_CLOSERS, _LEAD = frozenset(_CLOSE), frozenset(_OPEN + "¿¡…")
#: A mark that can end a sentence, what closes behind it, and whether white space follows.
_CANDIDATE = regex.compile(rf"(?:(?<wide>[。！？｡]+|[！？?!…]+(?=[”」』）〉》】]))|(?<mark>[.!?‼⁇⁈⁉؟۔।॥…]+|(?<=\s)[!?]+))(?<close>[{re.escape(_CLOSE)}]*)")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}](?:[\p{L}\p{M}\p{N}'’\-]|\.(?=[\p{L}\p{M}\p{N}]))*")
_NUMBER = regex.compile(r"[\p{N}]+(?:[.,:][\p{N}]+)*$")
_BEFORE = regex.compile(r"(?r)(?:[\p{L}\p{M}\p{N}'’\-_º°ª]|\.(?=[\p{L}\p{M}\p{N}]))+")
_WIDE_NEXT = regex.compile(rf"[{_CJK}「『（]")
_FENCE = re.compile(r"[ \t]*(```+|~~~+)")
_HEADING = re.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]|$)")
_ITEM = re.compile(r"[ \t]*(?:[-*+•‣◦–]|\d{1,9}[.)]|[A-Za-z][)])[ \t]+\S")
_LINE_MARK = regex.compile(r"[ \t]*(?:>|\||///?|#|\*)?[ \t]*")
_THAI = regex.compile(r"(?<=\p{Thai})[ \t 　]+(?:\r\n|\n|\r)?[ \t ]*(?=\p{Thai})")
# What continues a Japanese or Chinese sentence after a closing quote.
_CONTINUES = regex.compile(r"[とのはがをにもでやへ的地得了是这那这和与或等，、：；,:;—]|って|という|から|まで")


def _kind(ch: str) -> str:
    """Lower, upper, number, other letter or other of the first character."""
    if not ch:
        return ""
    return "n" if ch.isdigit() else "l" if ch.islower() else "u" if ch.isupper() else "o" if ch.isalpha() else "x"


def blocks(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whole) of every block; a whole one is a single unit.

    A blank line ends a block; a heading and a fence stand by themselves.  List
    items count as such only in a block that begins with one, so that a wrapped
    line that happens to begin with a number stays in its paragraph.
    """
    lines: list[tuple[int, int]] = []
    at = 0
    for m in re.finditer(r"\r\n|\n|\r|\x0b|\x0c| | |\x85", text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    out: list[tuple[int, int, bool]] = []
    begin = end = -1
    listing = False

    def close() -> None:
        nonlocal begin, listing
        if begin >= 0:
            out.append((begin, end, listing))
        begin, listing = -1, False

    k = 0
    while k < len(lines):
        a, b = lines[k]
        line = text[a:b]
        if not line.strip():
            close()
            k += 1
            continue
        if m := _FENCE.match(line):
            close()
            mark, j = m[1], k + 1
            while j < len(lines):
                s = text[lines[j][0] : lines[j][1]].strip()
                if s.startswith(mark[:3]) and not s.strip(mark[0]):
                    break
                j += 1
            last = min(j, len(lines) - 1)
            out.append((a, lines[last][1], True))
            k = last + 1
            continue
        if _HEADING.match(line):
            close()
            out.append((a, b, True))
            k += 1
            continue
        if _ITEM.match(line) and (begin < 0 or listing):
            close()
            begin, listing = a, True
        elif begin < 0:
            begin = a
        end = b
        k += 1
    close()
    return out


@dataclass
class Model:
    """What was learned: by language, the sets that the classifier asks for.

    Under None stands what any language says.
    """

    abbreviations: dict = field(default_factory=dict)  # lang -> type -> whether it can end a sentence
    starters: dict = field(default_factory=dict)  # lang -> types
    lower: dict = field(default_factory=dict)  # lang -> types also seen in lower case within sentences
    collocations: dict = field(default_factory=dict)  # lang -> second types of pairs with a number
    numbered: dict = field(default_factory=dict)  # lang -> types whose period mostly stands before a number
    known: dict = field(default_factory=dict)  # lang -> types seen often enough for their language to decide

    def abbreviation(self, lang: str, t: str) -> bool | None:
        """None if ``t`` is none, else whether it can end a sentence."""
        own = self.abbreviations.get(lang)
        if own is not None and t in own:
            return own[t]
        if t in self.known.get(lang, ()):
            return None
        return self.abbreviations.get(None, {}).get(t)

    def starter(self, lang: str, t: str) -> bool:
        return t in self.starters.get(lang, ()) or (t not in self.known.get(lang, ()) and t in self.starters.get(None, ()))

    def lowered(self, t: str) -> bool:
        return t in self.lower.get(None, ())

    def after_number(self, lang: str, t: str) -> bool:
        return t in self.collocations.get(lang, ()) or (t not in self.known.get(lang, ()) and t in self.collocations.get(None, ()))

    def before_number(self, t: str) -> bool:
        return t in self.numbered.get(None, ())


_TYPES: dict[str, str] = {}


def _type(word: str) -> str:
    """A word in lower case without marks at its ends; every number is one type."""
    if (got := _TYPES.get(word)) is None:
        w = word.lower().strip("'’-")
        if len(_TYPES) > _FLUSH:
            _TYPES.clear()
        got = _TYPES[word] = "##" if _NUMBER.fullmatch(w) else w
    return got


def _next_word(text: str, at: int, end: int):
    """The word that begins at most twelve characters after ``at``."""
    if m := _WORD.match(text, at, end):
        return m
    m = _WORD.search(text, at, min(end, at + 13))
    return m and _WORD.match(text, m.start(), end)


def _skip(text: str, at: int, end: int, chars: str | frozenset) -> int:
    while at < end and text[at] in chars:
        at += 1
    return at


def _skip_space(text: str, at: int, end: int) -> int:
    while at < end and text[at].isspace():
        at += 1
    return at


_KINDS = ("t", "d", "dl", "dn", "de", "dw", "s", "l", "f")


def count(text: str, into: dict[str, Counter]) -> None:
    """Add a text's counts of types, their periods and what stands beside them.

    ``into``: a counter for each kind: t a type, d one with a period,
    dl/dn/de such a one before lower case, a number, a block's end, dw one that
    ends a list item, s one that begins a block, l one in lower case within a
    sentence, f one in upper case after the end mark of a word, c a pair around
    a number's or an initial's period, p a period, N a token, S a block.
    """
    types, low, after_mark = [], [], []
    known = _TYPES.get
    tokens = 0
    for a, b, whole in blocks(text):
        if whole and _FENCE.match(text, a):
            continue
        fresh, first = True, not whole
        before = ""
        for m in _WORD.finditer(text, a, b):
            w, end = m[0], m.end()
            t = known(w) or _type(w)
            ch = w[0]
            tokens += 1
            if first:
                into["s"][t] += 1
                into["S"][""] += 1
                first = False
            if fresh:
                if len(before) > 2 and ch.isupper():
                    after_mark.append(t)
            elif ch.islower():
                low.append(t)
            before = "" if t == "##" else t
            nxt = text[end] if end < b else ""
            fresh = nxt != "" and nxt in ".!?。"
            if nxt == ".":
                after = text[end + 1] if end + 1 < b else ""
                if after == "" or after.isspace() or after in ",;:)":
                    _dotted(text, t, end + 1, b, after, whole, into)
                    if whole:
                        continue  # an item's last word says little
            types.append(t)
    into["N"][""] += tokens
    into["t"].update(types)
    into["l"].update(low)
    into["f"].update(after_mark)


def _dotted(text: str, t: str, at: int, b: int, after: str, whole: bool, into: dict[str, Counter]) -> None:
    """Count a type with a period that ends before ``at``."""
    if whole:
        into["dw"][t] += _skip_space(text, at, b) >= b
        return
    into["p"][""] += 1
    into["d"][t] += 1
    rest = _skip_space(text, _skip(text, at, b, _CLOSERS), b)
    if rest >= b:
        into["de"][t] += 1
        return
    k = _kind(text[rest])
    if k == "l" or after in (",", ";", ":"):
        into["dl"][t] += 1
    elif k == "n":
        into["dn"][t] += 1
    if (t == "##" or len(t) == 1) and (n := _next_word(text, at, b)):
        into["c"][t, _type(n[0])] += 1


def _llr(a: float, b: float, ab: float, n: float) -> float:
    """Dunning's ratio: ``ab`` of ``a`` events fall together with ``b`` of ``n``."""
    p, p1, p2 = b / n, ab / a if a else 0.0, (b - ab) / (n - a) if n > a else 0.0

    def part(k: float, m: float, x: float) -> float:
        x = min(max(x, 1e-12), 1 - 1e-12)
        return k * math.log(x) + (m - k) * math.log(1 - x)

    return 2 * (part(ab, a, p1) + part(b - ab, n - a, p2) - part(ab, a, p) - part(b - ab, n - a, p))


def abbreviation_score(t: str, total: int, dotted: int, lower: int, digits: int, ends: int, periods: int, n: int, end_share: float) -> float:
    """How much a type looks like an abbreviation.

    The ratio of "almost always with a period" to chance, weighed by length,
    inner periods and occurrences without; to it comes the ratio of what follows
    its period: an abbreviation goes on in lower case or with a number and
    rarely ends a paragraph, a word that merely closes sentences does the reverse.
    """
    plain = max(1, len(t.replace(".", "")))
    p = min(max(periods / n, 1e-6), 0.98)
    bare = total - dotted
    ratio = 2 * (dotted * math.log(0.99 / p) + bare * math.log(0.01 / (1 - p)))
    score = ratio * math.exp(-plain) * (t.count(".") + 1) * plain ** -min(bare, 60)

    def two(k: int, yes: float, no: float) -> float:
        yes, no = min(max(yes, 1e-3), 0.999), min(max(no, 1e-3), 0.999)
        return k * math.log(yes / no) + (dotted - k) * math.log((1 - yes) / (1 - no))

    # Titles go before names only, so that going on says something but its lack nothing.
    evidence = max(0.0, two(lower + digits, 0.45, 0.06)) + two(ends, 0.01, end_share)
    return score if evidence > EVIDENCE else min(score, 0.0)


def learn(rows: Iterable[tuple]) -> Model:
    """The model from learned rows (lang, kind, a, b, flag); see ``learned``."""
    m = Model()
    sets = {"start": m.starters, "lower": m.lower, "num": m.numbered, "known": m.known, "pair": m.collocations}
    for lang, kind, a, b, flag in rows:
        for at in (lang, None):
            if kind == "abbr":
                of = m.abbreviations.setdefault(at, {})
                of[a] = bool(flag) or of.get(a, False)
            else:
                sets[kind].setdefault(at, set()).add(b if kind == "pair" else a)
    return m


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by_lang: dict[str, dict[str, Counter]] = {}

    def out() -> pa.RecordBatch:
        rows = [(lang, kind, *(k if kind == "c" else (k, "")), n) for lang, kinds in by_lang.items() for kind, of in kinds.items() for k, n in of.items()]
        by_lang.clear()
        cols = list(zip(*rows)) or [[], [], [], [], []]
        return pa.RecordBatch.from_arrays([*(pa.array(k, pa.string()) for k in cols[:4]), pa.array(cols[4], pa.int64())], names=["lang", "kind", "a", "b", "n"])

    seen = 0
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            if (into := by_lang.get(lang or "")) is None:
                into = by_lang[lang or ""] = {k: Counter() for k in (*_KINDS, "c", "p", "N", "S")}
            count(text, into)
            seen += 1
            if seen % 256 == 0 and sum(len(c) for kinds in by_lang.values() for c in kinds.values()) > _FLUSH:
                yield out()
    yield out()


def statistics(docs: DataFrame) -> DataFrame:
    """``lang, a, t, d, dl, dn, de, dw, s, l`` per type, and the totals of its language."""
    raw = spread(docs.where("text is not null").select("lang", "text")).mapInArrow(_counted, "lang string, kind string, a string, b string, n bigint")
    return raw.groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n"))


def learned(docs: DataFrame) -> DataFrame:
    """``lang, kind, a, b, flag``: what all documents teach and the classifier can ask for.

    Kinds: abbr (flag: it can end a sentence), start, lower, num, known, and
    pair, a word ``b`` that belongs to a number before it.
    """
    counts = cut(statistics(docs))
    pick = lambda kind, name: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).alias(name)
    totals = {r["lang"]: r for r in counts.where("kind in ('N', 'p', 'S', 'de', 'd')").groupBy("lang").agg(pick("N", "n"), pick("p", "p"), pick("S", "s"), pick("de", "de"), pick("d", "d")).collect()}
    types = counts.where("kind in ('t', 'd', 'dl', 'dn', 'de', 'dw', 's', 'l', 'f')").groupBy("lang", "a").agg(*(pick(k, k) for k in ("t", "d", "dl", "dn", "de", "dw", "s", "l", "f")))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                tot, t = totals[r["lang"]], r["a"]
                n, periods = max(2, tot["n"]), max(1, tot["p"])
                share = min(0.5, max(0.05, tot["de"] / max(1, tot["d"])))
                if r["d"] and t != "##" and not (t.isdigit()):
                    if abbreviation_score(t, r["t"], r["d"], r["dl"], r["dn"], r["de"], periods, n, share) > ABBREVIATION:
                        out.append((r["lang"], "abbr", t, "", r["de"] + r["dw"] > 0.01 * r["d"]))
                if r["s"] > 4 and r["s"] > 0.1 * (r["t"] - r["l"]) or r["s"] and r["s"] / max(1, tot["s"]) > r["t"] / n and _llr(max(1, tot["s"]), r["t"], r["s"], n) > STARTER:
                    out.append((r["lang"], "start", t, "", None))
                if r["d"] > 2 and r["dn"] > 0.5 * r["d"] and t != "##":
                    out.append((r["lang"], "num", t, "", None))
                if r["l"] > 1 and r["s"] + r["d"] > 0:
                    out.append((r["lang"], "lower", t, "", None))
                if r["t"] >= 5 and (r["d"] or r["s"]):
                    out.append((r["lang"], "known", t, "", None))
            cols = list(zip(*out)) or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:4]), pa.array(cols[4], pa.bool_())], names=["lang", "kind", "a", "b", "flag"])

    schema = "lang string, kind string, a string, b string, flag boolean"
    lists = types.mapInArrow(choose, schema)
    second = types.select("lang", F.col("a").alias("b"), F.col("t").alias("nb"), "l", (F.col("s") + F.col("f")).alias("begins"))
    first = types.select("lang", "a", F.col("d").alias("na"))
    joined = counts.where("kind = 'c'").select("lang", "a", "b", "n").join(first, ["lang", "a"]).join(second, ["lang", "b"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                na, n = max(1, r["na"]), max(2, totals[r["lang"]]["n"])
                if r["n"] > 1 and r["begins"] <= 0.1 * r["n"] and r["n"] / na > r["nb"] / n and _llr(na, r["nb"], r["n"], n) > COLLOCATION:
                    out.append((r["lang"], "pair", r["a"], r["b"], None))
                    if r["l"] > 1:
                        out.append((r["lang"], "lower", r["b"], "", None))
            cols = list(zip(*out)) or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:4]), pa.array(cols[4], pa.bool_())], names=["lang", "kind", "a", "b", "flag"])

    return cut(_asked(cut(lists.unionByName(joined.mapInArrow(pairs, schema)))).distinct())


def train(docs: DataFrame) -> Model:
    """The model of all documents as one object, for lists that fit memory."""
    return learn(map(tuple, learned(docs).collect()))


def _asked(rows: DataFrame) -> DataFrame:
    """The learned rows that can decide anything.

    ``known`` and ``lower`` grow with the vocabulary, but the classifier asks for
    them only of types that are an abbreviation, a starter or the second of a pair
    in some language; of pairs it asks for those with a number alone.
    """
    rows = rows.where("kind <> 'pair' or a = '##'")
    kinds = rows.where("kind in ('abbr', 'start', 'pair')").select(F.when(F.col("kind") == "pair", F.col("b")).otherwise(F.col("a")).alias("a")).distinct()
    wide = F.col("kind").isin("known", "lower")
    return rows.where(~wide).unionByName(rows.where(wide).join(kinds, "a", "left_semi"))


def ends(text: str | None, lang: str | None, model: Model) -> list[int]:
    """Ends of the units of a text, in characters."""
    if not text or not text.strip():
        return []
    lang = lang or ""
    out: list[int] = []
    for a, b, whole in blocks(text):
        marks = [] if whole else _breaks(text, a, b, lang, model)
        at = a
        for e in [*marks, b]:
            piece = text[at:e].rstrip()
            if piece.strip():
                out.append(at + len(piece))
            at = e
    return sorted(set(out))


def candidates(text: str, a: int, b: int) -> Iterator[tuple]:
    """Marks of a block that may end a sentence and have text behind them: (match, gap)."""
    last = a + len(text[a:b].rstrip())
    for m in _CANDIDATE.finditer(text, a, b):
        end = m.end()
        if end >= last:
            continue
        mark = m["mark"]
        if mark is None or text[end].isspace():
            yield m, True
        elif mark[0] in "।॥؟۔" or mark[0] in "!?" and _WIDE_NEXT.match(text[end]):
            yield m, False


def _breaks(text: str, a: int, b: int, lang: str, model: Model) -> list[int]:
    out = []
    inside = _Inside(text, a, b)
    for m, gap in candidates(text, a, b):
        if m.start() >= inside.start and _is_break(text, inside, m, gap, b, lang, model):
            out.append(m.end())
            inside.restart(m.end())
    for m in _THAI.finditer(text, a, b):
        out.append(m.start())
    return sorted(set(out))


def _rest_at(text: str, m, b: int) -> int:
    """Where the text behind a mark goes on."""
    at = m.end()
    broken = False
    while at < b and (text[at].isspace() or text[at] in "\u200b\ufeff\u2060"):
        broken = broken or text[at] in "\r\n"
        at += 1
    # Marks at the start of the next line are no part of the text.
    if broken and (q := _LINE_MARK.match(text, at, b)) and at < q.end() < b:
        return q.end()
    return at


def _before(text: str, start: int, at: int):
    """The token that ends at a period."""
    return _BEFORE.match(text, max(start, at - 60), at)


def _is_break(text: str, inside: _Inside, m, gap: bool, b: int, lang: str, model: Model) -> bool:
    rest_at = _rest_at(text, m, b)
    rest = text[rest_at] if rest_at < b else ""
    lead = _skip(text, rest_at, b, _LEAD)
    kind = _kind(text[lead] if lead < b else "")
    closers = m["close"]
    mark = m["mark"] or m["wide"]
    quoted = closers.strip("*_`")
    if not quoted and inside.at(m.start()):
        return False
    if m["wide"]:
        if not closers:
            return True
        if not (rest_at > m.end()) and _CONTINUES.match(text, rest_at, b):
            return False
        return not rest or rest not in "，、；：,;:"
    if mark[0] in "।॥؟۔":
        return kind != "l" or not closers
    if rest and rest in "—–-,;:" and (rest in ",;:" or closers or text[rest_at + 1 : min(rest_at + 2, b)].isspace()) and (closers or mark[0] not in ".…" or rest in ",;:"):
        return False
    if "…" in mark or mark.count(".") >= 2 and set(mark) == {"."}:
        if kind == "l" or not gap:
            return False
        return kind != "n" or closers != ""
    if mark[0] in "!?‼⁇⁈⁉":
        if not gap:
            return not _CONTINUES.match(text, rest_at, b) or not closers
        if kind == "l" and (quoted or m.start() > 0 and text[m.start() - 1] in " \u00a0\u202f"):
            return False
        return not (kind == "l" and closers)
    # A period.
    if quoted:
        if kind == "l" and quoted[-1] not in ")]}":
            return False
        if kind == "l":
            return text[inside.first] in "([{"
        return True
    start = inside.start
    w = _before(text, start, m.start())
    if w is None:
        return True
    token, at = w[0], w.start()
    t = _type(token)
    if not t:
        return True
    if at > start and token[:1] != "-" and text[at - 1] in ".:/\\`@#$":
        return True  # the end of a name from code
    if t == "##":
        if kind not in ("l", "u", "o") or not (nxt := _next_word(text, rest_at, b)):
            return True
        nt = _type(nxt[0])
        if not model.after_number(lang, nt):
            return True
        return kind != "l" and (model.starter(lang, nt) or model.lowered(nt))
    single = len(t) == 1 and token.isalpha() and (token.isupper() or not token.islower())
    if kind == "n" and model.before_number(t):
        return False
    can_end = model.abbreviation(lang, t)
    if can_end is None and not single:
        return True
    if kind in ("l", "n") and not (kind == "l" and _code_ahead(text, lead, b) and can_end):
        return False
    if kind == "x" or kind == "":
        return bool(can_end)
    if single or not can_end or kind != "u":
        return False
    nxt = _next_word(text, rest_at, b)
    return model.starter(lang, _type(nxt[0]) if nxt else "")


def asked(text: str) -> set[str]:
    """The types of a text that its classification may ask the learned lists for."""
    out: set[str] = set()
    for a, b, whole in blocks(text):
        if whole:
            continue
        begins: list[int] = []  # where a sentence may begin
        for m, _ in candidates(text, a, b):
            if m["mark"] and m["mark"][0] == ".":
                if nxt := _next_word(text, _rest_at(text, m, b), b):
                    out.add(_type(nxt[0]))
                if w := _before(text, a, m.start()):
                    out.add(_type(w[0]))
                    for at in reversed(begins):
                        if at <= w.start():
                            break
                        out.add(_type(text[at : m.start()]))
            begins.append(m.end())
    return out - {""}


_PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "‚": "‘"}
_BRACKET = re.compile("[" + re.escape("".join(_PAIRS) + "".join(_PAIRS.values()) + '"') + "]")


class _Inside:
    """Whether a place lies in a quotation or bracket that began within its sentence and is closed later.

    Places are asked in order, and every character is looked at once: open
    brackets are kept from one place to the next.
    """

    def __init__(self, text: str, a: int, b: int):
        self.text, self.a, self.b = text, a, b
        self.ends: dict[str, int] = {}
        self.restart(a)

    def restart(self, start: int) -> None:
        """A new sentence begins at ``start``."""
        self.start = start
        self.first = _skip_space(self.text, start, self.b)
        self.upto = self.first
        self.quote = -1
        self.stack: list[tuple[str, int]] = []
        self.open: dict[str, int] = {}  # by what closes them, without one at the very start

    def _closes_after(self, c: str, at: int) -> bool:
        if c not in self.ends:
            self.ends[c] = self.text.rfind(c, self.a, self.b)
        return self.ends[c] >= at

    def at(self, at: int) -> bool:
        for m in _BRACKET.finditer(self.text, self.upto, at):
            c, k = m[0], m.start()
            if self.stack and c in self.stack[-1][0]:
                close, opened = self.stack.pop()
                if opened > self.first:
                    self.open[close] -= 1
            elif c in _PAIRS:
                self.stack.append((_PAIRS[c], k))
                if k > self.first:
                    self.open[_PAIRS[c]] = self.open.get(_PAIRS[c], 0) + 1
            elif c == '"':
                self.quote = -1 if self.quote >= 0 else k
        self.upto = max(at, self.upto)
        if self.quote > self.first and self._closes_after('"', at):
            return True
        return bool(self.open) and any(n and any(self._closes_after(x, at) for x in close) for close, n in self.open.items())


_CODE = re.compile(r"[\w./:]*(?:\(\))?")
_CODE_SIGN = re.compile(r"[_/]|\.\w|::|\(\)")


def _code_ahead(text: str, at: int, end: int) -> bool:
    """Whether a name from code stands here, which says nothing by its case."""
    m = _CODE.match(text, at, end)
    return bool(m and _CODE_SIGN.search(m[0]))


_OUT = "doc_id bigint, end_char int"


def _unit_rows(ids: list, langs: list, texts: list, model) -> pa.RecordBatch:
    """The units of some documents; ``model``: a model for each by its position."""
    out, at = [], []
    for k, (i, lang, text) in enumerate(zip(ids, langs, texts)):
        e = ends(text, lang, model(k))
        out += [i] * len(e)
        at += e
    return pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(at, pa.int32())], names=["doc_id", "end_char"])


def units(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, end_char``: one row per sentence unit of every document.

    ``docs``: doc_id, lang, text.  Null or blank texts have no units; a null or
    wrong language falls back on what all languages together say of a token; an
    empty table has none.  The whole text is read.  Learned lists that fit
    ``MAX_HELD`` rows are held by the workers, others are joined.
    """
    if model is None:
        lists = learned(docs)
        if lists.count() > MAX_HELD:
            return _units_joined(docs, lists)
        model = learn(map(tuple, lists.collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _unit_rows(*(b.column(n).to_pylist() for n in ("doc_id", "lang", "text")), lambda _: model)

    return spread(docs.select("doc_id", "lang", "text")).mapInArrow(run, _OUT)


def _units_joined(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """``units`` with lists of any size: each document gets what its own tokens ask for."""
    texts = cut(spread(docs.select("doc_id", "lang", "text").where("length(trim(text)) > 0")).withColumn("at", F.monotonically_increasing_id()))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, words = [], []
            for k, text in zip(b.column("at").to_pylist(), b.column("text").to_pylist()):
                found = asked(text)
                at += [k] * len(found)
                words += found
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(words, pa.string())], names=["at", "word"])

    # One row a word with what every language says of it, which is a few entries; a word that very many documents ask for is split by salt.
    said = lists.groupBy(F.when(F.col("kind") == "pair", F.col("b")).otherwise(F.col("a")).alias("word")).agg(F.collect_list(F.struct("lang", "kind", "a", "b", "flag")).alias("said"))
    salted = said.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1))))
    wanted = texts.select("at", "text").mapInArrow(ask, "at bigint, word string").withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(_SALT)).cast("int"))
    got = wanted.join(salted, ["word", "salt"]).groupBy("at").agg(F.flatten(F.collect_list("said")).alias("said"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("said").to_pylist()
            yield _unit_rows(*(b.column(n).to_pylist() for n in ("doc_id", "lang", "text")), lambda k: learn(tuple(x.values()) for x in own[k] or ()))

    return texts.join(got, "at", "left").select("doc_id", "lang", "text", "said").mapInArrow(run, _OUT)
