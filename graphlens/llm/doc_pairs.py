"""Functions paired with their documentation (problem 3)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..parse import LANGUAGES
from ..parse.base import Lines
from ..session import cut, cut_counting, spread
from .syntax import checked

# What stands in place of documentation, in several languages.
PLACEHOLDERS = (
    r"(?:todo|fixme|xxx|hack|wip|tbd|tba|t\.b\.d|t\.b\.a)\b[^.!?]*",
    r"n/?a", r"none", r"null", r"empty", r"nothing(?: here)?(?: yet)?", r"foo|bar|baz|asdf|test", r"\W*",
    r"(?:the |a )?(?:doc(?:s|umentation|string)?|description|summary|comment)s? (?:(?:is |are )?(?:to follow|to come|to be (?:done|added|written)|pending|missing|needed|goes here|here|will follow|coming soon))",
    r"(?:no|missing|add|insert|write|put|needs?|lacks?|without|empty)(?: (?:a|an|the|some|your|more|any))?(?: (?:doc(?:s|umentation|string)?s?|description|summary|comment|text))(?: (?:here|yet|provided|available|given|needed|for .{0,40}|please|goes here))*(?:,? please)?",
    r"(?:describe|document|explain)(?: (?:this|the|me))?(?: (?:function|method|class|item|here|properly))?(?: (?:here|later|properly))?",
    r"(?:un|not (?:yet )?)documented(?: yet)?", r"self[- ]?explanatory", r"as the name (?:says|suggests|implies)", r"(?:see|what) the name(?: says)?", r"the name says it(?: all)?", r"obvious(?:ly)?",
    r"auto[- ]?generated(?: (?:method|function|constructor|class))?(?: (?:stub|comment|documentation|javadoc))?.*", r"generated (?:method )?stub",
    r"lorem ipsum.*", r"placeholder\b.*", r"(?:<|\[|_|\{)+\s*(?:description|summary|docs?|documentation|type|insert .*)\s*(?:>|\]|_|\})+", r"_?summary_?", r"_?description_?",
    r"kommentar fehlt(?: noch)?", r"dokumentation (?:fehlt|folgt).*", r"beschreibung (?:fehlt|folgt).*", r"noch zu dokumentieren", r"à compléter", r"à (?:faire|documenter|remplir)", r"documentation à venir",
    r"описание отсутствует", r"нет описания", r"описание (?:будет )?(?:позже|добавить).*", r"документация отсутствует", r"без описания", r"sin (?:documentar|descripción|documentación)", r"por (?:hacer|documentar|completar)", r"pendiente(?: de documentar)?", r"da (?:completare|documentare)",
    r"待补充|暂无(?:说明|描述|注释)?|无|待完善|未完成|补充说明|说明待补|文档待补", r"説明なし|未記入|ドキュメント(?:なし|未作成)|後で書く|説明は後で|未文書化|要追記",
    # References elsewhere.
    r"(?:see|cf\.?|refer to|compare|siehe|voir|см\.?|véase)\b.{0,60}", r"(?:same|like|ditto|idem)(?: (?:as|to|for))?(?: (?:the )?(?:above|below|before|previous|parent|super|base|other|one|overload|\S+\(\)|\S+))*", r"(?:copied|inherited) from .*", r"\{?@?inherit ?doc\}?", r"overrides? .{0,40}", r"wie oben", r"同上|見よ|参照|上記(?:と同じ|参照)?|参见.*|同前",
    # Notes on authors, versions and tools.
    r"(?:@?author|@?authors|written by|created by|maintainer|maintained by|owner|contact|@?since|@?version|@?date|@?copyright|copyright|licen[cs]e|reviewed by|last (?:changed|modified|edit(?:ed)?|updated))\b.{0,60}", r"(?:added|introduced|available|new|changed|deprecated|removed) (?:in|since)(?: version)? v?[\d.]+.{0,30}",
    r"(?:noqa|nosec|nodoc|pylint|mypy|pyright|flake8|ruff|isort|fmt|type|pragma|eslint|ignore|nolint|clippy|coverage|dartfmt|ignore_for_file|rustfmt|yapf|black|skipcq|sonar|istanbul|jscpd|doctest|cspell|spell-checker)\b\s*(?::.*|$)", r"nodoc|no-?doc|internal|private|hidden|deprecated|experimental|unstable|legacy|noop|no-op", r"(?:-\*-|vim:|vi:|ex:).*", r"doc(?:test)?: ?\+?\w+",
)
_PLACEHOLDER = re.compile(r"(?:" + "|".join(PLACEHOLDERS) + r")\W*", re.I | re.S)
_SECTION = re.compile(
    r"(?:#+\s*)?(?:arguments?|args|param(?:eter)?s?|other parameters|keyword (?:arguments?|args)|attributes|returns?|return values?|yields?|raises?|throws|exceptions?|errors?|panics?|safety|examples?|see also|notes?|references|type param(?:eter)?s|signature|since|version|authors?)\s*:?\s*",
    re.I,
)
_TAG = re.compile(r"\s*(?:[@\\:](?:param|arg|argument|tparam|type|return|returns|rtype|throws|raises|raise|exception|see|since|author|version|deprecated|link|override|inheritdoc|date|copyright|todo|nodoc|template|macro|category|ivar|cvar|var|keyword|yields?|ytype)\b.*)", re.I | re.S)
_BRACES = re.compile(r"\{@?\w+[^{}]*\}|<[^<>\n]*>|\[[^\[\]\n]*\](?:\([^()\n]*\))?")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯฀-๿]")
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+|(?<=[。！？])")
_CALL = re.compile(r"\S+\([^()]*\)")
# Words that carry no information of their own.
_WEAK = frozenset("a an and are as at be by for from in into is it its of on or that the this to with function method fn def returns return args arguments parameter parameters param value values none null void self type types name signature see note notes".split())


def clean_doc(doc: str | None) -> str:
    """Documentation without comment marks, quotes and decoration."""
    if not doc:
        return ""
    out = []
    for line in re.split(r"\r\n|\n|\r", doc):
        s = line.strip()
        s = re.sub(r"^(?:///+|//!+|/\*[*!]+|[rRuU]?\"\"\"|[rRuU]?''')\s?", "", s)
        s = re.sub(r"(?:\*+/|\"\"\"|''')$", "", s)
        s = re.sub(r"^\*+(?=\s|$)", "", s) if not re.match(r"\* +`", s) else s
        out.append(s.strip() if s.strip() else "")
    return "\n".join(out).strip("\n")


def _body(text: str) -> list[str]:
    """The lines outside tags and sections on parameters and results."""
    keep: list[str] = []
    lines = text.split("\n")
    skip = False
    for n, s in enumerate(lines):
        if not s:
            keep.append("")
            continue
        nxt = lines[n + 1] if n + 1 < len(lines) else ""
        if _SECTION.fullmatch(s) and (s.startswith("#") or s.endswith(":") or re.fullmatch(r"[-=~]{3,}", nxt) or not nxt):
            skip = True
            continue
        if skip and (re.match(r"[-*+] |`|[-=~]{2,}$|[\w*]+\s*(?:\([^)]*\))?\s*:|[\w*]+ : |\w+$", s) or s.startswith("@") or s.startswith(":")):
            continue
        skip = False
        if _TAG.fullmatch(s) or re.fullmatch(r"[-*+]\s+`[^`]*`\s*(?:[-:].*)?", s):
            continue
        keep.append(s)
    return keep


def _parts(name: str) -> set[str]:
    """The words of a name and the name itself without separators."""
    words = [w.lower() for x in re.split(r"[_\W\d]+", name) for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+", x)]
    return {*words, "".join(words)} - {""}


def _stem(word: str) -> str:
    """A word without the endings that a sentence gives the words of a name."""
    for end in ("ing", "ed", "es", "s", "e"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)]
    return word


_WEAK_STEMS = frozenset(_stem(w) for w in _WEAK)


def informative(doc: str | None, name: str = "", params: tuple[str, ...] = (), signature: str | None = None) -> bool:
    """Whether documentation says something beyond name, parameters and signature.

    That is any word, however short the text, that is neither a word of theirs
    in any ending nor one that carries nothing of its own; or text in a script
    without spaces.
    """
    if not doc or doc.isspace():
        return False
    text = _BRACES.sub(" ", "\n".join(_body(clean_doc(doc))))
    found: set[str] = set()
    wide = 0
    for para in text.split("\n\n"):
        flat = " ".join(x for s in para.split("\n") if not _PLACEHOLDER.fullmatch(x := " ".join(s.split())))
        if not flat:
            continue
        for s in _SENTENCE.split(flat):
            s = s.strip(" \t*_`#-=~.!?:;\"'")
            if not s or _PLACEHOLDER.fullmatch(s):
                continue
            if "(" in s:
                s = _CALL.sub(" ", s)
            if name and s.startswith(name) and re.fullmatch(r"\s*:\s*\w+(?:\s*,\s*\w+)*", s[len(name) :]):
                continue  # the signature once more
            if not s.isascii():
                wide += len(_CJK.findall(s))
            found.update(_WORD.findall(s.lower()))
    if wide > 1:
        return True
    found = {w for w in found if len(w) > 1 and w not in _WEAK}
    if not found:
        return False
    known = _parts(name).union(*map(_parts, params), _parts(signature) if signature else ())
    stems = {_stem(w) for w in known}
    return any(w not in known and (stem := _stem(w)) not in stems and stem not in _WEAK_STEMS for w in found)


_SCHEMA = "file_id bigint, repo string, path string, line_start int, name_at int, name string, owner string, bases array<string>, signature string, params array<string>, doc string, informative boolean, language string, body string"
_ARROW = pa.schema([
    ("file_id", pa.int64()), ("repo", pa.string()), ("path", pa.string()), ("line_start", pa.int32()), ("name_at", pa.int32()), ("name", pa.string()), ("owner", pa.string()), ("bases", pa.list_(pa.string())),
    ("signature", pa.string()), ("params", pa.list_(pa.string())), ("doc", pa.string()), ("informative", pa.bool_()), ("language", pa.string()), ("body", pa.string()),
])


def functions_of(path: str | None, content: bytes | None, whole: bool = True) -> list[tuple]:
    """Every function of one valid file: the fields of ``_SCHEMA`` after ``path``.

    A class with bases is a row without a name, as one without methods still
    passes documentation on.  Without ``whole`` signature and body stay null, as
    do documentation that says nothing and rows that neither have nor seek any.
    """
    language, unit, text, errors = checked(path, content)
    if errors or not language:
        return []
    lines = Lines(text)
    bases = {}
    for it in unit.items:
        if it.kind in ("struct", "trait", "enum") and it.bases:
            bases[it.name] = list(it.bases)
        elif it.kind == "impl" and it.bases:
            bases[it.name] = list(it.bases)
    out = []
    for it in unit.items:
        if it.kind in ("struct", "trait", "enum", "impl") and it.bases:
            out.append((lines.of(it.name_at), it.name_at, None, it.name, list(it.bases), None, [], None, False, language, None))
        if it.kind != "function":
            continue
        if not whole:
            says = bool(it.doc) and informative(it.doc, it.name, it.params)
            above = bases.get(it.parent or "", [])
            if says or above:
                out.append((lines.of(it.name_at), it.name_at, it.name, it.parent, above, None, [], it.doc if says and it.parent else None, says, language, None))
            continue
        signature = " ".join(text[it.start if it.start >= 0 else it.name_at : it.body if it.body > 0 else it.end].split())
        body = text[it.body if it.body > 0 else it.name_at : it.end]
        out.append((lines.of(it.name_at), it.name_at, it.name, it.parent, bases.get(it.parent or "", []), signature, list(it.params), it.doc, informative(it.doc, it.name, it.params), language, body))
    return out


def extract_functions(files: DataFrame, whole: bool = True) -> DataFrame:
    """Every function of the files that parse, documented or not, and their classes with bases (``name`` null).

    Without ``whole`` only what the resolution of documentation needs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

        for b in batches:
            rows = []
            ids, repos, paths, contents = (b.column(n) for n in ("file_id", "repo", "display_path", "content"))
            for k in range(b.num_rows):
                path = paths[k].as_py()
                rows += [(ids[k].as_py(), repos[k].as_py(), path, *f) for f in functions_of(path, contents[k].as_py(), whole)]
                if len(rows) >= 5000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

    return spread(files.select("file_id", "repo", "display_path", "content")).mapInArrow(run, _SCHEMA)


def latest_atoms(atoms: DataFrame, *more: str) -> DataFrame:
    """Function atoms, of each (file_id, id) the one with the highest ``seq``, with the columns ``more``.

    Rows that can't be a case travel as bare keys: their text is dropped before
    the shuffle, but they still replace what came before them.
    """
    by = Window.partitionBy("file_id", "id").orderBy(F.desc("seq"))
    case = (F.col("kind") == "function") & (F.length(F.trim("doc")) > 0)
    keep = lambda c: F.when(case, F.col(c)).alias(c)
    slim = atoms.select("file_id", "id", "seq", keep("line_start"), keep("name"), keep("doc"), keep("signature"), *(keep(c) for c in more))
    return slim.withColumn("_n", F.row_number().over(by)).where("_n = 1 and doc is not null").select("file_id", "line_start", "name", "doc", "signature", *more)


def _said(b: pa.RecordBatch) -> list[bool]:
    docs, names, sigs = (b.column(n).to_pylist() for n in ("doc", "name", "signature"))
    return [informative(d, n or "", tuple(re.findall(r"\w+", (s or "").partition("(")[2]))) for d, n, s in zip(docs, names, sigs)]


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.select(["file_id", "line_start"]).filter(pa.array(_said(b), pa.bool_()))


def documented_atoms(atoms: DataFrame) -> DataFrame:
    """``file_id, line_start`` of the latest function atoms whose documentation says something."""
    return latest_atoms(atoms).mapInArrow(_judge, "file_id bigint, line_start int")


def resolved(fns: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Documentation of every function: (own, inherited).

    ``fns``: rows of ``extract_functions`` with ``at``, which names a row.  Both
    have ``at``, ``d`` (path, line, name_at and doc of the function that said it)
    and ``origin``, own also ``file_id`` and ``line_start``.  A method without own documentation takes that of the
    nearest method of the same name it overrides, in the same repo and language:
    its class is joined with its base classes level by level until nothing is
    left to resolve.  A base name that several classes of a repo carry is
    followed through each; the nearest level wins, ties by path and line.  A
    method meets each base once, so that a cycle of classes ends.
    """
    said = F.struct("path", F.col("line_start").alias("line"), "name_at", "doc").alias("d")
    own = fns.where("informative").select("at", "file_id", "line_start", said, F.lit("own").alias("origin"))
    owner = F.regexp_replace("owner", r".* for |<.*", "")
    docs = fns.where("informative and owner is not null").select("repo", "language", "name", owner.alias("base"), said).groupBy("repo", "language", "name", "base").agg(F.min("d").alias("d"))
    up = fns.where("owner is not null and size(bases) > 0").select("repo", "language", owner.alias("base"), F.explode("bases").alias("next")).distinct()
    key = ["repo", "language", "name", "base"]
    # ``at``: a row of ``fns``, so that two methods of one line stay apart; text joins at the end only.
    open_, more = cut_counting(fns.where("name is not null and not informative and owner is not null and size(bases) > 0").select("at", "repo", "language", "name", F.explode("bases").alias("base")).distinct())
    seen = open_.select("at", "base")
    hits = None
    while more:
        hit = cut(open_.join(docs, key).groupBy("at").agg(F.min("d").alias("d")))
        hits = hit if hits is None else hits.unionByName(hit)
        left = open_.join(hit.select("at"), "at", "left_anti")
        above = left.join(up, ["repo", "language", "base"]).drop("base").withColumnRenamed("next", "base").distinct()
        open_, more = cut_counting(above.join(seen, ["at", "base"], "left_anti"))
        seen = cut(seen.unionByName(open_.select("at", "base")))
    return own, None if hits is None else hits.withColumn("origin", F.lit("inherited"))


def documented(files: DataFrame) -> DataFrame:
    """``file_id, line_start, origin``: every function of ``files`` that has documentation in the end."""
    fns = cut(extract_functions(files, whole=False).withColumn("at", F.monotonically_increasing_id()))
    own, inherited = resolved(fns)
    out = own.select("file_id", "line_start", "origin")
    return out if inherited is None else out.unionByName(fns.join(inherited, "at").select("file_id", "line_start", "origin"))


def found(files: DataFrame, atoms: DataFrame) -> DataFrame:
    """``file_id, line_start`` of every function whose documentation is its own.

    Null docs, names and signatures are allowed; a file that does not parse has
    no cases; of repeated atoms the highest ``seq`` counts, whether or not it is
    still a documented function.
    """
    return documented(files).where("origin = 'own'").select("file_id", "line_start").unionByName(documented_atoms(atoms))


def _informative(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.filter(pa.array(_said(b), pa.bool_()))


def atom_pairs(atoms: DataFrame) -> DataFrame:
    """The pairs of the latest function atoms: their sources were not kept, so that ``body`` is null."""
    got = latest_atoms(atoms, "repo", "file_path").mapInArrow(_informative, "file_id bigint, line_start int, name string, doc string, signature string, repo string, file_path string")
    language = F.create_map(*(F.lit(x) for e, (name, _) in LANGUAGES.items() for x in (e, name)))
    return got.select(
        "file_id", "line_start", "repo", language[F.lower(F.element_at(F.split("file_path", r"\."), -1))].alias("language"), "name", "signature", F.lit(None).cast("string").alias("body"), "doc", F.lit("own").alias("origin")
    )


def pairs(files: DataFrame, atoms: DataFrame | None = None) -> DataFrame:
    """Code and description pairs of files and atoms, with inherited documentation resolved.

    Methods that stay without documentation are dropped (see ``resolved``).
    ``origin`` tells own from inherited.  Atoms have no bases and no ``body``.
    """
    fns = cut(extract_functions(files).withColumn("at", F.monotonically_increasing_id()))
    result = ["file_id", "line_start", "repo", "language", "name", "signature", "body", "doc", "origin"]
    _, inherited = resolved(fns)
    out = fns.where("informative").withColumn("origin", F.lit("own")).select(*result)
    if inherited is not None:
        out = out.unionByName(fns.drop("doc").join(inherited, "at").withColumn("doc", F.col("d.doc")).select(*result))
    return out if atoms is None else out.unionByName(atom_pairs(atoms))
