"""Generated, minified, copied and data files among source files (problem 2).

Linear support-vector classifiers over three views teach each other.  One sees a
file's text as hashed character n-grams with the comments at its head and foot
masked, one its path as hashed components, and one those comments alone, line by
line, again as hashed character n-grams.  Notices and the shape of the text give
labels and decide nothing: a file is a case if a classifier says so, unless one
of its comments is classified as saying that it was taken over by hand.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..parse.base import decode_leniently, unify
from ..session import cut, spread

#: Most rows that the classifiers are fitted on, taken by a hash of the content.
SAMPLE_ROWS = 3000
#: Most comment lines of one file in that sample, those with the least hash.
SAMPLE_LINES = 200
#: Hash buckets of text n-grams, of their shapes, of path components and of comment lines.
RAW, SHAPE, PATH, LINE = 4096, 4096, 1 << 18, 4096
_N_RAW, _N_SHAPE = 5, 7
#: Share of repositories (in 256ths) kept for validation.
_VALIDATION = 64

# Notices of generators and of copied code, at the start of a comment.
GENERATED_NOTICE = re.compile(
    r"^\W*(?:@generated\b|<auto-?generated|auto-?generated\b(?! (?:method|function|class|constructor) stub)|(?:this (?:file|code|module) (?:is|was|has been) )?(?:automatically |auto-?)?(?:generated|created|produced|written|emitted) (?:automatically |by machine )?(?:by|from|with|using)\b"
    r"|this (?:file|code|module) (?:is|was|has been) (?:created|generated|produced|written) automatically|do not (?:edit|modify|change)\b|code (?:generated|produced) by\b|generated code\b|machine[- ](?:written|generated)\b|autogenerated\b"
    r"|dieses? (?:modul|datei) (?:wird|wurde) .*(?:erzeugt|generiert)|automatisch (?:erzeugt|generiert)|(?:ce )?fichier généré|généré (?:automatiquement )?par|本文件由.*生成|.*自动生成|(?:このファイルは)?.*自動生成|(?:archivo|fichero) generado|generado (?:automáticamente )?por|(?:этот )?файл (?:сгенерирован|создан автоматически)|автоматически (?:создан|сгенерирован))",
    re.I,
)
COPIED_NOTICE = re.compile(
    r"^\W*(?:vendored from\b|copied (?:verbatim|unchanged|as is)\b|(?:verbatim|unmodified) copy\b|part of [^,]+, \(c\) .*(?:imported|copied|taken|included) (?:unchanged|verbatim|as is)|upstream: .*local changes: none|imported (?:unchanged|verbatim) from\b|bundled (?:copy )?(?:of|from)\b"
    r"|[\w.-]+ v?\d[\w.]*\s*[-–:,]\s*copyright\b.*(?:used|licen[sc]ed|distributed) under\b|[\w.-]+: see licen[sc]e-[\w.-]+ for\b)",
    re.I,
)
TAKEN_OVER = re.compile(r"^\W*(?:once|originally|initially|formerly|first) (?:auto-?)?(?:generated|created|produced|vendored|copied)\b.*(?:by hand|manually|edit freely|maintained|hand-(?:written|edited))", re.I)
# Conventional directories and suffixes, as seeds of the path classifier.
COPIED_DIRS = "vendor third_party thirdparty third-party _vendor node_modules external deps bower_components site-packages Pods".split()
GENERATED_DIRS = "generated __generated__ gen autogen _generated generated-src generated_src".split()
SUFFIXES = "pb2 pb2_grpc g freezed mocks gr pb pbenum pbjson gen generated min bundle".split()

_COMMENT = re.compile(r"\s*(?:#(?!\[|!\[)|//|/\*|\*|<!--)")
_DOC = re.compile(r"\s*(?:///(?!/)|//!|/\*\*(?!/)|/\*!)")
_LITERAL = re.compile(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|\b0x[0-9a-fA-F_]+,?|-?\b\d[\d._eE]*,?")


def notice_lines(text: str) -> tuple[list[str], str]:
    """Ordinary comment lines at the head and the foot of a file, and the rest."""
    lines = text.split("\n")
    a, b = 0, len(lines)
    while a < b and (not lines[a].strip() or _COMMENT.match(lines[a]) and not _DOC.match(lines[a])):
        a += 1
    while b > a and (not lines[b - 1].strip() or _COMMENT.match(lines[b - 1]) and not _DOC.match(lines[b - 1])):
        b -= 1
    return [x for x in lines[:a] + lines[b:] if x.strip()], "\n".join(lines[a:b])


def comment_lines(text: str) -> list[str]:
    return [x for x in text.split("\n") if _COMMENT.match(x)]


def _bucket(s: str, n: int) -> int:
    return zlib.crc32(s.encode("utf-8", "replace")) % n


def path_tokens(path: str | None) -> list[str]:
    """Directories, with a mark where another one follows, and suffixes."""
    parts = [x for x in re.split(r"[/\\]+", path or "") if x not in ("", ".")]
    if not parts:
        return []
    dirs, base = parts[:-1], parts[-1]
    out = []
    for k, d in enumerate(dirs):
        out.append(f"d:{d.lower()}")
        if k + 1 < len(dirs):
            out.append(f"over:{d.lower()}")
        if re.search(r"[-@]\d+(?:\.\d+)+$", d):
            out.append("versioned")
    stem, *exts = base.lower().split(".")
    out += [f"x:{'.'.join(exts[k:])}" for k in range(len(exts))]
    words = re.split(r"[-_]", stem)
    out += [f"s:{'_'.join(words[k:])}" for k in range(1, len(words)) if not re.search(r"\d", words[k]) or words[k].startswith("pb")]
    if len(words) > 1 and "-" in stem:
        out.append(f"-:{stem.rsplit('-', 1)[-1]}")
    return out


def path_buckets(path: str | None) -> np.ndarray:
    return np.unique(np.array([_bucket(t, PATH) for t in path_tokens(path)], np.int64))


def path_score(w: np.ndarray, path: str | None) -> float:
    return float(w[path_buckets(path)].sum() + w[-1])


def _gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams of a code array, in order."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    wide = codes.astype(np.uint64)
    h = np.zeros(len(codes) - n + 1, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x100000001B3) + wide[k : len(codes) - n + 1 + k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _grams(codes: np.ndarray, n: int, size: int) -> np.ndarray:
    """Counts of hashed n-grams of a code array."""
    return np.bincount((_gram_hashes(codes, n) % np.uint64(size)).astype(np.int64), minlength=size).astype(np.float32)


_SHAPES = np.zeros(256, np.uint8)
for _c in range(256):
    _ch = chr(_c)
    _SHAPES[_c] = ord("a") if _ch.islower() else ord("A") if _ch.isupper() else ord("0") if _ch.isdigit() else ord("u") if _c > 126 else ord(" ") if _ch in "\t\r\f" else _c
_DIGITS = np.arange(256, dtype=np.uint8)
_DIGITS[ord("0") : ord("9") + 1] = ord("0")


def text_vector(body: str) -> np.ndarray:
    """Hashed n-grams of the whole text and of its shape, each part of length one."""
    raw = np.frombuffer(body.encode("utf-8", "replace"), np.uint8)
    parts = []
    for codes, n, size in ((_DIGITS[raw], _N_RAW, RAW), (_SHAPES[raw], _N_SHAPE, SHAPE)):
        c = np.sqrt(_grams(codes, n, size))
        parts.append(c / (np.linalg.norm(c) or 1))
    return np.concatenate(parts)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER[ord("0") : ord("9") + 1] = ord("0")
_STARTS = (6, 9, 13, 18)


def line_key(line: str) -> str:
    """A comment line without its mark and with all digits alike."""
    return re.sub(r"\d", "0", re.sub(r"^\W+", "", line.strip()))


def line_grams(key: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a comment line, with its beginnings: (buckets, weights), of length one."""
    raw = _LOWER[np.frombuffer(("\x01" + key).encode("utf-8", "replace"), np.uint8)]
    found = [_gram_hashes(raw, n) % np.uint64(LINE) for n in (3, 4, 5)]
    starts = [zlib.crc32(raw[:n].tobytes()) % LINE for n in _STARTS if len(raw) >= n]
    at, n = np.unique(np.concatenate([*found, np.array(starts, np.uint64), np.array(starts, np.uint64)]), return_counts=True)
    v = np.sqrt(n.astype(np.float32))
    return at.astype(np.int64), v / (np.linalg.norm(v) or 1)


@dataclass
class Evidence:
    """What labels a file for the fit; none of it decides about a file."""

    notice: bool  # a notice of a generator or of copied code
    taken_over: bool
    by_path: bool  # a conventional directory or suffix
    by_shape: bool  # squeezed code, one block of data, or one line over and over


def evidence(path: str | None, text: str) -> Evidence:
    """What can be said of a file without a classifier; blank files say nothing."""
    if not text.strip():
        return Evidence(False, False, False, False)
    notes, body = notice_lines(text)
    over = any(TAKEN_OVER.match(x) for x in comment_lines(text))
    notice = any(says_notice(x) for x in notes)
    tokens = set(path_tokens(path))
    by_path = any(f"over:{d.lower()}" in tokens for d in COPIED_DIRS) or any(f"d:{d.lower()}" in tokens for d in GENERATED_DIRS) or any((x := t[2:].split(".")[0]) in SUFFIXES and (t[0] == "x" or len(x) > 2) for t in tokens if t[:2] in ("x:", "s:", "-:"))
    code = [x for x in body.split("\n") if x.strip()]
    size = max(1, len(body))
    dense = len(code) > 0 and (sum(map(len, code)) / len(code) > 150 or size > 400 and sum(c.isspace() for c in body) / size < 0.06)
    data = sum(len(m) for m in _LITERAL.findall(body)) / size > 0.6 and size > 300
    shapes: dict[str, int] = {}
    for x in code:
        k = re.sub(r"[A-Za-z]+", "a", re.sub(r"\d+", "0", x))
        shapes[k] = shapes.get(k, 0) + 1
    same = len(code) >= 8 and max(shapes.values(), default=0) / len(code) > 0.45
    return Evidence(notice, over, by_path, dense or data or same)


def says_notice(line: str) -> bool:
    return bool(GENERATED_NOTICE.match(line) or COPIED_NOTICE.match(line)) and not TAKEN_OVER.match(line)


class Rows:
    """Sparse rows: the buckets that are not zero, and their values."""

    def __init__(self, at: list[np.ndarray], value: list[np.ndarray]):
        self.at, self.value = at, value

    def of(self, mask: np.ndarray) -> Rows:
        keep = np.flatnonzero(mask).tolist()
        return Rows([self.at[k] for k in keep], [self.value[k] for k in keep])

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.array([float(v @ w[a] + w[-1]) for a, v in zip(self.at, self.value)], np.float32)


def train_svm(x: Rows, size: int, y: np.ndarray, c: float = 4.0, epochs: int = 25, positive: float = 1.0) -> np.ndarray:
    """A linear SVM (squared hinge) by dual coordinate descent; the last of ``size + 1`` weights is the bias.

    ``positive``: how much more an error on a positive row costs.
    """
    n = len(y)
    w = np.zeros(size + 1, np.float32)
    alpha = np.zeros(n)
    diag = np.where(y > 0, 0.5 / (c * positive), 0.5 / c)
    q = np.array([float(v @ v) + 1 for v in x.value]) + diag
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(n).tolist():
            at, v = x.at[i], x.value[i]
            g = y[i] * float(v @ w[at] + w[-1]) - 1 + diag[i] * alpha[i]
            new = max(alpha[i] - g / q[i], 0.0)
            if new != alpha[i]:
                step = np.float32((new - alpha[i]) * y[i])
                w[at] += step * v
                w[-1] += step
                alpha[i] = new
    return w


def score(w: np.ndarray, v: np.ndarray) -> float:
    return float(v @ w[:-1] + w[-1])


@dataclass
class Model:
    text: np.ndarray
    path: np.ndarray
    note: np.ndarray  # comment lines that say that nobody wrote the file here
    over: np.ndarray  # comment lines that say that somebody took it over
    text_at: float
    path_at: float
    report: dict


def _threshold(scores: np.ndarray, truth: np.ndarray, precision: float) -> float:
    """The least cut, 0 at least, from which on labels are this precise."""
    order = np.argsort(-scores)
    best = None
    hits = np.cumsum(truth[order] > 0)
    for k in range(len(order)):
        if scores[order[k]] <= 0:
            break
        if hits[k] / (k + 1) >= precision:
            best = float(scores[order[k]])
    positive = scores[scores > 0]
    if best is None:
        return 0.0 if not len(positive) else float(positive.max())
    rest = scores[scores < best]
    return max(0.0, (best + float(rest.max())) / 2 if len(rest) else 0.0)


@dataclass
class Sample:
    """One file of the fit, without its text."""

    repo: str | None
    path: str | None
    notice: bool
    taken_over: bool
    by_path: bool
    by_shape: bool
    blank: bool
    at: np.ndarray  # buckets of its text vector that are not zero
    value: np.ndarray
    lines: list[str]  # comment lines, at most SAMPLE_LINES


def sample(repo: str | None, path: str | None, content: bytes | None) -> Sample:
    text = unify(decode_leniently(content))
    e = evidence(path, text)
    body = notice_lines(text)[1] if text.strip() else ""
    v = text_vector(body)
    at = np.flatnonzero(v)
    lines = list({x: None for x in comment_lines(text) if line_key(x)})
    if len(lines) > SAMPLE_LINES:
        lines = sorted(lines, key=lambda x: zlib.crc32(x.encode("utf-8", "replace")))[:SAMPLE_LINES]
    return Sample(repo, path, e.notice, e.taken_over, e.by_path, e.by_shape, not body.strip(), at.astype(np.int32), v[at], lines)


def fit(rows: list[tuple[str, str, bytes]]) -> Model:
    """Train on rows (repo, path, content)."""
    return fit_samples([sample(*r) for r in rows])


def _held(repo: str | None) -> bool:
    return zlib.crc32((repo or "").encode()) % 256 < _VALIDATION


def _fit_lines(rows: list[Sample], report: dict) -> tuple[np.ndarray, np.ndarray]:
    """Classifiers of distinct comment lines; those of held-out repositories alone validate them."""
    lines: dict[str, tuple[str, bool]] = {}
    for r in rows:
        for x in r.lines:
            k = line_key(x)
            lines[k] = (x, _held(r.repo) and lines.get(k, (x, True))[1])
    out = []
    if not lines:
        none = np.zeros(LINE + 1, np.float32)
        none[-1] = -1
        return none, none
    x = Rows(*map(list, zip(*(line_grams(k) for k in lines))))
    held = np.array([h for _, h in lines.values()], bool)
    for name, said in (("note", says_notice), ("over", lambda t: bool(TAKEN_OVER.match(t)))):
        y = np.array([1.0 if said(t) else -1.0 for t, _ in lines.values()])

        def train(rows: np.ndarray) -> np.ndarray:
            if (y[rows] > 0).any() and (y[rows] < 0).any():
                return train_svm(x.of(rows), LINE, y[rows], 1.0, positive=float((y[rows] < 0).sum() / (y[rows] > 0).sum()))
            w = np.zeros(LINE + 1, np.float32)
            w[-1] = -1
            return w

        hit = x.of(held).scores(train(~held)) > 0
        both, true = int((hit & (y[held] > 0)).sum()), int((y[held] > 0).sum())
        report[f"{name}_recall"] = both / true if true else None
        report[f"{name}_precision"] = both / int(hit.sum()) if hit.any() else None
        out.append(train(np.ones(len(y), bool)))  # validated apart, then fitted on all lines
    return out[0], out[1]


def fit_samples(rows: list[Sample]) -> Model:
    """Train all classifiers; thresholds and the report come from repositories that none has seen."""
    report: dict = {}
    note_w, over_w = _fit_lines(rows, report)
    keep = [r for r in rows if not r.blank]
    held = np.array([_held(r.repo) for r in keep], bool)
    tv = Rows([r.at for r in keep], [r.value for r in keep])
    pb = [path_buckets(r.path) for r in keep]
    by_path = np.array([r.by_path and not r.taken_over for r in keep], bool)
    by_shape = np.array([r.by_shape for r in keep], bool)
    notice = np.array([r.notice and not r.taken_over for r in keep], bool)
    over = np.array([r.taken_over for r in keep], bool)
    copied = np.array([any(f"over:{d.lower()}" in path_tokens(r.path) for d in COPIED_DIRS) for r in keep], bool)

    # Text: labels from path and shape; copies look like ordinary code and stay out.
    ty = np.where(by_shape | by_path & ~copied, 1.0, -1.0)
    use = ~(copied | notice & (ty < 0))
    use &= ~(by_path & ~by_shape & (ty > 0))  # a suffix alone does not show in the text
    report |= {"rows": len(keep), "text_positive": int((use & (ty > 0)).sum())}
    text_w = np.zeros(RAW + SHAPE + 1, np.float32)
    text_w[-1] = -1
    text_at = 0.0
    for _ in range(2):
        fitted = use & ~held
        if (ty[fitted] > 0).sum() >= 2 and (ty[fitted] < 0).sum() >= 2:
            text_w = train_svm(tv.of(fitted), RAW + SHAPE, ty[fitted])
        s = tv.scores(text_w)
        use = use & ~((ty < 0) & (s > 0.3))  # unlabelled cases among the rest
    val = use & held
    if val.any():
        text_at = _threshold(s[val], ty[val], 0.97)
        report["text_recall"] = float(((s > text_at) & (ty > 0) & val).sum() / max(1, (val & (ty > 0)).sum()))

    # Path: labels from notices and text, with the conventions as seeds.
    words = [x for x in ("src", "lib", "core", "bin", "tests", "tools") for _ in range(2)]
    kinds = ("py", "rs", "dart")
    seeds = [f"{a}/{d}/package{v}/{b}file.{e}" for d in COPIED_DIRS for a in ("a", "src", "a/lib") for v in ("", "-1.2.3") for b in ("", "src/") for e in kinds]
    seeds += [f"{a}/{d}/file.{e}" for d in GENERATED_DIRS for a in ("a", "src", "a/lib") for e in kinds]
    seeds += [f"{a}/file{sep}{s}.{e}" for s in SUFFIXES for sep in (".", "_", "-") for e in kinds for a in words[:2] if sep == "." or len(s) > 2]
    plain = [f"{a}/{d}/{x}file.{e}" for a in ("a", *words) for d in words for x in ("", "package/", "package-1.2.3/", "package/src/") for e in kinds]
    py = np.where(notice | by_shape | (s > text_at), 1.0, -1.0)
    usable = ~over & ~((py > 0) & ~by_path)  # evidence of other kinds with a plain path teaches nothing
    fitted = usable & ~held
    buckets = [b for b, f in zip(pb, fitted) if f] + [path_buckets(p) for p in seeds + plain]
    x = Rows(buckets, [np.ones(len(b), np.float32) for b in buckets])
    # A conventional path without further evidence is no negative example.
    y = np.concatenate([np.where(py[fitted] > 0, 1.0, -1.0), np.ones(len(seeds)), -np.ones(len(plain))])
    ok = np.concatenate([~(by_path[fitted] & (py[fitted] < 0)), np.ones(len(seeds) + len(plain), bool)])
    path_w = train_svm(x.of(ok), PATH, y[ok], 50.0, 60)
    ps = np.array([path_w[b].sum() + path_w[-1] for b in pb], np.float32)
    val = usable & held & ~(by_path & (py < 0))
    path_at = _threshold(ps[val], py[val], 0.97) if val.any() else 0.0
    report["path_recall"] = float(((ps > path_at) & (py > 0) & val).sum() / max(1, (val & (py > 0)).sum()))
    return Model(text_w, path_w, note_w, over_w, text_at, path_at, report)


def _line_scores(model: Model, line: str, known: dict[str, tuple[float, float]]) -> tuple[float, float]:
    """Scores of a comment line as a notice and as a taking over; equal lines are scored once."""
    key = line_key(line)
    if (got := known.get(key)) is None:
        if len(known) > 200_000:
            known.clear()
        at, v = line_grams(key)
        got = known[key] = (float(v @ model.note[at] + model.note[-1]), float(v @ model.over[at] + model.over[-1]))
    return got


def judge(model: Model, path: str | None, content: bytes | None, known: dict | None = None) -> tuple[bool, float, float, float]:
    """Whether a file is a case, and the scores of its text, path and comments."""
    known = {} if known is None else known
    text = unify(decode_leniently(content))
    if not text.strip():
        return False, 0.0, 0.0, 0.0
    notes, body = notice_lines(text)
    heads = [_line_scores(model, x, known) for x in notes]
    note = max((n for n, o in heads if n > o), default=-1.0)
    if not body.strip() and note <= 0:
        return False, 0.0, 0.0, note
    t, p = score(model.text, text_vector(body)) - model.text_at, path_score(model.path, path) - model.path_at
    found = note > 0 or t > 0 or p > 0
    if found:
        found = not any(o > 0 and o > n for n, o in (_line_scores(model, x, known) for x in comment_lines(text)))
    return found, t, p, note


def sample_of(files: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``repo, display_path, content`` of at most ``rows`` distinct files, those with the least hash.

    Copies (the same content and path) are dropped before anything is counted
    or cut, on hashes and paths alone; only the chosen rows' contents move.
    """
    usable = files.where("content is not null and length(content) > 0").select("repo", "display_path", "content", F.xxhash64("content").alias("h"))
    distinct = cut(usable.groupBy("h", "display_path").agg(F.min("repo").alias("repo")))
    n = distinct.count()
    rank = F.pmod(F.xxhash64("h", "display_path"), F.lit(1 << 40))
    # Of a large table only a hash range that holds the sample is looked at, so that no
    # partition has to offer as many rows as the whole sample; if chance leaves it too
    # narrow, the whole table is looked at.
    near = distinct.where(rank < F.lit(int((1 << 40) * 2 * rows / n))) if n > 4 * rows else distinct
    keys = cut(near.orderBy(rank, "display_path").limit(rows))
    if near is not distinct and keys.count() < rows:
        keys = cut(distinct.orderBy(rank, "display_path").limit(rows))
    same = [F.col("a.h") == F.col("k.h"), F.col("a.display_path").eqNullSafe(F.col("k.display_path")), F.col("a.repo").eqNullSafe(F.col("k.repo"))]
    found = usable.alias("a").join(F.broadcast(keys.alias("k")), same).select("a.*")
    return found.dropDuplicates(["h", "display_path"]).orderBy(rank, "display_path").select("repo", "display_path", "content")


def fit_on(files: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``rows`` files, those with the least hash of path and content.

    The sample is drawn over the whole table; equal files count once in it.  The
    workers turn each file into its vector and labels, so that no content of any
    size comes to the driver.
    """
    names = [f.name for f in fields(Sample)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sample(r["repo"], r["display_path"], r["content"]) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([getattr(x, n) for x in got], t) for n, t in zip(names, _SAMPLE_ARROW)], names=names)

    types = "repo string, path string, notice boolean, taken_over boolean, by_path boolean, by_shape boolean, blank boolean, at array<int>, value array<float>, lines array<string>"
    got = sample_of(files, rows).mapInArrow(run, types).toArrow().combine_chunks()
    plain = [got[n].to_pylist() for n in names if n not in ("at", "value")]
    at, value = (_parts(got[n]) for n in ("at", "value"))
    return fit_samples([Sample(*r[:-1], a, v, r[-1]) for *r, a, v in zip(*plain, at, value)])


def _parts(lists: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as arrays that share its memory."""
    return [np.asarray(c.values)[a:b] for c in lists.chunks for a, b in zip(c.offsets.to_pylist(), c.offsets.to_pylist()[1:])]


_SAMPLE_ARROW = [pa.string(), pa.string(), *[pa.bool_()] * 5, pa.list_(pa.int32()), pa.list_(pa.float32()), pa.list_(pa.string())]


def scored(files: DataFrame, model: Model | None = None) -> DataFrame:
    """Every file with ``found``, ``text_score``, ``path_score`` and ``note_score``.

    ``files``: file_id, repo, display_path, content; more columns are ignored.
    Null or blank content is no case; a null path has no components; repeated
    rows give repeated rows; an empty table gives none.
    """
    fitted = model or fit_on(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            got = [judge(fitted, p.as_py(), c.as_py(), known) for p, c in zip(b.column("display_path"), b.column("content"))]
            cols = list(zip(*got)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [b.column("file_id"), pa.array(cols[0], pa.bool_()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())],
                names=["file_id", "found", "text_score", "path_score", "note_score"],
            )

    return spread(files.select("file_id", "display_path", "content")).mapInArrow(run, "file_id bigint, found boolean, text_score double, path_score double, note_score double")


def not_hand_written(files: DataFrame) -> DataFrame:
    """The ``file_id`` of every file that nobody wrote by hand in its project."""
    return scored(files).where("found").select("file_id")
