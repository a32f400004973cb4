"""Evaluation texts inside a corpus (problem 6), by winnowing.

Of every window of ``w`` consecutive k-gram hashes the least one is kept as a
fingerprint.  Two texts that share ``w + k - 1`` units in a row then share a
fingerprint, so no shared span of the required length is missed; every hit is
extended and counts only if the span really has that length.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, cut, spread

#: Units a shared span needs, and the k of the k-grams: by words, and by letters for languages without spaces.
WORDS, WORD_K = 13, 6
LETTERS, LETTER_K = 24, 10
LETTER_LANGS = ("zh", "ja")
#: Most fingerprints of test items that every worker holds to drop others early (8 bytes each).
MAX_HELD = 4_000_000

#: Parts of a fingerprint's documents in the join beyond that.
_SALT = 16
#: Most entries of a worker's tables of words, items and documents.
_MEMO = 500_000
#: Documents that are fingerprinted at once.
_TOGETHER = 64

_INVISIBLE = regex.compile(r"[\p{Cf}\p{Cc}--[\n\r\t\v\f\x1c-\x1f\x85]]", regex.V1)
_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")


# ASCII text needs no Unicode: letters in lower case, all else but controls is a gap.
_KEEP = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123))
_PLAIN = bytes((c + 32 if 65 <= c <= 90 else c) if c in _KEEP else 32 for c in range(128)) + bytes(128)
_DROP = bytes(c for c in (*range(32), 127) if not (9 <= c <= 13 or 28 <= c <= 31))


def normal(text: str | None) -> str:
    """Compatibility forms folded, invisible characters and case removed."""
    if not text:
        return ""
    return _INVISIBLE.sub("", unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))).casefold()


def words(text: str | None) -> list[str]:
    """The words of a text in normal form."""
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(_PLAIN, _DROP).decode().split()
    return _WORD.findall(normal(text))


def _letters_of(ws: list[str]) -> np.ndarray:
    """The code points of all letters and digits in a row."""
    whole = "".join(ws)
    if whole.isascii():
        return np.frombuffer(whole.encode(), np.uint8)
    return np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)


_STEP = 0x9E3779B97F4A7C15


def _k_grams(units: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` units in a row: a polynomial, put together from spans of 1, 2, 4, ... units."""
    if len(units) < k:
        return np.zeros(0, np.uint64)
    out, done = None, 0
    span, size = units, 1
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                power = np.uint64(pow(_STEP, size, 1 << 64))
                out = span if out is None else out[: len(units) - done - size + 1] * power + span[done:]
                done += size
            if done == k:
                break
            span = span[:-size] * np.uint64(pow(_STEP, size, 1 << 64)) + span[size:]
            size *= 2
        h = out ^ (out >> np.uint64(31))
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of every ``w`` hashes in a row, from the least of windows half as long."""
    have = 1
    while have < w:
        step = min(have, w - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    return h


def winnow(units: np.ndarray, k: int, w: int) -> np.ndarray:
    """Fingerprints of a sequence of 64-bit units; a short one keeps its least hash."""
    h = _k_grams(units, k)
    return np.unique(_least(h, min(w, len(h)))).view(np.int64) if len(h) else h.view(np.int64)


def winnow_all(texts: list[np.ndarray], k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the text, fingerprint) of many sequences at once; as ``winnow`` of each, but for repetitions."""
    sizes = np.array([len(u) for u in texts], np.int64)
    short = np.flatnonzero((sizes >= k) & (sizes < k + w - 1))
    few = [(i, winnow(texts[i], k, w)) for i in short.tolist()]
    who = [np.repeat(short, [len(f) for _, f in few])]
    found = [f for _, f in few]
    n = np.maximum(sizes - (k + w - 2), 0)  # whole windows of each text
    if n.any():
        least = _least(_k_grams(np.concatenate(texts), k), w)
        owner = np.repeat(np.arange(len(texts)), n)
        at = np.arange(len(owner)) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(n) - n), n)
        h = least[at]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        who.append(owner[first])
        found.append(h[first].view(np.int64))
    return np.concatenate(who), np.concatenate(found) if found else np.zeros(0, np.int64)


class _Hashes(dict):
    """Hashes of words, filled as they are asked for."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = _Hashes()


def _word_units(ws: list[str]) -> np.ndarray:
    if len(_HASHES) > _MEMO:
        _HASHES.clear()
    return np.fromiter(map(_HASHES.__getitem__, ws), np.uint64, len(ws))


def _letter_units(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.uint64) + np.uint64(0x1F123BB5)


def fingerprints(text: str | None, by_letters: bool) -> np.ndarray:
    """Winnowed fingerprints of a whole text; those by letters have the lowest bit set."""
    return _prints(words(text), by_letters)


def _prints(ws: list[str], by_letters: bool) -> np.ndarray:
    if by_letters:
        return winnow(_letter_units(_letters_of(ws)), LETTER_K, LETTERS - LETTER_K + 1) | np.int64(1)
    return winnow(_word_units(ws), WORD_K, WORDS - WORD_K + 1) & ~np.int64(1)


class Spans:
    """A text in normal form, to be asked for shared runs of units; normalised once for any number of others."""

    def __init__(self, text: str | None):
        self.words = words(text)
        self._runs: dict[bool, tuple] = {}

    def runs(self, by_letters: bool) -> tuple[list, int, np.ndarray]:
        """(units, length of a run, hash of every run)."""
        if by_letters not in self._runs:
            if by_letters:
                codes = _letters_of(self.words)
                self._runs[True] = codes.tolist(), LETTERS, _k_grams(_letter_units(codes), LETTERS)
            else:
                self._runs[False] = self.words, WORDS, _k_grams(_word_units(self.words), WORDS)
        return self._runs[by_letters]

    def shares(self, item: Spans, by_letters: bool) -> bool:
        """Whether a run of the item's units occurs here; equal hashes are compared unit by unit."""
        a, n, ha = self.runs(by_letters)
        b, _, hb = item.runs(by_letters)
        at = np.flatnonzero(np.isin(ha, hb))
        if not len(at):
            return False
        runs = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
        return any(tuple(a[i : i + n]) in runs for i in at.tolist())


def shares_span(text: str, item: str, by_letters: bool) -> bool:
    """Whether a text holds a long enough run of the item's units."""
    return Spans(text).shares(Spans(item), by_letters)


def item_fingerprints(items: DataFrame) -> DataFrame:
    """``item_id, hash`` of every test item, by letters or words as its language has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes = [], []
            for i, lang, text in zip(*(b.column(n).to_pylist() for n in ("item_id", "lang", "text"))):
                f = fingerprints(text, lang in LETTER_LANGS)
                ids += [i] * len(f)
                hashes += f.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64())], names=["item_id", "hash"])

    return items.select("item_id", "lang", "text").mapInArrow(run, "item_id bigint, hash bigint")


def marked_documents(docs: DataFrame, held: np.ndarray | None) -> DataFrame:
    """``doc_id, text, hashes``: documents with their fingerprints.

    ``held``: sorted fingerprints of all items; others are dropped in the
    worker, and documents without any left as well.  None keeps everything.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _TOGETHER):
                b = whole.slice(start, _TOGETHER)
                ws = [words(x) for x in b.column("text").to_pylist()]
                by_word = winnow_all([_word_units(x) for x in ws], WORD_K, WORDS - WORD_K + 1)
                by_letter = winnow_all([_letter_units(_letters_of(x)) for x in ws], LETTER_K, LETTERS - LETTER_K + 1)
                who = np.concatenate([by_word[0], by_letter[0]])
                f = np.concatenate([by_word[1] & ~np.int64(1), by_letter[1] | np.int64(1)])
                if held is not None:
                    known = held[np.minimum(np.searchsorted(held, f), len(held) - 1)] == f if len(held) else np.zeros(len(f), bool)
                    who, f = who[known], f[known]
                hashes: dict[int, set[int]] = {}
                for k, h in zip(who.tolist(), f.tolist()):
                    hashes.setdefault(k, set()).add(h)
                kept = sorted(hashes)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(kept, pa.int64())), b.column("text").take(pa.array(kept, pa.int64())), pa.array([sorted(hashes[k]) for k in kept], pa.list_(pa.int64()))], names=["doc_id", "text", "hashes"]
                )

    return spread(docs.where("text is not null and doc_id is not null").select("doc_id", "text")).mapInArrow(run, "doc_id bigint, text string, hashes array<bigint>")


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id`` of every document that holds a long run of an item.

    ``docs``: doc_id, text.  ``items``: item_id, lang, text.  Whole texts are
    read; null, blank and short texts share nothing; copies of a document count
    each; empty tables give no rows.  Items are fingerprinted once; if their
    fingerprints are few enough to be held by every worker, documents that share
    none leave before anything is shuffled, else the join alone decides.
    """
    prints = cut(item_fingerprints(items).distinct())
    n = prints.count()
    held = np.unique(prints.select("hash").toArrow()["hash"].to_numpy()) if n <= MAX_HELD else None
    marked = marked_documents(docs, held)
    hits = marked.select("doc_id", F.explode("hashes").alias("hash"))
    if held is not None:
        marked = cut(marked)  # read twice; only documents that share a fingerprint
        pairs = marked.select("doc_id", F.explode("hashes").alias("hash")).join(prints, "hash")
    else:
        # A passage that very many documents hold is one hash: its documents are split by salt.
        salted = hits.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SALT)).cast("int"))
        pairs = salted.join(prints.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1)))), ["hash", "salt"])
    pairs = pairs.select("doc_id", "item_id").distinct()
    tests = items.select("item_id", "lang", F.col("text").alias("item_text"))
    bytes_ = items.agg(F.sum(F.octet_length("text") + 100)).first()[0] or 0
    both = pairs.join(marked.select("doc_id", F.col("text").alias("doc_text")), "doc_id").join(F.broadcast(tests) if bytes_ <= BROADCAST_BYTES else tests, "item_id")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, of = None, None  # rows of one document mostly follow each other
        kept: dict[str, Spans] = {}
        for b in batches:
            keep = []
            for text, item, lang in zip(*(b.column(n).to_pylist() for n in ("doc_text", "item_text", "lang"))):
                if of is None or text != doc:
                    doc, of = text, Spans(text)
                if (other := kept.get(item)) is None:
                    if len(kept) >= 1000:
                        kept.clear()
                    other = kept[item] = Spans(item)
                keep.append(of.shares(other, lang in LETTER_LANGS))
            yield b.select(["doc_id", "item_id"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(extend, "doc_id bigint, item_id bigint")
