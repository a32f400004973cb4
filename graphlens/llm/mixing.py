"""Mixing sources to target weights (problem 7).

Every distinct text gets a place in a fixed random order of its source (a hash).
A source's token quota becomes a number of full passes over its texts and a cut
in that order for one more, found by radix selection on aggregated counts.  The
passes are cut into blocks, a tree of multivariate hypergeometric draws splits
the block quotas of all sources among the output shards, and each shard takes
its own run of every source's permuted blocks and shuffles it locally.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut, spread

TOKENIZER = os.environ.get("GRAPHLENS_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
#: Bits of the random order, and bits that one round of the selection resolves.
ORDER_BITS, ROUND_BITS = 62, 10
#: Texts in a block, on average, and the blocks from which on blocks grow instead of their number.
BLOCK, BLOCKS = 64, 1 << 28
#: Upper estimates of a target's and a source's plan in memory.
_TARGET_ROW, _PLAN_ROW = 300, 400
#: Sums that one round of the selection may bring to the driver.
_SUMS = 1 << 20


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``docs`` with ``tokens``, the length in tokens; null for a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for b in batches:
            texts = b.column("text").to_pylist()
            n = [len(x) for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if x is None else k for x, k in zip(texts, n)], pa.int64())], names=[*b.schema.names, "tokens"])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + ", tokens bigint")


def distinct_texts(docs: DataFrame, targets: DataFrame, seed: int, tokenizer: str) -> DataFrame:
    """One row per distinct text of a wanted source: ``source, doc_id, key, place, tokens``.

    A text that occurs in several sources belongs to the first of them by name,
    with the least doc_id there, so that it can't be used once for each.  Null
    and blank texts, null sources and texts without a token are left out.
    """
    wanted = targets.where("source is not null and target_weight > 0 and max_repeats > 0").select("source").distinct()
    usable = spread(docs.select("doc_id", "text", "source").where("source is not null and length(trim(text)) > 0"))
    sized = token_counts(usable.join(broadcast_if_small(wanted, _TARGET_ROW), "source", "left_semi"), tokenizer).where("tokens > 0")
    key = F.md5("text")
    return (
        sized.select(key.alias("key"), F.struct("source", "doc_id", "tokens").alias("d"))
        .groupBy("key").agg(F.min("d").alias("d"))
        .select("d.source", "d.doc_id", "key", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("key")), 64 - ORDER_BITS).alias("place"), "d.tokens")
    )


@dataclass
class Quota:
    source: str
    wanted: float  # share that the targets name
    max_repeats: int
    supply: int  # tokens of the distinct texts
    texts: int
    quota: float  # tokens to draw
    passes: int  # full passes
    cut: int = 0  # places below it are used once more


def quotas(supply: list[tuple[str, int, int]], targets: list[tuple[str, float, int]], total: float | None = None) -> list[Quota]:
    """Token quotas per source for the largest total that the caps allow, or ``total``.

    Weights are taken in proportion over the sources that have texts; a source
    without any keeps a quota of 0.  A total beyond the caps is an error.
    """
    have = {s: (t, n) for s, t, n in supply}
    live = [(s, w, m) for s, w, m in targets if s is not None and w and w > 0 and m and m > 0 and have.get(s, (0, 0))[0] > 0]
    weight = math.fsum(w for _, w, _ in live)
    most = min((m * have[s][0] / (w / weight) for s, w, m in live), default=0.0)
    if total is not None and total > most * (1 + 1e-12):
        raise ValueError(f"the caps allow {most:.0f} tokens at these weights")
    total = most if total is None else total
    out = []
    for s, w, m in targets:
        tokens, texts = have.get(s, (0, 0))
        q = total * w / weight if any(s == x for x, _, _ in live) else 0.0
        passes = int(min(m, q // tokens)) if tokens else 0
        if tokens and passes < m and (passes + 1) * tokens - q < 1e-6 * tokens:
            passes += 1
        out.append(Quota(s, w or 0.0, m or 0, tokens, texts, q, passes))
    return out


def select_cuts(texts: DataFrame, plan: list[Quota]) -> None:
    """Set each quota's ``cut`` so that the places below it hold the rest of its tokens.

    Radix selection: each round sums the tokens by the next bits of the place
    under the prefix found so far, which are at most 2**ROUND_BITS numbers a
    source and fewer if there are many sources, and narrows to the digit in
    which the rest ends.  The text at the
    edge is taken if that comes nearer to the quota.
    """
    open_ = {q.source: [q.quota - q.passes * q.supply, 0] for q in plan if q.passes < q.max_repeats and q.quota - q.passes * q.supply > 0}
    by = {q.source: q for q in plan}
    shift = ORDER_BITS
    while open_ and shift > 0:
        step = min(ROUND_BITS, shift, max(1, (_SUMS // len(open_)).bit_length() - 1))
        shift -= step
        spark = texts.sparkSession
        at = spark.createDataFrame([(s, p) for s, (_, p) in open_.items()], "source string, prefix bigint")
        digit = F.shiftright("place", shift).bitwiseAND((1 << step) - 1)
        rows = (
            texts.join(broadcast_if_small(at, _TARGET_ROW), "source").where(F.shiftright("place", shift + step) == F.col("prefix"))
            .groupBy("source", digit.alias("digit")).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).collect()
        )
        found: dict[str, list] = {}
        for r in rows:
            found.setdefault(r["source"], []).append((r["digit"], r["t"], r["n"], r["first"]))
        for s in list(open_):
            rest, prefix = open_[s]
            for d, t, n, first in sorted(found.get(s, [])):
                if t <= rest:
                    rest -= t
                    continue
                if n == 1:
                    by[s].cut = first + (1 if t - rest < rest else 0)
                    del open_[s]
                else:
                    open_[s] = [rest, (prefix << step) | d]
                break
            else:
                by[s].cut = ((prefix + 1) << (shift + step))
                del open_[s]
    for s, (_, prefix) in open_.items():
        by[s].cut = prefix << shift  # texts of one place stay out together


def draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement from ``good + bad`` are good.

    The generator's own hypergeometric draw where it takes the numbers; beyond
    that ratio-of-uniforms rejection about the mode, the same distribution.
    """
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mean = n * good / total
    spread_ = math.sqrt(mean * (bad / total) * ((total - n) / (total - 1)) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread_ + 3 - 2 * math.sqrt(3 / math.e)
    mode = (n + 1) * (good + 1) // (total + 2)

    def log_weight(k: int) -> float:
        return -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(n - k + 1) + math.lgamma(bad - n + k + 1))

    top = log_weight(mode)
    while True:
        u = 1.0 - rng.random()
        x = mean + 0.5 + width * (rng.random() - 0.5) / u
        if low <= x < high + 1 and 2 * math.log(u) <= log_weight(int(x)) - top:
            return int(x)


def split_tree(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Block quotas of every source (columns) in every shard (rows).

    A shard's size is its equal part of all blocks.  Each node of the tree draws
    what its left half gets of every source by a multivariate hypergeometric
    distribution, so every column sums to its count exactly.
    """
    out = np.zeros((shards, len(counts)), np.int64)
    total = int(sum(counts))
    sizes = np.diff(np.floor(np.linspace(0, total, shards + 1)).astype(np.int64))

    def down(a: int, b: int, have: np.ndarray) -> None:
        if b - a == 1:
            out[a] = have
            return
        mid = (a + b) // 2
        rng = np.random.default_rng([seed, a, b])
        left, rest, open_ = np.zeros_like(have), int(sizes[a:mid].sum()), int(have.sum())
        for k, n in enumerate(have):
            open_ -= int(n)
            got = draw(rng, int(n), open_, rest) if rest else 0
            left[k], rest = got, rest - got
        down(a, mid, left)
        down(mid, b, have - left)

    down(0, shards, np.array(counts, np.int64))
    return out


def _coprime(n: int, seed: int) -> int:
    a = (seed * 2654435761 + 12345) % max(n, 1) | 1
    while math.gcd(a, n) != 1:
        a += 2
    return a


@dataclass
class Mix:
    allocation: DataFrame  # source, doc_id, key, use, shard, rank, tokens
    plan: list[Quota]


def mix(docs: DataFrame, targets: DataFrame, shards: int = 16, seed: int = 1, total: float | None = None, tokenizer: str = TOKENIZER) -> Mix:
    """Draw texts so that every source fills its weight of the total token count.

    ``docs``: doc_id, text, source.  ``targets``: source, target_weight,
    max_repeats (a few rows; repeated sources are an error).  No distinct text
    is used more than its source's ``max_repeats`` times, whatever the number of
    its copies.  Within a shard, ``rank`` is a random order.
    """
    wish = [(r["source"], r["target_weight"], r["max_repeats"]) for r in targets.select("source", "target_weight", "max_repeats").orderBy("source").limit(100_001).collect()]
    if len(wish) > 100_000 or len({s for s, _, _ in wish}) < len(wish):
        raise ValueError("targets must name each source once, 100,000 at most")
    texts = cut(distinct_texts(docs, targets, seed, tokenizer))
    sums = texts.groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    plan = quotas([(r["source"], r["t"], r["n"]) for r in sums], wish, total)
    select_cuts(texts, plan)
    block_size = max(BLOCK, -(-sum(q.texts * (q.passes + 1) for q in plan) // BLOCKS))
    width = [max(1, -(-q.texts // block_size)) for q in plan]
    last = [-(-(q.cut * w) // (1 << ORDER_BITS)) for q, w in zip(plan, width)]
    uses = [q.passes * w + k for q, w, k in zip(plan, width, last)]
    tree = split_tree(uses, shards, seed)
    ends = np.cumsum(tree, axis=0)
    rows = [(q.source, q.passes, q.cut, w, max(1, u), _coprime(max(1, u), seed + k), ends[:, k].tolist()) for k, (q, w, u) in enumerate(zip(plan, width, uses)) if u]
    spark = docs.sparkSession
    dim = broadcast_if_small(spark.createDataFrame(rows, "source string, passes int, cut bigint, width bigint, blocks bigint, step bigint, ends array<bigint>"), _PLAN_ROW + 8 * shards)
    used = texts.join(dim, "source").withColumn("n", F.col("passes") + (F.col("place") < F.col("cut")).cast("int")).where("n > 0")
    each = used.withColumn("use", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    block = F.floor(F.col("place").cast("decimal(38,0)") * F.col("width") / F.lit(1 << ORDER_BITS).cast("decimal(38,0)")).cast("bigint")
    spot = F.pmod((F.col("use") * F.col("width") + block).cast("decimal(38,0)") * F.col("step"), F.col("blocks").cast("decimal(38,0)")).cast("bigint")
    placed = each.withColumn("spot", spot).withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("spot"))))
    allocation = placed.select("source", "doc_id", "key", "use", "shard", F.xxhash64(F.lit(seed), "shard", "key", "use").alias("rank"), "tokens")
    return Mix(allocation, plan)


def write(m: Mix, docs: DataFrame, path: str) -> None:
    """Write the drawn texts, a folder a shard, each in its local order."""
    rows = m.allocation.join(docs.select("doc_id", "text"), "doc_id")
    rows.repartition("shard").sortWithinPartitions("shard", "rank").write.mode("overwrite").partitionBy("shard").parquet(path)


def shares(m: Mix) -> DataFrame:
    """Per source of the targets: what was wanted and what was reached.

    ``source, target_share, max_repeats, supply_tokens, quota_tokens,
    drawn_tokens, drawn_share, texts_used, most_uses``.
    """
    spark = m.allocation.sparkSession
    plan = spark.createDataFrame([(q.source, float(q.wanted), q.max_repeats, q.supply, float(q.quota)) for q in m.plan], "source string, target_share double, max_repeats int, supply_tokens bigint, quota_tokens double")
    per_text = m.allocation.groupBy("source", "key").agg(F.count(F.lit(1)).alias("uses"), F.sum("tokens").alias("t"))
    got = per_text.groupBy("source").agg(F.sum("t").alias("drawn_tokens"), F.count(F.lit(1)).alias("texts_used"), F.max("uses").cast("int").alias("most_uses"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    everything = F.sum("drawn_tokens").over(Window.partitionBy(F.lit(1)))  # over the few rows of the targets
    return plan.join(got, "source", "left").select(
        *plan.columns, zero("drawn_tokens"), (F.coalesce("drawn_tokens", F.lit(0)) / everything).alias("drawn_share"), zero("texts_used"), F.coalesce("most_uses", F.lit(0)).alias("most_uses")
    )
