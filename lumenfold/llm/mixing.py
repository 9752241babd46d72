"""Mixing sources to target weights by temperature.

Shares of tokens are raised to an exponent between 0 (equal weights) and 1 (as they are) and normalised. Bisection finds
the least exponent at which no source is repeated more than ``limit`` times, and the greatest at which the weights'
entropy reaches ``entropy``; the greater of the two holds, so the limit is never broken. The weights are realised as
budgeted block permutations: a source's texts lie in blocks of about ``BLOCK_TOKENS`` tokens by their hash, each epoch
goes through the blocks in another order, and through a block's texts in the order of another hash, until the source's
budget is spent. Whole epochs take every text; the last one takes whole blocks and part of one.

Which epochs a text is in depends only on its own hash and on one row a source (last block, last hash), so realising a
mixture moves no text. The order within it is (``at``, ``block``, ``order``): blocks are spread over the stream evenly.

Edge cases: a null source is a source of its own; null and empty texts have no tokens and go along with their block;
repeated rows are taken alike; an empty table gives no rows; other columns are kept as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import kept_names

BLOCK_TOKENS, SEED, STEPS, MAX_SOURCES = 1_000_000, 5, 80, 100_000
NO_SOURCE = ""
MADE = ("__epoch", "__at", "__block", "__place")  # the columns that a mixture adds


def weights_of(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    total = sum(tokens.values())
    raised = {s: (t / total) ** exponent for s, t in tokens.items() if t}
    return {s: w / sum(raised.values()) for s, w in raised.items()}


def entropy_of(weights: dict[str, float]) -> float:
    return -sum(w * math.log2(w) for w in weights.values() if w > 0)


def budget_of(tokens: dict[str, int], weights: dict[str, float], budget: float | None) -> float:
    """None: the least budget that takes every text of every source at least once."""
    return budget if budget is not None else max((tokens[s] / w for s, w in weights.items()), default=0.0)


def repetitions(tokens: dict[str, int], weights: dict[str, float], budget: float | None) -> dict[str, float]:
    b = budget_of(tokens, weights, budget)
    return {s: w * b / tokens[s] for s, w in weights.items()}


def solve(tokens: dict[str, int], limit: float | None = None, entropy: float | None = None, budget: float | None = None) -> float:
    """The exponent, 0 to 1."""

    def bisect(too_low) -> float:
        if not too_low(0.0):
            return 0.0
        low, high = 0.0, 1.0
        for _ in range(STEPS):
            mid = (low + high) / 2
            low, high = (mid, high) if too_low(mid) else (low, mid)
        return high

    if not any(tokens.values()):
        return 1.0
    found = [0.0]
    if limit is not None:
        found.append(bisect(lambda e: max(repetitions(tokens, weights_of(tokens, e), budget).values()) > limit * (1 + 1e-12)))
    if entropy is not None:  # entropy falls as the exponent grows
        found.append(bisect(lambda e: entropy_of(weights_of(tokens, e)) > entropy))
    return max(found)


def plan(docs: DataFrame, limit: float | None, entropy: float | None, budget: float | None, seed: int, block_tokens: int, columns: dict) -> tuple[DataFrame, list[tuple]]:
    """docs as one column __row beside those of source, tokens and hash, and a row a source: what of it the mixture takes."""
    own = {k: F.col(f"`{c}`") for k, c in columns.items()}
    source = F.coalesce(own["source"].cast("string"), F.lit(NO_SOURCE))
    tokens = F.coalesce(F.regexp_count(own["text"], F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    hashed = F.xxhash64(F.lit(seed), own["doc_id"], F.xxhash64(own["text"]))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))  # no column's name can clash with those made here
    rows = docs.select(row.alias("__row"), source.alias("__source"), tokens.alias("__tokens"), hashed.alias("__hash"))
    slim = rows.select("__source", "__tokens", "__hash")
    found = slim.groupBy("__source").agg(F.sum("__tokens").alias("t")).limit(MAX_SOURCES + 1).collect()  # one row a source
    if len(found) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    count = {r["__source"]: r.t for r in found}
    weights = weights_of(count, solve(count, limit, entropy, budget))
    times = repetitions(count, weights, budget)
    spark = docs.sparkSession
    base = []
    for s in sorted(count):
        n_blocks = max(1, math.ceil(count[s] / block_tokens))
        r = times.get(s, 1.0)
        whole = math.floor(r + 1e-9)
        stride = next(a for a in range(n_blocks // 2 + 1, 2 * n_blocks + 2) if math.gcd(a, n_blocks) == 1)
        base.append((s, n_blocks, stride, whole, max(0.0, r - whole) * count[s]))
    table = spark.createDataFrame(base, "__source string, __blocks long, __stride long, __whole long, __rest double") if base else None
    if table is None:
        return rows, []
    placed = placed_rows(slim.join(F.broadcast(table), "__source").filter("__rest > 0"), F.col("__whole"), seed)
    sums = placed.groupBy("__source", "__rest", "__seq").agg(F.sum("__tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("__source").orderBy("__seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = sums.withColumn("before", before).filter((F.col("before") < F.col("__rest")) & (F.col("before") + F.col("t") >= F.col("__rest"))).groupBy("__source").agg(F.min("__seq").alias("__last"), F.min("before").alias("before"))
    inner = placed.join(F.broadcast(last), "__source").filter(F.col("__seq") == F.col("__last"))  # a block a source
    run = F.coalesce(F.sum("__tokens").over(Window.partitionBy("__source").orderBy("__order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = inner.withColumn("run", F.col("before") + run).filter(F.col("run") < F.col("__rest")).groupBy("__source", "__last").agg(F.max("__order").alias("__cut"))
    cuts = {r["__source"]: (r["__last"], r["__cut"]) for r in cut.collect()}
    out = [(s, n, stride, whole, *cuts.get(s, (-1, 0)), float(max(1.0, times.get(s, 1.0) * count[s]))) for s, n, stride, whole, _ in base]
    return rows, out


def placed_rows(rows: DataFrame, epoch, seed: int) -> DataFrame:
    """With __seq, the place of the row's block in the epoch, and __order, its place in the block."""
    block = F.floor(F.shiftrightunsigned("__hash", 11) / F.lit(float(1 << 53)) * F.col("__blocks"))
    moved = F.pmod(block * F.col("__stride") + epoch * (F.col("__stride") + 1) + F.pmod(F.xxhash64(F.lit(seed), "__source"), F.col("__blocks")), F.col("__blocks"))
    return rows.withColumns({"__seq": moved.cast("long"), "__order": F.xxhash64("__hash", epoch.cast("long"))})


def mix(docs: DataFrame, limit: float | None = None, entropy: float | None = None, budget: float | None = None, seed: int = SEED, block_tokens: int = BLOCK_TOKENS, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs' rows as often as the mixture takes them, with __epoch, __at, __block and __place added (a column of docs of
    such a name: NAME_kept).

    budget: tokens of the mixture; None takes every text at least once.
    """
    rows, table = plan(docs, limit, entropy, budget, seed, block_tokens, {"doc_id": doc_id, "source": source, "text": text})
    names = [*(F.col("__row")[c].alias(n) for c, n in zip(docs.columns, kept_names(docs.columns, MADE), strict=True)), *MADE]
    if not table:
        return rows.withColumns({"__epoch": F.lit(0), "__at": F.lit(0.0), "__block": F.lit(0).cast("long"), "__place": F.lit(0).cast("long")}).select(*names)
    small = docs.sparkSession.createDataFrame(table, "__source string, __blocks long, __stride long, __whole long, __last long, __cut long, __budget double")
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__whole")))
    each = placed_rows(rows.join(F.broadcast(small), "__source").withColumn("__e", epochs), F.col("__e"), seed)
    taken = (F.col("__e") < F.col("__whole")) | (F.col("__seq") < F.col("__last")) | ((F.col("__seq") == F.col("__last")) & (F.col("__order") <= F.col("__cut")))
    at = (F.col("__e") * F.col("__blocks") + F.col("__seq")) / (F.col("__budget") / F.lit(float(block_tokens)))
    return each.filter(taken).withColumns({"__epoch": F.col("__e").cast("int"), "__at": at, "__block": F.col("__seq"), "__place": F.col("__order")}).select(*names)
