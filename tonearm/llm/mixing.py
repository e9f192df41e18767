"""Mixtures of sources by target share (problem 7), interleaved by Pfair scheduling.

Sizes are tokens. The mixture's size is the largest at which every source that has documents can give its share with
at most ``max_repeats`` copies of any document (shares are scaled up to add to 1 over these sources). A source gives
its documents in a fixed random order, pass after pass; the pass that would overshoot ends with the document that
brings the source nearest to its quota.

Each source's stream is cut into blocks of ``block_tokens``; a document belongs to the block in which it starts, and
may be longer than one. Weights are rounded to whole numbers of ``period`` slots, of which the smallest source gets
``LEAST`` unless that takes more than ``LONGEST`` slots (then it gets one at least, which moves the order, never the
shares); block i of a source with weight w is released at slot floor((i-1)/w) and due at ceil(i/w), and each slot goes to the
released block with the earliest deadline. The schedule repeats after ``period`` slots, so one period is planned on
the driver (``LONGEST`` rows at most, whatever the size of the data) and every block finds its slot by arithmetic and a join.

Null sources never match a target. Sources that aren't listed, and listed ones with a share of 0 or no repeats, give
nothing. Documents without tokens ride along in the block of their place. Repeated rows are documents of their own.
Without documents or targets, the mixture is empty.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.llm.tokens import encode
from tonearm.shared import cut

BLOCK_TOKENS = 16384
PERIOD, LONGEST, LEAST = 4096, 1 << 18, 8
ROWS_PER_BUCKET = 20_000


def pfair(weights: dict[str, int]) -> list[tuple[str, int]]:
    """(source, block number from 0) of each slot of one period; the weights add up to the number of slots."""
    total = sum(weights.values())
    waiting: list[tuple[int, str, int]] = []
    ready: list[tuple[int, str, int]] = []

    def window(source: str, i: int) -> tuple[int, int]:
        w = Fraction(weights[source], total)
        return int(i / w), -int(-(i + 1) // w)

    for source, w in sorted(weights.items()):
        if w:
            heapq.heappush(waiting, (0, source, 0))
    slots = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, source, i = heapq.heappop(waiting)
            heapq.heappush(ready, (window(source, i)[1], source, i))
        _, source, i = heapq.heappop(ready)
        slots.append((source, i))
        if i + 1 < weights[source]:
            heapq.heappush(waiting, (window(source, i + 1)[0], source, i + 1))
    return slots


def whole_weights(shares: dict[str, float], period: int) -> dict[str, int]:
    """Shares as whole numbers that add up to ``period``; every source keeps at least one slot."""
    exact = {s: Fraction(x) * period for s, x in shares.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s)):
        if sum(out.values()) < period:
            out[s] += 1
    over = sum(out.values()) - period
    for s in sorted(out, key=lambda s: (-out[s], s)):  # what the lifted ones have too many comes off the largest
        less = min(over, out[s] - max(1, out[s] // 2))
        out[s] -= less
        over -= less
    return out


def sized(docs: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """doc_id, source and n_tokens of the documents of listed sources."""
    wanted = targets.filter((F.col("target_share") > 0) & (F.col("max_repeats") > 0)).select("source").distinct()
    listed = docs.select("doc_id", "source", "text").join(wanted, "source", "left_semi")
    return encode(listed, keep=("source",), count_only=True, **options)


def period_of(shares: dict[str, float]) -> int:
    """Slots of a period, enough for ``LEAST`` of the smallest source."""
    wanted = max(PERIOD, LEAST * len(shares), math.ceil(LEAST / min(shares.values())))
    return max(len(shares), min(LONGEST, wanted))


def mixture(docs: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, period: int | None = None, seed: int = 42, sizes: DataFrame | None = None) -> DataFrame:
    """source, doc_id, repeat_no (from 1), n_tokens, start_token (in the source's stream), block_no and slot.

    Reading by (slot, source, start_token) gives the interleaved order. Targets are a small table by definition: one row per source.
    """
    spark = docs.sparkSession
    sizes = cut(sizes if sizes is not None else sized(docs, targets)).withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    per_source = {r["source"]: r for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("docs")).collect()}
    goal = {r["source"]: r for r in targets.groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats")).collect()}
    here = sorted(s for s, r in per_source.items() if r["size"] > 0)
    schema = "source string, doc_id bigint, repeat_no int, n_tokens bigint, start_token bigint, block_no bigint, slot bigint"
    if not here:
        return spark.createDataFrame([], schema)
    scale = sum(goal[s]["share"] for s in here)
    share = {s: goal[s]["share"] / scale for s in here}
    total = min(goal[s]["repeats"] * per_source[s]["size"] / share[s] for s in here)
    weights = whole_weights(share, period or period_of(share))
    slots = [(s, i, t) for t, (s, i) in enumerate(pfair(weights))]

    n_buckets = max(1, sum(r["docs"] for r in per_source.values()) // ROWS_PER_BUCKET)
    plan = spark.createDataFrame([(s, int(round(total * share[s])), per_source[s]["size"], goal[s]["repeats"], weights[s]) for s in here], "source string, quota bigint, size bigint, repeats int, weight int")
    # the place of each document in its source's random order, by totals of hash ranges and then within each range
    upper = F.shiftright("h", 32) + F.lit(1 << 31)  # buckets are ranges of the hash, in its order
    rows = sizes.withColumn("bucket", F.shiftright(upper * F.lit(n_buckets), 32).cast("int"))
    ranges = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    before = ranges.withColumn("base", F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket")) - F.col("in_bucket")).drop("in_bucket")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("n_tokens").over(inside)).join(before, ["source", "bucket"]).withColumn("at", F.col("base") + F.col("upto") - F.col("n_tokens"))
    copies = placed.join(F.broadcast(plan), "source").withColumn("repeat_no", F.explode(F.sequence(F.lit(1), F.least(F.col("repeats"), F.ceil(F.col("quota") / F.col("size")).cast("int")))))
    copies = copies.withColumn("start_token", (F.col("repeat_no") - 1) * F.col("size") + F.col("at")).filter(F.col("start_token") + F.col("n_tokens") / 2 <= F.col("quota"))
    blocked = copies.withColumn("block_no", F.floor(F.col("start_token") / F.lit(block_tokens))).withColumn("in_period", (F.col("block_no") % F.col("weight")).cast("int"))
    timetable = spark.createDataFrame(slots, "source string, in_period int, t int")
    timed = blocked.join(F.broadcast(timetable), ["source", "in_period"])
    slot = F.floor(F.col("block_no") / F.col("weight")) * F.lit(len(slots)) + F.col("t")
    return timed.select("source", "doc_id", "repeat_no", "n_tokens", "start_token", "block_no", slot.alias("slot"))


def shares(mix: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Each source of either table: its target, what it gives, and the share reached."""
    got = mix.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("copies"), F.max("repeat_no").alias("most_repeats"))
    have = docs.filter(F.col("source").isNotNull()).groupBy("source").agg(F.count("*").alias("documents"))
    goal = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    every = have.join(goal, "source", "full").join(got, "source", "left")
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return every.select("source", zero("documents"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), zero("max_repeats"), zero("tokens"), zero("copies"), zero("most_repeats"), F.coalesce(F.round(F.col("tokens") / total, 9), F.lit(0.0)).alias("share"))
