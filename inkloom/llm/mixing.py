"""Mixing sources to target weights.

Method: Pfair scheduling.  A source's documents, laid end to end and repeated as often as needed, form blocks of equal
size.  Block k of a source of weight w may go from slot floor(k/w) on and must go before slot ceil((k+1)/w); among the
blocks released, the one with the earliest deadline takes the next slot.  At every slot each source is then less than a
block from its target.  The schedule is worked out for one period, after which every source has had whole blocks and
all begins anew, so mixes of any length have blocks of one size.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkloom.session import store

BLOCK = 4096  # tokens
PERIOD = 100_000  # slots of a period, at most; weights without so small a common denominator are rounded to as many parts
PLANS = 500_000  # rows of the periods that are broadcast, at most
SALTED = 200_000  # documents of one salt, about: where they begin is summed in one task


def schedule(blocks: dict[str, int], weights: dict[str, Fraction]) -> list[tuple[str, int]]:
    """``(source, block)`` slot by slot, earliest deadline first among the blocks released."""
    waiting = [(0, s, 0) for s, n in blocks.items() if n > 0]  # by release
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []  # by deadline
    out: list[tuple[str, int]] = []
    slot = 0
    while waiting or ready:
        if not ready and waiting[0][0] > slot:  # a last, partial block left a slot idle
            slot = waiting[0][0]
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (math.ceil((k + 1) / weights[s]), s, k))
        _, s, k = heapq.heappop(ready)
        out.append((s, k))
        slot += 1
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, (math.floor((k + 1) / weights[s]), s, k + 1))
    return out


def period(weights: dict[str, Fraction]) -> dict[str, int]:
    """Blocks of every source in one period: exact where the weights' common denominator is small enough, else rounded."""
    size = math.lcm(*(w.denominator for w in weights.values()))
    if size <= PERIOD:
        return {s: int(w * size) for s, w in weights.items()}
    size = max(PERIOD, len(weights))
    whole = {s: max(1, math.floor(w * size)) for s, w in weights.items()}
    most = sorted(weights, key=lambda s: (whole[s] - weights[s] * size, s))  # what rounding cost most comes first
    for s in most[: max(0, size - sum(whole.values()))]:
        whole[s] += 1
    return whole


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    """Quotas of one mix and the slots of one period; its rows are as many as sources."""
    mix = group["mix"].iloc[0]
    have = group[(group["supply"] > 0) & (group["share"] > 0) & (group["repeats"] > 0)].sort_values("source")
    if not len(have):
        return pd.DataFrame(columns=["mix", "source", "quota", "period", "slots"])
    total_share = sum(Fraction(x).limit_denominator(10**9) for x in have["share"])
    weights = {s: Fraction(x).limit_denominator(10**9) / total_share for s, x in zip(have["source"], have["share"], strict=True)}
    # The largest mix for which every source has enough.
    total = min(Fraction(int(n) * int(r)) / weights[s] for s, n, r in zip(have["source"], have["supply"], have["repeats"], strict=True))
    blocks = period(weights)
    size = sum(blocks.values())
    slots: dict[str, list[int]] = {s: [] for s in blocks}
    for at, (s, _) in enumerate(schedule(blocks, {s: Fraction(n, size) for s, n in blocks.items()})):
        slots[s].append(at)
    return pd.DataFrame([(mix, s, math.floor(weights[s] * total), size, slots[s]) for s in blocks], columns=["mix", "source", "quota", "period", "slots"])


def mix_sources(documents: DataFrame, doc_id: str, source: str, size: str, targets: DataFrame) -> DataFrame:
    """``mix, source, item, use_no, size, slot``: each use of a document in each mix and the slot of its first token.

    ``targets``: ``mix, source, share, repeats``; the shares of a mix are relative.  A mix is as large as the sources
    allow when none is used more often than its ``repeats``; sources without documents (or without share) can't
    contribute, and the others keep their proportions.  A document goes in if its middle falls within its source's
    quota; where the one at the quota's end is so long that this misses it by more than half a block, it is passed over
    in that pass and those behind it fill the rest.  So a source misses its quota by half a block at most, unless its
    documents run out.  Documents without id, source or size are in no mix;
    repeated rows are one; of repeated targets the greatest counts.
    """
    docs = documents.where(F.col(doc_id).isNotNull() & F.col(source).isNotNull() & (F.col(size) > 0))
    docs = docs.select(F.col(doc_id).alias("item"), F.col(source).alias("source"), F.col(size).cast("bigint").alias("size")).dropDuplicates(["item"])
    order = F.xxhash64("item")
    docs = store(docs.withColumn("order", order))
    salts = max(1, -(-docs.count() // SALTED))
    docs = docs.withColumn("salt", F.floor((F.col("order") / F.lit(2.0**64) + 0.5) * salts))
    targets = targets.where("mix is not null and source is not null").groupBy("mix", "source").agg(F.max("share").cast("double").alias("share"), F.max("repeats").alias("repeats"))
    sums = store(docs.groupBy("source", "salt").agg(F.sum("size").alias("n")))
    supply = sums.groupBy("source").agg(F.sum("n").alias("supply"))
    plan = targets.join(supply, "source", "left").na.fill({"supply": 0, "share": 0.0, "repeats": 1})
    plan = store(plan.groupBy("mix").applyInPandas(_plan, "mix string, source string, quota bigint, period bigint, slots array<bigint>"))
    # Where a document begins among its source's: behind the salts before, and inside its own.
    before = sums.select("source", "salt", (F.sum("n").over(Window.partitionBy("source").orderBy("salt")) - F.col("n")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("source", "salt").orderBy("order", "item").rowsBetween(Window.unboundedPreceding, -1))
    placed = docs.withColumn("inside", F.coalesce(inside, F.lit(0))).join(before, ["source", "salt"]).join(supply, "source").withColumn("begin", F.col("before") + F.col("inside"))
    placed = store(placed.select("item", "source", "size", "begin", "supply"))
    quotas = plan.join(supply, "source").select("mix", "source", "period", F.size("slots").alias("share"), F.floor(F.col("quota") / F.col("supply")).alias("passes"), (F.col("quota") % F.col("supply")).alias("end"))
    quotas = store(quotas)
    ends, skipped = _ends(placed, quotas)
    # Uses: whole passes, and in the last one what lies before its end.
    per = placed.join(_small(quotas.drop("end").join(ends, ["mix", "source"]).join(skipped, ["mix", "source"], "left")), "source")
    skips = F.coalesce("skips", F.array().cast("array<struct<begin:bigint,size:bigint>>"))
    gone = F.exists(skips, lambda x: x["begin"] == F.col("begin"))
    shift = F.aggregate(F.filter(skips, lambda x: x["begin"] < F.col("begin")), F.lit(0).cast("bigint"), lambda n, x: n + x["size"])
    last = (F.col("begin") + F.col("size") / 2 < F.col("end")) & ~gone
    uses = (F.col("passes") + F.when(last, 1).otherwise(0)).cast("int")
    used = per.withColumn("uses", uses).where("uses > 0").select("mix", "source", "item", "size", "begin", "supply", "period", "share", "passes", shift.alias("shift"), F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("use_no"))
    place = (F.col("use_no") - 1) * F.col("supply") + F.col("begin") - F.when(F.col("use_no") > F.col("passes"), F.col("shift")).otherwise(0)
    block = F.floor(place / BLOCK)
    used = used.withColumn("round", F.floor(block / F.col("share"))).withColumn("nth", F.pmod(block, F.col("share")))
    slots = store(plan.select("mix", "source", F.posexplode("slots").alias("nth", "at")).withColumn("nth", F.col("nth").cast("bigint")))
    return used.join(_small(slots), ["mix", "source", "nth"]).select("mix", "source", "item", "use_no", "size", (F.col("round") * F.col("period") + F.col("at")).alias("slot"))


def _small(df: DataFrame) -> DataFrame:
    """The frame with a hint to broadcast it if a count shows that it is small."""
    return F.broadcast(df) if df.count() <= PLANS else df


def _ends(placed: DataFrame, quotas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``mix, source, end`` of each last pass, and ``mix, source, skips``: documents passed over, by where they begin.

    A round looks at the one document across each open end; every round moves an end on, so there are as many as long
    documents follow one another at an end.
    """
    ends = quotas.select("mix", "source", "end")
    open_, moved, skipped = ends, None, None
    while True:
        across = placed.join(_small(open_), "source").where("begin < end and end < begin + size")
        miss = F.least(F.col("end") - F.col("begin"), F.col("begin") + F.col("size") - F.col("end"))
        far = store(across.where(miss * 2 > BLOCK).select("mix", "source", "begin", "size", F.least(F.col("begin") + F.col("size") + F.col("end") - F.col("begin"), F.col("supply")).alias("end")))
        if far.isEmpty():
            break
        skipped = far if skipped is None else skipped.unionByName(far)
        open_ = far.select("mix", "source", "end")
        moved = open_ if moved is None else moved.unionByName(open_)
    if skipped is None:
        return ends, ends.select("mix", "source", F.lit(None).cast("array<struct<begin:bigint,size:bigint>>").alias("skips")).limit(0)
    final = ends.unionByName(moved).groupBy("mix", "source").agg(F.max("end").alias("end"))
    return final, skipped.groupBy("mix", "source").agg(F.collect_list(F.struct("begin", "size")).alias("skips"))


def mix_report(uses: DataFrame, targets: DataFrame) -> DataFrame:
    """``mix, source, documents, uses, tokens, target, actual`` of every source of every mix."""
    got = uses.groupBy("mix", "source").agg(F.countDistinct("item").alias("documents"), F.count(F.lit(1)).alias("uses"), F.sum("size").alias("tokens"))
    all_ = targets.where("mix is not null and source is not null").groupBy("mix", "source").agg(F.max("share").alias("share")).join(got, ["mix", "source"], "left").na.fill(0, ["documents", "uses", "tokens"])
    whole = Window.partitionBy("mix")
    return all_.select(
        "mix", "source", "documents", "uses", "tokens", F.try_divide(F.col("share"), F.sum("share").over(whole)).alias("target"), F.try_divide(F.col("tokens"), F.sum("tokens").over(whole)).alias("actual")
    )
