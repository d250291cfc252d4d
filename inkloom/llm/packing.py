"""Filling fixed-capacity containers with items.

Method: sizes are whole numbers up to the capacity, so the instance is a histogram no longer than the capacity, however
many items there are.  Martello and Toth's dominance criteria fix sets of items that are as good as any alternative
until none applies; best fit, largest first, places the rest.  Whole groups of equal items move at once.  The patterns
found are then laid over the items, which never leave their partitions but for a rank among their equals.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkloom.session import store

SALTED = 200_000  # items of one salt, about: their ranks are counted in one task
SPAN = 4096  # ranks that are looked up together
KINDS = 10_000  # kinds that are broadcast, at most


class _Sizes:
    """A multiset of sizes with the distinct ones in order."""

    def __init__(self, counts: dict[int, int]):
        self.count = Counter({s: n for s, n in counts.items() if n > 0})
        self.order = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if self.count[size] == 0:
            del self.count[size]
            self.order.pop(bisect_left(self.order, size))

    def largest_upto(self, limit: int, used: tuple[int, ...] = ()) -> int:
        """The largest size within ``limit`` of which more copies are there than ``used`` holds; 0 if none."""
        at = bisect_left(self.order, limit + 1) - 1
        while at >= 0:
            size = self.order[at]
            if self.count[size] > used.count(size):
                return size
            at -= 1
        return 0

    def smallest(self, n: int, used: tuple[int, ...]) -> list[int]:
        out: list[int] = []
        for size in self.order:
            out += [size] * min(n - len(out), self.count[size] - used.count(size))
            if len(out) >= n:
                break
        return out


def _best_pair(sizes: _Sizes, room: int, used: tuple[int, ...]) -> tuple[int, int]:
    """The two sizes with the greatest sum within ``room``, the larger first; zeros if there are no two."""
    best = (0, 0)
    low, high = 0, bisect_left(sizes.order, room + 1) - 1
    while low <= high:
        a, b = sizes.order[high], sizes.order[low]
        if a + b > room or sizes.count[a] <= used.count(a):
            high -= 1
            continue
        have = sizes.count[b] > used.count(b) if a != b else sizes.count[a] - used.count(a) >= 2
        if have and sizes.count[a] > used.count(a) and a + b > sum(best):
            best = (a, b)
        low += 1
    return best


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Dominance reduction: ``(sizes, copies)`` of the containers fixed, and what is left of the histogram."""
    sizes, fixed, changed = _Sizes(counts), [], True
    while changed:
        changed = False
        for j in sorted(sizes.order, reverse=True):
            while sizes.count.get(j):
                room, used = capacity - j, (j,)
                three = sizes.smallest(3, used)
                fit = 0
                while fit < len(three) and sum(three[: fit + 1]) <= room:
                    fit += 1
                top = sizes.largest_upto(room, used)
                chosen: tuple[int, ...] | None = None
                if fit == 0:
                    chosen = (j,)
                elif fit == 1 or j + top == capacity:
                    chosen = (j, top)
                elif fit == 2:
                    a, b = _best_pair(sizes, room, used)
                    if top >= a + b:
                        chosen = (j, top)
                    elif top == a and b:
                        # No two items smaller than b may take its place together with room to spare.
                        below = sizes.largest_upto(b - 1, used)
                        second = sizes.largest_upto(below, (*used, below)) if below else 0
                        if not second or j + below + second > capacity:
                            chosen = (j, a, b)
                if chosen is None:
                    break
                need = Counter(chosen)
                # Taking items away only takes alternatives away, so what dominates goes on doing so.
                copies = min(sizes.count[s] // n for s, n in need.items())
                for s, n in need.items():
                    sizes.take(s, n * copies)
                fixed.append((chosen, copies))
                changed = True
    return fixed, dict(sizes.count)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Best fit, largest first, on a histogram: ``(sizes, copies)`` of the containers."""
    open_: dict[int, list[tuple[Counter, int]]] = {}  # by room left
    rooms: list[int] = []

    def put(room: int, group: tuple[Counter, int]) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append(group)

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                if left >= each:
                    put(capacity - size * each, (Counter({size: each}), left // each))
                    left %= each
                else:
                    put(capacity - size * left, (Counter({size: left}), 1))
                    left = 0
                continue
            room = rooms[at]
            inside, copies = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            each = room // size
            full = min(copies, left // each)
            if full:
                put(room - size * each, (inside + Counter({size: each}), full))
                left -= full * each
            elif left:
                put(room - size * left, (inside + Counter({size: left}), 1))
                full, left = 1, 0
            if copies > full:
                put(room, (inside, copies - full))
    return [group for groups in open_.values() for group in groups]


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    fixed, rest = reduce_instance(counts, capacity)
    merged: Counter[tuple[int, ...]] = Counter()
    for chosen, copies in fixed:
        merged[chosen] += copies
    return [(Counter(c), n) for c, n in merged.items()] + best_fit(rest, capacity)


def _solve(group: pd.DataFrame) -> pd.DataFrame:
    capacity, rows, first = int(group["capacity"].iloc[0]), [], 0
    start: Counter[int] = Counter()
    for inside, copies in patterns({int(s): int(n) for s, n in zip(group["size"], group["n"], strict=True)}, capacity):
        for size, each in inside.items():
            rows.append((group["kind"].iloc[0], size, start[size], start[size] + each * copies, first, each))
            start[size] += each * copies
        first += copies
    return pd.DataFrame(rows, columns=["kind", "size", "low", "high", "first", "each"])


def pack(items: DataFrame, item: str, size: str, kinds: DataFrame, kind: str, capacity: str) -> DataFrame:
    """``kind, container, item, piece, size``: the contents of the containers of every kind.

    Items larger than a capacity are split into full pieces, each a container of its own, and a last piece that is
    packed like any item; no other item is split.  Items of no size, and with null id or size, take no room and are in
    no container.  Kinds with a null name or a capacity below one are left out; repeated kinds count once.  ``item``
    tells the items apart: repeated rows are one.
    """
    kinds = kinds.where(F.col(kind).isNotNull() & (F.col(capacity) >= 1)).groupBy(F.col(kind).alias("kind")).agg(F.max(capacity).cast("bigint").alias("capacity"))
    sized = store(items.where(F.col(item).isNotNull() & (F.col(size) > 0)).select(F.col(item).alias("item"), F.col(size).cast("bigint").alias("all")).dropDuplicates(["item"]))
    salts = max(1, -(-sized.count() // SALTED))
    # Every item goes into a container of every kind: the result has that many rows.
    each = sized.crossJoin(F.broadcast(kinds) if kinds.count() <= KINDS else kinds)
    whole = F.floor(F.col("all") / F.col("capacity"))
    full = each.where(whole > 0).select("kind", "item", "capacity", F.explode(F.sequence(F.lit(1).cast("bigint"), whole)).alias("piece"))
    full = full.select("kind", F.concat_ws(":", "kind", F.concat(F.lit("d"), "item"), "piece").alias("container"), "item", "piece", F.col("capacity").alias("size"))
    rest = each.where(F.col("all") % F.col("capacity") > 0).select("kind", "capacity", "item", (whole + 1).alias("piece"), (F.col("all") % F.col("capacity")).alias("size"), F.pmod(F.xxhash64("item"), F.lit(salts)).alias("salt"))
    counts = store(rest.groupBy("kind", "capacity", "size", "salt").agg(F.count(F.lit(1)).alias("n")))
    slots = store(counts.groupBy("kind", "capacity", "size").agg(F.sum("n").alias("n")).groupBy("kind").applyInPandas(_solve, "kind string, size bigint, low bigint, high bigint, first bigint, each bigint"))
    # The rank of an item among its equals: inside its salt, behind the salts before.
    before = counts.select("kind", "size", "salt", (F.sum("n").over(Window.partitionBy("kind", "size").orderBy("salt")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("kind", "size", "salt").orderBy("item")) - 1
    ranked = rest.withColumn("inside", inside).join(before, ["kind", "size", "salt"]).withColumn("rank", F.col("before") + F.col("inside")).withColumn("part", F.floor(F.col("rank") / SPAN))
    # A span of ranks is looked up in every part that it reaches into, so an item meets at most SPAN spans.
    reach = F.sequence(F.floor(F.col("low") / SPAN), F.floor((F.col("high") - 1) / SPAN))
    placed = ranked.join(slots.withColumn("part", F.explode(reach)), ["kind", "size", "part"]).where("low <= rank and rank < high")
    number = F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))
    return placed.select("kind", F.concat_ws(":", "kind", number).alias("container"), "item", "piece", "size").unionByName(full)


def fill_report(packed: DataFrame, kinds: DataFrame, kind: str, capacity: str) -> DataFrame:
    """``kind, containers, tokens, bound, fill`` of every kind; ``bound``: the containers needed if none had room left."""
    capacities = kinds.where(F.col(kind).isNotNull() & (F.col(capacity) >= 1)).groupBy(F.col(kind).alias("kind")).agg(F.max(capacity).cast("bigint").alias("capacity"))
    used = packed.groupBy("kind", "container").agg(F.sum("size").alias("tokens")).groupBy("kind").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
    bound = F.ceil(F.col("tokens") / F.col("capacity"))
    return used.join(capacities, "kind").select("kind", "containers", "tokens", bound.alias("bound"), (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill"))
