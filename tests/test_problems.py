"""General data problems against brute force and on awkward input."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from inkloom.operators.hierarchy import all_descendants, descendants, resolve_hierarchy
from inkloom.operators.orphans import BITS, orphan_keys, pack, unpack
from inkloom.operators.snapshots import snapshot_changes, text_state


def brute_hierarchy(parent):
    out = {}
    for x in parent:
        seen, chain, y = set(), [], x
        while True:
            if y in seen:
                out[x] = ("cycle" if y == x else None, None, None)
                if y != x:
                    cyc, z = {y}, parent[y]
                    while z != y:
                        cyc.add(z)
                        z = parent[z]
                    out[x] = ("cycle" if x in cyc else "below_cycle", None, None)
                break
            seen.add(y)
            chain.append(y)
            p = parent[y]
            if p is None:
                out[x] = (None, y, chain[::-1])
                break
            if p not in parent:
                out[x] = ("detached", None, None)
                break
            y = p
    return out


@pytest.mark.parametrize("fragment_rows", [12, 1000])
def test_hierarchy_matches_brute_force(spark, fragment_rows):
    rng = random.Random(7)
    parent = {}
    for i in range(240):
        r = rng.random()
        parent[i] = None if i == 0 or r < 0.03 else 9000 + i if r < 0.05 else rng.choice([i - 1, rng.randrange(max(1, i))])
    for a, b in ((30, 60), (100, 100), (150, 200)):  # a becomes a child of something that may be below it
        parent[a] = b
    for i in range(200, 239):
        parent[i] = i + 1
    parent[239] = 200
    rows = spark.createDataFrame([(i, f"k{i}", None if p is None else f"k{p}", "s", i) for i, p in parent.items()] + [(5, "k5", f"k{parent[5]}" if parent[5] is not None else None, "s", 5)], "id long, key string, up string, site string, near long")
    got = {r.id: r for r in resolve_hierarchy(rows, "id", "key", "up", "site", "near", fragment_rows, True).collect()}
    want = brute_hierarchy(parent)
    assert len(got) == len(want)
    for i, (fault, root, path) in want.items():
        assert (got[i].fault, got[i].root_id, got[i].path) == (fault, root, path), i
        assert got[i].depth == (None if path is None else len(path) - 1)


def test_hierarchy_descendants_nulls_and_empty(spark):
    schema = "id long, key string, up string, site string"
    rows = spark.createDataFrame([(1, "a", None, "s"), (2, "b", "a", "s"), (3, "c", "b", "s"), (4, None, "a", "s"), (None, "d", "a", "s"), (6, "e", "", None), (7, "b", "zz", "t")], schema)
    solved = resolve_hierarchy(rows, "id", "key", "up", "site", None, 2, True)
    assert {(r.id, r.fault) for r in solved.collect()} == {(1, None), (2, None), (3, None), (6, None), (7, "detached")}
    assert {tuple(r) for r in descendants(solved).collect()} == {(1, 2, 1), (1, 3, 2), (2, 3, 1)}
    assert resolve_hierarchy(rows.limit(0), "id", "key", "up", "site").count() == 0


@pytest.mark.parametrize("fragment_rows", [4, 1000])
def test_all_descendants_match_brute_force(spark, fragment_rows):
    rng = random.Random(5)
    parent = {i: None if i % 20 == 0 else 900 + i if i % 20 == 1 else i - 1 if rng.random() < 0.6 else rng.randrange(i - i % 20, i) for i in range(80)}
    parent |= {20: 27, 33: 33, 40: 55}  # rings, one of a single entry
    rows = spark.createDataFrame([(i, f"k{i}", None if p is None else f"k{p}", "s", i) for i, p in parent.items()], "id long, key string, up string, site string, near long")
    want = set()
    for x in parent:
        seen, y, d = set(), parent[x], 1
        while y in parent and y not in seen:
            want.add((y, x, d))
            seen.add(y)
            y, d = parent[y], d + 1
    solved = resolve_hierarchy(rows, "id", "key", "up", "site", "near", fragment_rows, True)
    got = [tuple(r) for r in all_descendants(solved, fragment_rows).collect()]
    assert {g[:3] for g in got} == want and len(got) == len(want)
    faults = {r.id: r.fault for r in solved.collect()}
    assert set(faults.values()) == {None, "detached", "cycle", "below_cycle"} and all(faults[x] == f for _, x, _, f in got)


def test_bitmap_round_trip():
    import numpy as np

    for n in (0, 1, 100, 5000, BITS):
        bits = np.zeros(BITS, dtype=bool)
        bits[np.random.default_rng(n).permutation(BITS)[:n]] = True
        assert (unpack(pack(np.packbits(bits, bitorder="little").tobytes())) == bits).all()
    assert not unpack(pack(None)).any()


def test_orphans_match_brute_force(spark):
    rng = random.Random(3)
    refs = [("a", f"k{rng.randrange(60)}", rng.randrange(10)) for _ in range(400)] + [("a", None, 3), ("a", "k1", None)]
    parents = [("a", f"k{rng.randrange(50)}", rng.randrange(10), s, rng.random() < 0.6) for s in range(120)]
    parents = [(a, k, p, p * 1000 + s, x) for a, k, p, s, x in parents]
    want = set()
    for space, key, period in refs:
        if key is None or period is None:
            continue
        past = [p for p in parents if p[1] == key and p[2] <= period]
        if not past or not max(past, key=lambda p: p[3])[4]:
            want.add((space, key, period))
    r = spark.createDataFrame(refs, "space string, key string, period long")
    p = spark.createDataFrame(parents, "space string, key string, period long, seq long, present boolean")
    assert {tuple(x) for x in orphan_keys(r, p).collect()} == want
    assert orphan_keys(r.limit(0), p).count() == 0
    assert orphan_keys(r, p.limit(0)).count() == len({x for x in refs if None not in x})


def test_snapshot_changes(spark):
    at = lambda d: dt.datetime(2025, 1, d)
    rows = [
        (1, "u1", "a \nb", False, at(1)), (1, "u2", None, False, at(1)), (1, "u3", "x", False, at(1)), (1, "u3", "x", False, at(1)), (1, None, "x", False, at(1)), (None, "u9", "x", None, at(1)),
        (4, "u1", "a\nb \n\n", False, at(2)), (4, "u2", "", False, at(2)), (4, "u4", "new", None, at(2)), (4, "u3", "old", False, at(3)), (4, "u3", "x", False, None),
        (5, "u1", "a\n\nb", False, at(4)), (5, "u2", "", True, at(4)), (5, "u4", "new", False, at(4)), (5, "u3", "old", False, at(4)),
    ]
    df = spark.createDataFrame(rows, "no int, url string, md string, ph boolean, at timestamp").withColumns({"state": text_state(F.col("md")), "ph": F.coalesce("ph", F.lit(False)), "change_kind": F.lit(1)})
    got = {tuple(r) for r in snapshot_changes(df, "no", "url", ["state", "ph"], ["at"]).collect()}
    assert got == {(4, "u4", "added"), (4, "u3", "changed"), (5, "u1", "changed"), (5, "u2", "changed")}
    assert snapshot_changes(df.limit(0), "no", "url", ["state"], ["at"]).count() == 0
