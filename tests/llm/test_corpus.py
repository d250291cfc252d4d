"""Packing, mixing and subjects on small inputs."""

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkloom.llm import mixing as X
from inkloom.llm import packing as P
from inkloom.llm import subjects as S
from inkloom.llm.tokens import count_tokens, with_tokens


def test_tokens(spark):
    df = with_tokens(spark.createDataFrame([("hello world <|endoftext|>",), ("",), (None,)], "t string"), "t")
    got = [r.tokens for r in df.collect()]
    assert got[0] == count_tokens("hello world <|endoftext|>") > 3 and got[1:] == [0, 0]


@pytest.mark.parametrize("seed", range(6))
def test_patterns_keep_all_items_and_capacity(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 57, 200])
    counts = Counter(rng.randrange(1, capacity + 1) for _ in range(rng.choice([5, 60, 900])))
    made = P.patterns(dict(counts), capacity)
    used: Counter = Counter()
    for inside, copies in made:
        assert sum(s * n for s, n in inside.items()) <= capacity
        for s, n in inside.items():
            used[s] += n * copies
    assert used == counts
    bins, bound = sum(n for _, n in made), -(-sum(s * n for s, n in counts.items()) // capacity)
    assert bins <= 1.25 * bound + 2


def best(items, capacity):
    """The least number of containers, by trying all."""
    items, least = sorted(items, reverse=True), len(items)

    def go(i, rooms):
        nonlocal least
        if len(rooms) >= least:
            return
        if i == len(items):
            least = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= items[i]:
                rest = list(rooms)
                rest.remove(r)
                go(i + 1, [*rest, r - items[i]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return least


@pytest.mark.parametrize("seed", range(25))
def test_reduction_loses_no_optimum(seed):
    rng = random.Random(seed)
    items = [rng.randrange(1, 21) for _ in range(8)]
    fixed, rest = P.reduce_instance(dict(Counter(items)), 20)
    left = [s for s, n in rest.items() for _ in range(n)]
    assert sum(n for _, n in fixed) + (best(left, 20) if left else 0) == best(items, 20)


def test_pack(spark, monkeypatch):
    rng = random.Random(4)
    sizes = [rng.randrange(0, 130) for _ in range(400)] + [100] * 30 + [250]
    items = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)] + [(5, sizes[5], "x"), (None, 3, "x"), (900, None, "x")], "doc long, size long, piece string")
    kinds = spark.createDataFrame([("a", 100), ("b", 60), ("a", 100), (None, 5), ("z", 0)], "kind string, capacity int")
    rows = P.pack(items, "doc", "size", kinds, "kind", "capacity").collect()
    fill, got = Counter(), Counter()
    for r in rows:
        fill[r.kind, r.container] += r.size
        got[r.kind, r.item] += r.size
    assert all(n <= {"a": 100, "b": 60}[k] for (k, _), n in fill.items())
    assert got == Counter({(k, i): s for k in "ab" for i, s in enumerate(sizes) if s > 0})
    pieces = Counter((r.kind, r.item) for r in rows)
    assert all(n == 1 or sizes[i] > {"a": 100, "b": 60}[k] for (k, i), n in pieces.items())
    assert P.pack(items.limit(0), "doc", "size", kinds, "kind", "capacity").count() == 0
    report = {r.kind: r for r in P.fill_report(P.pack(items, "doc", "size", kinds, "kind", "capacity"), kinds, "kind", "capacity").collect()}
    assert report["a"].tokens == sum(sizes) and report["a"].bound == -(-sum(sizes) // 100) <= report["a"].containers <= 1.1 * report["a"].bound
    monkeypatch.setattr(P, "SALTED", 50)
    monkeypatch.setattr(P, "SPAN", 3)
    again = P.pack(items, "doc", "size", kinds, "kind", "capacity").collect()
    assert Counter((r.kind, r.item, r.piece, r.size) for r in again) == Counter((r.kind, r.item, r.piece, r.size) for r in rows)
    fill = Counter()
    for r in again:
        fill[r.kind, r.container] += r.size
    assert all(n <= {"a": 100, "b": 60}[k] for (k, _), n in fill.items()) and len(fill) == len({(r.kind, r.container) for r in rows})


def test_schedule_stays_within_a_block():
    weights = {"a": Fraction(1, 2), "b": Fraction(1, 3), "c": Fraction(1, 6)}
    blocks = {"a": 300, "b": 200, "c": 100}
    done: Counter = Counter()
    for slot, (source, block) in enumerate(X.schedule(blocks, weights), 1):
        assert block == done[source]
        done[source] += 1
        for s, w in weights.items():
            assert abs(done[s] - w * slot) < 1
    assert done == blocks


def test_periods_are_exact_or_rounded(monkeypatch):
    assert X.period({"a": Fraction(1, 2), "b": Fraction(1, 3), "c": Fraction(1, 6)}) == {"a": 3, "b": 2, "c": 1}
    odd = {"a": Fraction(300_007, 1_000_003), "b": Fraction(699_995, 1_000_003), "c": Fraction(1, 1_000_003)}
    rounded = X.period(odd)
    assert rounded["c"] == 1 and abs(sum(rounded.values()) - X.PERIOD) <= 1 and all(abs(rounded[s] - odd[s] * X.PERIOD) <= 1 for s in odd)


def test_slots_of_long_mixes(spark, monkeypatch):
    """More slots than a period holds: every source stays less than a block from its share, and no slot is taken twice by blocks."""
    monkeypatch.setattr(X, "BLOCK", 1)
    docs = spark.createDataFrame([(i, "ab"[i % 4 > 2], 1) for i in range(4000)], "doc long, source string, size long")
    targets = spark.createDataFrame([("m", "a", 0.75, 1), ("m", "b", 0.25, 1)], "mix string, source string, share double, repeats int")
    uses = sorted((r.slot, r.source) for r in X.mix_sources(docs, "doc", "source", "size", targets).collect())
    assert [s for s, _ in uses] == list(range(4000))
    done: Counter = Counter()
    for slot, source in uses:
        done[source] += 1
        assert abs(done["a"] - 0.75 * (slot + 1)) < 1
    assert done == {"a": 3000, "b": 1000}


def test_long_documents_at_the_end_of_a_quota(spark):
    """A document much longer than a block doesn't spoil its source's share; runs of them neither."""
    rng = random.Random(8)
    rows = [(i, "a", rng.choice([300, 500, 90_000]) if i % 5 == 0 else rng.randrange(100, 900)) for i in range(900)] + [(1000 + i, "b", 400) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc long, source string, size long")
    for share in (0.31, 0.5, 0.83):
        targets = spark.createDataFrame([("m", "a", share, 2), ("m", "b", 1 - share, 1)], "mix string, source string, share double, repeats int")
        used = X.mix_sources(docs, "doc", "source", "size", targets)
        report = {r.source: r for r in X.mix_report(used, targets).collect()}
        total = report["a"].tokens + report["b"].tokens
        assert abs(report["a"].tokens - share * total) <= X.BLOCK, (share, report)
        uses = used.collect()
        assert len({(r.item, r.use_no) for r in uses}) == len(uses) and all(r.slot is not None for r in uses)
        assert max(Counter(r.item for r in uses if r.source == "a").values()) <= 2


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["big"] * 8 + ["mid"] * 3 + ["small"]), rng.randrange(1, 300)) for i in range(3000)] + [(9001, None, 5), (9002, "big", None), (None, "big", 4)]
    docs = spark.createDataFrame(rows + rows[:4], "doc long, source string, size long").withColumn("item", F.lit(0))
    targets = spark.createDataFrame([("m", "big", 0.6, 1), ("m", "small", 0.3, 4), ("m", "none", 0.5, 2), ("n", "mid", 1.0, 2), ("n", "none", 1.0, 1), (None, "big", 1.0, 1)], "mix string, source string, share double, repeats int")
    used = X.mix_sources(docs, "doc", "source", "size", targets)
    uses = used.collect()
    report = {(r.mix, r.source): r for r in X.mix_report(used, targets).collect()}
    assert report["m", "big"].actual == pytest.approx(2 / 3, abs=0.01) and report["m", "small"].actual == pytest.approx(1 / 3, abs=0.01) and report["m", "none"].tokens == 0
    most = Counter((r.mix, r.item) for r in uses)
    caps = {"big": 1, "small": 4, "mid": 2}
    assert all(n <= caps[next(x[1] for x in rows if x[0] == i)] for (_, i), n in most.items())
    small = sum(x[2] for x in rows if x[1] == "small")
    assert report["m", "small"].tokens == pytest.approx(4 * small, rel=0.05) or report["m", "big"].uses == pytest.approx(len([x for x in rows if x[1] == "big"]), rel=0.05)
    assert all(r.slot is not None for r in uses)
    assert X.mix_sources(docs.limit(0), "doc", "source", "size", targets).count() == 0


TERMS = {"law": ["court", "judge", "clause", "tenant"], "sport": ["goal", "coach", "medal", "referee"], "farm": ["plough", "barn", "harvest", "tractor"]}


def corpus(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        own = rng.sample(sorted(TERMS), rng.choice([1, 1, 2]))
        lines = [f"The {rng.choice(TERMS[s])} of Xu{rng.randrange(99)}ba meets the {rng.choice(TERMS[s])}." for s in own for _ in range(rng.randrange(4, 8))]
        out.append((i, " ".join(lines + ["See the index."]), own))
    return out


def test_subjects_on_held_out_documents(spark):
    known = sorted(TERMS)
    train, held = corpus(1, 150), corpus(2, 80)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in train] + [(900, None, "x"), (901, "", "x")], "doc long, text string, subjects string")
    labels = spark.createDataFrame([(i, s) for i, _, own in train for s in own] + [(0, "law"), (1, "unknown"), (777, "law")], "doc long, subject string")
    model = S.fit(docs, labels, known, "doc", "text", "subject", steps=25)
    got = {}
    frame = spark.createDataFrame([(i, t) for i, t, _ in held] + [(900, None), (901, ""), (902, "# only\n")], "doc long, text string")
    for r in S.score(frame, model, known, "doc", "text").collect():
        got.setdefault(r.doc, set()).add(r.subject)
    assert not {900, 901, 902} & set(got)
    assert np.mean([got.get(i) == set(own) for i, _, own in held]) >= 0.9
    assert S.score(frame.limit(0), model, known, "doc", "text").count() == 0
    assert len(S.fit(docs, labels.limit(0), known, "doc", "text", "subject", steps=1)) == 3


def test_a_sentence_may_have_two_subjects():
    assert sorted(S.subjects_of(np.array([[0.9, 0.8], [0.1, 0.2]]), np.zeros(2, int), 1)) == [(0, 0), (0, 1)]
    labels, logits = np.array([[1, 1, 0], [1, 0, 0], [1, 0, 0]]), np.array([[2.0, 2.0, -5], [-3, -3, -3], [-2, 4, 3]])
    assert S.targets(labels, logits).tolist() == [[1, 1, 0], [0, 0, 0], [0, 1, 1]]


def test_gradient_against_differences():
    batch, wanted = S.Batch.encode(["a court judge", "the goal", ""]), np.array([[1, 0], [0, 1], [0, 0]], np.float32)
    model = [x.astype(np.float64) for x in S.start(2)]
    grads, loss = S.gradient(model, batch, wanted)
    for part, at in ((0, (S.features("court")[0], 3)), (1, (1, 2)), (2, (0,))):
        moved = [x.copy() for x in model]
        moved[part][at] += 1e-4
        assert (S.gradient(moved, batch, wanted)[1] - loss) / 1e-4 == pytest.approx(grads[part][at], abs=1e-3)


def test_share_of_sentences():
    p = np.zeros((10, 2))
    p[:8, 0], p[8:, 1] = 0.9, 0.9
    assert sorted(S.subjects_of(p, np.zeros(10, int), 1)) == [(0, 0), (0, 1)]
    p[9] = 0
    assert sorted(S.subjects_of(p, np.zeros(10, int), 1)) == [(0, 0)]
