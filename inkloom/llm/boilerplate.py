"""Page boilerplate mixed with main content.

Method: union-free regular expressions inferred per site.  A page is a stream of lines.  The streams of one site are
aligned one after the other into a wrapper: an ordered list of constants, with text slots wherever streams differ.  A
line that stands in its place on some pages only is an optional part, a run of link lines is a repeated group whose
labels are slots, and a label line of which only some words agree is a constant with a slot inside.  A line that the
site repeats, but at a place of its own on every page, gets no place in the wrapper and stays part of a text slot.
Every page is then parsed by the wrapper: what falls into a text slot is article, what matches a constant, an optional
part or a repeated group is not.

Hosts with few pages can't tell their constants by themselves; constants found on several other hosts hold for them too.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.session import store

TITLE, HEADING, TABLE, CODE, LINK_ITEM, TOC_ITEM, LINKS, TEXT = range(1, 9)
OPENS, LISTED = 1, 2  # flags of a line: announces what follows; is a list item
RECUR = 3  # documents of one site at one place, or sites, that make a line constant
PART = 20_000  # pages of one site that are aligned in one task, about
SHARED = 500_000  # keys of eight bytes that are broadcast, at most; more are joined
WORDS, ENDS = 20, 4  # words of a label line at most; constant words tried at each of its ends
_TITLE_TOKEN, _ITEMS, _LINKS = 1, 2, 3  # tokens that stand for the kind of a line
_BLANK = " \t\r 　"
_LETTERS = re.compile(r"[\W\d_]+")
_WORD = re.compile(r"[^\W\d_]+")
_LABEL = re.compile(r"!?\[([^\]\n]*)\]\([^)\n]*\)")
_LINK = r"!?\[[^\]\n]*\]\([^)\n]*\)"
_MARK = r"(?:[-*+]|\d{1,3}[.)])"
_HEAD = re.compile(r"(#{1,6})\s")
_TOC = re.compile(rf"{_MARK}\s+\*{{0,2}}\[[^\]]*\]\(#[^)]*\)\*{{0,2}}$")
_ITEM = re.compile(rf"{_MARK}\s+\*{{0,2}}{_LINK}\*{{0,2}}$")
_ROW = re.compile(rf"[>\s*_]*{_LINK}(?:[\s|·•,/*_]*{_LINK})*[\s*_]*$")
_BULLET = re.compile(rf"{_MARK}\s")
_CLOSED = re.compile(r"[.!?:;。！？：…]\W*$")
_OPEN = re.compile(r"[:：]\W*$")
_NAME = re.compile(r"\w_\w")


def letters(text: str) -> str:
    return _LETTERS.sub("", text.lower().replace("ß", "ss"))


def classify(line: str) -> tuple[int, str, int, str]:
    """``kind, letters, flags, label`` of a line; ``label``: the words of short lines that don't end as sentences do."""
    linked = "](" in line
    shown = _LABEL.sub(r"\1", line) if linked else line
    if line[0] == "#":
        m = _HEAD.match(line)
        kind = TEXT if not m else TITLE if len(m[1]) == 1 else HEADING
    elif line[0] == "|":
        kind = TABLE
    elif not linked:
        kind = TEXT
    else:
        kind = TOC_ITEM if _TOC.match(line) else LINK_ITEM if _ITEM.match(line) else LINKS if _ROW.match(line) else TEXT
    end = line[-4:]
    flags = (OPENS if _OPEN.search(end) else 0) | (LISTED if _BULLET.match(line) else 0)
    label = ""
    if kind == TEXT and not flags & LISTED and len(line) < 120 and not _CLOSED.search(end) and not _NAME.search(line):
        words = _WORD.findall(shown.lower())
        label = " ".join(words) if 1 < len(words) <= WORDS else ""
    return kind, letters(shown) if kind in (TITLE, HEADING, TEXT) else "", flags, label


def _hash(text: str, seed: int = 0) -> int:
    """A signed 62-bit number, never one of the tokens that stand for kinds."""
    return (xxhash.xxh64_intdigest(text, seed) >> 2) | 8


def line_key(kind: int, shown: str) -> int:
    """The string of a line as a number; link lines have none, as their labels are slots."""
    return _hash(shown, kind == HEADING) if shown and kind in (HEADING, TEXT) else 0


def label_keys(label: str) -> list[int]:
    """Keys of a label line with one slot inside, from the most constant words to the fewest."""
    words = label.split(" ")
    n = len(words)
    ends = sorted(((p + s, p, s) for p in range(min(ENDS, n - 1) + 1) for s in range(min(ENDS, n - 1 - p) + 1) if p + s), reverse=True)
    return [_hash(" ".join(words[:p]) + "\0" + " ".join(words[n - s :] if s else []), 2) for _, p, s in ends]


class _Reader:
    """Texts to lines; lines met before aren't looked at again."""

    def __init__(self) -> None:
        self.seen: dict[str, tuple[int, str, int, str]] = {}

    def read(self, text: str, owner: str) -> tuple[str, list[int], list[int], list[int], list[int], list[str]]:
        """Letters of the title, and ``number, kind, flags, key, label`` of the lines that aren't blank; code is one line."""
        title, numbers, kinds, flags, keys, labels = "", [], [], [], [], []
        inside = titled = False
        for n, line in enumerate(text.split("\n"), 1):
            line = line.strip(_BLANK)
            if not line or inside and not line.startswith("```"):
                continue
            if line.startswith("```"):
                inside = not inside
                if not inside:
                    continue
                kind, shown, flag, label = CODE, "", 0, ""
            else:
                found = self.seen.get(line)
                if found is None:
                    found = classify(line)
                    if len(line) < 300:
                        self.seen[line] = found
                kind, shown, flag, label = found
                if owner and owner in shown:  # the owner's name is a slot
                    shown = shown.replace(owner, "{}")
                    label = " ".join("{}" if w == owner else w for w in label.split(" "))
            if kind == TITLE and not titled:
                title, titled = shown, True
            numbers.append(n)
            kinds.append(kind)
            flags.append(flag)
            keys.append(line_key(kind, shown))
            labels.append(label if titled else "")
        if len(self.seen) > 200_000:
            self.seen.clear()
        return title, numbers, kinds, flags, keys, labels


_PAGES = "page bigint, site bigint, doc bigint, numbers binary, kinds binary, flags binary, keys binary, labels string"


def _read_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    reader = _Reader()
    for batch in batches:
        rows = []
        for page, site, doc, owner, text in batch[["page", "site", "doc", "owner", "text"]].itertuples(index=False, name=None):
            name = letters(owner) if owner else ""
            title, numbers, kinds, flags, keys, labels = reader.read(text, name if len(name) > 2 else "")
            if numbers:
                # Copies of one article under several addresses are one document: its title tells it.
                rows.append((
                    page, site, _hash(title, 3) if title else doc, np.array(numbers, "<i4").tobytes(), np.array(kinds, "i1").tobytes(), np.array(flags, "i1").tobytes(),
                    np.array(keys, "<i8").tobytes(), "\n".join(labels) if any(labels) else "",
                ))
        yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in _PAGES.split(", ")])


def page_streams(pages: DataFrame, text: str, site: str, document: str, row_id: str, owner: str) -> DataFrame:
    """The lines of every page, those that aren't blank, as packed numbers: one row a page, ``site`` and ``doc`` hashed."""
    rows = pages.where(F.col(text).isNotNull() & F.col(row_id).isNotNull()).select(
        F.col(row_id).cast("bigint").alias("page"), F.xxhash64(F.coalesce(site, F.lit(""))).alias("site"), F.xxhash64(F.coalesce(document, F.lit(""))).alias("doc"),
        F.col(owner).cast("string").alias("owner"), F.col(text).alias("text"),
    )
    return rows.mapInPandas(_read_pages, _PAGES)


def _keys_of(keys: bytes, labels: str) -> set[int]:
    found = set(np.frombuffer(keys, "<i8").tolist())
    if labels:
        for label in labels.split("\n"):
            if label:
                found.update(label_keys(label))
    found.discard(0)
    return found


def _count(group: pd.DataFrame) -> pd.DataFrame:
    """``key, doc``: of every key up to RECUR documents of a part; where the site has one part, only what recurs."""
    docs: dict[int, set[int]] = defaultdict(set)
    for doc, keys, labels in group.drop_duplicates(["doc", "keys", "labels"])[["doc", "keys", "labels"]].itertuples(index=False, name=None):
        for key in _keys_of(keys, labels):
            own = docs[key]
            if len(own) < RECUR:
                own.add(doc)
    alone = group["parts"].iloc[0] == 1
    rows = [(key, doc) for key, own in docs.items() if not alone or len(own) >= RECUR for doc in sorted(own)]
    out = pd.DataFrame(rows, columns=["key", "doc"], dtype=np.int64)
    return out.assign(site=group["site"].iloc[0], part=group["part"].iloc[0])[["site", "part", "key", "doc"]]


def _present(group: pd.DataFrame) -> pd.DataFrame:
    found: set[int] = set()
    for keys, labels in group[["keys", "labels"]].itertuples(index=False, name=None):
        found |= _keys_of(keys, labels)
    out = pd.DataFrame({"key": np.array(sorted(found), dtype=np.int64)})
    return out.assign(site=group["site"].iloc[0], part=group["part"].iloc[0])[["site", "part", "key"]]


class Wrapper:
    """Places in order, each for one token; a token that streams have in several orders has several places."""

    def __init__(self) -> None:
        self.rank: list[float] = []
        self.docs: list[set[int]] = []  # up to RECUR documents matched at the place
        self.pages: list[int] = []
        self.text: list[int] = []  # pages on which a text slot follows
        self.places: dict[int, list[int]] = {}  # by token, the last place first

    def align(self, stream: list[int], follows: list[bool], doc: int, weight: int = 1) -> list[int]:
        """The place of every token of a stream; tokens differ.  What has no place in the wrapper's order becomes an option there."""
        # Of all runs in the wrapper's order, the one whose places most pages stand for matches.
        ranks: list[float] = []  # where the best runs so far end, with what they weigh and their links, all ascending
        best: list[int] = []
        ends: list[tuple] = []
        for j, token in enumerate(stream):
            for place in self.places.get(token, ()):
                rank = self.rank[place]
                at = bisect_left(ranks, rank)
                total = (best[at - 1] if at else 0) + self.pages[place]
                to = at
                while to < len(ranks) and best[to] <= total:
                    to += 1
                if to > at or at == len(ranks) or ranks[at] > rank:
                    ranks[at:to], best[at:to], ends[at:to] = [rank], [total], [(j, place, ends[at - 1] if at else None)]
        got = [-1] * len(stream)
        link = ends[-1] if ends else None
        while link:
            got[link[0]], link = link[1], link[2]
        low, fresh = 0.0, []
        for j, place in enumerate(got):
            if place < 0:
                fresh.append(j)
                continue
            self._insert(stream, got, fresh, low, self.rank[place])
            fresh, low = [], self.rank[place]
        self._insert(stream, got, fresh, low, low + len(fresh) + 1)
        for j, place in enumerate(got):
            self.pages[place] += weight
            self.text[place] += weight * follows[j]
            if len(self.docs[place]) < RECUR:
                self.docs[place].add(doc)
        return got

    def _insert(self, stream: list[int], got: list[int], fresh: list[int], low: float, high: float) -> None:
        step = (high - low) / (len(fresh) + 1)
        for n, j in enumerate(fresh, 1):
            got[j] = len(self.rank)
            self.rank.append(low + step * n)
            self.docs.append(set())
            self.pages.append(0)
            self.text.append(0)
            self.places.setdefault(stream[j], []).append(got[j])
            self.places[stream[j]].sort(key=lambda p: -self.rank[p])
        if fresh and step < 1e-6:  # no room left between two places: number all of them anew
            number = {r: float(n) for n, r in enumerate(sorted(set(self.rank)), 1)}
            self.rank = [number[r] for r in self.rank]


def tokens(kinds: list[int], flags: list[int], keys: list[int], labels: list[str], known: set[int], wide: set[int], slotted: dict[str, int]) -> list[int]:
    """The token of every line, 0 for what is text.  Links that a sentence of the text announces belong to that text."""
    out = [0] * len(kinds)
    announced = titled = False
    for i, kind in enumerate(kinds):
        if kind in (TITLE, HEADING, TABLE, CODE):
            announced = False
            if kind == TITLE and not titled:
                out[i], titled = _TITLE_TOKEN, True
            elif kind == HEADING and (keys[i] in known or keys[i] in wide):
                out[i] = keys[i]
        elif kind in (LINK_ITEM, TOC_ITEM) or flags[i] & LISTED:
            if not announced:
                out[i] = _ITEMS if kind != TEXT else keys[i] if keys[i] in known or keys[i] in wide else 0
        elif kind == LINKS:
            out[i], announced = _LINKS, False
        else:
            if keys[i] in wide:
                out[i] = keys[i]
            else:
                out[i] = slotted.get(labels[i], 0) or (keys[i] if keys[i] in known else 0)
            announced = bool(flags[i] & OPENS) and not out[i]
    return out


def slots(labels: set[str], known: set[int], wide: set[int]) -> dict[str, int]:
    """The key of every label line that has one: of those its site repeats, the one that most labels agree in."""
    fit = {label: [k for k in label_keys(label) if k in known or k in wide] for label in labels}
    alike = Counter(k for found in fit.values() for k in found)
    return {label: max(found, key=alike.__getitem__) for label, found in fit.items() if found}


def infer_and_parse(streams: list[tuple[int, list[int], list[int], list[int], list[str], int]], known: set[int], wide: set[int]) -> list[list[bool]]:
    """Infer the wrapper of a site's streams, ``doc, kinds, flags, keys, labels, pages``, and parse them: which lines aren't article.

    ``known``: keys that the site repeats; ``wide``: constants of other hosts.  A key of ``known`` is constant where
    RECUR documents have it at one place of the wrapper; where fewer have it at all here, in one of several parts of a
    site, all of them must.
    """
    wrapper = Wrapper()
    marks, docs = [], defaultdict(set)
    slotted = slots({label for *_, labels, _ in streams for label in labels if label}, known, wide)
    for doc, kinds, flags, keys, labels, pages in streams:
        made = tokens(kinds, flags, keys, labels, known, wide, slotted)
        first: dict[int, int] = {}
        for i, token in enumerate(made):
            if token:
                first.setdefault(token, i)  # a token met again repeats its group
                if len(docs[token]) < RECUR:
                    docs[token].add(doc)
        text = [i + 1 < len(made) and not made[i + 1] and kinds[i + 1] in (TITLE, TABLE, CODE, TEXT) for i in first.values()]
        got = wrapper.align(list(first), text, doc, pages)
        marks.append((kinds, made, dict(zip(first, got, strict=True))))
    out = []
    for kinds, made, place in marks:
        start = kinds.index(TITLE) if TITLE in kinds else -1
        n = len(kinds)
        found = [i < start for i in range(n)]  # nothing is article before its title heading
        for i in range(start + 1, n):
            token = made[i]
            if token:
                fixed = token <= _LINKS or token in wide or len(wrapper.docs[place[token]]) >= min(RECUR, len(docs[token]))
                # Headings that mostly lead into text label a text slot.
                found[i] = fixed and not (kinds[i] == HEADING and wrapper.text[place[token]] * 2 >= wrapper.pages[place[token]])
        for i in range(n - 1, start, -1):
            if kinds[i] == HEADING:  # a heading goes with the group it opens
                found[i] = found[i] and (i + 1 == n or found[i + 1])
        out.append(found)
    return out


def _parse(pages: pd.DataFrame, known: set[int], wide: set[int]) -> pd.DataFrame:
    alike = ["doc", "kinds", "flags", "keys", "labels", "numbers"]
    groups = [(*key, group) for key, group in pages.drop_duplicates(["page", *alike]).groupby(alike, sort=True)["page"]]
    streams = [
        (doc, np.frombuffer(kinds, "i1").tolist(), np.frombuffer(flags, "i1").tolist(), np.frombuffer(keys, "<i8").tolist(), labels.split("\n") if labels else [""] * len(kinds), len(group))
        for doc, kinds, flags, keys, labels, _, group in groups
    ]
    ids, lines = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for (*_, numbers, group), marks in zip(groups, infer_and_parse(streams, known, wide), strict=True):
        found = np.frombuffer(numbers, "<i4")[np.array(marks, dtype=bool)]
        ids.append(np.repeat(group.to_numpy(np.int64), len(found)))
        lines.append(np.tile(found, len(group)))
    return pd.DataFrame({"page": np.concatenate(ids), "line_no": np.concatenate(lines)})


def boilerplate_lines(pages: DataFrame, text: str, site: str, document: str, row_id: str, owner: str) -> DataFrame:
    """``row_id, line_no`` of every non-blank line that isn't part of a page's article.

    ``row_id`` (an integer) tells the rows apart; rows without it are left out, repeated ones count once.  Null or empty
    texts have no lines; a null site is a site of its own, a null owner leaves no slot for its name.  Before the title
    heading nothing is article; a page without one is parsed from its first line.  An empty table gives an empty result;
    other columns are ignored.  Lines of any length may be constants.  Large sites are aligned in parts of about PART
    pages each, cut by row and not by content, so copies of one page can't gather in one task.
    """
    streams = store(page_streams(pages, text, site, document, row_id, owner))
    size = streams.groupBy("site").agg(F.ceil(F.count(F.lit(1)) / PART).cast("bigint").alias("parts"))
    size = F.broadcast(size) if size.count() <= SHARED else size
    parted = streams.join(size, "site").withColumn("part", F.pmod(F.xxhash64("page"), "parts"))
    counted = store(parted.select("site", "part", "parts", "doc", "keys", "labels").groupBy("site", "part").applyInPandas(_count, "site bigint, part bigint, key bigint, doc bigint"))
    own = store(counted.select("site", "key", "doc").distinct().groupBy("site", "key").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= RECUR).select("site", "key"))
    known = counted.select("site", "part", "key").distinct().join(own, ["site", "key"], "left_semi")
    wide = store(own.groupBy("key").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= RECUR).select("key"))
    if wide.count() <= SHARED:  # eight bytes each
        shared = streams.sparkSession.sparkContext.broadcast(np.array([r[0] for r in wide.collect()], dtype=np.int64))
        keys = known.withColumn("wide", F.lit(False))
    else:
        shared = None
        present = parted.groupBy("site", "part").applyInPandas(_present, "site bigint, part bigint, key bigint")
        keys = known.withColumn("wide", F.lit(False)).unionByName(present.join(wide, "key", "left_semi").withColumn("wide", F.lit(True)))

    def parse(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        others = set(shared.value.tolist()) if shared else set(right.loc[right["wide"], "key"].tolist())
        return _parse(left, set(right.loc[~right["wide"].astype(bool), "key"].tolist()), others)

    parsed = parted.drop("parts").groupBy("site", "part").cogroup(keys.groupBy("site", "part")).applyInPandas(parse, "page bigint, line_no int")
    return parsed.select(F.col("page").alias(row_id), "line_no")
