"""Lines repeated across one site's documents.

Method: lines go down a fixed-depth tree per site - number of words, first word, second word, with a wildcard branch for
words too rare to lead to a template - to leaves that hold templates, word lists with wildcard slots.  Branches are
counted on partitions and the trees merged by adding the counts; crowded leaves grow in several pieces, whose equal
templates are one.  Templates that can't cover enough documents fall away, and of the rest those wordings count that
stand in the texts of enough documents of their site themselves.  Texts are cut into lines once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.session import store

ALIKE = 0.6  # share of equal words from which a wording joins a template
CROWD = 20_000  # wordings of one leaf in one piece
SMALL = 200_000  # rows of a few numbers that are broadcast, at most; a larger side is shuffled
SLOT = "*"
_GAP = re.compile(r"[\W\d_]+")
_LABEL = re.compile(r"!?\[([^\]\n]*)\]\([^)\n]*\)")
_LINES = "row bigint, doc bigint, line_no int, k1 bigint, k2 bigint, site string, words string, n bigint"


def wordings(text: str) -> list[tuple[int, str, str]]:
    """``number, words, letters`` of the lines that count: their letters in one case, between single spaces; of a link its label."""
    shown = _LABEL.sub(r"\1", text) if "](" in text else text
    out, inside = [], False
    for n, (line, label) in enumerate(zip(text.split("\n"), shown.split("\n"), strict=True), 1):
        line = line.lstrip(" \t")
        if line.startswith("```"):
            inside = not inside
        elif not inside and line and line[0] not in "#|":
            words = _GAP.sub(" ", label.upper().lower()).strip()
            letters = words.replace(" ", "")
            if letters and not letters.isalpha():  # signs such as ² ½ Ⅷ
                words = " ".join("".join(c if c.isalpha() else " " for c in words).split())
                letters = words.replace(" ", "")
            if letters:
                out.append((n, words, letters))
    return out


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for every line, and one without ``row`` for every wording of a batch, which has its words and lines."""
    names = [c.split(" ")[0] for c in _LINES.split(", ")]
    for batch in batches:
        seen: dict[tuple[str, str], list[int]] = {}
        rows, docs, numbers, first, second = [], [], [], [], []
        for row, doc, site, text in batch[["row", "doc", "site", "text"]].itertuples(index=False, name=None):
            for n, words, letters in wordings(text):
                own = seen.get((site, words))
                if own is None:
                    key = f"{site}\0{letters}"
                    own = seen[site, words] = [xxhash.xxh64_intdigest(key, 1) - (1 << 63), xxhash.xxh64_intdigest(key, 2) - (1 << 63), 0]
                own[2] += 1
                rows.append(row)
                docs.append(doc)
                numbers.append(n)
                first.append(own[0])
                second.append(own[1])
        yield pd.DataFrame({"row": pd.array(rows, "Int64"), "doc": pd.array(docs, "Int64"), "line_no": pd.array(numbers, "Int32"), "k1": np.array(first, np.int64), "k2": np.array(second, np.int64), "site": None, "words": None, "n": pd.array([None] * len(rows), "Int64")})[names]
        spelled = [(*own[:2], site, words, own[2]) for (site, words), own in seen.items()]
        made = pd.DataFrame(spelled, columns=["k1", "k2", "site", "words", "n"])
        yield made.assign(row=pd.array([None] * len(made), "Int64"), doc=pd.array([None] * len(made), "Int64"), line_no=pd.array([None] * len(made), "Int32"))[names]


def cut_lines(pages: DataFrame, text: str, site: str, document: str, row_id: str) -> tuple[DataFrame, DataFrame]:
    """``row, doc, line_no, k1, k2`` of the lines that count, and ``k1, k2, site, words, n``; keys tell the wordings of all sites apart."""
    rows = pages.where(F.col(site).isNotNull() & F.col(document).isNotNull() & F.col(text).isNotNull() & F.col(row_id).isNotNull())
    rows = rows.select(F.col(row_id).cast("bigint").alias("row"), F.xxhash64(document).alias("doc"), F.col(site).alias("site"), F.col(text).alias("text"))
    both = store(rows.mapInPandas(_cut, _LINES))
    return both.where("row is not null").select("row", "doc", "line_no", "k1", "k2"), both.where("row is null").select("k1", "k2", "site", "words", "n")


class Leaf:
    """Templates of one length; words are numbers here, and a slot is none of them."""

    def __init__(self, length: int) -> None:
        self.codes: dict[str, int] = {}
        self.rows = np.empty((4, length), dtype=np.int32)
        self.size = 0

    def grow(self, words: list[str]) -> int:
        """Place words in the leaf: the most similar template takes them, differing words becoming slots."""
        row = np.array([self.codes.setdefault(w, len(self.codes)) for w in words], dtype=np.int32)
        if self.size:
            same = (self.rows[: self.size] == row).sum(axis=1)
            at = int(same.argmax())
            if same[at] >= ALIKE * len(words):
                self.rows[at][self.rows[at] != row] = -1
                return at
        if self.size == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[self.size] = row
        self.size += 1
        return self.size - 1

    def patterns(self) -> list[str]:
        names = list(self.codes)
        return [" ".join(SLOT if c < 0 else names[c] for c in row) for row in self.rows[: self.size].tolist()]


def _close(site: str, pieces: int, rows: list[tuple[int, int, int, int]], leaf: Leaf, least: int) -> list[tuple]:
    """Rows of a leaf with their patterns; a leaf in one piece knows what its templates cover."""
    cover = np.bincount([r[3] for r in rows], weights=[r[2] for r in rows], minlength=leaf.size)
    patterns = leaf.patterns()
    return [(site, a, b, n, patterns[slot]) for a, b, n, slot in rows if pieces > 1 or cover[slot] >= least]


def _leaves(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Templates of rows sorted by leaf, piece and words."""
        last, leaf, rows, out = None, None, [], []
        for batch in batches:
            for *at, pieces, a, b, words, n in zip(*(batch[c] for c in ("site", "size", "first", "second", "piece", "pieces", "k1", "k2", "words", "n")), strict=True):
                if at != last:
                    if rows:
                        out += _close(last[0], last_pieces, rows, leaf, least)
                    last, last_pieces, leaf, rows = at, pieces, Leaf(at[1]), []
                rows.append((a, b, n, leaf.grow(words.split(" "))))
            yield pd.DataFrame(out, columns=["site", "k1", "k2", "n", "pattern"])
            out = []
        if rows:
            yield pd.DataFrame(_close(last[0], last_pieces, rows, leaf, least), columns=["site", "k1", "k2", "n", "pattern"])

    return run


def _sized(df: DataFrame) -> DataFrame:
    """The frame with a hint to broadcast it if a count shows that it is small."""
    return F.broadcast(df) if df.count() <= SMALL else df


def line_templates(spelled: DataFrame, least: int) -> DataFrame:
    """``k1, k2, template, site, pattern, n``: the wordings of all templates that cover at least ``least`` lines."""
    words = F.split("words", " ")
    spelled = spelled.select("*", F.size(words).alias("size"), words[0].alias("w1"), F.coalesce(F.get(words, F.lit(1)), F.lit("")).alias("w2"))
    # The trees of all partitions merged: lines and wordings of every path.
    paths = store(spelled.groupBy("site", "size", "w1", "w2").agg(F.sum("n").alias("lines"), F.count(F.lit(1)).alias("spelled")))
    firsts = paths.groupBy("site", "size", "w1").agg((F.sum("lines") >= least).alias("common"))
    tree = paths.join(firsts, ["site", "size", "w1"]).withColumn("first", F.when(F.col("common"), F.col("w1")).otherwise(SLOT))
    seconds = tree.groupBy("site", "size", "first", "w2").agg((F.sum("lines") >= least).alias("known"))
    tree = tree.join(seconds, ["site", "size", "first", "w2"]).withColumn("second", F.when(F.col("known"), F.col("w2")).otherwise(SLOT))
    leaf = ["site", "size", "first", "second"]
    # No template of a leaf with fewer lines than asked for can cover as many.
    full = tree.groupBy(*leaf).agg(F.sum("lines").alias("all"), F.ceil(F.sum("spelled") / CROWD).cast("int").alias("pieces")).where(F.col("all") >= least)
    tree = _sized(store(tree.join(full.drop("all"), leaf).select("site", "size", "w1", "w2", "first", "second", "pieces")))
    placed = spelled.join(tree, ["site", "size", "w1", "w2"]).withColumn("piece", F.pmod("k1", "pieces").cast("int"))
    order = [*leaf, "piece"]
    placed = placed.select(*order, "pieces", "k1", "k2", "words", "n").repartition(*order).sortWithinPartitions(*order, "words")
    grown = store(placed.mapInPandas(_leaves(least), "site string, k1 bigint, k2 bigint, n bigint, pattern string").withColumn("template", F.xxhash64("site", "pattern")))
    cover = grown.groupBy("template").agg(F.sum("n").alias("cover")).where(F.col("cover") >= least).select("template")
    return grown.join(_sized(store(cover)), "template", "left_semi")


def _documents(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """``template, k1, k2, doc``: the documents of every wording of the templates, once each."""
    return lines.select("k1", "k2", "doc").join(templates.select("k1", "k2", "template").distinct(), ["k1", "k2"]).groupBy("k1", "k2", "template", "doc").agg(F.count(F.lit(1)).alias("lines"))


def repeated_lines(pages: DataFrame, text: str, site: str, document: str, row_id: str, least: int = 12) -> DataFrame:
    """``row_id, line_no`` of each line whose wording stands in at least ``least`` documents of its site.

    Wording: the letters in one case, of a link its label.  Lines without letters, lines beginning with ``#`` or ``|``,
    and code fences with what they hold don't count.  Rows without ``row_id`` (an integer), site, document or text have
    no lines; repeated rows and several rows of one document count once; an empty table gives an empty result; other
    columns are ignored.
    """
    lines, spelled = cut_lines(pages, text, site, document, row_id)
    templates = line_templates(spelled, least)
    often = _documents(lines, templates).groupBy("k1", "k2", "template").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= least)
    often = _sized(store(often.select("k1", "k2").distinct()))
    return lines.join(often, ["k1", "k2"], "left_semi").select(F.col("row").alias(row_id), "line_no").distinct()


def repeated_templates(pages: DataFrame, text: str, site: str, document: str, row_id: str, least: int = 12) -> DataFrame:
    """``site, pattern, wordings, lines, documents`` of the templates that cover at least ``least`` documents of a site.

    A ``*`` in a pattern is a slot for one word.  What counts as a line is as in ``repeated_lines``; ``lines`` counts
    repeated rows too.
    """
    lines, spelled = cut_lines(pages, text, site, document, row_id)
    templates = store(line_templates(spelled, least))
    size = templates.groupBy("template").agg(F.first("site").alias("site"), F.first("pattern").alias("pattern"), F.countDistinct("k1", "k2").alias("wordings"))
    cover = _documents(lines, templates).groupBy("template", "doc").agg(F.sum("lines").alias("lines")).groupBy("template").agg(F.sum("lines").alias("lines"), F.count(F.lit(1)).alias("documents"))
    return size.join(cover.where(F.col("documents") >= least), "template").select("site", "pattern", "wordings", "lines", "documents")


def without_lines(pages: DataFrame, text: str, row_id: str, lines: DataFrame) -> DataFrame:
    """The pages with the given ``row_id, line_no`` taken out of their texts; all else as it was."""
    drop = lines.groupBy(row_id).agg(F.collect_set("line_no").alias("_drop"))
    numbered = F.filter(F.transform(F.split(F.col(text), "\n", -1), lambda x, i: F.struct((i + 1).alias("no"), x.alias("line"))), lambda s: ~F.array_contains("_drop", s["no"]))
    kept = F.when(F.col("_drop").isNull(), F.col(text)).otherwise(F.array_join(F.transform(numbered, lambda s: s["line"]), "\n"))
    return pages.join(drop, row_id, "left").withColumn(text, kept).drop("_drop")
