"""Visually identical text with different characters.

Method: the words that hold anything but plainly written characters are exploded to positioned code points.  Broadcast
tables - fixed in size by the Unicode standard - give decompositions, combining classes and look-alikes; letters of a
word go to the script of that word.  Combining marks are put in order of class, base and marks are recomposed, and the
words are rebuilt and put back in place.  Distinct words are worked on once, however many texts they stand in.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.session import store

# Letters that a reader can't tell apart, by script.  Fixed values.
LATIN = "AaBCcEeHIiJjKMOoPpSsTXxYyAaEIiKMNOoPpTXYZ"
OTHER = "АаВСсЕеНІіЈјКМОоРрЅѕТХхУуΑαΕΙιΚΜΝΟοΡρΤΧΥΖ"
# Look-alikes that only go one way: into Cyrillic words.  Fixed values.
TO_CYRILLIC = {"k": "к", "m": "м", "t": "т", "N": "И", "Z": "З", "Α": "А", "Β": "В", "Ε": "Е", "Η": "Н", "Ι": "І", "Κ": "К", "Μ": "М", "Ο": "О", "Ρ": "Р", "Τ": "Т", "Χ": "Х", "Υ": "У", "ο": "о", "α": "а", "ρ": "р", "χ": "х", "γ": "у"}
TO_LATIN = {"Β": "B", "Η": "H", "Χ": "X", "Υ": "Y", "Ζ": "Z", "ν": "v", "γ": "y", "χ": "x", "κ": "k", "τ": "t", "ε": "e", "һ": "h", "Һ": "H", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "к": "k", "т": "t", "м": "m", "г": "r", "п": "n", "ь": "b", "З": "3"}
# Characters that aren't seen.  Fixed values.
_UNSEEN = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x200B, 0x200C, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), 0xFEFF]
_EMOJI = ((0x1F000, 0x1FAFF), (0x2190, 0x21FF), (0x2600, 0x27BF), (0x2B00, 0x2BFF), (0xFE0F, 0xFE0F))
_JOINERS = ((0x200D, 0x200D), (0xFE00, 0xFE0F))
# Letters of three scripts that have doubles in each other.
_LAT = ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF))
_CYR = ((0x400, 0x52F),)
_GRE = ((0x370, 0x373), (0x376, 0x37D), (0x37F, 0x3FF), (0x1F00, 0x1FFF))
_SHAPES = ("wide", "narrow", "font", "initial", "medial", "final", "isolated")  # kinds of decompositions that change the shape only
_BREAK = re.compile(r"[\x00-\x20]+")


def _java(*ranges: tuple[int, int]) -> str:
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)


def _python(ranges: Iterable[tuple[int, int]]) -> str:
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in ranges)


@lru_cache(1)
def parts() -> dict[str, str]:
    """Every character that is written otherwise, fully decomposed: from the Unicode tables, spaces and invisible ones besides."""
    out: dict[str, str] = {}
    for code in range(0x80, 0x30000):
        if 0xAC00 <= code < 0xD7A4 or 0xD800 <= code < 0xE000:
            continue
        ch = chr(code)
        given = unicodedata.decomposition(ch)
        kind = given[1 : given.index(">")] if given.startswith("<") else ""
        category = unicodedata.category(ch)
        if unicodedata.normalize("NFD", ch) != ch:
            out[ch] = unicodedata.normalize("NFD", ch)
        elif kind in ("noBreak", "compat") and category == "Zs" and code != 0x3000 or code == 0x1680:
            out[ch] = " "
        elif kind in _SHAPES and category[0] in "LN" or 0xFB00 <= code <= 0xFB06 or code in (0x132, 0x133) or 0x1C4 <= code <= 0x1CC or 0x1F1 <= code <= 0x1F3:
            out[ch] = unicodedata.normalize("NFKD", ch)
    return out | {"\u2010": "-", "\u2011": "-"} | {chr(c): "" for c in _UNSEEN}


_ODD, _L, _C, _G, _DOUBLE, _JOINER = 1, 2, 4, 8, 16, 32


@lru_cache(1)
def kinds() -> np.ndarray:
    """Bits of every character, from the same tables: whether it may not be plain by itself, its script, whether it has doubles."""
    out = np.zeros(0x110000, dtype=np.uint8)
    single = {c for c, plain in parts().items() if unicodedata.normalize("NFC", plain) != c}
    single |= {chr(c) for c in range(0x300, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.combining(chr(c))}
    single |= {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}  # letters that Hangul syllables are composed of
    out[[ord(c) for c in single]] |= _ODD
    for bit, ranges in ((_L, _LAT), (_C, _CYR), (_G, _GRE), (_JOINER, _JOINERS)):
        for low, high in ranges:
            out[low : high + 1] |= bit
    out[[ord(c) for c in frozenset(OTHER) - frozenset(LATIN)]] |= _DOUBLE
    return np.where(out & _JOINER, out & ~np.uint8(_ODD), out)


_JOINED = re.compile(f"(?<![{_python(_EMOJI)}])[{_python(_JOINERS)}]")


def _look(text: str) -> tuple[bool, bool, bool]:
    """Whether a text has anything that may not be plain, letters of another script with doubles, and such without."""
    bits = kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    seen = int(np.bitwise_or.reduce(bits))
    odd = bool(seen & _ODD) or bool(seen & _JOINER and _JOINED.search(text))
    if not seen & (_C | _G):
        return odd, False, False
    script = bits & (_L | _C | _G)
    odd = odd or bool(((script[1:] != script[:-1]) & (script[1:] > 0) & (script[:-1] > 0)).any())
    foreign = bits[bits & (_C | _G) > 0]
    return odd, bool((foreign & _DOUBLE).any()), bool((foreign & _DOUBLE == 0).any())


def odd_words(text: str) -> tuple[bool, list[str]]:
    """The words of a text, as between ASCII white space, that may not be plainly written; and whether its letters of
    another script all have doubles, so that none tells that they are meant."""
    if text.isascii():
        return False, []
    odd, double, telling = _look(text)
    alone = double and not telling
    if not (odd or alone):
        return alone, []
    looked = ((w, _look(w)) for w in set(_BREAK.split(text)) if not w.isascii())
    return alone, sorted(w for w, (own, doubled, _) in looked if own or alone and doubled)


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(ch, parts)``, ``(ch, cls)`` of non-zero classes, ``(ch, script, plain)``; their sizes are Unicode's."""
    classes = [(chr(c), unicodedata.combining(chr(c))) for c in range(0x300, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.combining(chr(c))]
    to_latin = {**{o: a for a, o in zip(LATIN, OTHER, strict=True)}, **TO_LATIN}
    to_cyrillic = {**{a: o for a, o in zip(LATIN, OTHER, strict=True) if "Ѐ" <= o < "԰"}, **TO_CYRILLIC}
    alike = [(c, "L", p) for c, p in to_latin.items()] + [(c, "C", p) for c, p in to_cyrillic.items()]
    make = spark.createDataFrame
    return make([(c, list(out)) for c, out in parts().items()], "ch string, parts array<string>"), make(classes, "ch string, cls int"), make(alike, "ch string, script string, plain string")


@F.pandas_udf(T.StringType())
def _composed(words: pd.Series) -> pd.Series:
    return words.map(lambda w: unicodedata.normalize("NFC", w))


def plain_words(words: DataFrame) -> DataFrame:
    """``word, alone, plain`` of distinct ``word, alone`` - words as between ASCII white space - whose plain spelling differs."""
    parted, classes, alike = _tables(words.sparkSession)
    key = ["word", "alone"]
    at = Window.partitionBy(*key).orderBy("pos")
    chars = words.select(*key, F.posexplode(F.regexp_extract_all("word", F.lit(r"(?s)."), F.lit(0))).alias("pos", "ch"))
    emoji = lambda c: F.coalesce(c.rlike(f"[{_java(*_EMOJI)}]"), F.lit(False))
    joiner = F.col("ch").rlike(f"[{_java(*_JOINERS)}]")
    kept_joiner = joiner & (emoji(F.col("before")) | (F.col("ch") != "\u200d") & F.col("before").rlike(r"[0-9#*]"))
    chars = chars.withColumn("before", F.lag("ch").over(at)).where(~joiner | F.coalesce(kept_joiner, F.lit(False)))
    chars = chars.join(F.broadcast(parted), "ch", "left")
    spelled = chars.select(*key, "pos", F.posexplode(F.coalesce("parts", F.array("ch"))).alias("sub", "ch"))
    spelled = spelled.join(F.broadcast(classes), "ch", "left").withColumn("cls", F.coalesce("cls", F.lit(0)))
    # The script of each run of letters: that of the letters which have no double elsewhere, else of most letters.
    order = Window.partitionBy(*key).orderBy("pos", "sub")
    letter = F.col("ch").rlike(r"^[\p{L}\p{M}]$")
    runs = spelled.withColumn("run", F.sum(F.when(letter, 0).otherwise(1)).over(order))
    is_latin, is_cyrillic, is_greek = (F.col("ch").rlike(f"^[{_java(*r)}]$") for r in (_LAT, _CYR, _GRE))
    doubled = F.col("ch").isin(*sorted({*LATIN, *OTHER}))
    in_run = Window.partitionBy(*key, "run")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(in_run)
    score = lambda c: (count(c & ~doubled) * 1000 + count(c)).cast("int")
    runs = runs.withColumns({"l": score(is_latin), "c": score(is_cyrillic), "g": score(is_greek)})
    # A run of letters with doubles only, in a text that has no other letter of their script, is Latin.
    script = F.when((F.col("l") > 0) & (F.col("l") >= F.col("c")) & (F.col("l") >= F.col("g")), "L").when(F.col("c") >= F.col("g"), "C").otherwise("G")
    script = F.when(F.col("alone") & (F.col("c") + F.col("g") > 0) & ((F.col("c") + F.col("g")) < 1000) & (F.col("l") == 0), "L").otherwise(script)
    runs = runs.withColumn("script", script).join(F.broadcast(alike), ["ch", "script"], "left").withColumn("ch", F.coalesce("plain", "ch"))
    # Marks in order of class behind their base, those of one class as they stood; then all is composed again.
    segment = F.sum(F.when(F.col("cls") == 0, 1).otherwise(0)).over(order)
    ordered = runs.withColumn("seg", segment).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seg", "cls", "pos", "sub", "ch"))).alias("all"))
    ordered = ordered.select(*key, F.array_join(F.transform("all", lambda x: x["ch"]), "").alias("all"))
    rebuilt = words.select(*key).join(ordered, key, "left").select(*key, _composed(F.coalesce("all", F.lit(""))).alias("plain"))
    return rebuilt.where("plain <> word")


def suspects(values: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep..., text, alone, words`` of the values that may be other than plain: the words in question."""
    schema = T.StructType([*values.select(*keep, text).schema.fields, T.StructField("alone", T.BooleanType()), T.StructField("words", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [odd_words(t) for t in batch[text]]
            hit = [bool(words) for _, words in found]
            if not any(hit):
                continue  # pandas makes an empty column one of floats, which Arrow doesn't turn into lists
            out = batch.loc[hit].copy()
            out["alone"], out["words"] = [a for a, w in found if w], [w for _, w in found if w]
            yield out

    return values.where(F.col(text).isNotNull() & F.col(text).rlike(r"[^\x00-\x7F]")).select(*keep, text).mapInPandas(run, schema)


def plain_texts(values: DataFrame, text: str, row_id: list[str]) -> DataFrame:
    """``row_id..., plain`` of the texts whose plain form differs.  Equal-looking texts come out equal.

    Spaces of every width become spaces, invisible characters go (but for those that make up emoji), accents are
    composed, full-width letters and digits, ligatures and styled letters become plain ones, and look-alike letters go
    to the script of their word.  Signs such as ™ № ² ½ and Japanese punctuation stay.  Null and empty texts have no
    other form and yield nothing; equal ``row_id`` with equal text yield one row.
    """
    suspect = store(suspects(values, text, row_id)).distinct()
    words = suspect.select(*row_id, text, "alone", F.explode("words").alias("word"))
    spelled = plain_words(words.select("word", "alone").distinct())
    fixes = words.join(spelled, ["word", "alone"]).groupBy(*row_id, text).agg(F.map_from_entries(F.collect_set(F.struct("word", "plain"))).alias("fix"))
    pieces = F.split(text, r"(?<=[\x00-\x20])(?=[^\x00-\x20])|(?<=[^\x00-\x20])(?=[\x00-\x20])", -1)
    plain = F.array_join(F.transform(pieces, lambda w: F.coalesce(F.col("fix")[w], w)), "")
    return fixes.select(*row_id, plain.alias("plain"))


def changed_texts(suspect: DataFrame, row_id: list[str]) -> DataFrame:
    """``row_id...`` of those suspects that have a word whose plain spelling differs."""
    words = suspect.select(*row_id, "alone", F.explode("words").alias("word"))
    return words.join(plain_words(words.select("word", "alone").distinct()), ["word", "alone"], "left_semi").select(*row_id).distinct()
