"""Garbled text from wrong character encodings.

Method: a multinomial classifier over hashed byte bigrams tells clean words from words garbled by one of the encoding
chains below.  It is trained on a bounded sample of the table's own words, garbled synthetically by every chain.  The
predicted chain is inverted; only a strict decoding that reads better than what stood there before is taken.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# (written as, read as) steps, applied in turn.  Fixed values.
CHAINS: dict[str, tuple[tuple[str, str], ...]] = {
    "utf-8 > cp1252": (("utf-8", "cp1252"),),
    "utf-8 > latin-1": (("utf-8", "latin-1"),),
    "utf-8 > cp1251": (("utf-8", "cp1251"),),
    "utf-8 > mac-roman": (("utf-8", "mac-roman"),),
    "utf-8 > cp437": (("utf-8", "cp437"),),
    "utf-8 > cp850": (("utf-8", "cp850"),),
    "utf-8 > koi8-r": (("utf-8", "koi8-r"),),
    "utf-8 > cp866": (("utf-8", "cp866"),),
    "utf-8 > cp1252 > utf-8 > cp1252": (("utf-8", "cp1252"), ("utf-8", "cp1252")),
    "utf-8 > latin-1 > utf-8 > latin-1": (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    "cp1252 > latin-1": (("cp1252", "latin-1"),),
    "cp1252 > cp437": (("cp1252", "cp437"),),
    "cp1252 > cp850": (("cp1252", "cp850"),),
    "cp1252 > mac-roman": (("cp1252", "mac-roman"),),
    "mac-roman > cp1252": (("mac-roman", "cp1252"),),
    "cp1251 > cp1252": (("cp1251", "cp1252"),),
    "cp1251 > latin-1": (("cp1251", "latin-1"),),
    "cp1251 > koi8-r": (("cp1251", "koi8-r"),),
    "cp1251 > cp866": (("cp1251", "cp866"),),
    "cp1251 > mac-roman": (("cp1251", "mac-roman"),),
    "koi8-r > cp1251": (("koi8-r", "cp1251"),),
    "koi8-r > cp1252": (("koi8-r", "cp1252"),),
    "koi8-r > latin-1": (("koi8-r", "latin-1"),),
    "cp866 > cp1251": (("cp866", "cp1251"),),
    "cp866 > cp1252": (("cp866", "cp1252"),),
    "cp866 > latin-1": (("cp866", "latin-1"),),
    "euc-jp > latin-1": (("euc-jp", "latin-1"),),
    "euc-jp > cp1252": (("euc-jp", "cp1252"),),
    "shift-jis > cp1252": (("shift-jis", "cp1252"),),
    "shift-jis > latin-1": (("shift-jis", "latin-1"),),
}
CLEAN, CAPITALS, LOST = "clean", "clean, in capitals", "lost"  # lost: replacement characters stand where the bytes were
BUCKETS = 1 << 15
SAMPLE_PAGES = 3000  # texts that the classifier is trained on, at most
MARGIN = 4.0  # nats by which a chain must beat the clean reading
SURE = 12.0  # nats from which a single word is enough
_EDGE = r" \t\n\r\f\v\[\](){}<>|*_#\"`"
_WORD = re.compile(rf"[^{_EDGE}]*[^\x00-\x7f{_EDGE}][^{_EDGE}]*")
_SENTENCE = re.compile(r"(?<=[.!?;])[ \t]+")
_MIXED = re.compile(r"[A-Za-z][^\x00-\x7f]|[^\x00-\x7f][A-Za-z]")
_CYRILLIC = ("cp1251", "koi8-r", "cp866")
# Characters of other damage, which say nothing about encodings: spaces, invisible ones, look-alike letters.  Fixed.
_FAINT = dict.fromkeys(map(ord, "\u00a0\u00ad\u2007\u2009\u200b\u200c\u200d\u202f\u2060\ufeffаеорсхуіјѕАВЕКМНОРСТХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧο"))
_QUOTED = re.compile(r"`[^`\n]*`")
_FENCE = re.compile(r"^[ \t]*```[^\n]*$.*?(?:^[ \t]*```[^\n]*$|\Z)", re.M | re.S)
_CONTROL = re.compile(r"[\x00-\x08\x0b-\x1f\x7f-\x9f]")
_LOOKALIKE = str.maketrans("aeopcxiAEOPCXKMHTBI", "аеорсхіАЕОРСХКМНТВІ")  # fixed values: Latin, Cyrillic


@lru_cache(None)
def _tables(codec: str) -> tuple[str, dict[str, int]]:
    """Byte to character of a one-byte codec, bytes it doesn't know standing for themselves; and the way back."""
    there = []
    for b in range(256):
        try:
            there.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            there.append(chr(b))
    return "".join(there), {c: b for b, c in enumerate(there)}


def _wide() -> re.Pattern[str]:
    """A lead byte and a continuation byte of UTF-8 as any of the codecs shows them."""
    pairs = []
    for codec in sorted({read for chain in CHAINS.values() for written, read in chain if written == "utf-8"}):
        there = _tables(codec)[0]
        pairs.append(f"[{re.escape(there[0xC2:0xF5])}][{re.escape(there[0x80:0xC0])}]")
    return re.compile("|".join(pairs))


_WIDE = _wide()


def garble(text: str, chain: str) -> str | None:
    """The text written and read as the chain says; None where it can't be written so."""
    for written, read in CHAINS[chain]:
        try:
            text = codecs.charmap_decode(text.encode(written), "strict", _tables(read)[0])[0]
        except UnicodeEncodeError:
            return None
    return text


def invert(text: str, chain: str) -> str | None:
    """The text as it was before the chain; None where no strict decoding leads back."""
    for written, read in reversed(CHAINS[chain]):
        back = _tables(read)[1]
        try:
            text = bytes([back[c] for c in text]).decode(written)
        except (KeyError, UnicodeDecodeError):
            return None
    return text


def _bigrams(words: Iterable[str]) -> np.ndarray:
    """Hashed byte bigrams of words, each between spaces."""
    raw = np.frombuffer((" " + " ".join(words) + " ").encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    return (((raw[:-1] * np.uint32(256) + raw[1:]) * np.uint32(2654435761)) >> np.uint32(17)) & np.uint32(BUCKETS - 1)


def _counts(words: list[tuple[str, int]]) -> np.ndarray:
    """How often each bigram stands in the words, each as often as it occurs."""
    if not words:
        return np.zeros(BUCKETS)
    sizes = [len(w.encode("utf-8", "surrogatepass")) + 1 for w, _ in words]
    return np.bincount(_bigrams(w for w, _ in words), np.repeat([n for _, n in words], sizes), BUCKETS)


def _core(word: str) -> str:
    return word.strip(".,;:!?()[]{}<>\"'*_#|`~/-").lower()


class Classifier:
    """Multinomial naive Bayes over hashed byte bigrams of words that aren't plain ASCII."""

    def __init__(self, classes: list[str], logs: np.ndarray):
        self.classes, self.logs = classes, logs
        self.seen: dict[str, tuple] = {}

    @classmethod
    def train(cls, texts: Iterable[str], alpha: float = 0.02) -> Classifier:
        """From texts mostly clean; words that a first model takes for garbled are left out of the second."""
        count: Counter[str] = Counter()
        for text in texts:
            if "\ufffd" not in text and not text.isascii():
                count.update(_WORD.findall(_QUOTED.sub(" ", text)))
        model = None
        for _ in range(2):
            if model:
                model.prepare(count)
            kept = [w for w in count if model is None or not any(sure for *_, sure in model.readings(w))]
            # Clean words in every case, and with the usual look-alike damage, stay clean; capitals are a class of their own.
            words = {CLEAN: [(x, count[w]) for w in kept for x in {w, w.capitalize(), w.translate(_LOOKALIKE)}], CAPITALS: [(w.upper(), count[w]) for w in kept]}
            for chain in CHAINS:
                words[chain] = [(g, count[w]) for w in kept for g in [garble(w, chain)] if g is not None and g != w]
            classes = list(words)
            counts = np.stack([_counts(words[c]) for c in classes]) + alpha
            model = cls(classes, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))
        return model

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of every word (rows) in every class (columns)."""
        if not words:
            return np.zeros((0, len(self.classes)))
        sizes = np.array([len(w.encode("utf-8", "surrogatepass")) + 1 for w in words])
        grams = self.logs[:, _bigrams(words)]
        return np.add.reduceat(grams, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=1).T

    def prepare(self, words: Iterable[str]) -> None:
        """Work out the readings of many words at once."""
        new = [w for w in set(words) if w not in self.seen]
        if not new:
            return
        total = self.scores(new)
        clean = total[:, :2].max(axis=1)
        gain = total - clean[:, None]
        hopeful = gain[:, 2:].max(axis=1) > 0
        for i, word in enumerate(new):
            self.seen[word] = self._readings(word, float(clean[i]), gain[i]) if hopeful[i] else ()

    def readings(self, word: str) -> tuple[tuple[str, str, float, bool], ...]:
        """``chain, restored, gain, sure`` of the chains that may have garbled a word, best first.

        ``gain``: the nats by which the classifier holds the chain for likelier than a clean word, or the restored word
        for a likelier clean word than what stands there, whichever are fewer; ``sure``: by a wide margin.
        """
        if word not in self.seen:
            self.prepare([word])
        return self.seen[word]

    def _readings(self, word: str, clean: float, gains: np.ndarray) -> tuple[tuple[str, str, float, bool], ...]:
        """The classes that beat the clean one, in the classifier's order, as far as they decode strictly."""
        bare = word.translate(_FAINT)
        out = []
        for k in np.argsort(-gains):
            chain, gain = self.classes[k], float(gains[k])
            if chain in (CLEAN, CAPITALS):
                break
            wide = chain.startswith("utf-8")
            if not wide and (bare.isascii() or chain.startswith(_CYRILLIC) and _MIXED.search(word)):
                continue
            back = invert(word, chain)
            if back is None or back == word or _CONTROL.search(back) or not wide and not _core(back):
                continue
            better = float(self.scores([back])[0, :2].max()) - clean
            if better > 0:
                out.append((chain, back, min(gain, better), min(gain, better) >= SURE))
        return tuple(out)

    def passages(self, line: str) -> list[tuple[int, int, str, str | None]]:
        """``start, end, chain, restored`` of each garbled passage of a line; passages quoted in backticks aren't ones."""
        if "`" in line:
            line = _QUOTED.sub(lambda m: " " * len(m[0]), line)
        words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(line)]
        found = [(a, b, LOST, None) for a, b, w in words if "\ufffd" in w]
        open_ = [(a, b, r) for a, b, w in words if "\ufffd" not in w and (r := self.readings(w))]
        # The chain that most speaks for goes first: neighbouring words were garbled together.  A single character, which
        # any language may have as a word, speaks for none.
        weight: Counter[str] = Counter()
        most: Counter[str] = Counter()
        for a, b, readings in open_:
            if len(_core(line[a:b])) < 2:
                continue
            for chain, _, gain, sure in readings:
                weight[chain] += min(gain, 20.0) * (3 if sure else 1)
                most[chain] = max(most[chain], gain)
        for a, b, readings in open_:
            chain, back, gain, sure = max(readings, key=lambda r: (weight[r[0]], r[2]))
            if chain.startswith("utf-8"):
                if sure or gain >= MARGIN or weight[chain] >= 2 * MARGIN:
                    found.append((a, b, chain, back))
            # One byte a character decodes nearly always, so a word must be told well, and those around have gone the same way.
            elif most[chain] >= 2 * MARGIN and self._together(line, a, words, chain):
                found.append((a, b, chain, back))
        return sorted(found)

    def _together(self, line: str, at: int, words: list[tuple[int, int, str]], chain: str) -> bool:
        """Whether at least half of the words of the sentence that the chain could have garbled seem so."""
        start = max([m.end() for m in _SENTENCE.finditer(line, 0, at)], default=0)
        end = next((m.start() for m in _SENTENCE.finditer(line, at)), len(line))
        yes = no = 0
        for a, b, word in words:
            if start <= a and b <= end + 1:
                if any(r[0] == chain for r in self.readings(word)):
                    yes += 1
                elif not word.translate(_FAINT).isascii() and sum(c.isalpha() and c > "\x7f" for c in word) > (1 if yes else 0):
                    no += 1
        return yes >= no

    def _restored(self, line: str, passages: list[tuple[int, int, str, str | None]]) -> str:
        """The line with its passages restored; or restored as a whole, if the classifier holds that for likelier clean text.

        Multi-byte characters may hold signs that part words, and short words may not be told by themselves.
        """
        parts = line
        for a, b, _, back in reversed(passages):
            parts = parts if back is None else parts[:a] + back + parts[b:]
        told = Counter(chain for *_, chain, back in passages if back is not None)
        if not told or "`" in line or "\ufffd" in line:
            return parts
        whole = invert(line, told.most_common(1)[0][0])
        if whole is None or _CONTROL.search(whole):
            return parts
        reads = lambda s: float(self.scores(words)[:, :2].max(axis=1).sum()) if (words := _WORD.findall(s)) else 0.0
        return whole if reads(whole) > reads(parts) else parts

    def repair(self, text: str, words: Iterable[str] | None = None) -> tuple[str, list[str]]:
        """The text with every passage restored that can be, and the chains found."""
        if text.isascii():
            return text, []
        if words is None:
            words = _WORD.findall(text)
            self.prepare(words)
        if not any(self.seen[w] or "\ufffd" in w for w in words):
            return text, []
        chains: list[str] = []
        inside = [m.span() for m in _FENCE.finditer(text)] if "```" in text else []
        out, at = [], 0
        for line in text.split("\n"):
            start, at = at, at + len(line) + 1
            if not line.isascii() and not any(a <= start < b for a, b in inside):
                before: set[str] = set()
                while line not in before:  # what was garbled several times comes out step by step
                    before.add(line)
                    passages = self.passages(line)
                    chains += [chain for _, _, chain, _ in passages]
                    line = self._restored(line, passages)
                    if all(back is None for *_, back in passages):
                        break
            out.append(line)
        return "\n".join(out), chains


def train_on(texts: DataFrame, text: str, sample: int = SAMPLE_PAGES) -> Classifier:
    """Train on at most ``sample`` texts, those with the least hashes; repeated texts count once."""
    hashed = texts.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("h"), text)
    last = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    picked = hashed.where(F.col("h") <= F.lit(last)).dropDuplicates(["h"]).orderBy("h")
    return Classifier.train(row[1] for row in picked.toLocalIterator())


def repair_text(rows: DataFrame, text: str, model: Classifier, keep: list[str]) -> DataFrame:
    """``keep..., restored, chains`` of the rows whose text has at least one garbled passage.

    ``chains``: the encoding chains found, sorted, ``lost`` where only replacement characters are left; ``restored``:
    the text with every passage put right that can be.  Null, empty and plain ASCII texts are never garbled; rows stay
    apart however equal they are.
    """
    schema = rows.select(*keep, F.col(text).alias("restored")).schema.add("chains", T.ArrayType(T.StringType()))
    shared = rows.sparkSession.sparkContext.broadcast((model.classes, model.logs))  # a fixed number of buckets

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Classifier(*shared.value)
        for batch in batches:
            words = [set(_WORD.findall(t)) for t in batch[text]]
            if len(own.seen) > 500_000:
                own.seen.clear()
            own.prepare(set().union(*words))
            done = [own.repair(t, w) for t, w in zip(batch[text], words, strict=True)]
            hit = [bool(c) for _, c in done]
            if not any(hit):
                continue
            out = batch.loc[hit, keep].copy()
            out["restored"] = [t for t, c in done if c]
            out["chains"] = [sorted(set(c)) for _, c in done if c]
            yield out

    return rows.where(F.col(text).rlike(r"[^\x00-\x7F]")).select(*keep, text).mapInPandas(run, schema)
