"""Subject areas of documents.

Method: averaged word and subword embeddings with an independent logistic output for each subject.  Gradients are
computed on partitions of the labelled sentences, summed on an executor and synchronised after every step, until the
loss is flat; then every document is scored, sentence by sentence, with a threshold for every output.
Labels belong to whole documents and some are wrong, so after a first fit each labelled sentence is given to the
subjects it speaks of itself, and the model is fitted again.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.session import store

BUCKETS, WIDTH = 1 << 14, 16  # half a megabyte of weights goes to every partition and step
SAMPLE_DOCS = 6000  # labelled documents that the model is fitted on, at most; a bound for the fit only
STEPS, RATE = 40, 0.15  # at most; a fit ends when FLAT steps lower the loss by less than a hundredth
FLAT = 4
PART_DOCS = 2000  # labelled documents whose gradient one task computes
SURE = 0.45  # probability from which a sentence is about a subject
SHARE = 0.2  # of a document's sentences that makes a subject its own
_TOKEN = re.compile(r"[^\W\d_]+")
_END = re.compile(r"(?<=[.!?。！？])[\"”»)]*\s+")


def sentences(text: str) -> list[str]:
    """The sentences of a text; headings, rules and code fences are none."""
    out = []
    for line in text.split("\n"):
        line = line.strip()
        if line and line[0] not in "#|`":
            out += [s for s in _END.split(line) if _TOKEN.search(s)]
    return out


@lru_cache(1 << 18)
def features(word: str) -> tuple[int, ...]:
    """Buckets of a word: itself and its letter groups of four, taken with its ends."""
    word = word.lower()
    marked = f"<{word}>"
    parts = {word, *(marked[i : i + 4] for i in range(len(marked) - 3))} if len(word) > 2 else {word}
    return tuple(sorted(zlib.crc32(p.encode()) % BUCKETS for p in parts))


class Batch:
    """Sentences as numbers of words, and the feature buckets of every word once."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, words: np.ndarray, begins: np.ndarray):
        self.flat, self.starts, self.words, self.begins = flat, starts, words, begins
        self.sizes = np.diff(np.append(starts, len(flat)))  # features of each word
        self.lengths = np.diff(np.append(begins, len(words)))  # words of each sentence
        self.counts = np.add.reduceat(self.sizes[words], begins) if len(begins) else np.zeros(0)

    @classmethod
    def encode(cls, texts: list[str]) -> Batch:
        lists = [_TOKEN.findall(t) or [""] for t in texts]
        place = {w: i for i, w in enumerate(dict.fromkeys(w for found in lists for w in found))}
        own = [features(w) for w in place]
        return cls(
            np.array([f for x in own for f in x], np.int64), np.concatenate([[0], np.cumsum([len(x) for x in own])[:-1]]).astype(np.int64),
            np.array([place[w] for found in lists for w in found], np.int64), np.concatenate([[0], np.cumsum([len(x) for x in lists])[:-1]]).astype(np.int64),
        )

    def pack(self) -> dict[str, list[bytes]]:
        return {name: [getattr(self, name).astype("<i4").tobytes()] for name in ("flat", "starts", "words", "begins")}

    @classmethod
    def unpack(cls, row) -> Batch:
        return cls(*(np.frombuffer(getattr(row, name), "<i4").astype(np.int64) for name in ("flat", "starts", "words", "begins")))

    def mean(self, table: np.ndarray) -> np.ndarray:
        """The averaged embeddings of the sentences."""
        words = np.add.reduceat(table[self.flat], self.starts, axis=0)
        return np.add.reduceat(words[self.words], self.begins, axis=0) / self.counts[:, None]

    @cached_property
    def _sorted(self) -> tuple[np.ndarray, ...]:
        """The sentences of all words in order of words, the words of all features in order of buckets, and where each begins."""
        order = np.argsort(self.words, kind="stable")
        sentence = np.repeat(np.arange(len(self.begins)), self.lengths)[order]
        back = np.argsort(self.flat, kind="stable")
        word = np.repeat(np.arange(len(self.starts)), self.sizes)[back]
        buckets, first = np.unique(self.flat[back], return_index=True)
        return sentence, np.searchsorted(self.words[order], np.arange(len(self.starts))), word, first, buckets

    def spread(self, inner: np.ndarray) -> np.ndarray:
        """The gradient of the embeddings from that of the sentences' means."""
        sentence, words, word, first, buckets = self._sorted
        by_word = np.add.reduceat((inner / self.counts[:, None]).astype(np.float32)[sentence], words, axis=0)
        out = np.zeros((BUCKETS, inner.shape[1]), np.float32)
        out[buckets] = np.add.reduceat(by_word[word], first, axis=0)
        return out


_MET: dict[str, tuple[Batch, np.ndarray]] = {}  # of one worker: parts met in an earlier step, a few of bounded size


def _met(row, width: int) -> tuple[Batch, np.ndarray]:
    if row.part not in _MET:
        if len(_MET) > 8:
            _MET.clear()
        _MET[row.part] = Batch.unpack(row), np.frombuffer(row.wanted, "<f4").reshape(-1, width)
    return _MET[row.part]


def start(subjects: int, seed: int = 7) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [rng.normal(0, 0.05, (BUCKETS, WIDTH)).astype(np.float32), rng.normal(0, 0.3, (subjects, WIDTH)).astype(np.float32), np.full(subjects, -2.0, np.float32)]


def gradient(model: list[np.ndarray], batch: Batch, wanted: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Summed gradients of the logistic losses, and their sum."""
    mean = batch.mean(model[0])
    logits = np.clip(mean @ model[1].T + model[2], -30, 30)
    error = (1 / (1 + np.exp(-logits)) - wanted).astype(np.float32)
    loss = float((np.log1p(np.exp(logits)) - wanted * logits).sum())
    return [batch.spread(error @ model[1]), error.T @ mean, error.sum(axis=0)], loss


class Steps:
    """Adam over the synchronised gradients."""

    def __init__(self, model: list[np.ndarray]):
        self.model, self.n = model, 0
        self.first, self.second = [np.zeros_like(x) for x in model], [np.zeros_like(x) for x in model]

    def apply(self, grads: list[np.ndarray], rate: float) -> None:
        self.n += 1
        for x, g, a, b in zip(self.model, grads, self.first, self.second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x -= rate * (a / (1 - 0.9**self.n)) / (np.sqrt(b / (1 - 0.99**self.n)) + 1e-7)


def targets(labels: np.ndarray, logits: np.ndarray) -> np.ndarray:
    """Wanted outputs of sentences after a first fit: of its document's labels those a sentence itself speaks of.

    A sentence that is plainly about something its document isn't labelled with counts for that as well; one that is
    plainly about nothing counts for nothing.
    """
    inside = np.where(labels > 0, logits, -99)
    best = np.maximum(inside.max(axis=1, keepdims=True), -1.0)
    own = (labels > 0) & (logits >= best)
    other = (labels == 0) & (logits > np.maximum(best, 0) + 1.0)
    return (np.where(other.any(axis=1, keepdims=True), other, own)).astype(np.float32)


def subjects_of(probability: np.ndarray, document: np.ndarray, count: int) -> list[tuple[int, int]]:
    """``document, subject`` of the subjects of at least SHARE of a document's sentences; a sentence may have several."""
    total = np.bincount(document, minlength=count)
    sentence, subject = np.nonzero(probability >= SURE)
    hits = np.zeros((count, probability.shape[1]))
    np.add.at(hits, (document[sentence], subject), 1)
    return list(zip(*np.nonzero((hits > 0) & (hits >= SHARE * total[:, None] - 1e-9)), strict=True))


_PACKED = "part string, flat binary, starts binary, words binary, begins binary, wanted binary"


def fit(documents: DataFrame, labels: DataFrame, subjects: list[str], doc_id: str, text: str, subject: str, sample: int = SAMPLE_DOCS, steps: int = STEPS) -> list[np.ndarray]:
    """Fit on at most ``sample`` labelled documents, those with the least hashes.  Labels of unknown subjects don't count."""
    kept = labels.where(F.col(subject).isin(subjects)).groupBy(F.col(doc_id).alias("_id")).agg(F.array_sort(F.collect_set(subject)).alias("subjects"))
    texts = documents.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    picked = kept.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    place = {s: i for i, s in enumerate(subjects)}
    width = len(subjects)

    def encode_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, marks = [], []
        for batch in batches:
            for value, own in zip(batch["text"], batch["subjects"], strict=True):
                found = sentences(value)
                split += found
                marks += [[place[s] for s in own]] * len(found)
        if split:
            wanted = np.zeros((len(split), width), np.float32)
            for i, m in enumerate(marks):
                wanted[i, m] = 1
            yield pd.DataFrame({"part": [uuid.uuid4().hex], **Batch.encode(split).pack(), "wanted": [wanted.astype("<f4").tobytes()]})

    rows = texts.join(picked, "_id").repartition(-(-sample // PART_DOCS), "_id")
    parts = store(rows.mapInPandas(encode_part, _PACKED))
    model: list[np.ndarray] = []
    for seed in (7, 11):
        if model:
            slim = [x.astype(np.float16) for x in model]

            def retarget(batches: Iterator[pd.DataFrame], slim=slim) -> Iterator[pd.DataFrame]:
                guide = [x.astype(np.float32) for x in slim]
                for batch in batches:
                    for row in batch.itertuples(index=False):
                        own, labels = _met(row, width)
                        wanted = targets(labels, own.mean(guide[0]) @ guide[1].T + guide[2])
                        yield pd.DataFrame({"part": [uuid.uuid4().hex], **own.pack(), "wanted": [wanted.astype("<f4").tobytes()]})

            parts = store(parts.mapInPandas(retarget, _PACKED))
        step = Steps(start(width, seed))
        losses: list[float] = []
        for n in range(steps):
            shared = [x.astype(np.float16) for x in step.model]

            def part_gradient(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
                weights = [x.astype(np.float32) for x in shared]
                total, loss, count = None, 0.0, 0
                for batch in batches:
                    for row in batch.itertuples(index=False):
                        own, wanted = _met(row, width)
                        grads, lost = gradient(weights, own, wanted)
                        flat = np.concatenate([g.ravel() for g in grads])
                        total = flat if total is None else total + flat
                        loss, count = loss + lost, count + len(own.begins)
                if total is not None:
                    yield pd.DataFrame({"n": [count], "loss": [loss], "g": [total.astype("<f4").tobytes()]})

            def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                total, loss, count = 0.0, 0.0, 0
                for batch in batches:
                    for row in batch.itertuples(index=False):
                        total, loss, count = total + np.frombuffer(row.g, "<f4"), loss + row.loss, count + row.n
                if count:
                    yield pd.DataFrame({"n": [count], "loss": [loss], "g": [total.astype("<f4").tobytes()]})

            # One gradient for every PART_DOCS documents of the bounded sample is summed in one task; their sum comes to the driver.
            schema = "n bigint, loss double, g binary"
            got = parts.mapInPandas(part_gradient, schema).repartition(1).mapInPandas(add_up, schema).collect()
            if not got:
                return step.model
            flat, at, grads = np.frombuffer(got[0].g, "<f4") / got[0].n, 0, []
            for x in step.model:
                grads.append(flat[at : at + x.size].reshape(x.shape))
                at += x.size
            step.apply(grads, RATE * (1 - 0.8 * n / steps))
            losses.append(got[0].loss / got[0].n)
            if n >= FLAT and losses[-1] > 0.99 * losses[-1 - FLAT]:
                break
        model = step.model
    return model


def score(documents: DataFrame, model: list[np.ndarray], subjects: list[str], doc_id: str, text: str) -> DataFrame:
    """``doc_id, subject`` of every document; null and empty texts, and those about none of the subjects, have none."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # fixed in size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, heads, bias = shared.value
        # Words met before keep what they add to each output: their summed embeddings through the output weights.
        places: dict[str, int] = {}
        outputs = np.zeros((1 << 12, len(subjects) + 1), np.float32)
        for batch in batches:
            words: list[str] = []
            lengths, docs = [], []
            for i, value in enumerate(batch[text]):
                for sentence in sentences(value):
                    found = _TOKEN.findall(sentence)
                    words += found
                    lengths.append(len(found))
                    docs.append(i)
            if not lengths:
                continue
            if len(places) > 300_000:
                places.clear()
            for w in set(words).difference(places):
                own = list(features(w))
                at = places[w] = len(places)
                if at == len(outputs):
                    outputs = np.concatenate([outputs, np.zeros_like(outputs)])
                outputs[at, :-1], outputs[at, -1] = table[own].sum(axis=0) @ heads.T, len(own)
            index = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
            summed = np.add.reduceat(outputs[index], np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=0)
            probability = 1 / (1 + np.exp(-np.clip(summed[:, :-1] / summed[:, -1:] + bias, -30, 30)))
            found = subjects_of(probability, np.array(docs), len(batch))
            ids = batch[doc_id].to_numpy()
            yield pd.DataFrame({doc_id: np.array([ids[d] for d, _ in found], dtype=np.int64), "subject": pd.Series([subjects[s] for _, s in found], dtype=object)})

    return documents.where(F.col(text).isNotNull() & (F.col(text) != "")).select(doc_id, text).mapInPandas(run, f"{doc_id} bigint, subject string")
