"""The reading level of each document, from the levels of its sentences.

Rated documents of a bounded sample give shrunken log-odds of every word and
of every character four-gram for each level (the regularised word and
character models). A sentence is described by their means and its length and
classified by a softmax regression; the distributions of a document's
sentences are averaged and a second, calibrated regression on the averages
gives the document's level. Features of training sentences come from the other
half of the sample, so neither regression sees statistics of its own texts.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.canonical import canonical_form

LEVELS = 4
#: Rated documents the models are fitted on, at most, and characters of their texts, at most: the bounds of the sample on the driver.
SAMPLE, SAMPLE_CHARS = 4000, 16_000_000
LEAST_WORDS = 40
CACHE_TOKENS = 600_000
BATCH_CHARS = 4_000_000
GRAM, BUCKETS = 4, 1 << 15
#: Pseudo-counts that draw the log-odds of rare words and grams to zero.
SHRINK_WORD, SHRINK_GRAM = 4.0, 20.0
_LETTERS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_MACHINE = re.compile(r"[\d=/\\{}<>|_@#]|\w[:.]\w")
_END = re.compile(r"[.!?]+[\"'”’»)\]*]*$")
_LINE = "\x02"  # white space to no one
WORD, NONE, LINE = 0, 1, 2


def _token(token: str) -> tuple[str, int, bool, bool]:
    """The canonical word of a token, its kind, whether it ends a sentence, whether it begins with a small letter."""
    if token == _LINE:
        return "", LINE, False, False
    found = _LETTERS.search(token)
    if token.endswith(":"):  # a speaker's label, or what comes before a quotation
        return "", NONE, True, False
    if not found or _MACHINE.search(token):
        return "", NONE, bool(_END.search(token)), False
    return canonical_form(found[0]), WORD, bool(_END.search(token)), found[0][0].islower()


def _grams(word: str) -> list[int]:
    w = f"^{word}$"
    out = []
    for k in range(max(1, len(w) - GRAM + 1)):
        h = 0
        for ch in w[k : k + GRAM]:
            h = (h * 1_000_003 + ord(ch)) & 0xFFFFFFFF
        out.append((h ^ h >> 15) % BUCKETS)
    return out


class Tokens(dict):
    """Rows of tokens, made once a token: word number, kind, end of a sentence, small first letter, length."""

    def __init__(self) -> None:
        super().__init__()
        self.words: dict[str, int] = {}
        self.facts: list[tuple[int, int, bool, bool, int]] = []

    def __missing__(self, token: str) -> int:
        word, kind, end, small = _token(token)
        n = self.words.setdefault(word, len(self.words)) if kind == WORD else -1
        self.facts.append((n, kind, end, small, len(word)))
        self[token] = len(self.facts) - 1
        return len(self.facts) - 1


def split_sentences(texts: list[str], tokens: Tokens) -> tuple[np.ndarray, ...]:
    """Word numbers and lengths of all texts' sentences one after another, first words of sentences, their texts.

    A line break ends a sentence unless the next line goes on in small
    letters; tokens that aren't words (machine lines, numbers) are left out.
    """
    cut = [t.replace("\n", f" {_LINE} ").split() for t in texts]
    sizes = np.array([len(c) for c in cut], dtype=np.int64)
    row = np.fromiter(map(tokens.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=int(sizes.sum()))
    facts = np.array(tokens.facts, dtype=np.int64).reshape(-1, 5)[row]
    owner = np.repeat(np.arange(len(texts)), sizes)
    number, kind, end, small, length = facts.T
    ends = np.cumsum(end)  # sentences closed so far
    lines = np.cumsum(kind == LINE)
    word = kind == WORD
    number, small, length, owner, ends, lines = number[word], small[word], length[word], owner[word], ends[word] - end[word], lines[word]
    if not len(number):
        return number, length, np.zeros(0, dtype=np.int64), owner
    new = np.r_[True, (owner[1:] != owner[:-1]) | (ends[1:] != ends[:-1]) | ((lines[1:] != lines[:-1]) & (small[1:] == 0))]
    first = np.flatnonzero(new)
    return number, length, first, owner[first]


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


class Regression:
    """Softmax regression on standardised features with an L2 penalty, fitted by damped Newton-like steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 60) -> None:
        self.mean, self.sd = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = self._scale(x)
        n, d = x.shape
        w = np.zeros((d, y.shape[1]))
        # Böhning's bound of the curvature is the same for every step
        bound = np.linalg.inv(0.5 * x.T @ x / n + penalty * np.eye(d))
        v, before = w, w
        for k in range(rounds):
            v = w + k / (k + 3) * (w - before)
            before = w
            w = v - bound @ (x.T @ (_softmax(x @ v) - y) / n + penalty * v)
        self.w = w

    def _scale(self, x: np.ndarray) -> np.ndarray:
        return np.c_[(x - self.mean) / self.sd, np.ones(len(x))]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return _softmax(self._scale(x) @ self.w)


class Statistics:
    """Shrunken log-odds of words and character grams for each level."""

    def __init__(self, numbers: np.ndarray, target: np.ndarray, words: list[str]) -> None:
        self.words = {w: k for k, w in enumerate(words)}
        counts = np.stack([np.bincount(numbers, weights=target[:, j], minlength=len(words)) for j in range(LEVELS)], axis=1)
        prior = (counts.sum(axis=0) + 1) / (counts.sum() + LEVELS)
        self.word = np.log((counts + SHRINK_WORD * prior) / (counts.sum(axis=1, keepdims=True) + SHRINK_WORD) / np.maximum(prior, 1e-9))
        grams = np.zeros((BUCKETS, LEVELS))
        for w, k in self.words.items():
            if counts[k].any():
                np.add.at(grams, _grams(w), counts[k])
        self.gram = np.log((grams + SHRINK_GRAM * prior) / (grams.sum(axis=1, keepdims=True) + SHRINK_GRAM) / np.maximum(prior, 1e-9))

    def row(self, word: str) -> np.ndarray:
        """The word's log-odds by its own statistics and, on average, by those of its grams."""
        k = self.words.get(word)
        return np.r_[self.word[k] if k is not None else np.zeros(LEVELS), self.gram[_grams(word)].mean(axis=0)]


def _features(odds: np.ndarray, length: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """A row a sentence: mean log-odds, log of the words, mean word length."""
    size = np.diff(np.r_[first, n])[:, None]
    return np.c_[np.add.reduceat(odds, first, axis=0) / size, np.log(size), np.add.reduceat(length, first)[:, None] / size]


def _averages(p: np.ndarray, x: np.ndarray, owner: np.ndarray, texts: int, size: np.ndarray) -> np.ndarray:
    """A row a text: its sentences' distributions averaged, plainly and by words, their spread, and the mean features."""
    n = np.maximum(np.bincount(owner, minlength=texts), 1)[:, None]
    per = lambda v: np.stack([np.bincount(owner, weights=v[:, j], minlength=texts) for j in range(v.shape[1])], axis=1)
    mean = per(p) / n
    words = np.maximum(np.bincount(owner, weights=size, minlength=texts), 1)[:, None]
    return np.c_[mean, per(p * size[:, None]) / words, np.log(np.maximum(mean, 1e-4)), per(x) / n, per(x[:, :LEVELS] * size[:, None]) / words]


class Model:
    """Fitted on rated texts: ``texts`` and ``target``, a row a text of the share of its ratings at each level."""

    def __init__(self, texts: list[str], target: np.ndarray) -> None:
        tokens = Tokens()
        number, length, first, owner = split_sentences(texts, tokens)
        words = list(tokens.words)
        size = np.diff(np.r_[first, len(number)])
        each = np.repeat(owner, size)
        self.prior = target.mean(axis=0)
        self.statistics = Statistics(number, target[each], words)
        half = np.random.default_rng(0).permutation(len(texts)) % 2
        x = np.zeros((len(first), 2 * LEVELS + 2))
        for h in (0, 1):
            own = half[each] != h
            other = Statistics(number[own], target[each[own]], words)
            table = np.stack([other.row(w) for w in words]) if words else np.zeros((0, 2 * LEVELS))
            x[half[owner] == h] = _features(table[number], length, first, len(number))[half[owner] == h]
        self.sentence = Regression(x, target[owner], 1e-3)
        self.document = Regression(_averages(self.sentence(x), x, owner, len(texts), size), target, 3e-3, 200)
        self._start()

    def _start(self) -> None:
        self.tokens, self.table = Tokens(), np.zeros((0, 2 * LEVELS))

    def __call__(self, texts: list[str]) -> np.ndarray:
        """The distribution over the levels of each text."""
        if len(self.tokens) > CACHE_TOKENS:
            self._start()
        number, length, first, owner = split_sentences(texts, self.tokens)
        if not len(number):
            return np.tile(self.prior, (len(texts), 1))
        if len(self.table) < len(self.tokens.words):
            fresh = list(self.tokens.words)[len(self.table) :]
            self.table = np.concatenate([self.table, np.stack([self.statistics.row(w) for w in fresh])])
        x = _features(self.table[number], length, first, len(number))
        return self.document(_averages(self.sentence(x), x, owner, len(texts), np.diff(np.r_[first, len(number)])))


def rated_sample(documents: DataFrame, ratings: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> tuple[list[str], np.ndarray]:
    """Texts of at most ``sample`` rated documents and ``chars`` characters, first in order of a hash of their id, and their ratings."""
    own = ratings.where(F.col("level").between(1, LEVELS) & F.col("doc_id").isNotNull()).select("doc_id", "rater", "level").distinct()
    own = own.groupBy("doc_id").agg(*[F.sum((F.col("level") == k).cast("double")).alias(f"n{k}") for k in range(1, LEVELS + 1)])
    own = own.orderBy(F.xxhash64("doc_id")).limit(sample)
    rows = documents.where(F.length("text") > 0).select("doc_id", "text").join(F.broadcast(own), "doc_id").orderBy(F.xxhash64("doc_id"), "text")
    upto, texts, target = 0, [], []
    for r in rows.limit(2 * sample).toLocalIterator():
        upto += len(r["text"])
        if upto > chars or len(texts) == sample:
            break
        texts.append(r["text"])
        target.append([r[f"n{k}"] for k in range(1, LEVELS + 1)])
    target = np.array(target, dtype=float).reshape(-1, LEVELS)
    return texts, target / np.maximum(target.sum(axis=1, keepdims=True), 1)


_models: dict[str, Model] = {}


def levels(documents: DataFrame, ratings: DataFrame, least: int = LEAST_WORDS, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``words``, ``level`` and ``confidence`` of every document of at least ``least`` words.

    Words are what white space separates. A text without a word in letters
    gets the most frequent level; without ratings nothing can be fitted and
    level and confidence are null. Null ratings, repeated ratings of a rater
    and levels off the scale don't count; null texts have no words; repeated
    ids give a row each; other columns are ignored.
    """
    texts, target = rated_sample(documents, ratings, sample)
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, Model(texts, target) if len(texts) > 1 else None))
    kind = dict(documents.dtypes)["doc_id"]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, model = shared.value
        if name not in _models:  # a worker keeps its cache from task to task
            _models.clear()
            _models[name] = model
        model = _models[name]
        for b in batches:
            codes, values = pd.factorize(b["text"])
            p, start, size = [], 0, 0
            for k, v in enumerate(values):
                size += len(v)
                if size >= BATCH_CHARS or k + 1 == len(values):
                    if model:
                        p.append(model(list(values[start : k + 1])))
                    start, size = k + 1, 0
            p = np.concatenate(p) if p else np.full((len(values), LEVELS), np.nan)
            words = np.array([len(v.split()) for v in values], dtype=np.int64)
            keep = codes >= 0
            keep[keep] = words[codes[keep]] >= least
            c = codes[keep]
            if model:
                out = {"level": p[c].argmax(axis=1) + 1, "confidence": p[c].max(axis=1)}
            else:
                out = {"level": pd.array([None] * len(c), dtype="Int32"), "confidence": pd.array([None] * len(c), dtype="Float64")}
            yield pd.DataFrame({"doc_id": b["doc_id"][keep].to_numpy(), "words": words[c], **out})

    schema = f"doc_id {kind}, words int, level int, confidence double"
    return documents.select("doc_id", "text").mapInPandas(of, schema)
