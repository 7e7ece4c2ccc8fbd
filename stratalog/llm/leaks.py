"""Held-out passages inside a large corpus, found whole or in part.

A passage counts as leaked when at least half of its words stand in a text, in
order, in stretches of at least eight words. Item-sized windows (of the words
such a stretch must hold, however it lies) are taken of passages and texts and
embedded by the CGK random walk, which maps a small edit distance of two
windows to a small Hamming distance of their embeddings. Bit-sampling LSH of
the embeddings, repeated, finds the texts' windows that are close to windows
of a passage; texts with enough of them are verified exactly.

The passages are a fixed query set: their windows go to every task, in blocks
of bounded size, and the corpus is read in place, without a shuffle.
"""

from __future__ import annotations

import html
import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.canonical import canonical_form

STRETCH = 8
SHARE = 0.5
#: Words of a window and steps between the windows of a text: any eight words hold a whole window.
WINDOW, STEP = 6, 3
WALK = 3 * WINDOW
#: Repetitions of the walk, and positions of its output sampled in each.
REPEATS, SAMPLED = 2, 10
#: Passages of one pass over the corpus; more passages make more passes.
BLOCK_ITEMS = 5000
#: Characters of texts that are worked on together.
BATCH_CHARS = 4_000_000
CACHE_TOKENS = 1_000_000

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>|<!--.*?-->", re.S)


def words(text: str) -> list[str]:
    """The words of a text without markup, punctuation, letter case and odd characters."""
    return [w for token in _plain(text).split() for w in _WORD.findall(canonical_form(token))]


def _plain(text: str) -> str:
    """The text without markup."""
    if "&" in text:
        text = html.unescape(text)
    return _TAG.sub(" ", text) if "<" in text else text


class Numbers(dict):
    """Word numbers of tokens between white space, computed once a token.

    A token of one word has the word's number (0: no passage has it), one of
    none has -1, and one of several has -2 - k, with the numbers in many[k].
    """

    def __init__(self, vocabulary: dict[str, int]) -> None:
        super().__init__()
        self.vocabulary, self.many = vocabulary, []

    def __missing__(self, token: str) -> int:
        own = _WORD.findall(canonical_form(token))
        if len(own) == 1:
            n = self.vocabulary.get(own[0], 0)
        elif not own:
            n = -1
        else:
            n = -2 - len(self.many)
            self.many.append(np.array([self.vocabulary.get(w, 0) for w in own], dtype=np.int32))
        self[token] = n
        return n

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The word numbers of all texts one after another, and how many each has."""
        if len(self) > CACHE_TOKENS:
            self.clear()
            self.many = []
        tokens = [_plain(t).split() for t in texts]
        sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        row = np.fromiter(map(self.__getitem__, chain.from_iterable(tokens)), dtype=np.int32, count=int(sizes.sum()))
        if (row < 0).any():
            own = np.where(row >= 0, 1, 0)
            several = np.flatnonzero(row < -1)
            parts = [self.many[-2 - k] for k in row[several]]
            own[several] = [len(x) for x in parts]
            ends = np.r_[0, np.cumsum(own)]
            out = np.repeat(row, own)
            for k, x in zip(several, parts):
                out[ends[k] : ends[k] + len(x)] = x
            bounds = np.r_[0, np.cumsum(sizes)]
            row, sizes = out, np.diff(ends[bounds])
        return row, sizes


def checksums(row: np.ndarray) -> np.ndarray:
    """A checksum of each STRETCH of word numbers."""
    out = np.zeros(max(0, len(row) - STRETCH + 1), dtype=np.int64)
    for k in range(STRETCH):
        out = out * np.int64(1_000_003) + row[k : k + len(out)]
    return out


class Walk:
    """CGK embeddings of windows of word numbers, and their sampled keys. Number 0 is any word that no passage has."""

    def __init__(self, vocabulary: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.move = rng.integers(0, 2, (WALK, vocabulary + 1)).astype(np.int8)
        self.sampled = np.sort(rng.choice(WALK, SAMPLED, replace=False))
        self.weights = rng.integers(1, 2**63 - 1, SAMPLED, dtype=np.int64) | 1

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """One number a window (a row of WINDOW word numbers)."""
        n = len(windows)
        flat = np.zeros((n, WINDOW + 1), dtype=np.int32)
        flat[:, :WINDOW] = windows
        flat = flat.ravel()
        at = np.arange(n, dtype=np.int64) * (WINDOW + 1)
        end = at + WINDOW
        key = np.zeros(n, dtype=np.int64)
        k = 0
        for step in range(self.sampled[-1] + 1):
            symbol = flat[at]
            if step == self.sampled[k]:
                key += symbol * self.weights[k]
                k += 1
            at = np.minimum(at + self.move[step][symbol], end)
        return key


#: Share of a passage's words that may be edited where it stands whole, random walks, LSH tables and positions of a walk sampled for each.
TOLERANCE = 0.15
WALKS, TABLES, POSITIONS = 6, 48, 6
#: Passages of lengths within this factor share one size of window; so many windows overlap at a word.
SIZES, OVERLAPPING = 1.15, 8


class Embedding:
    """CGK walks over windows of one size, and the keys of many samples of their output."""

    def __init__(self, vocabulary: int, size: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.size, steps = size, 3 * size
        self.move = rng.integers(0, 2, (WALKS, steps, vocabulary + 1)).astype(np.int8)
        self.uses: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for table in range(TABLES):
            for step in rng.choice(steps, POSITIONS, replace=False):
                self.uses[table % WALKS, int(step)].append((table, int(rng.integers(1, 2**63 - 1)) | 1))

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """A row of TABLES numbers a window; a window shorter than the size ends in -1."""
        n = len(windows)
        flat = np.full((n, self.size + 1), -1, dtype=np.int32)
        flat[:, : windows.shape[1]] = windows
        flat = flat.ravel()
        first = np.arange(n, dtype=np.int64) * (self.size + 1)
        out = np.zeros((n, TABLES), dtype=np.int64)
        for walk in range(WALKS):
            at, end = first.copy(), first + self.size
            for step in range(self.move.shape[1]):
                symbol = flat[at]
                for table, weight in self.uses.get((walk, step), ()):
                    out[:, table] += (symbol + 2).astype(np.int64) * np.int64(weight)
                at = np.minimum(at + self.move[walk, step][symbol], end)
        return out


def edits(passage: np.ndarray, text: np.ndarray) -> int:
    """The fewest words to insert, delete or replace so that the passage stands in the text, beginning and ending anywhere."""
    places = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for k, w in enumerate(passage, 1):
        new = np.empty_like(row)
        new[0] = k
        new[1:] = np.minimum(row[:-1] + (text != w), row[1:] + 1)
        row = np.minimum.accumulate(new - places) + places
    return int(row.min())


class WholeProbe:
    """Passages of a block by windows of their own size, to find them whole but edited."""

    def __init__(self, items: list[tuple[int, str]], tolerance: float) -> None:
        self.ids, self.tolerance = [i for i, _ in items], tolerance
        texts = [words(p) for _, p in items]
        vocabulary = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        self.rows = [np.array([vocabulary[w] for w in t], dtype=np.int32) for t in texts]
        self.numbers = Numbers(vocabulary)
        self.classes: list[tuple[Embedding, list[tuple[np.ndarray, np.ndarray]], np.ndarray]] = []
        order = sorted((k for k in range(len(items)) if len(self.rows[k]) >= STRETCH), key=lambda k: len(self.rows[k]))
        while order:
            least = len(self.rows[order[0]])
            own = [k for k in order if len(self.rows[k]) <= SIZES * least]
            order = order[len(own) :]
            made = Embedding(len(vocabulary), least, len(self.classes))
            keys = made.keys(np.stack([self.rows[k][:least] for k in own]))
            tables = []
            for t in range(TABLES):
                by = np.argsort(keys[:, t], kind="stable")
                tables.append((keys[by, t], np.array(own)[by]))
            self.classes.append((made, tables, np.array(own)))

    def found(self, texts: list[str]) -> list[tuple[int, int, int, float]]:
        """(text number, item id, edits, share of the passage that is unedited)."""
        row, lengths = self.numbers.rows(texts)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        owner = np.repeat(np.arange(len(texts)), lengths)
        local = np.arange(len(row)) - np.repeat(starts, lengths)
        known = np.r_[0, np.cumsum(row > 0)]
        best: dict[tuple[int, int], int] = {}
        for made, tables, _ in self.classes:
            size, step = made.size, max(1, made.size // OVERLAPPING)
            room = np.repeat(lengths, lengths)
            last = np.maximum(room - size, 0)
            # windows at every step, and one at the end of each text
            at = np.flatnonzero(((local % step == 0) & (local <= last)) | (local == last))
            end = np.minimum(at + size, np.repeat(ends, lengths)[at])
            at = at[known[end] - known[at] >= (1 - 2 * self.tolerance) * size]
            for k in range(0, len(at), 100_000):
                few = at[k : k + 100_000]
                place = few[:, None] + np.arange(size)
                inside = place < np.repeat(ends, lengths)[few][:, None]
                windows = np.where(inside, row[np.minimum(place, len(row) - 1)], -1)
                keys = made.keys(windows)
                met = set()
                for t, (sorted_keys, items) in enumerate(tables):
                    lo, hi = np.searchsorted(sorted_keys, keys[:, t]), np.searchsorted(sorted_keys, keys[:, t], side="right")
                    for w in np.flatnonzero(hi > lo):
                        met.update((int(w), int(i)) for i in items[lo[w] : hi[w]])
                for w, i in met:
                    passage, text = self.rows[i], int(owner[few[w]])
                    slack = step + int(self.tolerance * len(passage)) + 1
                    a, b = max(int(starts[text]), int(few[w]) - slack), min(int(ends[text]), int(few[w]) + len(passage) + slack)
                    region = row[a:b]
                    if np.isin(passage, region).sum() < (1 - self.tolerance) * len(passage):
                        continue  # each word that is missing takes an edit
                    n = edits(passage, region)
                    if n <= self.tolerance * len(passage) and n < best.get((text, i), len(passage)):
                        best[text, i] = n
        return [(t, self.ids[i], n, 1 - n / len(self.rows[i])) for (t, i), n in best.items()]


class Probe:
    """The windows of a block of passages, to hold texts against."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids = [i for i, _ in items]
        self.texts = [words(p) for _, p in items]
        self.vocabulary = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for t in self.texts for w in t))}
        # of a stretch of STRETCH + STEP - 1 words one window is sure to be met, so of a leak's words at least this many lie in windows
        self.sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.least = np.ceil(np.ceil(SHARE * self.sizes) * WINDOW / (STRETCH + STEP - 1) - 1e-9).astype(np.int64)
        self.firsts = np.r_[0, np.cumsum(self.sizes)]
        places, windows = [], []
        for i, t in enumerate(self.texts):
            row = np.array([self.vocabulary[w] for w in t], dtype=np.int32)
            if len(row) >= STRETCH:
                w = np.lib.stride_tricks.sliding_window_view(row, WINDOW)
                windows.append(w)
                places.append(self.firsts[i] + np.arange(len(w)))
        self.owner = np.repeat(np.arange(len(self.texts)), self.sizes)
        self.walks = [Walk(len(self.vocabulary), seed) for seed in range(REPEATS)]
        self.tables = []
        if windows:
            windows, places = np.concatenate(windows), np.concatenate(places)
            for walk in self.walks:
                own = walk.keys(windows)
                order = np.argsort(own, kind="stable")
                keys, first = np.unique(own[order], return_index=True)
                self.tables.append((keys, np.r_[first, len(order)], places[order]))
        self.numbers = Numbers(self.vocabulary)
        self.numbered = [np.array([self.vocabulary[w] for w in t], dtype=np.int32) for t in self.texts]
        self.grams: dict[int, tuple[np.ndarray, dict[int, list[int]]]] = {}

    def candidates(self, row: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
        """(text, item) numbers that have enough close windows to be a leak.

        ``row`` has the word numbers of all texts, ``lengths`` how many each has.
        """
        if not self.tables:
            return []
        if len(row) < WINDOW:
            return []
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        local = np.arange(len(row)) - np.repeat(starts, lengths)
        at = np.flatnonzero((local % STEP == 0) & (local + WINDOW <= np.repeat(lengths, lengths)))
        known = np.r_[0, np.cumsum(row > 0)]
        at = at[known[at + WINDOW] - known[at] >= WINDOW - 1]  # one word may be another
        windows = np.lib.stride_tricks.sliding_window_view(row, WINDOW)[at]
        owner = np.repeat(np.arange(len(lengths)), lengths)[at]
        found = []
        total = int(self.firsts[-1])
        for walk, (keys, first, places) in zip(self.walks, self.tables):
            own = walk.keys(windows)
            place = np.searchsorted(keys, own)
            place[place == len(keys)] = 0
            hit = np.flatnonzero(keys[place] == own)
            n = first[place[hit] + 1] - first[place[hit]]
            met = places[np.repeat(first[place[hit]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            found.append(np.repeat(owner[hit], n) * total + met)
        met = np.unique(np.concatenate(found))  # a passage's window that is met several times counts once
        # words of the passage in windows that are met: a window adds what the one before it doesn't hold
        text, place = met // total, met % total
        pair = text * len(self.ids) + self.owner[place]
        new = np.r_[True, pair[1:] != pair[:-1]] if len(met) else np.zeros(0, dtype=bool)
        adds = np.where(new, WINDOW, np.minimum(np.diff(place, prepend=0), WINDOW))
        start = np.flatnonzero(new)
        if not len(start):
            return []
        covered = np.add.reduceat(adds, start)
        pair = pair[start]
        pair = pair[covered >= self.least[pair % len(self.ids)]]
        return [(int(c // len(self.ids)), int(c % len(self.ids))) for c in pair]

    def covered(self, row: np.ndarray, sums: np.ndarray, item: int) -> int:
        """The words of the item that stand in a text in its order, in stretches of STRETCH words at least.

        ``row`` has the text's word numbers, ``sums`` a checksum of each STRETCH of them.
        """
        own = self.numbered[item]
        if item not in self.grams:
            grams = defaultdict(list)
            for k, key in enumerate(checksums(own).tolist()):
                grams[key].append(k)
            self.grams[item] = np.sort(np.array(list(grams), dtype=np.int64)), dict(grams)
        keys, grams = self.grams[item]
        if not len(keys) or len(row) < STRETCH:
            return 0
        place = np.searchsorted(keys, sums)
        place[place == len(keys)] = 0
        open_: dict[int, list[int]] = {}  # diagonal: first and last place of the stretch in the text
        stretches = []
        for d0 in np.flatnonzero(keys[place] == sums).tolist():
            d = d0 + STRETCH - 1
            for k in grams[int(sums[d0])]:
                if not np.array_equal(row[d0 : d + 1], own[k : k + STRETCH]):
                    continue
                s = open_.get(d0 - k)
                if s and s[1] == d:
                    s[1] = d + 1
                else:
                    s = open_[d0 - k] = [d0, d + 1]
                    stretches.append((d0 - k, s))
        runs = sorted((s[0], s[0] - diagonal, s[1] - s[0]) for diagonal, s in stretches)
        best: list[int] = []
        for i, (d, k, n) in enumerate(runs):
            top = n
            for j in range(i):
                dj, kj, nj = runs[j]
                cut = max(0, dj + nj - d, kj + nj - k)
                if kj < k and n - cut >= STRETCH:
                    top = max(top, best[j] + n - cut)
            best.append(top)
        return max(best, default=0)

    def leaks(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """(text number, item id, share of the item's words)."""
        out = []
        row, lengths = self.numbers.rows(texts)
        ends = np.cumsum(lengths)
        sums = checksums(row)
        for t, i in self.candidates(row, lengths):
            first, end = int(ends[t] - lengths[t]), int(ends[t])
            n = self.covered(row[first:end], sums[first : max(first, end - STRETCH + 1)], i)
            if n and n >= SHARE * len(self.texts[i]):
                out.append((t, self.ids[i], n / len(self.texts[i])))
        return out


_probes: dict[str, Probe | WholeProbe] = {}


def _searched(documents: DataFrame, items: DataFrame, columns: str, make: Callable, search: Callable, doc_id: str, text: str, item_id: str, passage: str) -> DataFrame:
    """The corpus read in place, each distinct text of a batch searched for a block of passages; a block is a pass of its own."""
    rows = [(r[0], r[1]) for r in items.where(F.col(passage).isNotNull()).select(item_id, passage).distinct().orderBy(item_id, passage).collect()]  # the query set
    spark = documents.sparkSession
    kinds = dict(documents.dtypes)[doc_id], dict(items.dtypes)[item_id]
    names = ["doc_id", "item_id", *[c.split()[0] for c in columns.split(", ")]]

    def of(block: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block))  # BLOCK_ITEMS passages at most

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            name, own = shared.value
            if name not in _probes:  # a worker keeps it from task to task
                _probes.clear()
                _probes[name] = make(own)
            probe = _probes[name]
            for b in batches:
                codes, values = pd.factorize(b["text"])
                found: dict[int, list[tuple]] = defaultdict(list)
                start = size = 0
                for k, v in enumerate(values):
                    size += len(v)
                    if size >= BATCH_CHARS or k + 1 == len(values):
                        for t, *rest in search(probe, list(values[start : k + 1])):
                            found[start + t].append(tuple(rest))
                        start, size = k + 1, 0
                out = [(d, *f) for d, c in zip(b["doc_id"], codes) for f in found.get(c, ())]
                yield pd.DataFrame(out, columns=names)

        return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(find, f"doc_id {kinds[0]}, item_id {kinds[1]}, {columns}")

    out = of(rows[:BLOCK_ITEMS])
    for k in range(BLOCK_ITEMS, len(rows), BLOCK_ITEMS):
        out = out.unionByName(of(rows[k : k + BLOCK_ITEMS]))
    return out


def leaked(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """``doc_id``, ``item_id`` and ``share`` (of the passage's words) of every leak, whole or in pieces.

    ``items`` are a query set that fits the driver (some MB). Null and empty
    texts and passages hold and are no leak; passages of fewer than eight
    words can't be found; rows of a repeated id give a row each; a null id is
    kept; empty tables give no rows; other columns are ignored.
    """
    return _searched(documents, items, "share double", Probe, Probe.leaks, doc_id, text, item_id, passage)


def edited(documents: DataFrame, items: DataFrame, tolerance: float = TOLERANCE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """``doc_id``, ``item_id``, ``edits`` and ``share`` (unedited) of the passages that stand whole in a text but for edits to at most ``tolerance`` of their words.

    Windows of the passage's size are embedded, candidates are those that
    agree with the passage in all positions of one of the samples, and the
    edit distance decides. Unlike the pieces of :func:`leaked` no stretch need
    be untouched. Edge cases are those of :func:`leaked`.
    """
    return _searched(documents, items, "edits int, share double", partial(WholeProbe, tolerance=tolerance), WholeProbe.found, doc_id, text, item_id, passage)
