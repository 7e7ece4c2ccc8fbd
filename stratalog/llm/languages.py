"""The language of each message and of each stretch of it, by cross-parsing.

For every language a suffix automaton is built of labelled text. A word is
parsed into the longest pieces that the automaton contains; the language whose
automaton needs the fewest pieces a character explains the text best. Pieces
start anew at each word, so a word's piece counts are computed once and a text
costs one look-up a word. Sentences are classified one by one, neighbours of
the same language form a stretch.

Labels are wrong now and then, so the labelled sample is cleaned first: a
sentence whose words occur mostly under another label is not used.
"""

from __future__ import annotations

import math
import re
import unicodedata as ud
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm.canonical import canonical_form

LANGUAGES = ("en", "ru", "de", "fr", "es", "it", "pt", "uk")
# ISO 639-2 codes (terminological and bibliographic) of these languages.
ISO_639_2 = {"eng": "en", "rus": "ru", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "ita": "it", "por": "pt", "ukr": "uk"}
#: Labelled texts a language that the automata are built of, at most; the bound of the sample on the driver.
SAMPLE = 400
#: A stretch is a whole sentence from so many words and letters; shorter ones have no language of their own.
LEAST_WORDS, LEAST_LETTERS = 3, 12
#: A sentence that needs more pieces a character than this in every language is in none of them.
NOISE = 0.55
#: Under this relative gap to the second language a sentence goes with the text around it.
CLEAR = 0.06
#: A word of more pieces a letter than this in every language (a name, a code) belongs to none and doesn't count.
STRANGE = 0.25
CACHE_WORDS = 400_000

# Romanisation of Cyrillic letters as in passports and maps, where it differs between the languages.
ROMAN = {"а": "a", "б": "b", "в": "v", "г": "g", "ґ": "g", "д": "d", "е": "e", "ё": "e", "є": "ye", "ж": "zh", "з": "z", "и": "i", "і": "i", "ї": "yi", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya"}
ROMAN_UK = {**ROMAN, "г": "h", "и": "y"}
GERMAN = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"})

_CODE = re.compile(r"```.*?(?:```|$)|`[^`\n]*`", re.S)
_CUT = re.compile(r"[\n\r  ]+|(?<=[.!?])[\"'”’»)\]]*\s+|(?<=[:,])\s+(?=[\"“„«])|(?<=[.!?])[\"”»]+")
_WORD = re.compile(r"[^\W\d_]+")


def label_language(label: Column) -> Column:
    """The language a label names, among :data:`LANGUAGES`; null if it names none of them."""
    code = F.lower(F.regexp_extract(F.coalesce(label, F.lit("")), r"^\s*([A-Za-z]{2,3})(?:[-_][A-Za-z0-9]+)*\s*$", 1))
    three = F.create_map(*[F.lit(x) for kv in ISO_639_2.items() for x in kv])
    return F.when(code.isin(*LANGUAGES), code).otherwise(F.try_element_at(three, code))


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences of a canonical text, without program text."""
    out = []
    at = 0
    for code in [*_CODE.finditer(text), None]:
        end = code.start() if code else len(text)
        start = at
        for m in _CUT.finditer(text, at, end):
            out.append((start, m.start()))
            start = m.end()
        out.append((start, end))
        at = code.end() if code else end
    return [(a, b) for a, b in out if a < b]


class Automaton:
    """The suffix automaton of a set of words, each standing between spaces."""

    def __init__(self, words: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        link, length = [-1], [0]
        for w in words:
            last = 0
            for ch in f" {w} ":
                if ch in self.next[last]:
                    q = self.next[last][ch]
                    if length[q] == length[last] + 1:
                        last = q
                        continue
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[last] + 1)
                    link.append(link[q])
                    link[q] = clone
                    p = last
                    while p != -1 and self.next[p].get(ch) == q:
                        self.next[p][ch] = clone
                        p = link[p]
                    last = clone
                    continue
                cur = len(self.next)
                self.next.append({})
                length.append(length[last] + 1)
                link.append(0)
                p = last
                while p != -1 and ch not in self.next[p]:
                    self.next[p][ch] = cur
                    p = link[p]
                if p != -1:
                    q = self.next[p][ch]
                    if length[q] == length[p] + 1:
                        link[cur] = q
                    else:
                        clone = len(self.next)
                        self.next.append(dict(self.next[q]))
                        length.append(length[p] + 1)
                        link.append(link[q])
                        while p != -1 and self.next[p].get(ch) == q:
                            self.next[p][ch] = clone
                            p = link[p]
                        link[q] = link[cur] = clone
                last = cur

    def pieces(self, word: str) -> int:
        """The fewest pieces of the automaton's text that the word, between spaces, falls into; an unknown letter is a piece."""
        n, state, inside = 0, 0, False
        for ch in f" {word} ":
            nxt = self.next[state].get(ch) if inside else None
            if nxt is None:
                n += 1
                nxt = self.next[0].get(ch)
                inside = nxt is not None
                state = nxt if inside else 0
            else:
                state = nxt
        return n


def variants(word: str, language: str) -> set[str]:
    """The spellings of a canonical word: as it is, without accents, and written in ASCII as its language does."""
    out = {word, "".join(ch for ch in ud.normalize("NFD", word) if ud.category(ch) != "Mn") if language not in ("ru", "uk") else word}
    if language == "de":
        out.add(word.translate(GERMAN))
    if language in ("ru", "uk"):
        table = ROMAN_UK if language == "uk" else ROMAN
        out.add(word.replace("ё", "е"))
        roman = "".join(table.get(ch, ch) for ch in word)
        out |= {roman, "".join("yo" if ch == "ё" else table.get(ch, ch) for ch in word)}
        out |= {p for w in (word.replace("ь", " ").replace("'", " "),) for p in "".join(table.get(ch, ch) for ch in w).split()}
    return out


def fit(labelled: list[tuple[str, str]]) -> dict[str, Automaton]:
    """Automata of (language, text) pairs, whose labels may be wrong now and then."""
    split = [(lang, [_WORD.findall(t[a:b]) for a, b in sentences(t)]) for lang, t in ((lang, canonical_form(text)) for lang, text in labelled)]
    seen: dict[str, Counter] = defaultdict(Counter)
    texts = Counter(lang for lang, _ in split)
    for lang, parts in split:
        seen[lang].update({w for p in parts for w in p})
    kept: dict[str, Counter] = defaultdict(Counter)
    for lang, parts in split:
        own = set()
        for words in parts:
            if len(words) >= LEAST_WORDS:
                of = {k: sum(math.log((seen[k][w] + 0.05) / (texts[k] + 1)) for w in words) for k in texts}
                if max(of, key=of.get) == lang:
                    own.update(words)
        kept[lang].update(own)
    out = {}
    for lang in LANGUAGES:
        least = 3 if texts[lang] > 200 else 2 if texts[lang] > 50 else 1
        # a word met more often, for its share of texts, under another label got here by a wrong one
        words = [w for w, n in kept[lang].items() if n >= least and all(n / (texts[lang] + 1) * 8 >= kept[k][w] / (texts[k] + 1) for k in texts)]
        out[lang] = Automaton(sorted({v for w in words for v in variants(w, lang)}))
    return out


class Classifier:
    """Classifies texts; keeps the piece counts of the words it met."""

    def __init__(self, automata: dict[str, Automaton]) -> None:
        self.automata = [automata[k] for k in LANGUAGES]
        self._start()

    def _start(self) -> None:
        self.rows: dict[str, int] = {}
        self.counts = np.zeros((1024, len(LANGUAGES) + 1), dtype=np.int32)

    def _row(self, word: str) -> int:
        i = len(self.rows)
        if i == len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        pieces = [a.pieces(word) for a in self.automata]
        least = min(pieces)
        if least < 3 or least <= STRANGE * len(word):
            # every word needs one piece at least; what is above that tells the languages apart
            self.counts[i] = [n - 1 for n in pieces] + [len(word)]
        self.rows[word] = i
        return i

    def classify(self, texts: list[str]) -> list[tuple[int, list[tuple[int, int, str, float]]]]:
        """For each canonical text its letters and its stretches: start, end, language, confidence."""
        if len(self.rows) > CACHE_WORDS:
            self._start()
        rows, get = [], self.rows.get
        spans, firsts, owners, letters = [], [], [], []
        for i, text in enumerate(texts):
            count = 0
            for a, b in sentences(text):
                words = _WORD.findall(text, a, b)
                if not words:
                    continue
                n = sum(map(len, words))
                count += n
                if len(words) < LEAST_WORDS or n < LEAST_LETTERS:
                    continue
                firsts.append(len(rows))
                spans.append((a, b))
                owners.append(i)
                for w in words:
                    r = get(w)
                    rows.append(self._row(w) if r is None else r)
            if "`" in text:
                count += sum(map(len, _WORD.findall("".join(m[0] for m in _CODE.finditer(text)))))
            letters.append(count)
        out = [(n, []) for n in letters]
        if not spans:
            return out
        sums = np.add.reduceat(self.counts[rows], firsts, axis=0)
        rate = (sums[:, :-1] + 0.2) / np.maximum(sums[:, -1:], 1)
        two = np.partition(rate, 1, axis=1)[:, :2]
        best, gap = rate.argmin(axis=1), (two[:, 1] - two[:, 0]) / two[:, 1]
        owners = np.array(owners)
        ends = np.r_[np.flatnonzero(np.diff(owners)) + 1, len(owners)]
        start = 0
        for end in ends:
            own = range(start, end)
            clear = np.zeros(len(LANGUAGES))
            for k in own:
                if two[k, 0] <= NOISE and gap[k] >= CLEAR:
                    clear[best[k]] += spans[k][1] - spans[k][0]
            found = out[owners[start]][1]
            for k in own:
                if two[k, 0] > NOISE:
                    continue
                lang = int(best[k])
                if gap[k] < CLEAR and clear.any():
                    # the likeliest language of the text around it, unless that explains it much worse
                    around = int(clear.argmax())
                    lang = around if rate[k, around] <= two[k, 0] * 1.25 else lang
                others = np.delete(rate[k], lang).min()
                sure = float(np.clip(1 - rate[k, lang] / (rate[k, lang] + others), 0, 1))
                if found and found[-1][2] == LANGUAGES[lang]:
                    a, b, name, before = found[-1]
                    size, more = b - a, spans[k][1] - spans[k][0]
                    found[-1] = (a, spans[k][1], name, (before * size + sure * more) / (size + more))
                else:
                    found.append((*spans[k], LANGUAGES[lang], sure))
            start = end
        return out


def labelled_sample(texts: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE) -> list[tuple[str, str]]:
    """At most ``sample`` labelled texts a language, the first in order of a hash of their key."""
    own = labels.select(F.col(key), label_language(F.col(label)).alias("lang")).where("lang is not null")
    own = own.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(key), key))).where(F.col("k") <= 2 * sample)
    found = texts.select(key, F.col(text).alias("text")).where(F.length("text") >= 40).join(F.broadcast(own.drop("k")), key)
    rows = found.orderBy(F.xxhash64(key), "text").limit(2 * sample * len(LANGUAGES)).collect()
    out, seen = [], Counter()
    for r in rows:
        if seen[r["lang"]] < sample:
            seen[r["lang"]] += 1
            out.append((r["lang"], r["text"]))
    return out


def detect(texts: DataFrame, labels: DataFrame, key: str = "row_id", text: str = "text", label: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """``key``, ``letters``, ``lang``, ``confidence`` and ``stretches`` of every text.

    lang and confidence are those of the language with most letters; a text
    without a sentence in any known language has null. stretches is an array
    of (first, last: offsets into the canonical form, lang, confidence).
    Labels are used to fit only: ``labels`` may lack rows, be wrong or be
    empty (then no text has a language). Null and blank texts have no letters
    and no stretches; repeated keys give a row each; other columns are ignored.
    """
    automata = fit(labelled_sample(texts, labels, key, text, label, sample))
    known = any(len(a.next) > 1 for a in automata.values())
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(automata)  # at most ``sample`` texts a language went into it
    kind = texts.select(key).schema[0].dataType.simpleString()

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(shared.value)
        for b in batches:
            codes, values = pd.factorize(b["text"])
            got = classifier.classify([canonical_form(v) for v in values]) if known and len(values) else [(0, [])] * len(values)
            got.append((0, []))
            main = []
            for _, found in got:
                size: Counter = Counter()
                for a, e, lang, _ in found:
                    size[lang] += e - a
                top = max(size, key=lambda k: (size[k], k)) if size else None
                main.append((top, sum((e - a) * c for a, e, lang, c in found if lang == top) / size[top] if top else None))
            yield pd.DataFrame({"key": b["key"], "letters": [got[c][0] for c in codes], "lang": [main[c][0] for c in codes], "confidence": pd.array([main[c][1] for c in codes], dtype="Float64"), "stretches": [[{"first": a, "last": e, "lang": k, "confidence": s} for a, e, k, s in got[c][1]] for c in codes]})

    schema = f"key {kind}, letters int, lang string, confidence double, stretches array<struct<first: int, last: int, lang: string, confidence: double>>"
    return texts.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(of, schema).withColumnRenamed("key", key)


def mislabelled(detected: DataFrame, labels: DataFrame, key: str = "row_id", label: str = "lang", least: int = 20) -> DataFrame:
    """``key`` and ``lang`` of each language with a whole sentence in a text of at least ``least`` letters whose label is absent, names no language or another one, or that has several languages."""
    own = labels.select(F.col(key).alias("_k"), label_language(F.col(label)).alias("said")).where("said is not null")
    langs = F.array_distinct(F.transform("stretches", lambda s: s["lang"]))
    found = detected.where(F.col("letters") >= least).select(key, langs.alias("langs")).where(F.size("langs") > 0)
    case = F.col("said").isNull() | (F.size("langs") > 1) | (F.col("langs")[0] != F.col("said"))
    return found.join(own, F.col(key) == F.col("_k"), "left").where(case).select(key, F.explode("langs").alias("lang")).distinct()
