"""Toxicity scores from misspelled lexicon terms and the context they stand in.

The lexicon is learned: words that labelled toxic documents hold more often than chance explains, by a likelihood ratio that allows
for the number of words tested. A trie of its terms is intersected
with their Levenshtein automata into one automaton over characters, made deterministic as words reach its states, so a batch of
distinct words runs through it column by column. Beginnings of words are
terms too, for inflected ones. A word that is no term but within the allowed edits of one counts as a term
misspelled. In a window around a match quotation marks tell a quoted term from abuse. How much a misspelled and how much a
quoted term weighs is fitted to the labels by maximum likelihood.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doppel.checkpoint import settled
from doppel.llm.batches import slices
from doppel.llm.labelled import labelled

# Documented bounds: what is broadcast is at most this many terms and known clean neighbours of terms.
TERMS = 4000
NEIGHBOURS = 4000
SUPPORT = 3  # labelled documents a clean neighbour is in
PRECISION = 0.7  # share of a term's documents that are toxic, smoothed
STEM_PRECISION = 0.85  # the same for beginnings of words
CHANCE = 1.0  # terms expected in the lexicon by chance, over all words tested
FUZZY_FROM = 5  # characters a term has to be matched with one edit
LONGEST = 40  # characters of a term
STEMS = (4, 9)  # characters of the beginnings that may be terms
WINDOW = 60  # characters on each side
# Tried values: the weight of quoted terms, the probability a misspelled term stands for.
QUOTED = np.linspace(0, 1, 11)
MISSPELLED = np.array([0.001, 0.01, 0.03, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
NEAR = 2.0

_WORD = re.compile(r"\w+")


class TrieAutomaton:
    """A deterministic automaton for all words within `edits` edits of the terms of a trie."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], fuzzy: set[str]):
        """terms: probability by exact term; stems: of any word that begins so; fuzzy: the terms that may have one edit."""
        self.next: list[dict[str, int]] = [{}]
        self.exact: list[float | None] = [None]
        self.stem: list[float | None] = [None]
        self.near = [False]
        for term in sorted(set(terms) | set(stems) | fuzzy):
            node = 0
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.exact.append(None)
                    self.stem.append(None)
                    self.near.append(False)
                node = self.next[node][c]
            self.exact[node] = terms.get(term, self.exact[node])
            self.stem[node] = stems.get(term)
            self.near[node] = term in fuzzy
        # Below a node without fuzzy terms an edit leads nowhere.
        self.reach = [False] * len(self.next)
        for node in range(len(self.next) - 1, -1, -1):
            self.reach[node] = self.near[node] or any(self.reach[k] for k in self.next[node].values())
        self.letters = np.array(sorted({ord(c) for kids in self.next for c in kids}), np.uint32)
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.value: list[float] = []
        self.table = np.full((64, len(self.letters) + 1), -1, np.int32)
        self._state(set())  # 0: no way to a match
        self.start = self._state({(0, 0)})

    def _state(self, members: set[tuple[int, int]]) -> int:
        # A character left out of the word: on to the children with one edit.
        members |= {(k, 1) for node, e in list(members) if e == 0 for k in self.next[node].values() if self.reach[k]}
        members = frozenset((n, e) for n, e in members if e == 0 or (n, 0) not in members)
        at = self.states.get(members)
        if at is None:
            self.states[members] = at = len(self.members)
            self.members.append(members)
            exact = [self.exact[n] for n, e in members if e == 0 and self.exact[n] is not None]
            stem = max((self.stem[n] for n, e in members if e == 0 and self.stem[n] is not None), default=None)
            self.value.append(exact[0] if exact else stem if stem else NEAR if any(self.near[n] for n, _ in members) else 0.0)
            if at >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return at

    def _step(self, state: int, letter: int) -> int:
        c = chr(self.letters[letter]) if letter < len(self.letters) else ""
        out = set()
        for node, e in self.members[state]:
            if c in self.next[node]:
                out.add((self.next[node][c], e))
            if e == 0 and self.stem[node] is not None:
                out.add((node, 0))
            if e == 0 and self.reach[node]:
                out.add((node, 1))  # one more character
                out.update((k, 1) for k in self.next[node].values() if self.reach[k])  # another character
        return self._state(out)

    def match(self, words: list[str]) -> np.ndarray:
        """The probability of each word that is a term, NEAR for one that is within an edit of a term, else 0."""
        out = np.zeros(len(words))
        rows = np.array([i for i, w in enumerate(words) if "\0" not in w], np.int64)
        if not len(rows) or not len(self.letters):
            return out
        # No term is longer than LONGEST, so of longer words only the beginning can be a term, which these characters tell.
        text = np.array([words[i][:LONGEST + 2] for i in rows], "U")
        codes = text.view(np.uint32).reshape(len(rows), -1)
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        letters = np.where(self.letters[at] == codes, at, len(self.letters))
        state = np.full(len(rows), self.start, np.int64)
        live = np.arange(len(rows))
        for k in range(codes.shape[1]):
            live = live[(codes[live, k] != 0) & (state[live] != 0)]
            if not len(live):
                break
            found = self.table[state[live], letters[live, k]]
            new = np.flatnonzero(found < 0)
            if len(new):
                width = len(self.letters) + 1
                for pair in np.unique(state[live[new]] * width + letters[live[new], k]).tolist():
                    target = self._step(pair // width, pair % width)
                    self.table[pair // width, pair % width] = target
                found = self.table[state[live], letters[live, k]]
            state[live] = found
        out[rows] = np.array(self.value)[state]
        return out


class Model:
    """Term probabilities, what misspelled and quoted terms weigh, and the share of toxic documents without any term."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], fuzzy: set[str], misspelled: float, quoted: float, floor: float):
        self.terms, self.stems, self.fuzzy, self.misspelled, self.quoted, self.floor = terms, stems, fuzzy, misspelled, quoted, floor
        self._automaton: TrieAutomaton | None = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self) -> TrieAutomaton:
        if self._automaton is None:
            self._automaton = TrieAutomaton(self.terms, self.stems, self.fuzzy)
        return self._automaton

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Per text the evidence of plain and of quoted terms, sums of -log(1 - p) over distinct words, and the numbers of
        plain and of quoted misspelled words. A word quoted in one place and plain in another is plain.
        """
        lowered = [t.lower() for t in texts]
        words = [_WORD.findall(t) for t in lowered]
        distinct = list(set().union(*words)) if words else []
        chance = dict(x for x in zip(distinct, self.automaton().match(distinct).tolist()) if x[1] > 0)
        out = np.zeros((len(texts), 4))
        for i, own in enumerate(words):
            hits = chance.keys() & set(own)
            if hits:
                bare = set()
                for m in _WORD.finditer(lowered[i]):
                    if m[0] in hits and m[0] not in bare and not is_quoted(lowered[i], m.start(), m.end()):
                        bare.add(m[0])
                for w in sorted(hits):
                    out[i, (w not in bare) + 2 * (chance[w] == NEAR)] += 1 if chance[w] == NEAR else -np.log1p(-min(chance[w], 1 - 1e-6))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 - (1 - self.floor) * np.exp(-weigh(self.evidence(texts), self.misspelled, self.quoted))


def weigh(evidence: np.ndarray, misspelled: float, quoted: float) -> np.ndarray:
    near = -np.log1p(-misspelled)
    return evidence[:, 0] + quoted * evidence[:, 1] + near * (evidence[:, 2] + quoted * evidence[:, 3])


def is_quoted(text: str, start: int, end: int) -> bool:
    """Whether quotation marks open before and close after the span, within a window of it."""
    left, right = text[max(0, start - WINDOW):start].rpartition("\n")[2], text[end:end + WINDOW].partition("\n")[0]
    if left.count('"') % 2 and '"' in right:
        return True
    return any(left.rfind(a) > left.rfind(b) and b in right for a, b in ("“”", "„“", "«»", "‹›"))


def _word_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of each class by word, and by beginning of words."""
    for part in slices(frames):
        counts = {(stem, label): Counter() for stem in (False, True) for label in (0, 1)}
        for text, label in zip(part["text"], part["label"]):
            words = set(_WORD.findall(text.lower()))
            counts[False, label].update(words)
            counts[True, label].update({w[:n] for w in words for n in range(STEMS[0], min(STEMS[1] + 1, len(w)))})
        for stem in (False, True):
            clean, toxic = counts[stem, 0], counts[stem, 1]
            words = list(clean.keys() | toxic.keys())
            yield pd.DataFrame({"word": words, "stem": stem, "clean": [clean[w] for w in words], "toxic": [toxic[w] for w in words]})


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """The model of `label` from the documents that have one. 

    Without toxic rows the lexicon is empty and every score is the smoothed share of toxic rows.
    """
    rows = labelled(docs, labels, label).select("text", "label")
    every = settled(rows.mapInPandas(_word_counts, "word string, stem boolean, clean long, toxic long")
                    .groupBy("word", "stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    counts, begun = every.where("not stem").drop("stem"), every.where("stem").drop("stem")
    share = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = (share[1] + 0.5) / (share[0] + 1)
    chance = (F.col("toxic") + 2 * prior) / (F.col("toxic") + F.col("clean") + 2)
    # The more words are tested, the more evidence a term needs.
    found_in = F.col("toxic") + F.col("clean")
    rate = F.col("toxic") / found_in
    gain = F.col("toxic") * F.log(rate / prior) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - rate) / (1 - prior))).otherwise(0.0)
    least = math.log(max(1, every.count()) / CHANCE)

    def significant(table: DataFrame, precision: float) -> dict[str, float]:
        rows = (table.where((F.col("toxic") > 0) & (F.length("word") <= LONGEST) & (chance >= precision) & (gain >= least))
                .orderBy(gain.desc(), "word").limit(TERMS).select("word", chance.alias("p")).collect())
        return {r["word"]: min(r["p"], 1 - 1e-6) for r in rows}

    # Inflected terms are rare one by one; their common beginning is not.
    terms, stems = significant(counts, PRECISION), significant(begun, STEM_PRECISION)
    fuzzy = {t for t in terms if len(t) >= FUZZY_FROM}
    if not terms and not stems:
        return Model({}, {}, set(), 0.0, 1.0, prior)

    # Words near a term that clean documents use are words of their own, with their own probability.
    probe = docs.sparkSession.sparkContext.broadcast(Model(terms, stems, fuzzy, 0.0, 1.0, 0.0))

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[probe.value.automaton().match(frame["word"].tolist()) == NEAR]

    own = (counts.where(F.col("clean") >= SUPPORT).mapInPandas(near, "word string, clean long, toxic long")
           .orderBy(F.desc("clean"), "word").limit(NEIGHBOURS).select("word", chance.alias("p")).collect())
    terms |= {r["word"]: r["p"] if r["p"] > 2 * prior else 1e-9 for r in own}
    shared = docs.sparkSession.sparkContext.broadcast(Model(terms, stems, fuzzy, 0.0, 1.0, 0.0))
    grid = [(m, q) for m in MISSPELLED for q in QUOTED]

    def likelihood(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, without = np.zeros(len(grid)), np.zeros(2, np.int64)
        for part in slices(frames):
            y = part["label"].to_numpy()
            found = shared.value.evidence(part["text"].tolist())
            none = found.max(axis=1, initial=0) < 1e-6
            without += [int((none & (y == 0)).sum()), int((none & (y == 1)).sum())]
            found, y = found[~none], y[~none]
            for k, (m, q) in enumerate(grid):
                p = np.clip(1 - np.exp(-weigh(found, m, q)), 1e-3, 1 - 1e-3)
                total[k] += np.where(y == 1, np.log(p), np.log(1 - p)).sum()
        yield pd.DataFrame({"k": range(len(grid)), "ll": total, "clean": without[0], "toxic": without[1]})

    sums = (rows.mapInPandas(likelihood, "k int, ll double, clean long, toxic long").groupBy("k")
            .agg(F.sum("ll").alias("ll"), F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect())
    best = max(sums, key=lambda r: (round(r["ll"], 6), r["k"]))
    return Model(terms, stems, fuzzy, *map(float, grid[best["k"]]), (best["toxic"] + prior) / (best["toxic"] + best["clean"] + 1))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """The documents with a score from 0 to 1; a null text counts as empty. All columns stay; `column` replaces one of its name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(np.concatenate([np.zeros(0)] + [shared.value.scores(p["text"].tolist()) for p in slices([texts.rename("text").to_frame()])]))

    kept = [F.col(f"`{c}`") for c in docs.columns if c != column]
    return docs.select(*kept, scores(F.col("text").cast("string")).alias(column))
