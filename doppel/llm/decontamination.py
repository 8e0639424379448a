"""Benchmark decontamination by edit distance: CGK embedding, bit-sampling LSH, exact verification.

Texts and items are compared as sequences of words (lower case, no ASCII punctuation). A window as long as an item is embedded by a
random walk that copies the word it stands on and moves on or stays by a random bit of the word and the step, so that edits become
a Hamming distance. Some walks, each with SAMPLED sampled places of the embedded string as its hash, compare a window
with the item. Places lie where a walk still stands on a word, so unrelated windows agree only where they share words. The
number of walks is what RECALL needs at the most edits allowed, found on random edits (`repeats_of`). Whatever agrees in one walk is verified exactly: the least number of word edits between the item and
any stretch of the text around the window.

A match within k edits holds at least one of k + 1 pieces of the item unchanged, which also tells where the item would
begin. Windows that no piece points at cannot match and are not embedded; this rule loses nothing. A match is lost, with a chance
of at most 1 - RECALL where edits fall at random, only if no walk agrees for any of the windows its pieces point at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doppel.checkpoint import settled
from doppel.llm.batches import run_folder, slices
from doppel.llm.lines import _PUNCTUATION
from doppel.llm.words import Words, mix

SIMILARITY = 0.8
SAMPLED = 2
RECALL = 0.995
TRIALS = 400  # pairs of each size in which the number of walks is found
SIZES = (8, 32, 128)  # words
MOST_REPEATS = 256  # walks, even where the recall asks for more
PAGE_CHARS = 4_000_000  # characters of items compared in one pass over the documents; bounds what is broadcast
HITS = "array<struct<item_id: long, start: int, words: int, distance: int>>"


def split_words(texts: list[str]) -> Words:
    return Words([t.lower().encode("utf-8", "replace").translate(None, _PUNCTUATION) for t in texts], lower=False)


def embed(windows: np.ndarray, size: np.ndarray, repeat: int) -> np.ndarray:
    """A hash of the sampled places of the CGK embedding of each window; windows are rows, filled with zeros to a common width."""
    draw = np.random.Generator(np.random.PCG64([11, repeat]))
    places = (draw.random(SAMPLED)[None, :] * size[:, None]).astype(np.int64)
    steps = draw.integers(0, 2 ** 64, windows.shape[1], np.uint64, endpoint=False)
    out = np.zeros((len(windows), SAMPLED), np.uint64)
    rows, at = np.arange(len(windows)), np.zeros(len(windows), np.int64)
    last = int(places.max(initial=-1))
    for j in range(last + 1):
        inside = at < size
        word = np.where(inside, windows[rows, np.minimum(at, windows.shape[1] - 1)], np.uint64(0))
        out = np.where(places == j, word[:, None], out)
        at += (inside & ((mix(word + steps[j]) >> np.uint64(63)) == 1)).astype(np.int64)
    sig = np.zeros(len(windows), np.uint64)
    for m in range(SAMPLED):
        sig = mix(sig * np.uint64(3) + out[:, m])
    return sig


def edited(item: list[int], edits: int, rng: np.random.Generator) -> list[int]:
    """The words after random replacements, insertions and deletions."""
    own = list(item)
    for _ in range(edits):
        at, kind, word = int(rng.integers(0, len(own) + 1)), int(rng.integers(0, 3)), int(rng.integers(1, 2 ** 63))
        if kind == 0 or at == len(own):
            own.insert(at, word)
        else:
            own[at:at + 1] = [word] if kind == 1 else []
    return own


def repeats_of(similarity: float, recall: float = RECALL) -> int:
    """The least number of walks, a multiple of 8, in which this share of windows agrees with the item at the most edits allowed."""
    rng = np.random.Generator(np.random.PCG64(17))
    rest = []
    for size in SIZES:
        items = rng.integers(1, 2 ** 63, (TRIALS, size))
        others = [edited(x, math.floor((1 - similarity) * size + 1e-9), rng) for x in items.tolist()]
        rest.append((items.astype(np.uint64), np.array([(x + [0] * size)[:size] for x in others], np.uint64), np.full(TRIALS, size)))
    missed = [np.ones(TRIALS, bool) for _ in rest]
    for r in range(MOST_REPEATS):
        if r and r % 8 == 0 and all(m.mean() <= 1 - recall for m in missed):
            return r
        for m, (a, b, size) in zip(missed, rest):
            m &= embed(a, size, r) != embed(b, size, r)
    return MOST_REPEATS


def best_match(item: list[int], text: list[int], most: int) -> tuple[int, int, int] | None:
    """Least edits between the item and any stretch of the text, with its start and end; the first such stretch. None above `most`."""
    before = [(0, j) for j in range(len(text) + 1)]
    for i, word in enumerate(item, 1):
        row = [(i, 0)]
        for j, other in enumerate(text, 1):
            same = before[j - 1][0] + (word != other), before[j - 1][1]
            gone = before[j][0] + 1, before[j][1]
            more = row[j - 1][0] + 1, row[j - 1][1]
            row.append(min(same, gone, more))
        before = row
        if min(c for c, _ in row) > most:
            return None
    distance, end = min((c, j) for j, (c, _) in enumerate(before))
    return (distance, before[end][1], end) if distance <= most else None


class Index:
    """The pieces and the embeddings of some items."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float):
        words = split_words([t for _, t in rows])
        cuts = np.cumsum(words.counts) - words.counts
        self.ids = [i for i, _ in rows]
        self.items = [words.hashes[c:c + n] for c, n in zip(cuts, words.counts)]
        self.size = words.counts.astype(np.int64)
        self.most = np.floor((1 - similarity) * self.size + 1e-9).astype(np.int64)
        self.widest = int(self.size.max(initial=0))
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for k, (item, most) in enumerate(zip(self.items, self.most.tolist())):
            if len(item):
                length = len(item) // (most + 1)
                for p in range(most + 1):
                    pieces.setdefault(length, []).append((int(_run(item[p * length:(p + 1) * length], length)[0]), k, p * length))
        self.pieces = {}
        for length, found in pieces.items():
            found.sort()
            keys = np.array([f[0] for f in found], np.uint64)
            marked = np.zeros(1 << 16, bool)
            marked[keys >> np.uint64(48)] = True
            self.pieces[length] = keys, np.array([f[1] for f in found], np.int64), np.array([f[2] for f in found], np.int64), marked
        wide = np.zeros((len(self.items), max(1, self.widest)), np.uint64)
        for k, item in enumerate(self.items):
            wide[k, :len(item)] = item
        self.signs = [embed(wide, self.size, r) for r in range(repeats_of(similarity))]

    def windows(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Distinct (text, item, start) of the windows that a piece points at; starts count from the first word of all texts."""
        text = np.repeat(np.arange(len(counts)), counts)
        found = [np.zeros((0, 3), np.int64)]
        for length, (keys, items, offsets, marked) in self.pieces.items():
            if len(hashes) < length:
                continue
            runs = _run(hashes, length)
            at = np.flatnonzero(marked[runs >> np.uint64(48)] & (text[:len(runs)] == text[length - 1:]))
            low, high = np.searchsorted(keys, runs[at], "left"), np.searchsorted(keys, runs[at], "right")
            hit = np.repeat(np.arange(len(at)), high - low)
            piece = np.arange(len(hit)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
            found.append(np.stack([text[at[hit]], items[piece], at[hit] - offsets[piece]], 1))
        return np.unique(np.concatenate(found), axis=0)

    def matches(self, texts: list[str]) -> list[list[dict]]:
        """Per text one best match for each item it holds."""
        words = split_words(texts)
        hashes, counts = words.hashes, words.counts
        first = np.cumsum(counts) - counts
        out: list[list[dict]] = [[] for _ in texts]
        spots = self.windows(hashes, counts)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for a in range(0, len(spots), 4096):
            part = spots[a:a + 4096]
            text, item, start = part.T
            size = self.size[item]
            place = start[:, None] + np.arange(max(1, self.widest))[None, :]
            inside = (place >= first[text][:, None]) & (place < (first + counts)[text][:, None]) & (place < (start + size)[:, None])
            wide = np.where(inside, hashes[np.clip(place, 0, len(hashes) - 1)], np.uint64(0))
            near = np.zeros(len(part), bool)
            for r, signs in enumerate(self.signs):
                near |= embed(wide, size, r) == signs[item]
            for t, k, s in part[near].tolist():
                n, most = int(self.size[k]), int(self.most[k])
                low, high = max(int(first[t]), s - most), min(int(first[t] + counts[t]), s + n + most)
                if best.get((t, k), (most + 1,))[0] == 0:
                    continue
                own = hashes[s:s + n]
                if s >= low and s + n <= high and np.array_equal(own, self.items[k]):
                    found = (0, s - low, s + n - low)
                else:
                    found = best_match(self.items[k].tolist(), hashes[low:high].tolist(), most)
                if found:
                    found = found[0], low + found[1] - int(first[t]), found[2] - found[1]
                    best[t, k] = min(best.get((t, k), found), found)
        for (t, k), (distance, start, size) in sorted(best.items()):
            out[t].append({"item_id": self.ids[k], "start": start, "words": size, "distance": distance})
        return out


def _run(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for j in range(n):
        out = mix(out * np.uint64(3) + hashes[j:len(hashes) - n + 1 + j])
    return out


def _pages(items: DataFrame, similarity: float):
    """An index for each page of the items; a page is of bounded size."""
    rows = items.selectExpr("cast(item_id as long) item_id", "cast(text as string) text").where("item_id is not null and text is not null").distinct()
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    pages = chars // PAGE_CHARS + 1
    for p in range(pages):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(pages)) == p).orderBy("item_id", "text").collect()
        yield Index([(r["item_id"], r["text"]) for r in own], similarity)


def _hits(docs: DataFrame, index: Index):
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf(HITS)
    def hits(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out = []
            for part in slices([texts.rename("text").to_frame()]):
                out += shared.value.matches(part["text"].tolist())
            yield pd.Series(out, dtype=object)

    return hits(F.col("text").cast("string"))


def find(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document and item it holds, within (1 - similarity) * words edits of the item.

    docs: doc_id, text; items: item_id, text; other columns are ignored. Null and empty texts hold nothing, items without words or id are
    held by none. Documents of a null id are reported with it; repeated rows are reported each, repeated items once. Empty
    tables: no rows. Returns doc_id, item_id, start (first word), words (of the stretch) and distance; of several places of an item in
    a document the one of fewest edits, then the first.
    """
    spark = docs.sparkSession
    folder = run_folder(spark, "matches")
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    for index in _pages(items, similarity):
        found = rows.select("doc_id", F.explode(_hits(rows, index)).alias("hit")).select("doc_id", "hit.*")
        found.write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that hold no item, with all their columns; see find."""
    pages = 0
    for index in _pages(items, similarity):
        docs = docs if not pages else settled(docs)
        docs = docs.where(F.size(_hits(docs, index)) == 0)
        pages += 1
    return docs
