"""Ranked lexical search by a K2-treap over the grid of terms and documents.

A shard of documents is a grid: a row for each of its terms, frequent ones first, a column for each document. Cells are cut in
four again and again; a node of the quadtree stands for a cell that holds something and keeps the greatest impact in it. Nodes
lie level by level: four bits each for the children that exist, and the maxima as differences to the parent's, compressed.
An item follows the paths of its terms' rows down the same column range at once; weights times maxima add up to a bound of
what any document of the range can score. The ranges of highest bound are opened first, and those below the item's k-th score so
far are never opened; scores of earlier shards of a task count as well. A range of one column is a document, and its
bound its score.

Terms are maximal runs of digits, ASCII letters (lower-cased) and characters beyond ASCII, told apart by 64-bit hashes. A weight is
floor(1000 ln((2 N + 2) / (2 df + 1))), an impact (10**9 tf) div (1000 tf + 20 m) with m = 50 + (50 n N) div L; N counts documents
with a term, L their terms, n those of one document, df documents holding the term. The index keeps impacts, so weights are
applied when asking.

Documents are indexed where they are read, without a shuffle. Items are asked in pages of bounded size; each page is one
scan of the index, of which tasks return their k best documents an item.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doppel.llm.batches import run_folder, slices, written
from doppel.llm.words import Words

SHARD_CHARS = 8_000_000
PAGE_TERMS = 1_000_000   # terms of items asked at once
OPENED = 256             # ranges of an item opened at once
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ONES = np.array([bin(c).count("1") for c in range(16)], np.int64)
SHARDS = "doc_ids binary, terms binary, dfs binary, rows binary, sizes array<int>, payload binary"


def terms(texts: list[str]) -> Words:
    """The terms of texts, as `hashes` and `counts`."""
    return Words([t.encode("utf-8", "replace").translate(_TERM) for t in texts], lower=False)


def _morton(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Bits of row and column in turn, the row's above."""
    out = np.zeros(len(row), np.uint64)
    for shift, v in ((np.uint64(1), row), (np.uint64(0), col)):
        x = v.astype(np.uint64)
        for s, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = (x | (x << np.uint64(s))) & np.uint64(mask)
        out |= x << shift
    return out


def quadtree(row: np.ndarray, col: np.ndarray, value: np.ndarray, height: int) -> tuple[list[int], bytes]:
    """Nodes a level from the top, and the compressed child bits and maxima."""
    code = _morton(row, col)
    order = np.argsort(code)
    code, value = code[order], value[order]
    bits, maxima = [], [value]
    for _ in range(height):
        up = code >> np.uint64(2)
        at = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]])) if len(up) else np.zeros(0, np.int64)
        own = np.left_shift(1, (code & np.uint64(3)).astype(np.int64)).astype(np.uint8)
        bits.append(np.bitwise_or.reduceat(own, at) if len(at) else own)
        code, value = up[at], np.maximum.reduceat(value, at) if len(at) else value
        maxima.append(value)
    bits, maxima = bits[::-1], maxima[::-1]
    steps = [maxima[0]] + [np.repeat(up, _ONES[b]) - down for up, down, b in zip(maxima, maxima[1:], bits)]
    nibbles = np.concatenate([*bits, np.zeros(1, np.uint8)])
    nibbles = nibbles[:len(nibbles) // 2 * 2]
    planes = np.concatenate(steps).astype("<u4").view(np.uint8).reshape(-1, 4).T  # high bytes, mostly 0, lie together
    raw = (nibbles[::2] | nibbles[1::2] << 4).tobytes() + planes.tobytes()
    return [len(m) for m in maxima], zstandard.ZstdCompressor(level=1).compress(raw)


class Shard:
    """A shard read back. Nodes are numbered over all levels."""

    def __init__(self, doc_ids: bytes, terms: bytes, rows: bytes, sizes: list[int], payload: bytes):
        self.doc_ids, self.terms, self.rows = np.frombuffer(doc_ids, "<i8"), np.frombuffer(terms, "<u8"), np.frombuffer(rows, "<i4")
        self.height = len(sizes) - 1
        inner, every = sum(sizes[:-1]), sum(sizes)
        raw = zstandard.ZstdDecompressor().decompress(payload)
        packed = np.frombuffer(raw, np.uint8, -(-inner // 2))
        self.bits = np.column_stack([packed & 15, packed >> 4]).ravel()[:inner].astype(np.int64)
        steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * every, len(packed)).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
        ones = _ONES[self.bits]
        self.child = sizes[0] + np.cumsum(ones) - ones
        self.most = np.empty(every, np.int64)
        self.most[:sizes[0]] = steps[:sizes[0]]
        start = 0
        for k, n in enumerate(sizes[:-1]):
            below = slice(start + n, start + n + sizes[k + 1])
            self.most[below] = np.repeat(self.most[start:start + n], ones[start:start + n]) - steps[below]
            start += n


def shard(doc_ids: list, words: np.ndarray, counts: np.ndarray, n_docs: int, n_terms: int) -> tuple:
    """A row of SHARDS from the terms of documents, text by text; documents without an id count but are not in the grid."""
    found, row = np.unique(words, return_inverse=True)
    cells, tf = np.unique(row * len(counts) + np.repeat(np.arange(len(counts)), counts), return_counts=True)
    row, col = cells // max(1, len(counts)), cells % max(1, len(counts))
    dfs = np.bincount(row, minlength=len(found))
    rows = np.empty(len(found), np.int64)
    rows[np.argsort(-dfs, kind="stable")] = np.arange(len(found))
    m = 50 + (50 * counts.astype(np.int64) * n_docs) // max(1, n_terms)
    impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[col])
    named = np.array([d is not None and d is not pd.NA for d in doc_ids], bool)
    keep = named[col]
    place = np.cumsum(named) - 1
    height = max(1, len(found) - 1, int(named.sum()) - 1).bit_length()
    sizes, payload = quadtree(rows[row[keep]], place[col[keep]], impact[keep], height)
    ids = np.array([d for d, ok in zip(doc_ids, named) if ok], "<i8")
    return ids.tobytes(), found.astype("<u8").tobytes(), dfs.astype("<i4").tobytes(), rows.astype("<i4").tobytes(), sizes, payload


@dataclass
class Index:
    """An index on shared storage; n_docs and n_terms are N and L."""

    shards: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame, path: str | None = None, shard_chars: int = SHARD_CHARS) -> Index:
    """Index whole texts of all documents, below `path` or a new folder of the run.

    docs: doc_id, text; other columns are ignored. Null and empty texts have no terms and do not count in N. Repeated rows are documents of
    their own; rows without a doc_id count in N, L and df but are not found. An empty table makes an empty index.
    """
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")

    def lengths(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(frames):
            counts = terms(part["text"].tolist()).counts
            yield pd.DataFrame({"n": [int((counts > 0).sum())], "l": [int(counts.sum())]})

    total = docs.select("text").mapInPandas(lengths, "n long, l long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    n_docs, n_terms = int(total[0]), int(total[1])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, chars = [], 0

        def close() -> pd.DataFrame:
            ids = [d for h in held for d in h[0]]
            row = shard(ids, np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), n_docs, n_terms)
            return pd.DataFrame([row], columns=["doc_ids", "terms", "dfs", "rows", "sizes", "payload"])

        for part in slices(frames):
            found = terms(part["text"].tolist())
            with_terms = found.counts > 0
            held.append(([d for d, ok in zip(part["doc_id"].astype("Int64").tolist(), with_terms) if ok], found.hashes, found.counts[with_terms]))
            chars += int(part["text"].str.len().sum())
            if chars >= shard_chars:
                yield close()
                held, chars = [], 0
        if any(len(h[1]) for h in held):
            yield close()

    path = path or run_folder(docs.sparkSession, "treap")
    docs.mapInPandas(work, SHARDS).write.parquet(path)
    return Index(docs.sparkSession.read.schema(SHARDS).parquet(path), n_docs, n_terms)


class _Best:
    """The k best documents of each item so far; equal scores by ascending id."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)  # a score of 0 is no match
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = (np.concatenate(p) for p in ((self.item, item), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = rank < self.k
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]
        full = rank[keep] == self.k - 1
        self.least[self.item[full]] = self.score[full]


class _Paths:
    """Nodes of row paths, range by range, in arrays that grow."""

    def __init__(self):
        self.node, self.term, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def add(self, node: np.ndarray, term: np.ndarray) -> int:
        """The place of the first one added."""
        start, self.n = self.n, self.n + len(node)
        if self.n > len(self.node):
            self.node, self.term = (np.concatenate([a[:start], np.zeros(self.n, np.int64)]) for a in (self.node, self.term))
        self.node[start:self.n], self.term[start:self.n] = node, term
        return start

    def of(self, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes and terms of some ranges, and which of these each belongs to."""
        owner = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(owner)) + np.repeat(start - (np.cumsum(size) - size), size)
        return self.node[at], self.term[at], owner


def descend(grid: Shard, item: np.ndarray, weight: np.ndarray, row: np.ndarray, best: _Best, opened: int = OPENED) -> int:
    """Best-first search of items side by side. Each entry is a term: its item, ascending, its weight, and its row in the shard.

    Documents that belong to the best go to `best`; returns how many ranges were opened. Scores are exact up to 2**53.
    """
    n, paths = 0, _Paths()
    at, size = np.unique(item, return_counts=True)
    start = paths.add(np.zeros(len(item), np.int64), np.arange(len(item))) + np.cumsum(size) - size
    level, col = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    bound = np.add.reduceat(weight * grid.most[0], start) if len(at) else np.zeros(0, np.int64)
    while True:
        alive = bound >= best.least[at]
        pool = [a[alive] for a in (at, level, col, bound, start, size)]
        at, level, col, bound, start, size = pool
        if not len(at):
            return n
        order = np.lexsort((-bound, at))
        rank = np.empty(len(at), np.int64)
        rank[order] = np.arange(len(at)) - np.searchsorted(at[order], at[order])
        go = rank < opened
        n += int(go.sum())
        node, term, owner = paths.of(start[go], size[go])
        bit = row[term] >> (grid.height - 1 - level[go])[owner] & 1
        bits, child = grid.bits[node], grid.child[node]
        new = [[a[~go]] for a in pool]
        for side in (0, 1):
            quarter = 2 * bit + side
            there = np.flatnonzero(bits >> quarter & 1)
            down = child[there] + _ONES[bits[there] & ((1 << quarter[there]) - 1)]
            own, what = owner[there], term[there]
            sums = np.bincount(own, weight[what] * grid.most[down], minlength=int(go.sum())).astype(np.int64)
            keep = sums >= best.least[at[go]]
            leaf = keep & (level[go] == grid.height - 1)
            if leaf.any():
                best.add(at[go][leaf], sums[leaf], grid.doc_ids[2 * col[go][leaf] + side])
            keep &= ~leaf
            stay = keep[own]
            count = np.bincount(own[stay], minlength=len(keep))[keep]
            first = paths.add(down[stay], what[stay])
            for old, more in zip(new, (at[go][keep], level[go][keep] + 1, 2 * col[go][keep] + side, sums[keep], first + np.cumsum(count) - count, count)):
                old.append(more)
        at, level, col, bound, start, size = (np.concatenate(p) for p in new)


def _asked(items: DataFrame) -> DataFrame:
    """item_id, term: distinct terms of each item."""
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(frames):
            found = terms(part["text"].tolist())
            yield pd.DataFrame({"item_id": np.repeat(part["item_id"].to_numpy(), found.counts), "term": found.hashes.view(np.int64)}).drop_duplicates()

    return (items.where("item_id is not null").selectExpr("cast(item_id as long) item_id", "cast(text as string) text")
            .mapInPandas(work, "item_id long, term long").distinct())


def search(index: Index, items: DataFrame, k: int = 50) -> DataFrame:
    """The k highest-scoring documents of each item with a score above 0: item_id, rank (from 1), doc_id, score; ties by ascending doc_id.

    items: item_id, text; other columns are ignored. Rows of one item_id are one item, rows without one are left out; an item
    without terms, or with terms that no document or every document holds, has no rows.
    """
    asked = written(_asked(items), "treap-asked")
    pages = asked.count() // PAGE_TERMS + 1
    found = None
    for page in range(pages):
        pairs = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(pages)) == page).toPandas()  # about PAGE_TERMS
        made = _page(index, pairs, k)
        found = made if found is None else found.unionByName(made)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _page(index: Index, pairs: pd.DataFrame, k: int) -> DataFrame:
    spark = index.shards.sparkSession
    pairs = pairs.sort_values(["item_id", "term"])
    wanted, term = np.unique(pairs["term"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
    ids, counts = np.unique(pairs["item_id"].to_numpy(np.int64), return_counts=True)
    page = spark.sparkContext.broadcast(wanted)

    def frequencies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for there, dfs in frame.itertuples(index=False):
                there = np.frombuffer(there, "<u8")
                _, at, to = np.intersect1d(there, page.value, assume_unique=True, return_indices=True)
                yield pd.DataFrame({"term": to, "df": np.frombuffer(dfs, "<i4")[at]})

    df = np.zeros(len(wanted), np.int64)
    for t, n in index.shards.select("terms", "dfs").mapInPandas(frequencies, "term long, df long").groupBy("term").agg(F.sum("df")).toPandas().itertuples(index=False):
        df[int(t)] = int(n)
    weight = np.floor(1000 * np.log((2 * index.n_docs + 2) / (2 * df + 1))).astype(np.int64)
    shared = spark.sparkContext.broadcast((wanted, term, weight, ids, np.repeat(np.arange(len(ids)), counts)))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, term, weight, ids, item = shared.value
        best = _Best(len(ids), k)
        for frame in frames:
            for row in frame.itertuples(index=False):
                grid = Shard(*row)
                if len(grid.doc_ids):
                    place = np.searchsorted(grid.terms, wanted).clip(max=len(grid.terms) - 1)
                    there = (grid.terms[place] == wanted) & (weight > 0)
                    held = there[term]
                    descend(grid, item[held], weight[term[held]], grid.rows[place[term[held]]].astype(np.int64), best)
        yield pd.DataFrame({"item_id": ids[best.item], "doc_id": best.doc, "score": best.score})

    return index.shards.select("doc_ids", "terms", "rows", "sizes", "payload").mapInPandas(ask, "item_id long, doc_id long, score long")
