"""Language-model scores by a weighted backoff automaton.

The states of the automaton are the n-grams, up to order - 1 words, that training texts hold; an arc reads a word that followed the state
there, with the logarithm of its smoothed probability, and leads to the longest suffix that is a state. A word without an
arc takes the failure arc, whose weight is the share left to shorter contexts, to the state's suffix and is read there; the
empty state reads every word. With c the training counts and K = SMOOTH,

    p(w | s) = m * c(s w) / c(s) + (1 - m) * p(w | suffix of s),   m = c(s) / (c(s) + K),   p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)).

The state before a token is the last order - 1 words, the first of a text follows an end. States and arcs are not built as tables: all positions
of a batch are evaluated at once as interpolated look-ups of the counts of their n-grams, which gives the same probabilities.

No part of the model is broadcast. Documents are dealt to blocks of bounded size. A block asks for the training counts of
the distinct n-grams its texts hold, once each; counters, each responsible for a range of hashes, add up what all blocks
counted and answer in the order asked; with the answers a block builds its part of the automaton, all its texts can
reach. N-grams are told apart by 56-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doppel.llm.batches import slices
from doppel.llm.groups import tidy
from doppel.llm.words import Words, mix

ORDER = 2
SMOOTH = 200.0
BLOCK_CHARS = 16_000_000
END = np.uint64(0x5851F42D4C957F2D)
BYTES = 7  # of a key
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, each text followed by an end; tokens of each text."""
    parts, sizes = [], []
    for part in slices([frame]):
        words = Words(part["text"].tolist())
        parts.append(np.insert(words.hashes, np.cumsum(words.counts), END))
        sizes.append(words.counts + 1)
    return np.concatenate(parts or [np.zeros(0, np.uint64)]), np.concatenate(sizes or [np.zeros(0, np.int64)])


def states(hashes: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """For n from 1 to order the key of the n tokens that end at each token; before a text stands an end, and nothing before that.

    Where there are fewer than n, the key is that of all there are.
    """
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, run = [], np.zeros(len(hashes), np.uint64)
    for n in range(1, order + 1):
        back = np.concatenate([np.full(min(n - 1, len(hashes)), END), hashes[:max(0, len(hashes) - n + 1)]])
        back = np.where(place == n - 2, END, back)
        run = np.where(place >= n - 2, mix(run * np.uint64(5) + back + np.uint64(n)), run)
        out.append(run >> np.uint64(64 - 8 * BYTES))
    return out


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(8 * BYTES - 32)) * np.uint64(buckets)) >> np.uint64(32)


def _short(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys, "<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()


def _long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // BYTES, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, BYTES)
    return out.view("<u8").ravel()


def _counted(frame: pd.DataFrame, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of the texts and how often training texts hold them. An end before a text is no token."""
    hashes, sizes = tokens(frame)
    train = np.repeat(~frame["held_out"].to_numpy(bool), sizes)
    keys = np.concatenate(states(hashes, sizes, order))
    found, at = np.unique(keys, return_inverse=True)
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = np.concatenate([train & (place >= n - 2) for n in range(1, order + 1)])  # shorter ones are counted as what they are
    return found, np.bincount(at, whole, len(found)).astype(np.int64)


def _asked(block: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pd.DataFrame:
    """One row for each counter: keys in ascending order and their counts."""
    bucket = _bucket(keys, buckets)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    return pd.DataFrame({
        "bucket": bucket[np.concatenate([[0], cuts]).astype(int)].astype(np.int64) if len(keys) else np.zeros(0, np.int64), "block": block,
        "keys": [_short(k) for k in np.split(keys, cuts)] if len(keys) else [],
        "counts": [c.astype("<i4").tobytes() for c in np.split(counts, cuts)] if len(keys) else []})


def _answers(frame: pd.DataFrame) -> pd.DataFrame:
    """Totals over all blocks, for each block in the order it asked."""
    frame = frame.sort_values("block")
    keys = [_long(k) for k in frame["keys"]]
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate([np.frombuffer(c, "<i4") for c in frame["counts"]]), len(found)).astype(np.int64)
    return pd.DataFrame({
        "block": frame["block"].to_numpy(), "bucket": frame["bucket"].to_numpy(),
        "totals": [t.astype("<i8" if total.max(initial=0) >= 2 ** 31 else "<i4").tobytes() for t in np.split(total[at], np.cumsum([len(k) for k in keys])[:-1])],
        "wide": bool(total.max(initial=0) >= 2 ** 31)})


class Automaton:
    """The part of the automaton that the texts of a block can reach, as sorted keys and their training counts."""

    def __init__(self, keys: np.ndarray, totals: np.ndarray, order: int, smooth: float, n: int, v: int):
        self.keys, self.totals, self.order, self.smooth, self.n, self.v = keys, totals, order, smooth, n, v

    def read(self, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token its count, its base log10 probability and the log10 weight of reading it in the state before it."""
        counts = [self.totals[np.searchsorted(self.keys, k)] for k in states(hashes, sizes, self.order)]
        base = (counts[0] + 0.5) / (self.n + 0.5 * (self.v + 1))
        first = np.cumsum(sizes) - sizes
        place = np.arange(len(hashes)) - np.repeat(first, sizes)
        p = base
        for n in range(2, self.order + 1):
            # The context is what ended one token earlier; at the start of a text it is the end.
            context = np.concatenate([[0], counts[n - 2][:-1]]).astype(float)
            context[first] = self.ends
            share = context / (context + self.smooth)
            p = np.where((context > 0) & (place >= n - 2), share * counts[n - 1] / np.maximum(context, 1) + (1 - share) * p, p)
        return counts[0], np.log10(base), np.log10(p)

    @property
    def ends(self) -> int:
        key = states(np.array([END], np.uint64), np.array([1]), 1)[0][0]
        at = int(np.searchsorted(self.keys, key))
        return int(self.totals[at]) if at < len(self.keys) and self.keys[at] == key else 0


def score(docs: DataFrame, order: int = ORDER, smooth: float = SMOOTH) -> DataFrame:
    """Log10 probabilities of whole texts under the model of those that are not held out.

    docs: doc_id, text, held_out; other columns are ignored. A null text is empty and is one end. Repeated rows count and are scored
    each; a null held_out is false. Without training texts every count is 0. An empty table gives no rows.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams), score.
    """
    if order < 2:
        raise ValueError("order must be at least 2")
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text", "coalesce(held_out, false) held_out")
    chars = docs.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0]
    blocks = chars // BLOCK_CHARS + 1

    def types(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(frames, most=BLOCK_CHARS):
            keys, counts = _counted(part[~part["held_out"].astype(bool)].reset_index(drop=True), 1)
            yield _asked(0, keys, counts, blocks)

    def sums(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [sum(int(np.frombuffer(c, "<i4").sum()) for c in frame["counts"])],
                             "v": [len(np.unique(np.concatenate([_long(k) for k in frame["keys"]])))]})

    asked = "bucket long, block long, keys binary, counts binary"
    seen = (docs.select("text", "held_out").mapInPandas(types, asked).groupBy("bucket").applyInPandas(sums, "n long, v long")
            .agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first())
    n, v = int(seen[0]), int(seen[1])
    tidy(docs.sparkSession)
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long"))

    def ask(frame: pd.DataFrame) -> pd.DataFrame:
        return _asked(int(frame["block"].iloc[0]), *_counted(frame, order), blocks * order)

    def trace(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        hashes, sizes = tokens(frame)
        answers = answers.sort_values("bucket")
        keys = np.unique(np.concatenate(states(hashes, sizes, order)))
        totals = np.concatenate([np.zeros(0, np.int64)] + [np.frombuffer(t, "<i8" if w else "<i4").astype(np.int64) for t, w in zip(answers["totals"], answers["wide"])])
        counts, base, weight = Automaton(keys, totals, order, smooth, n, v).read(hashes, sizes)
        text = np.repeat(np.arange(len(sizes)), sizes)
        return pd.DataFrame({
            "doc_id": frame["doc_id"].astype("Int64"), "held_out": frame["held_out"], "n_tokens": sizes,
            "n_known": np.bincount(text, counts > 0, len(sizes)).astype(np.int64), "train_tokens": n,
            "base_score": np.bincount(text, base, len(sizes)), "score": np.bincount(text, weight, len(sizes))})

    replies = (dealt.groupBy("block").applyInPandas(ask, asked).groupBy("bucket")
               .applyInPandas(_answers, "block long, bucket long, totals binary, wide boolean"))
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(trace, SCORES)
