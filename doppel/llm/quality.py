"""Quality classifier: a linear support vector machine on n-gram indicators scaled by naive Bayes log-count ratios.

Indicators are hashed words, n-grams of word shapes (case, digits, marks) and
of the pattern of words that repeat one of the three before.
Each class counts its labelled documents with an indicator (at most labelled.LABELLED in all); the indicator's value
is the logarithm of the ratio of the two smoothed shares. Documents are scaled to unit length. A hinge-loss model is fitted
by dual coordinate descent on at most SAMPLE of them for each class, those with the lowest hash of their id, and a logistic
curve over margins of rows it was not fitted on turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doppel.llm.batches import slices
from doppel.llm.labelled import labelled
from doppel.llm.words import Words, mix

SIZE = 1 << 18  # hashed indicators
SAMPLE = 6000  # labelled rows of each class the margin is fitted on
SMOOTH = 1.0
PENALTY = 1.0
EPOCHS = 12

_SHAPE = bytearray(range(256))
for _c in range(256):
    _SHAPE[_c] = 97 if 97 <= _c <= 122 or _c >= 128 else 65 if 65 <= _c <= 90 else 48 if 48 <= _c <= 57 else _c
_SHAPE = bytes(_SHAPE)


def _shapes(raw: bytes, words: Words) -> np.ndarray:
    """A hash of each word's shape: its kinds of characters with runs of one kind counted as one."""
    kinds = np.frombuffer(raw.translate(_SHAPE), np.uint8)
    new = np.diff(kinds, prepend=0) != 0
    new[words.starts] = True
    at = np.flatnonzero(new)
    first = np.searchsorted(at, words.starts)
    last = np.searchsorted(at, words.ends)
    out = np.zeros(len(first), np.uint64)
    for j in range(4):
        more = first + j < last
        out[more] = mix(out[more] + kinds[at[first[more] + j]].astype(np.uint64) + np.uint64(j + 1))
    return mix(out + np.minimum(last - first, 5).astype(np.uint64))


def indicators(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and indicator of each distinct pair, sorted."""
    exact = Words(texts, lower=False)
    words, doc = exact.hashes, exact.docs
    shape = _shapes(exact.raw, exact)
    same_doc = np.concatenate([[False], doc[1:] == doc[:-1]])
    again = np.zeros(len(words), np.uint64)  # which of the three words before are the same
    for j in (1, 2, 3):
        again[j:] += ((words[j:] == words[:-j]) & (doc[j:] == doc[:-j])).astype(np.uint64) << np.uint64(j)
    before = np.where(same_doc, np.concatenate([[0], shape[:-1]]).astype(np.uint64), np.uint64(0))
    kinds = [mix(words + np.uint64(11)), mix(shape + np.uint64(23)), mix(shape * np.uint64(3) + before + np.uint64(37)),
             mix(again + (np.concatenate([[0], again[:-1]]).astype(np.uint64) << np.uint64(8)) + np.uint64(53))]
    key = np.concatenate([doc * SIZE + (k % np.uint64(SIZE)).astype(np.int64) for k in kinds])
    key = np.unique(key)
    return key // SIZE, key % SIZE


def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros((2, SIZE + 1), np.int64)  # the last place counts documents
    for part in slices(frames):
        doc, at = indicators(part["text"].tolist())
        label = part["label"].to_numpy()
        for c in (0, 1):
            total[c] += np.bincount(at[label[doc] == c], minlength=SIZE + 1)
            total[c, SIZE] += int((label == c).sum())
    at = np.flatnonzero(total.any(0))
    yield pd.DataFrame({"at": at, "n0": total[0, at], "n1": total[1, at]})


def _vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in slices(frames):
        doc, at = indicators(part["text"].tolist())
        cuts = np.searchsorted(doc, np.arange(1, len(part)))
        yield pd.DataFrame({"label": part["label"], "tie": part["tie"], "at": [x.astype("<i4").tobytes() for x in np.split(at, cuts)]})


def _descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Weights of the indicators by dual coordinate descent for the L1 hinge loss."""
    weight = np.zeros(SIZE)
    x = [ratio[r] / max(1e-12, np.sqrt((ratio[r] ** 2).sum())) for r in rows]
    alpha = np.zeros(len(rows))
    order = np.random.Generator(np.random.PCG64(1))
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            gradient = y[i] * (weight[rows[i]] @ x[i]) - 1
            new = min(max(alpha[i] - gradient, 0.0), PENALTY)  # rows have length 1
            if new != alpha[i]:
                weight[rows[i]] += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return weight


def _margins(weight: np.ndarray, ratio: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    return np.array([weight[r] @ ratio[r] / max(1e-12, np.sqrt((ratio[r] ** 2).sum())) for r in rows])


def _logistic(margin: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    z = np.stack([margin, np.ones(len(margin))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ [a, b], -30, 30)))
        g = z.T @ (weights * (p - y)) + 1e-3 * np.array([a - 1, b])
        h = (z * (weights * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


class Model:
    """Weights by indicator (scaled by the ratio), the ratio itself, and the curve of the score."""

    def __init__(self, weight: np.ndarray, ratio: np.ndarray, slope: float, offset: float):
        self.weight, self.square, self.slope, self.offset = (weight * ratio).astype(np.float32), (ratio ** 2).astype(np.float32), slope, offset

    def scores(self, texts: list[str]) -> np.ndarray:
        doc, at = indicators(texts)
        dot = np.bincount(doc, self.weight[at], len(texts))
        norm = np.sqrt(np.bincount(doc, self.square[at], len(texts)))
        return 1 / (1 + np.exp(-np.clip(self.slope * dot / np.maximum(norm, 1e-12) + self.offset, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """The model of `label` from the documents that have one.

    Without rows of both classes every score is the share of class 1, or 0.5 without any rows.
    """
    rows = labelled(docs, labels, label)
    sums = rows.select("text", "label").mapInPandas(_counts, "at int, n0 long, n1 long").groupBy("at").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    count = np.zeros((2, SIZE + 1))  # at most SIZE + 1 sums
    count[:, sums["at"]] = sums[["n0", "n1"]].to_numpy().T
    total = count[:, SIZE]
    if not total.all():
        share = (total[1] + 0.5) / (total.sum() + 1)
        return Model(np.zeros(SIZE), np.zeros(SIZE), 1.0, float(np.log(share / (1 - share))))
    share = (count[:, :SIZE] + SMOOTH) / (total[:, None] + 2 * SMOOTH)
    ratio = np.log(share[1] / share[0])
    low = {r["label"]: r["tie"] for r in rows.select("label", "tie").withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("tie")))
           .where(F.col("place") <= SAMPLE).groupBy("label").agg(F.max("tie").alias("tie")).collect()}
    picked = (rows.where(((F.col("label") == 0) & (F.col("tie") <= low[0])) | ((F.col("label") == 1) & (F.col("tie") <= low[1])))
              .select("text", "label", "tie").mapInPandas(_vectors, "label int, tie long, at binary"))

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames)).sort_values(["tie", "label"])  # at most 2 * SAMPLE rows
        at = [np.frombuffer(a, "<i4") for a in frame["at"]]
        y = frame["label"].to_numpy() * 2.0 - 1
        half = np.arange(len(at)) % 2 == 0
        margin = np.zeros(len(at))
        for side in (half, ~half):
            if len(set(y[side])) == 2:
                own = _descend([a for a, s in zip(at, side) if s], y[side], ratio)
                margin[~side] = _margins(own, ratio, [a for a, s in zip(at, side) if not s])
        shares = total[(y > 0).astype(int)] / np.maximum(1, np.array([(y < 0).sum(), (y > 0).sum()]))[(y > 0).astype(int)]
        slope, offset = _logistic(margin, (y > 0).astype(float), shares / shares.mean())
        weight = _descend(at, y, ratio)
        yield pd.DataFrame({"weight": [weight.astype("<f8").tobytes()], "slope": [slope], "offset": [offset]})

    made = picked.repartition(1).mapInPandas(train, "weight binary, slope double, offset double").first()
    return Model(np.frombuffer(made["weight"], "<f8"), ratio, made["slope"], made["offset"])


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """The documents with a score from 0 to 1; a null text counts as empty. All columns stay; `column` replaces one of its name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != column]
    @F.pandas_udf("double")
    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(np.concatenate([np.zeros(0)] + [shared.value.scores(p["text"].tolist()) for p in slices([texts.rename("text").to_frame()])]))

    return docs.select(*[F.col(f"`{c}`") for c in kept], scores(F.col("text").cast("string")).alias(column))
