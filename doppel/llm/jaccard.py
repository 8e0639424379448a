"""Jaccard join of documents on word n-grams by MinHash banding.

Texts with the same set of n-grams are one node. Nodes whose signatures agree in all rows of a band meet in the shuffle on
band hashes; the number of bands is chosen for the target recall at the threshold. What meets, over any number of steps, is a
candidate group, and within it all pairs are verified on the full n-gram sets: members are dealt to pairs of blocks, and
a block pair is one sparse intersection count. Only counts and a spanning forest of the links leave a task, so neither
copies nor large groups are expanded into pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doppel.checkpoint import settled
from doppel.llm.batches import free, slices
from doppel.llm.groups import Forest, cells, connected, tidy
from doppel.llm.words import Words, mix, ngrams

N = 5
THRESHOLD = 0.8
RECALL = 0.9999
ROWS = 4
COLUMNS = 4096  # n-grams counted at once
BLOCK = 256  # members of a candidate group compared with each other in one call


def bands(threshold: float, recall: float, rows: int = ROWS) -> int:
    """Bands of `rows` rows for a pair at the threshold to meet with the target recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))


def sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, back to back, and their numbers."""
    words = Words(texts)
    grams, counts = ngrams(words.hashes, words.counts, n)
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[new], np.bincount(doc[new], minlength=len(texts))


def set_keys(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, 0 for an empty one."""
    out = np.zeros(len(counts), np.uint64)
    full = counts > 0
    first = (np.cumsum(counts) - counts)[full]
    if len(first):
        out[full] = mix(np.add.reduceat(mix(grams), first) + counts[full].astype(np.uint64))
    return out.view(np.int64)


def signatures(grams: np.ndarray, counts: np.ndarray, hashes: int) -> np.ndarray:
    """MinHash signatures (uint32) of non-empty sets, one row each."""
    first = (np.cumsum(counts) - counts)[counts > 0]
    out = np.zeros((len(first), hashes), np.uint32)
    odd = np.random.Generator(np.random.PCG64(3)).integers(1, 2 ** 63, (hashes, 2), np.uint64)
    if len(first):
        for j in range(hashes):
            out[:, j] = np.minimum.reduceat(((grams * (odd[j, 0] * np.uint64(2) + np.uint64(1)) + odd[j, 1]) >> np.uint64(32)).astype(np.uint32), first)
    return out


def _described(n: int, hashes: int):
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(frames):
            grams, counts = sets(part["text"].tolist(), n)
            keys, full = set_keys(grams, counts), counts > 0
            raw = np.full(len(part), None, object)
            raw[full] = [s.tobytes() for s in signatures(grams, counts, hashes)]
            node = pd.Series(keys).astype("Int64").where(full)
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "did": part["did"], "node": node, "signature": raw})
    return work


def _banded(rows: int, count: int):
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), 2000):
                part = frame.iloc[a:a + 2000]
                sig = np.frombuffer(b"".join(part["signature"]), np.uint32).reshape(len(part), -1).astype(np.uint64)
                key = np.zeros((len(part), count), np.uint64) + np.arange(count, dtype=np.uint64)
                for j in range(rows):
                    key = mix(key * np.uint64(3) + sig[:, j:rows * count:rows])
                yield pd.DataFrame({"band": key.ravel().view(np.int64), "node": np.repeat(part["node"].to_numpy(np.int64), count)})
    return work


def _verified(threshold: float):
    def work(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, group in frame.groupby("root", sort=True):
            group = group.sort_values("node").reset_index(drop=True)
            grams = [np.frombuffer(g, np.uint64) for g in group["grams"]]
            size = np.array([len(g) for g in grams])
            shared = intersections(grams)
            close = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9
            side = group["side"].to_numpy()
            close &= ((side[:, None] != side[None, :]) | (side[:, None] == 2)) & ~np.eye(len(group), dtype=bool)
            forest = Forest(len(group))
            for i, j in zip(*np.nonzero(np.triu(close))):
                forest.join(int(i), int(j))
            node = group["node"].to_numpy(np.int64)
            out.append(pd.DataFrame({"node": node, "up": node[forest.roots()], "links": close.astype(np.int64) @ group["copies"].to_numpy(np.int64)}))
        return pd.concat(out)
    return work


def intersections(grams: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from matrix products over slices of the n-grams that two sets or more hold."""
    flat = np.concatenate(grams)
    row = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    keep = count[at] > 1
    row, at = row[keep], place[at[keep]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros((len(grams), len(grams)))
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        a, b = np.searchsorted(at, [low, low + COLUMNS])
        has = np.zeros((len(grams), COLUMNS), np.float32)
        has[row[a:b], at[a:b] - low] = 1
        out += has @ has.T
    return out


def _candidates(nodes: DataFrame, count: int) -> DataFrame:
    """node, root: the groups of nodes that agree in a band, over any number of steps."""
    banded = nodes.select("node", "signature").mapInPandas(_banded(ROWS, count), "band long, node long")
    met = banded.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("band", "least")
    return settled(connected(banded.join(met, "band").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))))


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per document its group and the number of other documents whose n-gram sets are at least `threshold` similar.

    docs: doc_id, text; other columns are ignored. Words are split at ASCII white space and lower-cased in A-Z; a text of fewer than n
    words, but some, has one n-gram of all its words; a text without words (null, empty) is similar to none and its own group.
    Returns one row per row of docs: doc_id, did (a hash of the row's id and text), root (a hash that names the group), copy_id (least id of documents with the same set),
    class_id (least id of the connected group) and n_links. Null ids are carried along, repeated rows are copies of each
    other, an empty table gives no rows.
    """
    spark = docs.sparkSession
    count = bands(threshold, recall)
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text").withColumn("did", F.xxhash64("doc_id", "text"))
    described = settled(rows.mapInPandas(_described(n, count * ROWS), "doc_id long, did long, node long, signature binary"))
    nodes = settled(described.where("node is not null").groupBy("node").agg(
        F.min(F.struct("doc_id", "did")).alias("first"), F.min("doc_id").alias("copy_id"), F.count("*").alias("copies"), F.first("signature").alias("signature")))
    candidates = _candidates(nodes, count)
    tidy(spark)

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(frames):
            grams, counts = sets(part["text"].tolist(), n)
            yield pd.DataFrame({"node": part["node"], "root": part["root"], "copies": part["copies"],
                                "grams": [g.tobytes() for g in np.split(grams, np.cumsum(counts)[:-1])]})

    wanted = candidates.join(nodes.select("node", "first.did", "copies"), "node").select(F.col("did"), "node", "root", "copies")
    members = settled(rows.select("did", "text").join(wanted, "did").dropDuplicates(["node"])
                      .mapInPandas(gather, "node long, root long, copies long, grams binary"))
    tidy(spark)
    verified = settled(cells(members, "root", "node", BLOCK).groupBy("cell").applyInPandas(_verified(threshold), "node long, up long, links long"))
    groups = connected(verified.where("node <> up").select(F.col("node").alias("a"), F.col("up").alias("b")))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = (nodes.select("node", "copy_id", "copies").join(groups, "node", "left").join(links, "node", "left")
             .withColumn("root", F.coalesce("root", "node")))
    least = known.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    known = known.join(least, "root").select("node", "root", "copy_id", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return (described.select("doc_id", "did", "node").join(known, "node", "left")
            .select("doc_id", "did", "root", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
                    F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents without near copies: of each connected group the row with the least id, then least hash of the text, stays.

    All columns stay. Of rows that repeat an id and text one stays.
    """
    found = join(docs, **options)
    best = found.groupBy("root", F.when(F.col("root").isNull(), F.col("did")).alias("own")).agg(F.min(F.struct("doc_id", "did")).alias("first"))
    did = free(docs, "did")
    marked = docs.withColumn(did, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return marked.join(best.select(F.col("first.did").alias(did)), did, "left_semi").dropDuplicates([did]).drop(did)
