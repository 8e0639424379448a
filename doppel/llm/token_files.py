"""Token ids in files of fixed-width bit packing.

A file set is a Parquet folder of blocks. A block holds whole documents, about BLOCK_IDS ids of them (a longer document has
a block of its own), as one binary value: id k lies in bits k * bits to (k + 1) * bits - 1, lowest bit first, with
`bits` the fewest that hold every id of the vocabulary. Beside it stand the ids before the block in its shard and
the documents with their offsets, so any document or span is reached by reading one block and unpacking a slice with numpy.
Shards follow doc_id in ascending order, as do blocks in a shard. Spark's writer commits the files, so lost or
repeated tasks leave no partial blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doppel.llm.batches import slices, width
from doppel.llm.tokens import encoder

BLOCK_IDS = 1 << 18
SCHEMA = "shard long, block long, first long, n_ids long, bits int, payload binary, doc_ids array<long>, doc_starts array<long>"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids in `bits` bits each, lowest bit first."""
    raw = np.ascontiguousarray(ids, "<u4")
    if bits % 8 == 0:
        return raw.view(np.uint8).reshape(-1, 4)[:, :bits // 8].tobytes()
    return np.packbits(np.unpackbits(raw.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes()


def unpack_bits(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop - 1 of a payload; reads only their bytes."""
    low, high = start * bits // 8, -(-stop * bits // 8)
    raw = np.frombuffer(payload, np.uint8, high - low, low)
    if bits % 8 == 0:
        out = np.zeros((stop - start, 4), np.uint8)
        out[:, :bits // 8] = raw.reshape(-1, bits // 8)
    else:
        flat = np.unpackbits(raw, bitorder="little")[start * bits - low * 8:][:(stop - start) * bits]
        out = np.packbits(np.pad(flat.reshape(-1, bits), ((0, 0), (0, 32 - bits))), axis=1, bitorder="little")
    return np.ascontiguousarray(out).view("<u4").ravel()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Write the ids of every document, each followed by `end_id`, in ascending order of doc_id.

    docs: doc_id, text; other columns are ignored. A null text is empty; rows of one doc_id follow in the order of a hash of the
    text, repeated rows are written again, null ids come first. An empty table gives a folder without blocks.
    """
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        bits = bits_for(max(enc.vocabulary, end_id + 1))
        end = np.array([end_id], np.uint32)
        state = {"block": 0, "first": 0, "ids": [], "docs": [], "starts": [], "n": 0}

        def close() -> pd.DataFrame:
            row = (shard, state["block"], state["first"], state["n"], bits, pack_bits(np.concatenate(state["ids"]), bits), state["docs"], state["starts"])
            state.update(block=state["block"] + 1, first=state["first"] + state["n"], ids=[], docs=[], starts=[], n=0)
            return pd.DataFrame([row], columns=["shard", "block", "first", "n_ids", "bits", "payload", "doc_ids", "doc_starts"])

        for part in slices(frames):
            for doc_id, ids in zip(part["doc_id"].astype("Int64").tolist(), enc.encode(part["text"].tolist())):
                if state["n"] and state["n"] + len(ids) + 1 > BLOCK_IDS:
                    yield close()
                state["docs"].append(None if doc_id is pd.NA else doc_id)
                state["starts"].append(state["n"])
                state["ids"] += [ids, end]
                state["n"] += len(ids) + 1
        if state["n"]:
            yield close()

    (docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
         .withColumn("tie", F.xxhash64("text"))
         .repartitionByRange(width(docs.sparkSession), "doc_id", "tie")
         .sortWithinPartitions("doc_id", "tie")
         .select("doc_id", "text")
         .mapInPandas(work, SCHEMA)
         .write.mode("overwrite").parquet(path))


def shard_starts(blocks: DataFrame) -> DataFrame:
    """Ids before each shard; one row for each shard, of which there are as many as write tasks."""
    ids = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    return ids.select("shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a file set: doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit)."""
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, first, n, bits, payload, doc_ids, starts in frame.itertuples(index=False):
                ends = [*list(starts)[1:], n]
                ids = unpack_bits(payload, bits, 0, n)
                yield pd.DataFrame({
                    "shard": shard, "local": [first + s for s in starts], "doc_id": pd.array([None if d is None or d != d else int(d) for d in doc_ids], "Int64"),
                    "n_tokens": [e - s for s, e in zip(starts, ends)], "ids": [ids[s:e].tobytes() for s, e in zip(starts, ends)]})

    blocks = spark.read.parquet(path)
    found = (blocks.select("shard", "first", "n_ids", "bits", "payload", "doc_ids", "doc_starts")
             .mapInPandas(work, "shard long, local long, doc_id long, n_tokens long, ids binary"))
    return (found.join(F.broadcast(shard_starts(blocks)), "shard")
            .select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids"))


def read_span(spark: SparkSession, path: str, start: int, stop: int) -> np.ndarray:
    """Ids start to stop - 1 of the whole file set; only blocks that hold some of them are read."""
    blocks = spark.read.parquet(path)
    at = F.col("before") + F.col("first")
    rows = (blocks.join(F.broadcast(shard_starts(blocks)), "shard").where((at < stop) & (at + F.col("n_ids") > start))
            .select(at.alias("at"), "n_ids", "bits", "payload").orderBy("at").collect())
    return np.concatenate([np.zeros(0, np.uint32)] + [
        unpack_bits(bytes(r["payload"]), r["bits"], max(0, start - r["at"]), min(r["n_ids"], stop - r["at"])) for r in rows])


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
