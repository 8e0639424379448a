"""Cost-balanced packing of documents into training sequences.

The cost of a sequence is estimated as linear in its tokens plus quadratic in the length of each piece, as
attention stays within a piece. Documents in descending order go to the sequence of lowest cost that still has
room for them; where none has room for the whole, the one of lowest cost takes what fits and the rest goes on.

Each task packs its own documents in groups of GROUP_TOKENS ids, so nothing is shuffled and memory is bounded by a
group. Sequences of a group are exactly full. What a task has left at its end fills sequences of falling powers of two,
which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from doppel.llm.batches import slices
from doppel.llm.tokens import encoder

GROUP_TOKENS = 1 << 21
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def capacities(total: int, size: int) -> np.ndarray:
    """Full sequences, then falling powers of two for the rest."""
    rest = total % size
    return np.array([size] * (total // size) + [1 << b for b in range(size.bit_length(), -1, -1) if rest >> b & 1], np.int64)


def balance(lengths: list[int], room: np.ndarray, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset); the sum of `room` is the sum of `lengths`.

    Ties go to the earlier document and the earlier sequence.
    """
    room = room.copy()
    cost = np.zeros(len(room))
    used = np.zeros(len(room), np.int64)
    out = []
    for doc in np.argsort(-np.asarray(lengths, np.int64), kind="stable").tolist():
        start, left = 0, lengths[doc]
        while left:
            fits = room >= left
            if not fits.any():
                fits = room > 0
            at = int(np.argmin(np.where(fits, cost, np.inf)))
            take = min(left, int(room[at]))
            out.append((doc, start, take, at, int(used[at])))
            room[at] -= take
            used[at] += take
            cost[at] += linear * take + quadratic * take * take
            start += take
            left -= take
    return out


class _Packer:
    def __init__(self, partition: int, size: int, linear: float, quadratic: float):
        self.next = partition << 36
        self.size, self.linear, self.quadratic = size, linear, quadratic
        self.items: list[tuple] = []  # document, ids before, its ids, ids in all
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[pd.DataFrame]:
        for start in range(0, len(ids), GROUP_TOKENS):
            part = ids[start:start + GROUP_TOKENS]
            self.items.append((doc_id, start, part, len(ids)))
            self.held += len(part)
            if self.held >= GROUP_TOKENS:
                yield self.flush(last=False)

    def flush(self, last: bool) -> pd.DataFrame:
        items, self.items = self.items, []
        if not last:  # what is over the full sequences waits for the next group
            over = self.held % self.size
            while over:
                doc, start, ids, total = items.pop()
                keep = max(0, len(ids) - over)
                if keep:
                    items.append((doc, start, ids[:keep], total))
                self.items.insert(0, (doc, start + keep, ids[keep:], total))
                over -= len(ids) - keep
        room = capacities(sum(len(i[2]) for i in items), self.size)
        rows = []
        for k, start, length, at, offset in balance([len(i[2]) for i in items], room, self.linear, self.quadratic):
            doc, before, ids, total = items[k]
            rows.append((doc, before + start, length, ids[start:start + length].astype("<u4").tobytes(), total, self.next + at, offset))
        self.next += len(room)
        self.held = sum(len(i[2]) for i in self.items)
        frame = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 4096, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> DataFrame:
    """Every id of every document in exactly one piece of a sequence of at most `size` ids.

    docs: doc_id, text; other columns are ignored. A document is its text's ids by the tokenizer file, then `end_id`; a null
    text is empty and so has one id. Repeated rows are packed once for each row, null ids stay null, an empty
    table gives no rows. Returns doc_id, start (ids of the document before the piece), length, ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset (in the sequence, without gaps). Sequence ids are unique, not consecutive.
    """
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = _Packer(TaskContext.get().partitionId(), size, linear, quadratic)
        encode = encoder(tokenizer).encode
        end = np.array([end_id], np.uint32)
        for part in slices(frames):
            for doc_id, ids in zip(part["doc_id"].astype("Int64").tolist(), encode(part["text"].tolist())):
                yield from packer.add(doc_id, np.concatenate([ids, end]))
        if packer.items:
            yield packer.flush(last=True)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInPandas(work, SCHEMA)
