"""Fuzzy line deduplication by SimHash.

A line is normalised (lower case, digits as 0, no punctuation, single spaces). Lines with the same words are one node. Each node has a
SimHash of its distinct runs of GRAM bytes, of WORDS * 64 bits, and MINIMUM bits each of as many minima of them as fit in as much room.
Nodes that agree in one of many blocks meet, if their lengths allow the similarity; those within the SimHash's radius are candidates of
each other. `differing` says which share of SimHash bits is expected to differ at a similarity where whole words change; the radius lies
DEVIATIONS above. In small tables a block is a random choice of bits of the SimHash; their number follows from RECALL for such a pair, their bits
grow with the logarithm of the number of nodes, so that about MATES of them share a value by chance. Where that takes more than BLOCK_BITS
bits, a block is a choice of minima: unrelated lines agree in few of them, so fewer blocks find more pairs and compare less.
Scattered single letters change more bits and minima than whole words do; the README has the recall of
both. Candidate groups are verified on the normalised texts by edit similarity, where a pair that is already connected through
others is not compared again, and of each connected group the first occurrence stays.

SimHashes travel packed by block and range of its values, and each range is compared in one call with numpy. Values of a block that
many nodes share are not compared in one task: their nodes hang to one of them and meet in the verification, which compares all members of
a group with one of them and deals only groups with others to cells. Blocks are worked off in rounds, so that the disk does not hold all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doppel.checkpoint import settled
from doppel.llm.batches import erased, free, slices, width, written
from doppel.llm.groups import cells, connected, tidy
from doppel.llm.words import Spans

SIMILARITY = 0.8
WORDS = 4
GRAM = 5  # shorter runs are shared by too many unrelated long lines
RECALL = 0.9  # share of pairs at SIMILARITY that are to meet in a block
DEVIATIONS = 3.25
MATES = 2048
BLOCK_BITS = 5  # tables that would need wider blocks of the SimHash meet in blocks of minima
MINIMUM = 5  # bits of a minimum: with few bits there are so many minima that blocks share hardly any
MINIMA_RECALL = 0.985  # of minima that are equal independently
MINIMA_MATES = 256
MINIMA_CHANCE = 0.03  # share of the minima that unrelated lines have in common; so many more agree in their bits by chance
ROUND = 4  # blocks in a round, of large tables
ROUND_ROWS = 6_000_000  # rows in a round, of small tables
HOT = 16384  # about from this number on, nodes of one value are not compared in one task
HOT_VALUES = 1 << 20  # values of a round that may be told to all tasks; in rounds of so many rows the number HOT rises
SAMPLE = 64  # one of so many nodes is counted to find such values
BATCH = 1 << 17  # nodes of a task packed at once
RUN = 1 << 17  # nodes of a block compared in one call, about
TASK_ROWS = 1 << 20  # nodes compared in one task, about
FIRST = 4.0  # deviations of the first 64 bits
SECOND = 4.5  # of the first 128
DIMS = 512  # sums of a line's runs, from which its SimHash is taken
SUMS = 128  # lines whose sums are made together
LOWEST = 64  # distinct runs of a line that its minima are taken of, at most
LINE_CHARS = 100_000  # characters described at once: what fits in a processor's cache
TILE = 64  # SimHashes compared at once with those in their reach
PAIRS = 1 << 18  # pairs of SimHashes compared at once
SIDE = 256  # lines whose edit distances to one line are found together
BLOCK = 2048  # members of a candidate group compared with each other in one call
DEALT = 4  # copies of the members that cells of one round may hold, on average
DEALT_CHARS = 1 << 26  # characters of members that one round may hold in any case

_STEPS = [(1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (2, 0), (0, 2), (3, 3), (3, 0), (0, 3)]  # words left out on both sides
# ASCII punctuation goes, other white space within a line becomes a space, digits become 0.
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_ODD = 0x9E3779B97F4A7C15  # spreads the bits of a number it multiplies to the upper ones
_ORDERS = np.random.Generator(np.random.PCG64(13)).integers(0, 2 ** 31, 64 * WORDS // MINIMUM, np.uint32) * np.uint32(2) + np.uint32(1)
_TABLE = bytes(0x20 if c in (9, 11, 12, 13) else 0x30 if 0x30 <= c <= 0x39 else c for c in range(256))


def _normal(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_TABLE, _PUNCTUATION)


def normal_lines(text: str) -> list[bytes]:
    """The lines of a text, normalised but for runs of spaces."""
    return _normal(text).split(b"\n")


def described(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines with words: the text's number, the line's number, a hash of its words in order, its characters, its SimHash and minima."""
    parts = [_normal(t) for t in texts]
    size = np.fromiter((x.count(b"\n") + 1 for x in parts), np.int64, len(parts))
    text = np.repeat(np.arange(len(size)), size)
    number = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
    data = _single(np.frombuffer(b"\n".join(parts) + b"\n", np.uint8))
    size = np.diff(np.flatnonzero(data == 10), prepend=-1)
    full = np.flatnonzero(size > 1)
    if not len(full):
        none = np.zeros(0, np.uint64)
        return text[full], number[full], none, none.astype(np.int64), none.reshape(0, 2 * WORDS)
    if len(full) < len(size):
        data = data[np.repeat(size > 1, size)]
        size = size[full]
    ends = np.cumsum(size) - 1
    starts = ends - size + 1
    data[ends] = 32
    spans = Spans(data)
    key = spans(starts, ends)
    later = np.flatnonzero(data & 0xC0 == 0x80)  # bytes that continue a character
    length = size - 1 - np.diff(np.searchsorted(later, np.append(starts, len(data))))
    return text[full], number[full], key, length, sketches(*grams(spans, size))


def _single(data: np.ndarray) -> np.ndarray:
    """The bytes of lines, each ended by a new line, with single spaces between words and none around them."""
    space = data == 32
    keep = ~space
    keep[:-1] |= ~(space | (data == 10))[1:]
    data = data[keep]
    lead = data == 32
    lead[1:] &= data[:-1] == 10
    return data[~lead] if lead.any() else data


def grams(spans: Spans, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of 32 bits of the distinct runs of GRAM bytes of each line, back to back and ascending, and their numbers.

    spans: lines with a space after each; size: their bytes with it. The first bytes of a line are runs of fewer.
    Each distinct run votes once, or the few that fill every text would make all long lines alike.
    """
    starts = np.cumsum(size) - size
    run = np.empty(len(spans.sums) - 1, np.uint64)
    run[GRAM - 1:] = spans.plain(GRAM)
    for k in range(1, GRAM):
        at = starts[size >= k]
        run[at + k - 1] = spans.plain(k, at)
    run >>= np.uint64(32)
    run |= np.repeat(np.arange(len(size), dtype=np.uint64) << np.uint64(32), size)
    run.sort()
    run = run[np.concatenate([[True], run[1:] != run[:-1]])]
    return run & np.uint64(0xFFFFFFFF), np.diff(np.searchsorted(run, np.arange(len(size) + 1, dtype=np.uint64) << np.uint64(32)))


def sketches(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """WORDS times 64 bits of SimHash and as many of minima for each ascending run of hashes. No run is empty."""
    hashes = hashes * np.uint64(_ODD)
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(_ODD)
    return np.hstack([simhash(hashes, counts), minima(hashes, counts)])


def _hadamard(n: int) -> np.ndarray:
    i = np.arange(n)
    return 1 - 2 * (np.bitwise_count(i[:, None] & i) & 1).astype(np.float32)


def simhash(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """WORDS times 64 bits for each run of hashes: on which side of as many planes the sum of its hashes' vectors lies.

    A hash adds 1 or -1 to one of DIMS sums. Planes are rows of a Hadamard matrix of DIMS, a product of two small ones.
    """
    outer, inner = _hadamard(DIMS // 32)[:, :2 * WORDS], _hadamard(32)
    out = np.zeros((len(counts), WORDS), np.uint64)
    last = np.cumsum(counts)
    for low in range(0, len(counts), SUMS):
        own = counts[low:low + SUMS]
        at = hashes[last[low] - own[0]:last[low + len(own) - 1]] >> np.uint64(63 - DIMS.bit_length() + 1)
        at = at.astype(np.int64) + np.repeat(np.arange(len(own)) * 2 * DIMS, own)
        sums = np.bincount(at, minlength=2 * DIMS * len(own)).astype(np.float32).reshape(-1, 2)
        sums = ((sums[:, 0] - sums[:, 1]).reshape(-1, 32) @ inner).reshape(len(own), -1, 32).transpose(0, 2, 1).reshape(-1, DIMS // 32) @ outer
        out[low:low + SUMS] = np.packbits(sums.reshape(len(own), 64 * WORDS) >= 0, axis=1, bitorder="little").view("<u8")
    return out


def minima(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """MINIMUM bits each of the least of the run's hashes, under as many orders as fit in WORDS * 64 bits; of long runs the first LOWEST hashes count.

    Runs ascend by another hash, so the first ones of two lines are the same as far as the lines are.
    """
    some = np.minimum(counts, LOWEST)
    first = np.cumsum(some) - some
    own = hashes[np.repeat(np.cumsum(counts) - counts - first, some) + np.arange(some.sum())] >> np.uint64(32)
    own = own.astype(np.uint32)
    out = np.zeros((len(counts), len(_ORDERS), 1), np.uint8)
    for k, factor in enumerate(_ORDERS):
        out[:, k, 0] = np.minimum.reduceat(own * factor, first) * np.uint32(_ODD & 0xFFFFFFFF) >> np.uint32(32 - MINIMUM)
    bits = np.zeros((len(counts), 64 * WORDS), np.uint8)
    bits[:, :MINIMUM * len(_ORDERS)] = np.unpackbits(out, axis=2, count=MINIMUM, bitorder="little").reshape(len(counts), -1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def differing(similarity: float) -> float:
    """Share of SimHash bits expected to differ between lines of this edit similarity where whole words change."""
    return math.acos(max(0.0, 1 - 1.25 * (1 - similarity))) / math.pi


def radius_of(similarity: float, bits: int = 64 * WORDS, deviations: float = DEVIATIONS) -> int:
    """The bits expected to differ at this similarity, and some deviations."""
    p = differing(similarity)
    return round(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def blocks_of(nodes: int, similarity: float, recall: float = RECALL) -> np.ndarray:
    """Bits of each block, one block a row: as many blocks as a pair of this similarity needs to meet with the target recall."""
    bits = min(30, max(4, math.ceil(math.log2(max(nodes, 1) / MATES))))
    agree = (1 - differing(similarity)) ** bits
    number = 1 if agree >= recall else math.ceil(math.log(1 - recall) / math.log(1 - agree))
    rng = np.random.Generator(np.random.PCG64(11))
    return np.array([rng.permutation(64 * WORDS)[:bits] for _ in range(number)])


def similar(a: str, b: str, least: float) -> bool:
    """Whether 1 - edit distance / longer length is at least `least`."""
    longest = max(len(a), len(b))
    most = int((1 - least) * longest + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    while a and b and a[-1] == b[-1]:
        k = 1
        while k < min(len(a), len(b)) and a[-2 * k:] == b[-2 * k:]:
            k *= 2
        a, b = a[:-k], b[:-k]
    while a and b and a[0] == b[0]:
        k = 1
        while k < min(len(a), len(b)) and a[:2 * k] == b[:2 * k]:
            k *= 2
        a, b = a[k:], b[k:]
    return max(len(a), len(b)) <= most or reached(a, b, most) or distance(a, b, most) <= most


def reached(a: str, b: str, most: int) -> bool:
    """Whether an exchange of words, found from left to right, makes one text of the other in at most `most` edits. Where not, fewer may still do."""
    x, y = a.split(" "), b.split(" ")
    i = j = cost = 0
    n, m = len(x), len(y)
    while i < n and j < m:
        if x[i] == y[j]:
            i += 1
            j += 1
            continue
        for d, e in _STEPS:
            if i + d < n and j + e < m and x[i + d] == y[j + e]:
                break
        else:
            break
        cost += max(sum(map(len, x[i:i + d])) + d, sum(map(len, y[j:j + e])) + e)
        if cost > most:
            return False
        i += d
        j += e
    return cost + max(sum(map(len, x[i:])) + n - i, sum(map(len, y[j:])) + m - j) <= most


def distance(a: str, b: str, most: int | None = None) -> int:
    """Edit distance, a column of the table at a time in the bits of two integers; any number above `most` where it is above."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    mask, top = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, score = mask, 0, len(a)  # where the column rises and falls
    for left, c in zip(range(len(b) - 1, -1, -1), b):
        eq = at.get(c, 0)
        steady = eq | minus
        across = ((eq & plus) + plus ^ plus) | eq
        rise, fall = minus | ~(across | plus) & mask, plus & across
        score += bool(rise & top) - bool(fall & top)
        rise, fall = rise << 1 & mask | 1, fall << 1 & mask
        plus, minus = fall | ~(steady | rise) & mask, rise & steady
        if most is not None and (score - left > most or left and len(a) > 64 and left % (len(b) // 6 + 1) == 0 and _least(plus, minus, len(a), len(b), left) > most):
            return most + 1
    return score


def _ones(bits: int, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n].view(np.int8)


def _least(plus: int, minus: int, n: int, columns: int, left: int) -> int:
    """The least an edit distance can be that has come to this column, with so many columns left."""
    column = np.concatenate([[0], np.cumsum(_ones(plus, n) - _ones(minus, n), dtype=np.int64)]) + columns - left
    return int((column + np.abs(np.arange(n, -1, -1) - left)).min())


def near_ones(text: str, others: list[str], least: float) -> list[bool]:
    """similar() of a text and each of some others, whose columns lie side by side in the bits of the same integers."""
    out, rest = [False] * len(others), []
    for k, other in enumerate(others):
        longest = max(len(text), len(other))
        most = int((1 - least) * longest + 1e-9)
        if not text or not other:
            out[k] = longest <= most
        elif abs(len(text) - len(other)) <= most:
            out[k] = reached(text, other, most)
            if not out[k]:
                rest.append((k, len(other), most))
    if len(rest) < 2:
        for k, _, _ in rest:
            out[k] = similar(text, others[k], least)
        return out
    # One bit stays free above each text, so that no carry gets to the next one.
    joined = "\0".join(others[k] for k, _, _ in rest)
    starts = np.cumsum([0] + [n + 1 for _, n, _ in rest[:-1]]).tolist()
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    within = np.ones(len(points), bool)
    within[np.array(starts[1:], np.int64) - 1] = False

    def number(bits: np.ndarray) -> int:
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    mask = number(within)
    low = sum(1 << a for a in starts) if len(starts) < 8 else number(np.isin(np.arange(len(points)), starts))
    at = {c: number((points == ord(c)) & within) for c in set(text)}
    first, most = np.array(starts), np.array([most for _, _, most in rest])
    last = first + np.array([n for _, n, _ in rest])

    def column() -> np.ndarray:
        return np.concatenate([[0], np.cumsum(_ones(plus, len(points)) - _ones(minus, len(points)), dtype=np.int64)])

    after = np.concatenate([np.arange(n, -1, -1) for _, n, _ in rest])  # what is left of each other text
    plus, minus, pause = mask, 0, max(16, len(text) // 8)
    for k, c in enumerate(text):
        if k and k % pause == 0:
            total = column()
            if (np.minimum.reduceat(total + np.abs(after - (len(text) - k)), first) - total[first] + k > most).all():
                return out
        eq = at[c]
        steady = eq | minus
        across = ((eq & plus) + plus ^ plus) | eq
        rise, fall = minus | ~(across | plus) & mask, plus & across & mask
        rise, fall = rise << 1 & mask | low, fall << 1 & mask
        plus, minus = fall | ~(steady | rise) & mask, rise & steady
    total = column()
    for (k, _, _), like in zip(rest, (len(text) + total[last] - total[first] <= most).tolist()):
        out[k] = like
    return out


def minima_blocks(nodes: int, similarity: float, recall: float = MINIMA_RECALL) -> np.ndarray:
    """Bits of each block, one block a row, of those of some minima: about MINIMA_MATES unrelated nodes share a value.

    Lines of this similarity share the share `alike` of their distinct runs, where whole words change, and so many of their minima. Blocks
    that share minima miss the same pairs, so a minimum comes again in a block only after all others were in one.
    """
    share = max(0.01, 1 - 1.25 * (1 - similarity))
    alike = share / (2 - share)
    each = min(5, max(2, math.ceil(math.log(max(nodes, 1) / MINIMA_MATES) / math.log(1 / MINIMA_CHANCE))))
    number = max(1, math.ceil(math.log(1 - recall) / math.log1p(-min(alike ** each, 0.999))))
    rng = np.random.Generator(np.random.PCG64(17))
    per = len(_ORDERS) // each
    chosen = np.concatenate([rng.permutation(len(_ORDERS))[:per * each].reshape(per, each) for _ in range(-(-number // per))])[:number]
    return (64 * WORDS + MINIMUM * chosen[:, :, None] + np.arange(MINIMUM)).reshape(number, -1)


def _line_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in slices(frames):
        texts = part["text"].tolist()
        run = np.cumsum([len(t) for t in texts]) // LINE_CHARS
        cuts = [*np.flatnonzero(np.diff(run, prepend=-1)).tolist(), len(texts)]
        found = [described(texts[a:b]) for a, b in zip(cuts, cuts[1:])]
        text = np.concatenate([a + f[0] for a, f in zip(cuts, found)])
        number, key, length, sketch = (np.concatenate([f[k] for f in found]) for k in range(1, 5))
        yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").take(text).array, "did": part["did"].to_numpy()[text], "line": number.astype(np.int32),
                            "node": key.view(np.int64), "length": np.minimum(length, 2 ** 31 - 1).astype(np.int32)}
                           | {c: np.ascontiguousarray(sketch[:, w]).view(np.int64) for w, c in enumerate([*SIMS, *MINIMA])})


SIMS = [f"sim{w}" for w in range(WORDS)]
MINIMA = [f"min{w}" for w in range(WORDS)]
ENTRY = np.dtype([("sims", "<u8", (WORDS,)), ("value", "<u8"), ("length", "<u2")])  # lengths beyond 16 bits count as the greatest


def _bits(sims: np.ndarray) -> np.ndarray:
    return np.bitwise_count(sims).sum(axis=-1, dtype=np.int64)


def _close(sims: np.ndarray, run: np.ndarray, length: np.ndarray, radius: int, up: np.ndarray, least: float) -> None:
    """Joins pairs of the same run within the radius and of like length in the forest `up`; rows are sorted by run, then length.

    Lines of this similarity differ in length by no more than the share it leaves. The first 64 bits are compared first: a pair goes on
    where they differ in no more than radius_of says for 64 bits at FIRST deviations, then for 128 bits at SECOND.

    Rows are compared in tiles with all rows in their reach. After each tile all of `up` in its reach are roots, and pairs that are already
    connected are not compared.
    """
    rank = np.cumsum(np.diff(run, prepend=run[:1]) != 0) << 32
    start = np.searchsorted(rank, rank)
    key = rank | np.asarray(length, np.int64)
    end = np.searchsorted(key, rank + ((length + 1e-6) / least).astype(np.int64), side="right")
    front, second = np.ascontiguousarray(sims[:, 0]), np.ascontiguousarray(sims[:, 1])
    some, more = min(radius, radius_of(least, 64, FIRST)), min(radius, radius_of(least, 128, SECOND))
    for top in range(0, len(sims), TILE):
        below = min(top + TILE, len(sims))
        last = int(end[top:below].max())
        wide = PAIRS // TILE
        for left in range(top + 1, last, wide):
            right = min(left + wide, last)
            bits = np.bitwise_count(front[top:below, None] ^ front[None, left:right])
            near = bits <= some
            near &= np.arange(left, right) < end[top:below, None]
            if np.count_nonzero(near) * 4 > near.size:
                near &= up[top:below, None] != up[None, left:right]
            at = np.flatnonzero(near)
            i = np.repeat(np.arange(top, below), np.count_nonzero(near, axis=1))
            j = at - (i - top) * (right - left) + left
            keep = (bits.ravel()[at] + np.bitwise_count(second[i] ^ second[j]) <= more) & (j > i)
            i, j = i[keep], j[keep]
            keep = up[i] != up[j]
            i, j = i[keep], j[keep]
            keep = _bits(sims[i] ^ sims[j]) <= radius
            if keep.any():
                _hang(up, i[keep], j[keep], int(start[top]), last)


def _hang(up: np.ndarray, a: np.ndarray, b: np.ndarray, low: int, high: int) -> None:
    """Joins a and b in the forest `up`, whose nodes from low to high are roots or hang to one, and are so afterwards."""
    own = up[low:high]
    while True:
        a, b = up[a], up[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        up[np.maximum(a, b)] = np.minimum(a, b)
        while True:
            above = up[own]
            if (above == own).all():
                break
            own[:] = above


def _values(sims: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The value of a block of bits for each SimHash."""
    out = np.zeros(len(sims), np.int64)
    for bit in block.tolist():
        out = out << 1 | (sims[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1)).astype(np.int64)
    return out


def _sims(frame: pd.DataFrame) -> np.ndarray:
    return np.ascontiguousarray(frame[SIMS].to_numpy(np.int64)).view(np.uint64)


def _sketch(frame: pd.DataFrame) -> np.ndarray:
    """SimHash and, where the frame has them, minima."""
    return np.ascontiguousarray(frame[[c for c in (*SIMS, *MINIMA) if c in frame]].to_numpy(np.int64)).view(np.uint64)


def _sampled(blocks: np.ndarray, first: int):
    """How many SimHashes of a sample have a value of a block, and the least of them."""
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sims, own = _sketch(frame), frame["sim0"].to_numpy(np.int64)
            for k, block in enumerate(blocks):
                value, at, n = np.unique(_values(sims, block), return_inverse=True, return_counts=True)
                least = np.full(len(value), np.iinfo(np.int64).max)
                np.minimum.at(least, at, own)
                yield pd.DataFrame({"block": np.int32(first + k), "value": value, "n": n, "b": least})
    return work


def _dealt(blocks: np.ndarray, first: int, ranges: int, hot: Broadcast):
    """The SimHashes packed by block and range of its values, one row for each of these and BATCH nodes; those of hot values stay out."""
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, size = [], 0
        for frame in frames:
            rest.append(frame)
            size += len(frame)
            if size >= BATCH:
                yield from packed(pd.concat(rest, ignore_index=True))
                rest, size = [], 0
        if size:
            yield from packed(pd.concat(rest, ignore_index=True))

    def packed(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        sims = _sketch(frame)
        rows = np.zeros(len(sims), ENTRY)
        rows["sims"] = sims[:, :WORDS]
        rows["length"] = np.minimum(frame["length"].to_numpy(np.int64), 0xFFFF)
        for k, block in enumerate(blocks):
            value = _values(sims, block)
            rows["value"] = value
            left = np.flatnonzero(~_among(value, hot.value[first + k][0])) if first + k in hot.value else np.arange(len(sims))
            if not len(left):
                continue
            own = (value[left] >> max(0, len(block) - 31)) * ranges >> min(len(block), 31)
            order = np.argsort(own, kind="stable")
            own, left = own[order], left[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
            yield pd.DataFrame({"bucket": (first + k) * ranges + own[cuts], "rows": [x.tobytes() for x in np.split(rows[left], cuts[1:])]})
    return work


def _met(radius: int, least: float):
    """Links between SimHashes that share a block: a spanning forest of those within the radius, for each value of a block."""
    def work(frame: pd.DataFrame) -> pd.DataFrame:
        rows = np.concatenate([np.frombuffer(x, ENTRY) for x in frame["rows"]])
        key = rows["value"].astype(np.int64) << 16 | rows["length"]
        order = np.argsort(key)
        key, sims = key[order], np.ascontiguousarray(rows["sims"][order])
        up = np.arange(len(sims))
        _close(sims, key >> 16, key & 0xFFFF, radius, up, least)
        a, b = sims[:, 0].view(np.int64), sims[up, 0].view(np.int64)
        return pd.DataFrame({"a": a, "b": b})[a != b].drop_duplicates()
    return work


def _among(value: np.ndarray, some: np.ndarray) -> np.ndarray:
    return some[np.minimum(np.searchsorted(some, value), len(some) - 1)] == value


def _stars(blocks: np.ndarray, first: int, hot: Broadcast):
    """Links of hot values: each of their nodes hangs to one."""
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sims, own = _sketch(frame), frame["sim0"].to_numpy(np.int64)
            for k, (many, centre) in hot.value.items():
                value = _values(sims, blocks[k - first])
                star = _among(value, many)
                links = pd.DataFrame({"a": own[star], "b": centre[np.searchsorted(many, value[star])]})
                yield links[links["a"] != links["b"]].drop_duplicates()
    return work


def _verified(least: float, radius: int):
    def work(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, group in frame.groupby("root", sort=True):
            group = group.sort_values("node")
            texts, side = group["text"].tolist(), group["side"].to_numpy()
            sims = np.ascontiguousarray(group[SIMS].to_numpy(np.int64)).view(np.uint64)
            least_of = np.arange(len(texts))  # the first position of each position's group
            hubs = np.flatnonzero(group["hub"].to_numpy(bool))
            least_of[hubs] = hubs[:1]
            for i in range(len(texts) - 1):
                near = _bits(sims[i] ^ sims[i + 1:]) <= radius
                near &= ((side[i + 1:] != side[i]) | (side[i] == 2)) & (least_of[i + 1:] != least_of[i])
                found = np.flatnonzero(near) + i + 1
                for k in range(0, len(found), SIDE):
                    some = [j for j in found[k:k + SIDE].tolist() if least_of[i] != least_of[j]]
                    for j in (j for j, like in zip(some, near_ones(texts[i], [texts[j] for j in some], least)) if like):
                        a, b = sorted((least_of[i], least_of[j]))
                        if a != b:
                            least_of[least_of == b] = a
            node = group["node"].to_numpy(np.int64)
            out.append(pd.DataFrame({"a": node, "b": node[least_of]}))
        return pd.concat(out)[lambda x: x["a"] != x["b"]]
    return work


def _compared(least: float, radius: int):
    """Whether each member of a group is similar to the group's pivot, its least member."""
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pivot = _sims(frame[[f"pivot_{c}" for c in SIMS]].set_axis(SIMS, axis=1))
            near = np.flatnonzero(_bits(_sims(frame) ^ pivot) <= radius)
            texts, pivots, hub = frame["text"].tolist(), frame["pivot_text"].tolist(), np.zeros(len(frame), bool)
            for own in np.split(near, np.flatnonzero(np.diff(frame["root"].to_numpy()[near])) + 1):  # rows of a group lie together
                for k in range(0, len(own), SIDE):
                    some = own[k:k + SIDE].tolist()
                    hub[some] = near_ones(pivots[some[0]], [texts[j] for j in some], least)
            frame["hub"] = hub
            yield frame[["node", *SIMS, "root", "text", "size", "pivot", "hub"]]
    return work


def _verified_links(members: DataFrame, similarity: float, radius: int) -> DataFrame:
    """a, b: links that connect the similar members of each group.

    All members are compared with their pivot first. In groups where some are not similar to it the others are compared with
    each other, but for pairs that are both similar to it.
    """
    pivots = (members.groupBy("root").agg(F.min_by(F.struct("node", "text", *SIMS), "node").alias("p"), F.count("*").alias("size"))
              .select("root", "size", F.col("p.node").alias("pivot"), F.col("p.text").alias("pivot_text"), *[F.col(f"p.{c}").alias(f"pivot_{c}") for c in SIMS]))
    seen = written(members.join(pivots, "root").mapInPandas(
        _compared(similarity, radius), "node long, " + ", ".join(f"{c} long" for c in SIMS) + ", root long, text string, size long, pivot long, hub boolean"), "line-pivots")
    tidy(members.sparkSession)
    mixed = seen.where("not hub and size > 2").select("root").distinct()
    rest = seen.join(mixed, "root", "left_semi").select("node", *SIMS, "root", "text", "hub")
    dealt = cells(rest, "root", "node", BLOCK)
    rounds = _rounds(rest)
    links = written(seen.where("hub and node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")), "line-hubs")
    for k in range(rounds):
        own = dealt if rounds == 1 else dealt.where(F.pmod(F.xxhash64("cell"), F.lit(rounds)) == k)
        links = links.unionAll(written(own.groupBy("cell").applyInPandas(_verified(similarity, radius), "a long, b long"), "line-alike"))
        tidy(members.sparkSession)
    erased(seen)
    return links


def _rounds(rest: DataFrame) -> int:
    """In how many rounds the cells of groups are worked off: a group of n members is copied n / BLOCK times, and the disk holds the copies of one round."""
    groups = rest.groupBy("root").agg(F.sum(F.length("text") + F.lit(8 * WORDS)).alias("chars"), F.ceil(F.count("*") / BLOCK).alias("copies"))
    chars, copied = groups.agg(F.sum("chars"), F.sum(F.col("chars") * F.col("copies"))).first()
    return 1 if not copied else math.ceil(copied / max(DEALT * chars, DEALT_CHARS))


def _texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Normalised texts of the wanted lines of each document."""
    for part in slices(frames):
        rows = []
        for text, wanted in zip(part["text"], part["wanted"]):
            lines = normal_lines(text)
            rows += [(w["node"], *[w[c] for c in SIMS], w["root"], b" ".join(lines[w["line"]].split()).decode("utf-8", "replace")) for w in wanted]
        yield pd.DataFrame(rows, columns=["node", *SIMS, "root", "text"])


def _did() -> Column:
    """What names a document: a hash of its id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def _place() -> Column:
    return F.struct("doc_id", "did", "line")


def repeated_lines(docs: DataFrame, similarity: float = SIMILARITY, radius: int | None = None, files: list[DataFrame] | None = None) -> DataFrame:
    """Per document the numbers (from 0) of the lines that repeat a line kept elsewhere: did, lines.

    docs: doc_id, text; did is a hash of both and names the document, so rows that repeat an id and text are one. Documents without
    repeated lines are left out. Of each connected group the line of the least doc_id (nulls first), then did, then number stays.
    Radius: see radius_of. Lines without words are no one's copy. Null and empty texts, empty tables: no rows. `files` takes written frames
    that the result is made of, to be erased once it is settled.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), _did().alias("did"))
    radius = radius_of(similarity) if radius is None else radius
    schema = "doc_id long, did long, line int, node long, length int, " + ", ".join(f"{c} long" for c in (*SIMS, *MINIMA))
    occurrences = written(rows.mapInPandas(_line_rows, schema), "lines")
    # Numbers only, and each from the same row, so that this is combined in hash tables and not sorted.
    nodes = written(occurrences.groupBy("node").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("did", "line", "length", *SIMS, *MINIMA)]), "line-nodes")
    # Only nodes need the sketches from here on.
    places = written(occurrences.select("doc_id", "did", "line", "node"), "line-places")
    erased(occurrences)
    tidy(spark)
    members = _members(rows, nodes, _candidates(nodes, similarity, radius))
    tidy(spark)
    links = _verified_links(members, similarity, radius)
    erased(members)
    fuzzy = connected(links)
    erased(links)
    tidy(spark)
    if files is not None:
        files += [places, nodes]
    grouped = fuzzy.unionAll(nodes.where("copies > 1").select("node").join(fuzzy, "node", "left_anti").select("node", F.col("node").alias("root")))
    own = places.select("did", "line", "node", _place().alias("own")).join(grouped, "node").select("did", "line", "root", "own")
    doubled = own.join(own.groupBy("root").agg(F.min("own").alias("best")), "root").where("own <> best")
    return doubled.groupBy("did").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def _candidates(nodes: DataFrame, similarity: float, radius: int) -> DataFrame:
    """node (a SimHash), root: the groups of SimHashes that meet, and SimHashes of several nodes."""
    spark, n = nodes.sparkSession, nodes.count()
    blocks = blocks_of(n, similarity)
    if blocks.shape[1] > BLOCK_BITS:
        blocks = minima_blocks(n, similarity)
    step = max(ROUND, ROUND_ROWS // max(n, 1))
    links = None
    for first in range(0, len(blocks), step):
        found = written(_links(nodes, blocks[first:first + step], first, radius, similarity, n), "line-links")
        links = found if links is None else links.unionAll(found)
        tidy(spark)
    groups = connected(links)
    erased(links)
    twins = nodes.groupBy("sim0").agg(F.count("*").alias("n")).where("n > 1").select(F.col("sim0").alias("node"))
    return settled(groups.unionAll(twins.join(groups.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"))))


def _links(nodes: DataFrame, blocks: np.ndarray, first: int, radius: int, similarity: float = SIMILARITY, n: int | None = None) -> DataFrame:
    """a, b: SimHashes that meet in some blocks. n: the number of nodes, where it is known."""
    n = nodes.count() if n is None else n
    own = nodes.select(*(c for c in (*SIMS, *MINIMA) if c in SIMS or blocks.max() >= 64 * WORDS), "length")
    # A value of `hot` nodes has hot / SAMPLE in the sample on average; a few more or less are decided either way, with the same pairs found.
    least = max(HOT, n * len(blocks) // HOT_VALUES)
    sample = own.where(F.pmod(F.xxhash64("sim0", F.lit(5)), F.lit(SAMPLE)) == 0)
    found = (sample.mapInPandas(_sampled(blocks, first), "block int, value long, n long, b long").groupBy("block", "value")
             .agg(F.sum("n").alias("n"), F.min("b").alias("b")).where(F.col("n") * SAMPLE >= least).toPandas())
    hot = {int(k): (f["value"].to_numpy(np.int64), f["b"].to_numpy(np.int64)) for k, f in found.sort_values("value").groupby("block")}
    ranges = min(1 << len(blocks[0]), n // RUN + 1)
    told = nodes.sparkSession.sparkContext.broadcast(hot)
    dealt = own.mapInPandas(_dealt(blocks, first, ranges, told), "bucket long, rows binary")
    near = (dealt.repartition(max(width(nodes.sparkSession), min(ranges * len(blocks), n * len(blocks) // TASK_ROWS)), "bucket")
            .groupBy("bucket").applyInPandas(_met(radius, similarity), "a long, b long"))
    return near.unionAll(own.mapInPandas(_stars(blocks, first, told), "a long, b long")) if hot else near


def _members(rows: DataFrame, nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """The nodes of candidate groups with their normalised texts, each read from one of its occurrences."""
    wanted = (nodes.join(candidates.withColumnRenamed("node", "sim0"), "sim0").groupBy("did")
              .agg(F.collect_list(F.struct("node", *SIMS, "root", "line")).alias("wanted")))
    found = rows.select("did", "text").join(wanted, "did").dropDuplicates(["did"])
    return written(found.mapInPandas(_texts, "node long, " + ", ".join(f"{c} long" for c in SIMS) + ", root long, text string"), "line-texts")


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, radius: int | None = None, n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """The documents without lines that repeat a line kept elsewhere, see repeated_lines; all columns stay.

    Adds the numbers of lines and of removed lines, in place of columns of these names. A null text stays null.
    """
    did, gone = free(docs, "did"), free(docs, "gone")
    files: list[DataFrame] = []
    found = settled(repeated_lines(docs, similarity, radius, files)).select(F.col("did").alias(did), F.col("lines").alias(gone))
    erased(*files)
    tidy(docs.sparkSession)
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.split(whole, "\n", -1)
    number = F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    left = F.array_join(F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
                                             lambda r: ~F.array_contains(gone, r["i"])), lambda r: r["x"]), "\n")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (n_lines, n_removed, "text")]
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(left).alias("text")
    return (docs.withColumn(did, _did()).join(found, did, "left")
            .select(*kept, text, number.cast("long").alias(n_lines), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(n_removed)))
