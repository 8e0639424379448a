"""Random draws that do not depend on partitioning.

Every draw is a hash of (seed, stream, row id), so a row gets the same value
whichever task computes it, after a retry, and under any number of partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# 52 random bits fill a double's mantissa exactly.
_SPAN = float(2**52)


def uniform(seed: int, stream: str, *ids: Column) -> Column:
    """A double in (0, 1) fixed by seed, stream and the row's id columns."""
    key = F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *[c.cast("string") for c in ids])
    bits = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("bigint")
    # Never null, which spares later arithmetic its null checks.
    return F.coalesce((bits.cast("double") + F.lit(0.5)) / F.lit(_SPAN), F.lit(0.5))


def uniform_int(u: Column, low: int, high: int) -> Column:
    """Integer in [low, high) from a uniform draw."""
    return (F.lit(low) + F.floor(u * F.lit(float(high - low)))).cast("bigint")


def pick(values: Sequence, u: Column) -> Column:
    """Equally likely element of a short literal list."""
    return F.element_at(array_literal(values), F.floor(u * F.lit(float(len(values)))).cast("int") + 1)


def cumulative(weights: Sequence[float]) -> list[float]:
    """Upper ends of the intervals that split [0, 1) by weight; the last is 1."""
    total = float(sum(weights))
    running, ends = 0.0, []
    for w in weights:
        running += w
        ends.append(running / total)
    if ends:
        ends[-1] = 1.0
    return ends


def interval_index(ends: Column, size: int, u: Column) -> Column:
    """0-based interval of u: the number of upper ends (an ascending array) at or below it.

    A binary search inside the array, so wide tables cost log2(size) steps a row.
    """
    steps, step = [], 1
    while step <= size:
        steps.insert(0, step)
        step *= 2

    def advance(at, hop):
        inside = at + hop <= F.lit(size)
        return F.when(inside & (F.get(ends, at + hop - 1) <= u), at + hop).otherwise(at)

    return F.aggregate(F.expr(f"array({', '.join(map(str, steps))})"), F.lit(0), advance)


def array_literal(values: Sequence) -> Column:
    """A literal array of numbers or texts, built as one expression."""
    def text(v):
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{v!r}D" if isinstance(v, float) else f"{v}L" if isinstance(v, int) else f"'{v}'"
    return F.expr(f"array({', '.join(text(v) for v in values)})")


def interval_pick(values: Sequence, ends: Sequence[float], u: Column) -> Column:
    """Element whose interval [previous end, end) holds u."""
    if not values:
        return F.lit(None)
    if len(values) <= 64:
        out = F.lit(values[-1])
        for v, end in reversed(list(zip(values[:-1], ends[:-1]))):
            out = F.when(u < F.lit(end), F.lit(v)).otherwise(out)
        return out
    return F.get(array_literal(values), interval_index(array_literal(ends[:-1]), len(values) - 1, u))
