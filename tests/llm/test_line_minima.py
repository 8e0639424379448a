"""Blocks of minima, in which lines of large tables meet, and the early ends of edit distances."""

import random

import numpy as np
from pyspark.sql import SparkSession

from doppel.llm import lines


def _line(rng: random.Random, n: int, letters: str = "abcdefghijklmnopqrst") -> str:
    return " ".join("".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(n))


def _changed(rng: random.Random, line: str, n: int) -> str:
    own = line.split()
    for j in rng.sample(range(len(own)), n):
        own[j] = _line(rng, 1, "uvwxyz")
    return " ".join(own)


def test_blocks_move_little_and_find_most():
    """Blocks of SimHash bits moved 31 times 34 bytes a node at 2 million nodes and 5 times as much at 120 million."""
    for nodes, most in ((400_000, 760), (2_000_000, 760), (120_000_000, 1400)):
        assert len(lines.minima_blocks(nodes, lines.SIMILARITY)) * lines.ENTRY.itemsize <= most
    rng = random.Random(6)
    base = [_line(rng, n) for n in (8, 20, 60, 200) for _ in range(150)]
    copies = [_changed(rng, x, max(1, len(x.split()) * 17 // 100)) for x in base]
    pairs = [k for k, (a, b) in enumerate(zip(base, copies)) if lines.similar(a, b, 0.8)]
    a, b = lines.described(base)[-1][pairs], lines.described(copies)[-1][pairs]
    met = np.zeros(len(pairs), bool)
    for block in lines.minima_blocks(2_000_000, lines.SIMILARITY):
        met |= lines._values(a, block) == lines._values(b, block)
    assert len(pairs) > 500 and (met & (lines._bits(a[:, :4] ^ b[:, :4]) <= lines.radius_of(0.8))).mean() >= 0.9


def test_lines_meet_in_minima(spark: SparkSession, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK_BITS", 0)
    rng = random.Random(8)
    base = [_line(rng, 20) for _ in range(80)]
    rows = [*enumerate(base), *((1000 + k, _changed(rng, x, 2)) for k, x in enumerate(base))]
    made = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed = 1").collect()
    gone = {r["doc_id"] for r in made}
    alike = {k for k, x in rows[80:] if lines.similar(base[k - 1000], x, 0.8)}
    assert gone <= alike and len(gone) >= 0.95 * len(alike) > 60


def test_simhash_follows_the_angle():
    """Bits differ as often as the angle between two lines' runs says, as with independent planes."""
    rng = np.random.Generator(np.random.PCG64(4))
    for n, shared in ((30, 20), (300, 200), (3000, 2700)):
        hashes = rng.integers(0, 2 ** 64, (200, 2 * n - shared), np.uint64, endpoint=False)
        a, b = (lines.simhash(np.ascontiguousarray(x).ravel(), np.full(200, n)) for x in (hashes[:, :n], hashes[:, n - shared:]))
        share = np.arccos(shared / n) / np.pi
        bits = lines._bits(a ^ b)
        assert abs(bits.mean() - 256 * share) < 3 and bits.std() < 1.4 * np.sqrt(256 * share * (1 - share))


def test_words_exchanged_bound_the_distance():
    rng = random.Random(9)
    for _ in range(300):
        a = _line(rng, rng.randint(1, 12), "ab")
        own = a.split()
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(own))
            own[at:at + rng.randint(0, 2)] = [_line(rng, 1, "ab") for _ in range(rng.randint(0, 2))]
        b, far = " ".join(own), _line(rng, 30, "ab")
        for other in (b, far):
            exact = lines.distance(a, other)
            for most in (exact - 1, exact):
                assert (lines.distance(a, other, most) <= most) == (exact <= most)
                assert exact <= most or most < 0 or not lines.reached(a, other, most)
