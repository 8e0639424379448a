"""Lines compared in tiles and beside each other, against comparisons one by one."""

import random

import numpy as np

from doppel.llm import lines


def test_few_blocks_reach_the_recall():
    """Blocks move all SimHashes, so their number bounds the shuffle; a pair at the similarity still meets with the recall."""
    for nodes, most in ((400_000, 20), (2_000_000, 35), (120_000_000, 160)):
        blocks = lines.blocks_of(nodes, lines.SIMILARITY)
        agree = (1 - lines.differing(lines.SIMILARITY)) ** blocks.shape[1]
        assert len(blocks) <= most
        assert 1 - (1 - agree) ** len(blocks) >= lines.RECALL
        assert nodes >> blocks.shape[1] <= lines.MATES


def test_distances_beside_each_other():
    rng = random.Random(5)
    for turn in range(60):
        letters = "ab é𝕏"[:1 + turn % 5]
        text = "".join(rng.choices(letters, k=rng.randint(0, 130)))
        others = ["", text]
        for _ in range(rng.randint(0, 15)):
            other = list(text)
            for _ in range(rng.randint(0, len(text) // 3 + 1)):
                at = rng.randint(0, len(other))
                other[at:at + rng.randint(0, 1)] = rng.choices(letters, k=rng.randint(0, 2))
            others.append("".join(other))
        for least in (0.5, 0.8, 0.9):
            assert lines.near_ones(text, others, least) == [lines.similar(text, x, least) for x in others]


def test_tiles_find_the_same_groups(monkeypatch):
    monkeypatch.setattr(lines, "PAIRS", 16 * lines.TILE)
    rng = np.random.Generator(np.random.PCG64(9))
    radius, first, second = lines.radius_of(0.8), lines.radius_of(0.8, 64, lines.FIRST), lines.radius_of(0.8, 128, lines.SECOND)
    for n in (1, 63, 500):
        centres = rng.integers(0, 2 ** 63, (n // 9 + 1, lines.WORDS), np.uint64)
        sims = centres[rng.integers(0, len(centres), n)]
        for row in sims:
            for bit in rng.integers(0, 256, rng.integers(0, 70)).tolist():
                row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        run, length = rng.integers(0, 3, n), rng.integers(50, 80, n)
        order = np.lexsort((length, run))
        sims, run, length = np.ascontiguousarray(sims[order]), run[order], length[order]
        want = np.arange(n)
        for i in range(n):
            j = np.arange(i + 1, n)
            near = (run[j] == run[i]) & (0.8 * length[j] <= length[i] + 1e-6) & (np.bitwise_count(sims[j, 0] ^ sims[i, 0]) <= first)
            near &= lines._bits(sims[j, :2] ^ sims[i, :2]) <= second
            for k in j[near & (lines._bits(sims[j] ^ sims[i]) <= radius)].tolist():
                a, b = sorted((want[i], want[k]))
                want[want == b] = a
        up = np.arange(n)
        lines._close(sims, run, length, radius, up, 0.8)
        assert up.tolist() == want.tolist()
