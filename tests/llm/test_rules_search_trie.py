"""Compression bands, ranked search and the prefix trie against brute force and on odd input."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

from doppel.llm import compression, treap, trie

DOCS = "doc_id long, text string, rules string, score double, rank int, item_id long, n_words string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def prose(rng, n, letters="abcdefghijklmnopqrstuvwxyz"):
    return " ".join("".join(rng.choices(letters, k=rng.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    base = prose(rng, 60)
    noise = base64.b64encode(rng.randbytes(9000)).decode()
    return [(1, None), (2, ""), (3, " \n\t\n"), (4, "few words"), (5, base), (5, base), (None, base), (6, base.upper() + "\n" + base + "\n" + base),
            (7, "\n".join(["the same line again and again #1"] * 40)), (8, prose(rng, 3000)), (9, prose(rng, 4000) + "\n" + "abc " * 4000),
            (10, " ".join(noise[k:k + 60] for k in range(0, len(noise), 60))), (11, "中文 " * 30 + base), (12, "x" * 5000), (13, "é́ 🙂 <a|b> " + base),
            (14, " ".join(f"ab{k}" for k in range(200)) + " a\x1cb \x00"), (15, "Ä1 a_b-c " * 3), (16, prose(rng, 30) + "\n\n" + prose(rng, 30))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0.5, 1, 7, "y") for i, t in rows], DOCS).repartition(3).cache()


def plain_rules(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
    twice = Counter(windows)
    held = {k + j for k, w in enumerate(windows) if twice[w] > 1 for j in range(8)}
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    failed = len(words) < 20 or 100 * len(held) > 30 * len(words)

    def odd(raw):
        band = [b for b in compression.BANDS if b[0] <= len(raw)]
        ratio = len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(raw)) / max(1, len(raw))
        return bool(band) and not band[-1][1] <= ratio <= band[-1][2]

    raw = text.encode()
    chunks = [raw[k:k + 4096] for k in range(0, len(raw), 4096)]
    share = sum(len(c) for c in chunks if odd(c)) / max(1, len(raw))
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(held), failed,
            not failed and not odd(raw) and share <= 0.2)


def test_rules_brute_force(docs, rows):
    got = compression.judged(docs, "out").select("doc_id", "text", "out.*").collect()
    assert sorted(((r.doc_id, r.text, *r[2:9]) for r in got), key=repr) == sorted(((i, t, *plain_rules(t)) for i, t in rows), key=repr)
    kept = {r.doc_id for r in got if r.kept}
    assert {5, 8, 16} <= kept and not kept & {1, 2, 3, 4, 7, 9, 10, 12}
    assert [r for r in got if r.doc_id == 8][0].n_chunks > 1


def test_rules_columns_and_empty(docs, spark):
    assert compression.judged(docs).columns == [*docs.columns, "_rules"]
    left = compression.keep(docs)
    assert left.columns == docs.columns and left.where("doc_id is null").count() == 1 and left.where("doc_id = 5").count() == 2
    assert compression.judged(docs.limit(0)).count() == 0


def test_repeated_windows_within_one_text_only():
    words = "a b c d e f g h"
    assert compression.counted([words, words])["n_repeat_words"].tolist() == [0, 0]
    assert compression.counted([words + " " + words, "a " * 9])["n_repeat_words"].tolist() == [16, 9]


def plain_search(docs, items, k):
    lower = [(d, TERMS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for d, t in docs]
    lower = [(d, Counter(t), len(t)) for d, t in lower if t]
    n, total = len(lower), sum(x[2] for x in lower)
    df = Counter(t for _, c, _ in lower for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(TERMS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    out = []
    for i, terms in asked.items():
        found = []
        for d, c, size in lower:
            m = 50 + (50 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if d is not None and score > 0:
                found.append((-score, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_chars, k", [(2_000, 3), (10_000_000, 50)])
def test_search_brute_force(spark, rows, shard_chars, k):
    rng = random.Random(5)
    vocabulary = [prose(rng, 1, "abcdeé") for _ in range(300)]
    docs = rows + [(100 + i, " ".join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(300)], k=rng.randrange(1, 80)))) for i in range(300)]
    docs += docs[100:140] + [(1000 + d, t) for d, t in docs[50:90]]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 30)))) for i in range(30)] + [(90, None), (91, ""), (92, "zzzzunknown"), (None, "a b")]
    items += [(0, "AB ab " + vocabulary[0].upper()), (3, items[3][1])]
    index = treap.build(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string").repartition(3), shard_chars=shard_chars)
    got = treap.search(index, spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int"), k).collect()
    assert sorted(tuple(r) for r in got) == plain_search(docs, items, k)


def test_search_opens_few_ranges():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2000, 200_000).astype(np.uint64)
    words[:100] = 9000  # a term that fills one document
    grid = treap.Shard(*[treap.shard(list(range(2000)), words, np.full(2000, 100), 2000, 200_000)[k] for k in (0, 1, 3, 4, 5)])
    best = treap._Best(1, 1)
    at = np.searchsorted(grid.terms, np.array([9000], np.uint64))
    assert treap.descend(grid, np.zeros(1, np.int64), np.array([7000]), grid.rows[at].astype(np.int64), best, 1) <= 4 * grid.height
    assert best.doc.tolist() == [0]


def test_search_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, item_id long")
    some = spark.createDataFrame([(1, "one two", 1)], "doc_id long, text string, item_id long")
    assert treap.search(treap.build(none), some).count() == 0
    assert treap.search(treap.build(some), none).count() == 0
    assert treap.search(treap.build(some.unionAll(some.selectExpr("2", "'three'", "2"))), some).columns == ["item_id", "rank", "doc_id", "score"]


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        made[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    for node, held in members.items():
        leaves = saved = 0
        stack = [node]
        while stack:
            at = stack.pop()
            leaves += not children[at]
            saved += (len(members[at]) - 1) * (len(WORDS.findall(at[-1][1])) if at else 0)
            stack += children[at]
        ends = sorted(c for c in held if len(made[c]) == len(node))
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(children[node]), leaves, saved,
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(8)
    starts = [[("user", f"start {k} " * k)] for k in range(4)]
    out = []
    for c in [*range(-45, 160), 10 ** 12]:
        turns = list(starts[0 if c % 3 else rng.randrange(4)])
        while rng.random() < 0.7 and len(turns) < 9:
            turns.append((rng.choice(["user", "assistant", None]), rng.choice(["yes", "no", None, "", "a long answer with words"])))
        out += [(c, k if k else None, r, t) for k, (r, t) in enumerate(turns)]
    out += [(500, k, "user", f"word {k}") for k in range(60)] + [(501, k, "user", f"word {k}") for k in range(50)]
    return out + [(None, 1, "user", "x"), (7, 3, "user", "tie"), (7, 3, "user", "tie")]


@pytest.mark.parametrize("light, band, held", [(1024, 4096, 1 << 20), (5, 7, 3), (1, 1, 2)])
def test_trie_brute_force(spark, talks, light, band, held):
    table = spark.createDataFrame([(*r, 1) for r in talks], "conv_id long, turn long, role string, text string, depth int").repartition(5)
    got = trie.trie(*trie.with_shared_heads(trie.ordered(table)), light=light, band=band, held=held)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_trie(talks)


def test_trie_turnless_and_empty(spark):
    shape = "conv_id long, turn long, role string, text string"
    gone = [(21, 1, None, None), (22, 1, "user", None)]  # heads of conversation 20, which there is not
    got = trie.trie(*trie.with_shared_heads(trie.ordered(spark.createDataFrame(gone, shape))))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_trie(gone)
    assert trie.trie(*trie.with_shared_heads(trie.ordered(spark.createDataFrame([], shape)))).count() == 0


def test_digest_in_many_runs(spark):
    ids = spark.range(1000).selectExpr("id as conv_id", "if(id % 3 = 0, 0L, 1L) as depth", "0L as kx", "0L as ky")
    got = {r.depth: r.ends_sha256 for r in trie._digests(ids, run_ids=7).collect()}
    for d in (0, 1):
        assert got[d] == hashlib.sha256(",".join(str(i) for i in range(1000) if (i % 3 > 0) == d).encode()).hexdigest()


def test_queue_spills_and_keeps_order():
    rng = np.random.default_rng(1)
    level, ids = rng.integers(-9, 0, 5000), rng.integers(0, 200, 5000)
    queue = trie.Queue(most=50)
    queue.BLOCK = 16
    for a in range(0, 5000, 37):
        queue.push(level[a:a + 37], ids[a:a + 37], np.ones(len(ids[a:a + 37]), np.int64), ids[a:a + 37])
    assert queue.runs
    got = np.concatenate([queue.pop(x, y) for x in range(-9, 0) for y in (60, 61, 199)])
    want = Counter(zip(level.tolist(), ids.tolist()))
    assert {(a, b): n for a, b, n, _ in got.tolist()} == want and len(got) == len(want) and got[:, 3].sum() == ids.sum()
