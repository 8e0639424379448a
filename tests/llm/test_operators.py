"""The operators on training data against brute force, and on nulls, empty and long texts, repeated rows, empty tables, odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from doppel.llm import chat, decontamination, jaccard, lines, lm, packing, quality, token_files, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, did long, score double, label int, node string, n_lines int"


def words(rng, n, of="abcdefghij"):
    return " ".join("".join(rng.choices(of, k=rng.randrange(3, 9))) for _ in range(n))


def frame(spark, rows, parts=3):
    full = [(i, t, "en", None, len(t or ""), 7, 0.5, 1, "x", 3) for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(4)
    long = "\n".join(words(rng, 30) for _ in range(400))
    base = words(rng, 60)
    near = base.split()
    near[30] = "changed"
    return [(1, None), (2, ""), (3, "   \n\n "), (4, "one two"), (5, "one two"), (6, long), (7, base), (8, " ".join(near)), (9, base.upper()), (None, base),
            (None, None), (10, words(rng, 40)), (11, "Eins zwei\ndrei"), (11, "Eins zwei\ndrei"), (12, long[:3000]), (-3, "\x00 <|endoftext|> \ufffd é́ 🙂")]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return frame(spark, odd_rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- 1 lines ---

def test_lines_brute_force(spark):
    rng = random.Random(1)
    lines_ = [words(rng, 20) for _ in range(30)]
    edited = []
    for x in lines_[:10]:
        own = x.split()
        own[5] = own[5][:-1]
        edited.append(" ".join(own))
    rows = [(k, "\n".join(lines_[3 * k:3 * k + 3])) for k in range(10)]
    rows += [(100 + k, "\n".join([words(rng, 20), lines_[k].upper() + " !!", edited[k], "", "---"])) for k in range(10)]
    got = {r["doc_id"]: r for r in lines.dedup_lines(frame(spark, rows)).collect()}
    for k in range(10):
        assert got[k]["text"] == rows[k][1] and got[k]["n_removed"] == 0
        own = rows[10 + k][1].split("\n")
        assert got[100 + k]["text"].split("\n") in ([own[0], *own[3:]], [own[0], own[2], *own[3:]]) and got[100 + k]["n_lines"] == 5
    # One changed letter in twenty words is within the guaranteed or likely reach of the blocks.
    assert sum(got[100 + k]["n_removed"] == 2 for k in range(10)) >= 8


def test_lines_in_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK", 8)
    rng = random.Random(2)
    base = words(rng, 60).split()
    rows = []
    for k in range(50):
        own = list(base)
        own[k] = own[k] + "x"
        rows.append((k, " ".join(own)))
    got = lines.dedup_lines(frame(spark, rows)).where("n_removed = 0").collect()
    assert min(r["doc_id"] for r in got) == 0 and len(got) <= 3


def test_lines_recall(spark):
    """Pairs far above the similarity in letters, with many words touched; and pairs with whole words changed close to it."""
    rng = random.Random(12)
    base = [words(rng, 20, "abcdefghijklmnopqrst") for _ in range(120)]
    rows, copies = list(enumerate(base)), {}
    for k, x in enumerate(base):
        own = x.split()
        if k < 60:
            for j in rng.sample(range(20), 3):
                own[j] = own[j][:-1] + "z"
        else:
            for j in rng.sample(range(20), 3):
                own[j] = words(rng, 1, "uvwxyz")
        copies[1000 + k] = lines.similar(x, " ".join(own), 0.8)
        rows.append((1000 + k, " ".join(own)))
    gone = {r["doc_id"] for r in lines.dedup_lines(frame(spark, rows)).where("n_removed = 1").select("doc_id").collect()}
    assert gone <= {k for k, alike in copies.items() if alike}
    typos, changed = ([k for k, alike in copies.items() if alike and (k < 1060) == few] for few in (True, False))
    assert len(typos) == 60 and len(gone & set(typos)) >= 57
    assert len(changed) > 20 and len(gone & set(changed)) >= 0.85 * len(changed)


def test_lines_of_one_value(spark, monkeypatch):
    """Nodes of a value that many share hang to one of them instead of being compared with each other in one task."""
    monkeypatch.setattr(lines, "HOT", 20)
    monkeypatch.setattr(lines, "SAMPLE", 1)
    rows = [(7 if k < 30 else 1 << k - 30, 0, 0, 0, 100) for k in range(40)]
    nodes = spark.createDataFrame([(k << 40 | r[0], *r[1:]) for k, r in enumerate(rows)], "sim0 long, sim1 long, sim2 long, sim3 long, length int")
    blocks = np.array([[0, 1, 2]])
    links = {(r["a"], r["b"]) for r in lines._links(nodes, blocks, 0, -1).collect()}
    assert links == {(k << 40 | 7, 7) for k in range(1, 30)}  # the radius lets none pass, so no link is from a comparison
    monkeypatch.setattr(lines, "HOT", 1000)
    assert lines._links(nodes, blocks, 0, -1).count() == 0


def test_lines_odd(spark, odd, odd_rows, none):
    made = lines.dedup_lines(odd)
    assert made.columns == [*[c for c in odd.columns if c not in ("text", "n_lines")], "text", "n_lines", "n_removed"]
    got = made.collect()
    assert len(got) == len(odd_rows) and {r["did"] for r in got} == {7}
    by = {(r["doc_id"], r["text"]) for r in got}
    assert {(1, None), (2, ""), (3, "   \n\n "), (4, "one two"), (5, ""), (9, "")} <= by
    assert sum(r["doc_id"] == 11 and r["n_removed"] == 0 for r in got) == 2  # repeated rows are one document
    assert lines.dedup_lines(none).count() == 0


# --- 2 decontamination ---

def test_decontamination(spark, odd, none, monkeypatch):
    rng = random.Random(3)
    items = [(k, words(rng, rng.randrange(8, 40))) for k in range(25)] + [(30, None), (31, ""), (None, "one two"), (32, "solo"), (33, "dup dup dup dup dup")]
    rows, want = [], set()
    for k, text in items[:25]:
        own = text.split()
        for j, edits in enumerate([0, len(own) // 10, len(own) // 5]):
            part = list(own)
            for _ in range(edits):
                part[rng.randrange(len(part))] = "zz" + str(rng.randrange(1000))
            rows.append((10 * k + j, words(rng, 30, "klmnop") + " " + ", ".join(part).upper() + " " + words(rng, 30, "klmnop")))
            want.add((10 * k + j, k))
    rows += [(1000 + k, words(rng, 80, "klmnop")) for k in range(20)] + [(2000, "x Solo. y"), (2001, None), (None, items[0][1])]
    want |= {(2000, 32), (None, 0)}
    table = spark.createDataFrame(items + items[:2], "item_id long, text string")
    docs = frame(spark, rows)
    got = decontamination.find(docs, table).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    hit = next(r for r in got if r["doc_id"] == 0)
    assert (hit["start"], hit["distance"], hit["words"]) == (30, 0, len(items[0][1].split()))
    kept = decontamination.clean(docs, table)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1000 + k for k in range(20)} | {2001}
    monkeypatch.setattr(decontamination, "PAGE_CHARS", 500)
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.find(docs, table).collect()} == want
    assert decontamination.clean(odd, table.limit(0)).count() == odd.count()
    assert decontamination.find(none, table).count() == 0 and decontamination.find(odd, table.limit(0)).count() == 0


# --- 3 top k ---

def test_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [int(x) for x in rng.integers(-3, 4, 4)]) for i in range(300)] + [(7, [1, 2]), (400, []), (401, [2 ** 40] * 4), (7, [1, 2])]
    vectors = spark.createDataFrame(rows, "vec_id long, vector array<long>").repartition(5)
    got = rows_of(topk.top_k(vectors, vectors.where("vec_id % 50 = 0 or vec_id = 401"), 5).select("query_id", "rank", "vec_id", "score"))
    want = []
    for q, a in {(i, tuple(v)) for i, v in rows if i % 50 == 0 or i == 401}:
        scores = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in rows if i != q)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    assert got == sorted(want, key=repr)
    few = vectors.where("vec_id < 3")
    assert topk.top_k(few, few.where("vec_id = 0"), 5).count() == 2
    assert topk.top_k(few, few.limit(0), 5).count() == 0 and topk.top_k(few.limit(0), few.limit(0), 5).count() == 0


# --- 4 and 10 classifiers ---

def test_classifiers(spark, odd, odd_rows, none):
    rng = random.Random(6)
    bad = ["moronic", "idiotic", "pathetic"]
    rows, labels = [], []
    for k in range(400):
        own = words(rng, 40).split()
        toxic = k % 5 == 0
        if toxic:
            own[rng.randrange(40)] = rng.choice(bad)
        if k % 4 == 1:
            own = [w.upper() + "!!" for w in own]
        rows.append((k, " ".join(own)))
        labels.append((k, 0 if k % 4 == 1 else 1, int(toxic), "extra"))
    labels += [(None, 1, 1, ""), (9999, 0, 0, ""), (3, 5, None, "")]
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    model = quality.fit(docs, known)
    scored = quality.score(docs, model)
    assert scored.columns == [c for c in docs.columns if c != "score"] + ["score"]
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 4 != 1) for r in scored.collect())
    harm = toxicity.fit(docs, known)
    assert all((r["score"] >= 0.3) == (r["doc_id"] % 5 == 0) for r in toxicity.score(docs, harm).collect())
    assert set(bad) <= set(harm.terms)
    assert harm.evidence(["a mworonic word", 'he said "moronic" twice', "moronic", ""]).astype(bool).tolist() == [
        [False, False, True, False], [False, True, False, False], [True, False, False, False], [False] * 4]
    for module, fitted in ((quality, model), (toxicity, harm)):
        got = module.score(odd, fitted).collect()
        assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
        assert module.score(none, fitted).count() == 0
        for some in (known.limit(0), known.where("quality = 1 and toxic = 0")):
            assert all(0 <= r["score"] <= 1 for r in module.score(odd, module.fit(docs, some)).collect())


# --- 5 Jaccard ---

def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_jaccard_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(8)
    rows = []
    for g in range(6):
        base = words(rng, 100).split()
        for j in range(30 if g == 0 else 4):
            own = list(base)
            for _ in range(j % 4):
                own[rng.randrange(100)] = "q" + str(rng.randrange(10 ** 6))
            rows.append((len(rows) * 3, " ".join(own)))
    rows += [(1000 + k, words(rng, 50)) for k in range(20)]
    sets = {i: shingles(t) for i, t in rows}
    linked = {i: {j for j in sets if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}
    least = {i: i for i in sets}
    for _ in sets:
        least = {i: min([least[i], *(least[j] for j in linked[i])]) for i in sets}
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.join(frame(spark, rows)).collect()}
    assert got == {i: (least[i], len(linked[i])) for i in sets}
    kept = jaccard.keep_one(frame(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))


def test_jaccard_odd(spark, odd, odd_rows, none):
    got = [(r["doc_id"], r["copy_id"], r["class_id"], r["n_links"]) for r in jaccard.join(odd).collect()]
    assert len(got) == len(odd_rows)
    assert {(1, 1, 1, 0), (2, 2, 2, 0), (3, 3, 3, 0), (4, 4, 4, 1), (5, 4, 4, 1), (7, 7, 7, 3), (9, 7, 7, 3), (8, 8, 7, 3), (None, 7, 7, 3), (None, None, None, 0)} <= set(got)
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and {r["did"] for r in kept.collect()} == {7}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 6, None, None, 10, 11, 12, -3]))
    assert jaccard.join(none).count() == 0 and jaccard.keep_one(none).count() == 0


# --- 6 language model ---

def test_language_model(spark, odd, odd_rows, none, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_CHARS", 20_000)
    got = lm.score(odd.withColumn("held_out", F.col("doc_id") % 3 == 1), order=3).collect()
    train, low = [], bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    tokens = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode("utf-8", "replace").translate(low)) + [b" "]) for i, t in odd_rows]
    train = [w for i, w in tokens if i is None or i % 3 != 1]
    counts = [Counter(tuple(([b" "] + w)[max(0, k + 2 - n):k + 2]) for w in train for k in range(len(w))) for n in (1, 2, 3)]
    total, kinds = sum(counts[0].values()), len(counts[0])

    def probability(context, word):
        p = (counts[0][word,] + 0.5) / (total + 0.5 * (kinds + 1))
        for n in range(1, len(context) + 1):
            own = tuple(context[-n:])
            seen = counts[0][own] if own == (b" ",) or n == 1 else counts[n - 1][own]
            if seen:
                share = seen / (seen + lm.SMOOTH)
                p = share * counts[n][(*own, word)] / seen + (1 - share) * p
        return p

    want = []
    for _, w in tokens:
        run = [b" "] + w
        want.append((len(w), sum(np.log10((counts[0][x,] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w),
                     sum(np.log10(probability(run[max(0, k - 1):k + 1], w[k])) for k in range(len(w)))))
    assert sorted((r["n_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == sorted((n, round(b, 6), round(s, 6)) for n, b, s in want)
    assert {r["train_tokens"] for r in got} == {total}
    assert lm.score(none.withColumn("held_out", F.lit(False))).count() == 0
    assert lm.score(odd.withColumn("held_out", F.lit(True))).agg(F.max("n_known"), F.max("train_tokens")).first() == (0, 0)


# --- 7 chat ---

def test_chat(spark, monkeypatch):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "</s>[INST] ok [/INST]\\"), (1, 2, "assistant", ""), (1, 3, "user", "\\</s>\\\\<s"), (2, 0, None, None),
            (None, 0, "assistant", "x<s>y[/INST"), (3, None, "user", "q"), (3, 1, "assistant", "🙂\n[INST]"), (3, 1, "assistant", "🙂\n[INST]"), (4, 5, "as[INST]sistant ", "[/INST]")]
    rows += [(5, k, ["user", "assistant"][k % 2], f"t{k}<s>") for k in range(150)]
    made = chat.format_examples(spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, example string, n_turns int"))
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert made.where("conv_id = 5").count() == 75 and made.where("conv_id = 1").count() == 3
    texts = [r["text"] for r in made.where("conv_id = 1").collect()]
    assert all(t.count("</s>") == t.count("[INST]") == t.count("[/INST]") == t.count("<s>") for t in texts)
    assert chat.format_examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- 8 packing and 9 token files ---

def ids_of(name, rows):
    found = Tokenizer.from_file(public_tokenizers.path(name)).encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    return [np.array([*e.ids, 2], "<u4") for e in found]


def test_packing(odd, odd_rows, none, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_TOKENS", 1000)
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(odd, path, 2, size=256).toPandas()
    sequences = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert all(s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] for _, s in sequences)
    totals = sequences["length"].sum()
    assert all(t <= 256 and t & (t - 1) == 0 for t in totals) and (totals == 256).sum() > 20
    want = Counter(zlib.crc32(i.tobytes()) for i in ids_of("word_bpe_49k.json", odd_rows))
    whole = {}
    for r in got.sort_values("start").itertuples():
        whole.setdefault((str(r.doc_id), r.doc_tokens), []).append(r)
    assert got["length"].sum() == sum(len(i) for i in ids_of("word_bpe_49k.json", odd_rows))
    single = [p for p in whole.values() if sum(x.length for x in p) == p[0].doc_tokens]
    assert all(want[zlib.crc32(b"".join(x.ids for x in p))] for p in single) and len(single) >= 10
    assert packing.pack(none, path, 2).count() == 0


def test_token_files(spark, odd, odd_rows, none, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 500)
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_tokens(odd, str(tmp_path / "a"), path, 2)
    got = sorted(token_files.read_documents(spark, str(tmp_path / "a")).collect(), key=lambda r: r["start"])
    known = [r["doc_id"] for r in got]
    assert known[:2] == [None, None] and known[2:] == sorted(i for i, _ in odd_rows if i is not None)
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    ids = ids_of("byte_bpe_50k.json", odd_rows)
    assert sorted(bytes(r["ids"]) for r in got) == sorted(i.tobytes() for i in ids)
    flat = np.concatenate([np.frombuffer(bytes(r["ids"]), "<u4") for r in got])
    assert token_files.read_span(spark, str(tmp_path / "a"), 490, 1530).tolist() == flat[490:1530].tolist()
    token_files.write_tokens(none, str(tmp_path / "b"), path, 2)
    assert token_files.read_documents(spark, str(tmp_path / "b")).count() == 0


# --- pipeline ---

def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    good = [(k, "\n".join(words(rng, 25) for _ in range(3))) for k in range(60)]
    junk = [(100 + k, " ".join(w.upper() + "!!" for w in words(rng, 60).split())) for k in range(30)]
    leak = words(rng, 30)
    copies = [(200 + k, good[k][1]) for k in range(5)]
    leaks = [(300 + k, words(rng, 30) + " " + leak + " " + words(rng, 30)) for k in range(2)]
    rows = [(i, t, "en", "s", len(t)) for i, t in good + junk + copies + leaks]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in good[:40] + junk[:20]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(sorted({r["doc_id"] for r in docs.select("doc_id").collect()}))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = [k for k, _ in good]
    assert seen[0] == kept + [200 + k for k in range(5)] + [300, 301]
    assert seen[1] == seen[2] == kept + [300, 301] and seen[3] == seen[4] == kept
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == 60
