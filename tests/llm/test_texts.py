"""Helpers on texts: words, token ids, bits, edit distance, trie automaton."""

import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from doppel.llm import lines, token_files
from doppel.llm.packing import balance, capacities
from doppel.llm.tokens import Encoder
from doppel.llm.toxicity import NEAR, TrieAutomaton, is_quoted
from doppel.llm.words import Words, ngrams

NASTY = st.text(st.sampled_from([*" \n\tab.,|'sé́ßİ中\x1c\x85 ", "🙂"]), max_size=14)


@pytest.fixture(scope="module", params=["byte_bpe_50k", "word_bpe_49k"])
def encoder(request):
    return Encoder(public_tokenizers.path(f"{request.param}.json"))


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), NASTY, st.text(max_size=20)), max_size=4))
def test_pieces_give_the_ids_of_whole_texts(encoder, texts):
    want = [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids.tolist() for ids in encoder.encode(texts)] == want


def test_control_strings_and_a_full_memory(encoder, monkeypatch):
    monkeypatch.setattr("doppel.llm.tokens.REMEMBERED", 2)
    texts = ["<|endoftext|> a<|endoftext|>b word, word.\nWord", "one two three four five", "", "six\nseven, eight. " * 50]
    for _ in range(3):
        assert [ids.tolist() for ids in encoder.encode(texts)] == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(ids=st.lists(st.integers(0, 2 ** 11 - 1), max_size=40), bits=st.integers(11, 32), cut=st.tuples(st.integers(0, 40), st.integers(0, 40)))
def test_bits_round_trip(ids, bits, cut):
    payload = token_files.pack_bits(np.array(ids, np.uint32), bits)
    assert len(payload) == -(-len(ids) * bits // 8)
    low, high = sorted(min(c, len(ids)) for c in cut)
    assert token_files.unpack_bits(payload, bits, low, high).tolist() == ids[low:high]


@settings(max_examples=200, deadline=None)
@given(a=st.text("abc", max_size=12), b=st.text("abc", max_size=12))
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    assert lines.distance(a, b) == row[-1]
    if a or b:
        assert lines.similar(a, b, 0.8) == (1 - row[-1] / max(len(a), len(b)) >= 0.8 - 1e-9)


def test_words_and_runs():
    texts = ["One  two\tTHREE", "", "one two", "ÉÉ\x0b\x0cb\x1cc", "x"]
    words = Words(texts)
    want = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()) for t in texts]
    assert words.counts.tolist() == [len(w) for w in want]
    flat = [w for own in want for w in own]
    assert [words.word(i) for i in range(len(flat))] == flat
    assert len(set(words.hashes.tolist())) == len(set(flat)) and words.hashes[0] == words.hashes[3]
    grams, counts = ngrams(words.hashes, words.counts, 2)
    assert counts.tolist() == [2, 0, 1, 1, 1] and grams[0] == grams[2] and len(set(grams.tolist())) == 4
    assert Words([]).hashes.tolist() == [] and Words([""]).counts.tolist() == [0]


def test_trie_automaton_finds_one_edit():
    automaton = TrieAutomaton({"moron": 0.9, "fox": 0.5}, {"lowei": 0.8}, {"moron"})
    words = ["moron", "moronn", "mron", "moran", "oron", "amoron", "mroon", "marn", "fox", "foxx", "loweixyz", "lowe", "", "x" * 60]
    assert automaton.match(words).tolist() == [0.9, NEAR, NEAR, NEAR, NEAR, NEAR, 0, 0, 0.5, 0, 0.8, 0, 0, 0]
    assert TrieAutomaton({}, {}, set()).match(["a"]).tolist() == [0]


def test_quotation_window():
    text = 'he said "you moron now" and left'
    assert is_quoted(text, text.index("moron"), text.index("moron") + 5)
    assert not is_quoted("you moron", 4, 9) and is_quoted("«a moron»", 3, 8) and not is_quoted("«a» moron «b»", 4, 9)


@settings(max_examples=100, deadline=None)
@given(lengths=st.lists(st.integers(0, 60), max_size=12))
def test_sequences_are_full_and_pieces_disjoint(lengths):
    room = capacities(sum(lengths), 16)
    assert all(r == 16 or r & (r - 1) == 0 for r in room.tolist()) and room.sum() == sum(lengths)
    pieces = balance(lengths, room, 1.0, 0.01)
    for k, n in enumerate(lengths):
        own = sorted((s, m) for d, s, m, _, _ in pieces if d == k)
        assert [s for s, _ in own] == np.cumsum([0, *(m for _, m in own)])[:-1].tolist() and sum(m for _, m in own) == n
    for q, size in enumerate(room.tolist()):
        own = sorted((o, m) for _, _, m, s, o in pieces if s == q)
        assert [o for o, _ in own] == np.cumsum([0, *(m for _, m in own)])[:-1].tolist() and sum(m for _, m in own) == size


@settings(max_examples=200, deadline=None)
@given(text=st.text(st.sampled_from([*"ab c\t\n.5é🙂中"]), max_size=40))
def test_lengths_of_lines_count_characters(text):
    """Lines are compared by their characters, whatever bytes these take."""
    text_of, number, _, length, _ = lines.described([text])
    normal = [b" ".join(x.split()).decode() for x in lines.normal_lines(text)]
    assert length.tolist() == [len(normal[n]) for n in number]


def test_lines_of_like_length_meet():
    """Of 100 and 80 characters, a fifth apart, but not of 100 and 79."""
    sims = np.zeros((3, lines.WORDS), np.uint64)
    for short, joined in ((80, True), (79, False)):
        up = np.arange(2)
        lines._close(sims[:2], np.zeros(2, np.int64), np.array([short, 100]), 10, up, 0.8)
        assert (up[1] == 0) == joined
