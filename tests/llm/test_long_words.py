"""Words longer than any term."""

from __future__ import annotations

from doppel.llm.toxicity import LONGEST, NEAR, TrieAutomaton


def test_long_words_match_by_their_beginning():
    term = "b" * LONGEST
    automaton = TrieAutomaton({term: 0.9}, {"grim": 0.8}, {term})
    got = automaton.match(["grim" + "m" * 200, "g" * 300, term, term + "x", term + "xy", term + "b" * 100]).tolist()
    assert got == [0.8, 0.0, 0.9, NEAR, 0.0, 0.0]
