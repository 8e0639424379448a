"""Token ids of whole texts by a public tokenizer file, with each distinct word encoded once.

The tokenizers library spends its time on words it has seen before. A text may be cut in front of a space
without changing its ids where the pre-tokenizer always starts a new word there, so a batch is cut at spaces. A piece made of
words of Latin letters, each with any marks after it, on one line or several, is cut further: words and marks are told apart by
64-bit hash and length, all with numpy, and new words are encoded by the library, many in one call. Other pieces are looked up as
they are. Ids of a batch are gathered from all parts at once. A cut inside a run of white space could change ids; a text that has one is given to the library whole.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from doppel.llm.words import Spans

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)  # neither letter nor digit nor white space nor control
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
# Pieces remembered in a Python worker before it starts afresh; bounds memory, changes no ids.
REMEMBERED = 750_000


class _Store:
    """Ids of numbered entries, back to back, in arrays that grow."""

    def __init__(self):
        self.start, self.size, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.n = self.used = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of the new entries."""
        first, at = self.n, self.used
        self.n, self.used = first + len(sizes), at + len(ids)
        if self.n > len(self.start):
            self.start, self.size = (np.concatenate([x[:first], np.zeros(self.n, np.int64)]) for x in (self.start, self.size))
        if self.used > len(self.ids):
            self.ids = np.concatenate([self.ids[:at], np.zeros(self.used, np.uint32)])
        self.start[first:self.n], self.size[first:self.n] = at + np.cumsum(sizes) - sizes, sizes
        self.ids[at:self.used] = ids
        return np.arange(first, self.n)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of entries one after another, and how many each has."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        at = np.repeat(self.start[numbers] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.ids[at], size


class _Known:
    """Entries of words by hash."""

    def __init__(self):
        self.hashes, self.lengths, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers, or -1; a word of another length is another word."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.hashes, hashes).clip(max=len(self.hashes) - 1)
        return np.where((self.hashes[at] == hashes) & (self.lengths[at] == lengths), self.numbers[at], -1)

    def add(self, hashes: np.ndarray, lengths: np.ndarray, numbers: np.ndarray) -> None:
        """Hashes in ascending order; one that is taken by a word of another length is left out."""
        at = np.searchsorted(self.hashes, hashes)
        if len(self.hashes):
            free = self.hashes[at.clip(max=len(self.hashes) - 1)] != hashes
            at, hashes, lengths, numbers = at[free], hashes[free], lengths[free], numbers[free]
        self.hashes, self.lengths, self.numbers = (np.insert(x, at, y) for x, y in (
            (self.hashes, hashes), (self.lengths, lengths), (self.numbers, numbers)))


class _Cut:
    """The texts of a batch, cut at spaces and line breaks, as places in their bytes. A part begins with a word and ends in marks."""

    def __init__(self, texts: list[str], lower: bool):
        texts = [t.encode("utf-8", "replace") for t in texts]
        self.raw = b" ".join(texts) + b" "
        data = np.frombuffer(self.raw.translate(_LOWER) if lower else self.raw, np.uint8)
        lead = np.flatnonzero(data[:-1] == 0xC3)  # of letters of two bytes
        second = data[lead + 1]
        if lower:
            # Capital letters: the same lead, the second byte 32 further.
            capital = lead[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)] + 1
            if len(capital):
                data = data.copy()
                data[capital] += 32
        self.data = data
        self.end = np.flatnonzero((data == 0x20) | (data == 0x0A))
        self.start = np.concatenate([[0], self.end[:-1] + 1])
        self.broken = np.concatenate([[False], data[self.end[:-1]] == 0x0A])  # begins after a line break
        text_end = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        counts = np.diff(np.searchsorted(self.end, text_end), prepend=0)  # a text's last end lies one before its text_end
        self.first = np.cumsum(counts) - counts
        self.leads = np.zeros(len(self.start), bool)
        self.leads[self.first] = True
        letter = _LETTER[data]
        two = lead[(second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)]
        letter[two] = letter[two + 1] = True
        stops = np.flatnonzero(~letter)
        self.stem = stops[np.searchsorted(stops, self.start)]
        other = np.zeros(len(data) + 1, np.int32)
        np.cumsum(~_MARK[data], out=other[1:])
        plain = (self.stem > self.start) & (other[self.end] == other[self.stem])
        self.piece = np.flatnonzero(~self.broken)  # first parts of pieces between spaces
        self.simple = np.logical_and.reduceat(plain, self.piece)  # pieces
        self.plain = np.repeat(self.simple, np.diff(np.append(self.piece, len(plain))))  # parts
        self.hashes = Spans(data)

    def texts(self, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


class Encoder:
    """Ids of texts as `Tokenizer.encode(text, add_special_tokens=False)` gives them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # Bytes are kept one for one: words can be told apart by the length of their ids.
        self.lossless = spec.get("normalizer") is None and spec["pre_tokenizer"]["type"] == "ByteLevel"
        self.added = tuple(t["content"] for t in spec.get("added_tokens", []))
        self.width = np.zeros(self.vocabulary, np.int64)
        if self.lossless:
            for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
                self.width[i] = len(token.encode()) if token in self.added else len(token)
        # Else an id that closes a word ends in the model's mark, and case is dropped.
        self.closing = np.zeros(self.vocabulary, bool)
        suffix = self.tokenizer.model.end_of_word_suffix
        if suffix and not self.lossless:
            for token, i in self.tokenizer.get_vocab().items():
                self.closing[i] = token.endswith(suffix)
        self.line = self._whole(["\n"])[0]  # nothing where white space is dropped
        self.forget()

    def forget(self) -> None:
        """Start afresh: entry 0 is nothing, entry 1 a line break."""
        self.store = _Store()
        self.store.add(self.line, np.array([0, len(self.line)]))
        self.spaced, self.bare, self.marks = _Known(), _Known(), _Known()
        self.others: dict[bool, dict[bytes, int]] = {False: {}, True: {}}
        self.opens, self.closes = set(), set()  # entries that start or end with white space, or are empty

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[bytes], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each as it is after the space or the line break `lead`, and how many each has; many words in one call."""
        if not self.lossless:
            ids = self._whole([b" ".join(words).decode("utf-8")])[0]
            return ids, np.diff(np.flatnonzero(self.closing[ids]) + 1, prepend=0)
        ids = self._whole([lead + lead.encode().join(words).decode("utf-8")])[0]
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        stop = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1
        sizes = np.diff(stop, prepend=0)
        if lead == "\n":  # the break is an id of its own
            return np.delete(ids, stop - sizes), sizes - 1
        return ids, sizes

    def _apart(self, marks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self._whole([m.decode("utf-8") for m in marks])
        return np.concatenate(found), np.array([len(f) for f in found])

    def _numbers(self, cut: _Cut, known: _Known, starts: np.ndarray, ends: np.ndarray, encode) -> np.ndarray:
        """Entries of spans; new ones are encoded."""
        hashes, one, back = np.unique(cut.hashes(starts, ends), return_index=True, return_inverse=True)
        lengths = (ends - starts)[one]
        numbers = known.find(hashes, lengths)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            words = cut.texts(starts[one[new]], ends[one[new]])
            made = [encode(words[k:k + 1000]) for k in range(0, len(words), 1000)]
            numbers[new] = self.store.add(*(np.concatenate(x) for x in zip(*made)))
            known.add(hashes[new], lengths[new], numbers[new])
        out = numbers[back]
        for i in np.flatnonzero(lengths[back] != ends - starts).tolist():  # equal hashes of two words in one batch
            out[i] = self.store.add(*encode(cut.texts(starts[i:i + 1], ends[i:i + 1])))[0]
        return out

    def _other(self, cut: _Cut, at: np.ndarray, ends: np.ndarray, spaced: bool) -> list[int]:
        """Entries of whole pieces that hold something else than words and marks."""
        known, raw = self.others[spaced], cut.raw
        pieces = [raw[a:b] for a, b in zip(cut.start[at].tolist(), ends.tolist())]
        new = [p for p in dict.fromkeys(pieces) if p not in known]
        if new:
            texts = [p.decode("utf-8") for p in new]
            found = self._whole([(" " if spaced else "") + p for p in texts])
            numbers = self.store.add(np.concatenate(found), np.array([len(f) for f in found])).tolist()
            known.update(zip(new, numbers))
            self.opens.update(n for n, p in zip(numbers, texts) if not p or p[0].isspace())
            self.closes.update(n for n, p in zip(numbers, texts) if not p or p[-1].isspace())
        return [known[p] for p in pieces]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """One uint32 array per text; a null text is empty."""
        if self.store.n > REMEMBERED:
            self.forget()
        texts = [t or "" for t in texts]
        if not texts:
            return []
        cut = _Cut(texts, not self.lossless)
        numbers = np.zeros((len(cut.start), 3), np.int64)  # of each part a line break, a word or other piece, and marks
        bare = cut.plain & (cut.broken | cut.leads) if self.lossless else np.zeros(len(cut.plain), bool)
        numbers[cut.plain & cut.broken, 0] = 1
        for at, known, lead in ((np.flatnonzero(cut.plain & ~bare), self.spaced, " "), (np.flatnonzero(bare), self.bare, "\n")):
            if len(at):
                numbers[at, 1] = self._numbers(cut, known, cut.start[at], cut.stem[at], lambda words, lead=lead: self._words(words, lead))
        at = np.flatnonzero(cut.plain & (cut.end > cut.stem))
        if len(at):
            numbers[at, 2] = self._numbers(cut, self.marks, cut.stem[at], cut.end[at], self._apart)
        odd = np.flatnonzero(~cut.simple)
        last = cut.end[np.append(cut.piece[1:], len(cut.end)) - 1]  # ends of pieces
        for spaced in (False, True):
            mine = odd[cut.leads[cut.piece[odd]] != spaced]
            if len(mine):
                numbers[cut.piece[mine], 1] = self._other(cut, cut.piece[mine], last[mine], spaced)
        ids, sizes = self.store.gather(numbers.ravel())
        out = np.split(ids, np.cumsum(np.add.reduceat(sizes, 3 * cut.first))[:-1])
        if self.lossless and len(odd):
            opens, closes = (np.zeros(len(cut.piece), bool) for _ in range(2))
            found = numbers[cut.piece[odd], 1].tolist()
            opens[odd] = [n in self.opens for n in found]
            closes[odd] = [n in self.closes for n in found]
            begins = cut.leads[cut.piece]
            closes[begins & (last == cut.start[cut.piece])] = False  # an empty first piece has no character in front
            bad = cut.piece[np.flatnonzero(closes[:-1] & opens[1:] & ~begins[1:])]
            for i in np.unique(np.searchsorted(cut.first, bad, "right") - 1).tolist():
                out[i] = self._whole([texts[i]])[0]
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a Python worker, kept from batch to batch."""
    return Encoder(path)
