"""Quality rules by compression bands.

Text that says the same again compresses far better than prose of its length, and keys, encoded files or noise far worse. The
zstandard ratio (compressed over plain bytes) is taken for the whole document and for its chunks of CHUNK bytes, and held
against limits that depend on the length, since short texts compress less. A document goes where its own ratio leaves its
band, or where chunks with more than CHUNK_SHARE of its bytes leave theirs: a passage of noise in a long document does not show in
the whole, repetition over long distances does not show in a chunk.

Beside this stand plain counts of words, symbols, repeated lines and words in repeated windows, with two base rules.
Words are runs of characters other than ASCII white space; windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doppel.llm.batches import free, slices
from doppel.llm.words import Words, mix, ngrams

# From so many bytes on, ratios from low to high are those of prose. Prose of one-byte scripts lies near 0.64 at 256 bytes, 0.51 at
# 1024 and 0.42 at 16384, multi-byte scripts lower; base64 stays above 0.75 and random bytes near 1.
BANDS = ((128, 0.30, 0.95), (256, 0.28, 0.88), (512, 0.26, 0.80), (1024, 0.24, 0.74), (4096, 0.20, 0.70), (16384, 0.18, 0.68), (65536, 0.16, 0.68))
CHUNK = 4096
CHUNK_SHARE = 0.2
LEVEL = 3
WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
SPACE = "\t\n\v\f\r "
FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
          "ratio double, n_chunks long, n_odd_chunks long, odd_share double")


class Bands:
    """Ratios of a text and its chunks against limits by length."""

    def __init__(self, bands=BANDS, chunk: int = CHUNK, level: int = LEVEL):
        rows = sorted(bands)
        self.least = np.array([b[0] for b in rows])
        self.low, self.high = [b[1] for b in rows], [b[2] for b in rows]
        self.chunk = chunk
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False)

    def ratio(self, raw: bytes | memoryview) -> float:
        return len(self.zstd.compress(raw)) / len(raw) if len(raw) else 1.0

    def odd(self, size: int, ratio: float) -> bool:
        """Does a text of that size leave its band? Texts below the least size have none."""
        at = int(np.searchsorted(self.least, size, "right")) - 1
        return at >= 0 and not self.low[at] <= ratio <= self.high[at]

    def judge(self, raw: bytes) -> tuple[float, bool, int, int, float]:
        """Ratio, whether it leaves its band, chunks, chunks that leave theirs, and their share of the bytes."""
        whole = self.ratio(raw)
        if len(raw) <= self.chunk:  # its only chunk is itself
            odd = self.odd(len(raw), whole)
            return whole, odd, int(len(raw) > 0), int(odd), float(odd)
        view, odd_bytes, odd_chunks = memoryview(raw), 0, 0
        for start in range(0, len(raw), self.chunk):
            part = view[start:start + self.chunk]
            if self.odd(len(part), self.ratio(part)):
                odd_bytes += len(part)
                odd_chunks += 1
        return whole, self.odd(len(raw), whole), -(-len(raw) // self.chunk), odd_chunks, odd_bytes / len(raw)


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    held = [line for line in text.split("\n") if line.strip(SPACE)]
    return len(held) - len(set(held))


def repeated_words(words: Words, window: int = WINDOW) -> np.ndarray:
    """For each text, words in windows of so many words that the text holds twice or more, the first included."""
    grams, made = ngrams(words.hashes, words.counts, window, short=False)
    text = np.repeat(np.arange(len(made)), made)
    keys = mix(grams + (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    twice = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(keys) else order
    first = np.cumsum(words.counts) - words.counts
    place = np.arange(len(grams)) - np.repeat(np.cumsum(made) - made, made)
    at = first[text[twice]] + place[twice]
    steps = np.bincount(at, minlength=len(words.hashes) + 1) - np.bincount(at + window, minlength=len(words.hashes) + 1)
    held = np.cumsum(steps)[:len(words.hashes)] > 0
    return np.bincount(words.docs[held], minlength=len(words.counts)).astype(np.int64)


def counted(texts: list[str]) -> dict[str, np.ndarray]:
    """The plain counts of some texts."""
    words = Words(texts, lower=False)
    data = np.frombuffer(words.raw, np.uint8)
    ends = np.cumsum([len(t.encode("utf-8", "replace")) + 1 for t in texts])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    symbol, letter = np.zeros(256, np.int64), np.ones(256, np.int64)
    symbol[list(SYMBOLS)] = 1
    letter[[ord(c) for c in SPACE]] = 0
    letter[0x80:0xC0] = 0  # later bytes of a character
    return {
        "n_words": words.counts.astype(np.int64), "word_chars": np.add.reduceat(letter[data], starts), "n_symbols": np.add.reduceat(symbol[data], starts),
        "n_dup_lines": np.array([repeated_lines(t) for t in texts], np.int64), "n_repeat_words": repeated_words(words)}


def rules(text: Column, bands=BANDS, chunk: int = CHUNK, chunk_share: float = CHUNK_SHARE, level: int = LEVEL) -> Column:
    """A struct of FIELDS for a column of texts; see judged()."""
    def work(column: pd.Series) -> pd.DataFrame:
        judge, out = Bands(bands, chunk, level).judge, []
        for part in slices([pd.DataFrame({"text": column})]):
            found = part["text"].tolist()
            made = pd.DataFrame(counted(found))
            made["base_failed"] = (made["n_words"] < LEAST_WORDS) | (100 * made["n_repeat_words"] > REPEAT_PERCENT * made["n_words"])
            ratio, odd, chunks, odd_chunks, share = zip(*[judge(t.encode("utf-8", "replace")) for t in found])
            made["kept"] = ~made["base_failed"] & ~np.array(odd) & (np.array(share) <= chunk_share)
            out.append(made.assign(ratio=ratio, n_chunks=chunks, n_odd_chunks=odd_chunks, odd_share=share))
        names = [f.split()[0] for f in FIELDS.split(", ")]
        return pd.concat(out, ignore_index=True)[names] if out else pd.DataFrame({n: [] for n in names})

    return F.pandas_udf(work, FIELDS)(text.cast("string"))


def judged(docs: DataFrame, out: str | None = None, text: str = "text", **limits) -> DataFrame:
    """The documents with a struct column `out` (FIELDS; by default `rules`, with underscores where that name is taken).

    A null text counts as empty: no words, ratio 1, not kept. Whole texts are read, of any length. Every row is judged by itself, so
    repeated rows and rows without an id have the same result each, and an empty table gives no rows. A ratio on a limit is within it.
    """
    return docs.withColumn(out or free(docs, "rules"), rules(F.col(f"`{text}`"), **limits))


def keep(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The documents that pass the base rules and the bands, with the columns they had."""
    name = free(docs, "rules")
    return judged(docs, name, text, **limits).where(F.col(f"{name}.kept")).drop(name)
