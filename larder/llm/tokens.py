"""Ids of whole texts by a public word BPE, word by word, with each worker remembering the words it has met.

The tokenizer drops white space and no token spans it, so a text's ids are those of its words in a row. A word's ids come
from the tokenizer itself; what is kept here is only a table from a word's hash to them.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from larder.llm.textbuf import BASES, Chunk, Spans, byte_codes

SLOTS = 1 << 20
ARENA = 1 << 22
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: ASCII signs that form a token of their own after a letter; the apostrophe may open a contraction, "<" a special token.
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<"]] = True


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class WordIds:
    """Ids of words; a bounded table that forgets a word when another one takes its slot."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(SLOTS, dtype=np.uint64)
        self.at = np.zeros(SLOTS, dtype=np.int64)
        self.size = np.zeros(SLOTS, dtype=np.int32)
        self.arena = np.zeros(ARENA, dtype=np.uint32)
        self.used = 0

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word: plain lower-case words go straight to the BPE model, all others through the whole tokenizer."""
        out: list[list[int] | None] = [None] * len(words)
        tokenize, letters, later = self.tokenizer.model.tokenize, self.letters, []
        for k, word in enumerate(words):
            if word.isascii():
                if word.isalpha() and word.islower():
                    out[k] = [t.id for t in tokenize(word.decode())]
                    continue
            else:
                text = word.decode()
                if text.isalpha() and max(text) < "ƀ" and text == text.lower() and unicodedata.is_normalized("NFC", text):
                    out[k] = [t.id for t in tokenize("".join([letters[b] for b in word]))]
                    continue
            later.append(k)
        if later:
            found = self.tokenizer.encode_batch_fast([words[k].decode() for k in later], add_special_tokens=False)
            for k, x in zip(later, found, strict=True):
                out[k] = x.ids
        return out

    def chunk(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk's texts, and where each text's begin (one entry more than there are texts)."""
        start, end, first = chunk.words()
        if not len(start):
            return np.empty(0, dtype=np.uint32), np.zeros(len(chunk) + 1, dtype=np.int64)
        data = chunk.data
        # a run of signs that ends a word and follows a letter is a token of its own, so "word," and "word" share an entry
        solid = np.where(_SIGN[data], 0, np.arange(1, len(data) + 1))
        np.maximum.accumulate(solid, out=solid)
        stem = np.maximum(solid[end - 1], start)
        cut = (stem > start) & (stem < end) & _LETTER[data[stem - 1]]
        odd = np.flatnonzero(data == ord("<"))
        raw = np.zeros(len(start), dtype=bool)
        if len(odd):
            raw[np.searchsorted(start, odd, side="right") - 1] = True
            cut &= ~raw
        parts = 1 + cut.astype(np.int64)
        where = np.cumsum(parts) - parts
        begin = np.empty(int(parts.sum()), dtype=np.int64)
        stop = np.empty_like(begin)
        begin[where], stop[where] = start, np.where(cut, stem, end)
        begin[where[cut] + 1], stop[where[cut] + 1] = stem[cut], end[cut]
        first = np.append(where, len(begin))[first]

        low = _LOWER[data]
        if raw.any():  # special tokens are matched with their case
            for k in np.flatnonzero(raw):
                low[start[k] : end[k]] = data[start[k] : end[k]]
        keys = Spans(byte_codes(BASES[0])[low], BASES[0]).hash(begin, stop) | np.uint64(1)
        slot = (keys >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)
        missing = np.flatnonzero(self.keys[slot] != keys)
        own = np.empty(0, dtype=np.int64)
        if len(missing):
            fresh, at, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            where = missing[at]
            ids = self.encode([low[a:b].tobytes() for a, b in zip(begin[where], stop[where], strict=True)])
            own = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            flat = np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=int(own.sum()))
        at, size = self.at[slot], self.size[slot].astype(np.int64)
        pool = self.arena
        if len(missing):
            if self.used + len(flat) > ARENA:
                hit = np.ones(len(keys), dtype=bool)
                hit[missing] = False
                old, self.arena = self.arena, np.zeros(max(ARENA, 2 * len(flat)), dtype=np.uint32)
                pool = np.concatenate((old[: self.used], flat))
                base = self.used
                self.keys[:], self.used = 0, 0
            else:
                pool, base = self.arena, self.used
            self.arena[self.used : self.used + len(flat)] = flat
            offsets = np.cumsum(own) - own
            at[missing], size[missing] = base + offsets[back], own[back]
            target = slot[where]
            self.keys[target], self.at[target], self.size[target] = fresh, self.used + offsets, own
            # of words that share a slot the last one written stays; key, place and size must be of the same word
            lost = self.keys[target] != fresh
            if lost.any():
                keep = ~lost
                self.at[target[keep]], self.size[target[keep]] = self.used + offsets[keep], own[keep]
            self.used += len(flat)
        total = np.cumsum(size)
        spread = np.arange(int(total[-1])) + np.repeat(at - (total - size), size)
        return pool[spread], np.append(0, total)[first]


_made: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One table per worker process and vocabulary."""
    if path not in _made:
        _made[path] = WordIds(path)
    return _made[path]
