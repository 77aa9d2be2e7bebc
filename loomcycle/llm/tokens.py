"""Token ids of whole texts by a public word-level BPE vocabulary, with a cache of words.

Pieces between the pre-tokenizer's cuts are encoded independently, so equal words need encoding once.
The quick path holds for texts of Latin characters without special-token strings, where splitting and
lower-casing here give just what the tokenizer's own steps give; every other text goes to the tokenizer
whole. Tests hold both against each other.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import regex

#: The pre-tokenizer's pattern in the vocabulary file.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[^\s\w]+|_+")
_OTHER = re.compile(r"[^\x09-\x0d\x20-\x7e¡-ſ]|<\|")
#: Signs and numerals among Latin-1 where the classes of the two regex engines could differ.
_ODD = re.compile(r"[_ª²³µ¹º¼-¾İſ]")
CACHE_WORDS = 1_000_000
_GROUP = 64

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core


class WordTokenizer:
    """encode(texts) gives an array of ids for each text; nothing is added or cut.

    A known word is a number; its ids are a stretch of one flat array. New words are encoded many at a
    time, joined by spaces: every word's last id, and no other, is one that ends a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        vocab = self.whole.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.slow = regex.compile(WORD)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 20, np.uint32), 0
        self.start, self.size = np.empty(CACHE_WORDS, np.int64), np.empty(CACHE_WORDS, np.int32)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, words: list[str]) -> None:
        ids = self._ids(" ".join(words))
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(words) or (len(ids) and last[-1] != len(ids) - 1):
            parts = [self._ids(w) for w in words]
            ids, last = np.concatenate(parts), np.cumsum([len(x) for x in parts]) - 1
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        n = len(self.number)
        size = np.diff(last, prepend=-1)
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n : n + len(words)] = self.used + last + 1 - size
        self.size[n : n + len(words)] = size
        self.used += len(ids)
        self.number.update(zip(words, range(n, n + len(words))))

    def _words(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text).lower()
        return (self.slow if _ODD.search(text) else _PLAIN_WORD).findall(text)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """-1 for unknown words."""
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int32, len(words))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for at in range(0, len(texts), _GROUP):
            group = texts[at : at + _GROUP]
            split = [None if _OTHER.search(t) else self._words(t) for t in group]
            known = [None if w is None else self._numbers(w) for w in split]
            missing = {w[i] for w, n in zip(split, known) if w is not None for i in np.flatnonzero(n < 0).tolist()}
            if len(self.number) + len(missing) > CACHE_WORDS:
                missing = set(chain.from_iterable(w for w in split if w))
                self._forget()
                if len(missing) > CACHE_WORDS:  # texts with a million different words
                    out += [self._ids(t) for t in group]
                    continue
                known = [None] * len(split)
            if missing:
                self._learn(sorted(missing))
            for text, words, number in zip(group, split, known):
                if words is None:
                    out.append(self._ids(text))
                    continue
                number = self._numbers(words) if number is None else number
                for i in np.flatnonzero(number < 0).tolist():
                    number[i] = self.number[words[i]]
                size = self.size[number]
                place = np.repeat(self.start[number] - np.cumsum(size) + size, size)
                place += np.arange(len(place))
                out.append(self.flat[place])
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker."""
    return WordTokenizer(path)
