"""Aho-Corasick over word numbers, shared by the decontamination and licence scans.

Patterns are tuples of words.  Their distinct words get numbers from 1; a text becomes the
sequence of its words' numbers with 0 for any other word, and the automaton walks that
sequence.  Runs of numbered words shorter than the shortest pattern cannot hold a match and
are skipped before the automaton is asked; this drops no match.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from tallyforge.llm.words import hash_word


class PhraseIndex:
    """``patterns``: (words, value) pairs; equal word tuples may occur with several values."""

    def __init__(self, patterns: Iterable[tuple[tuple[str, ...], object]]) -> None:
        import ahocorasick

        by_words: dict[tuple[str, ...], list] = {}
        for ws, value in patterns:
            if ws:
                by_words.setdefault(tuple(ws), []).append(value)
        vocabulary = sorted({w for ws in by_words for w in ws})
        hashes = np.array([hash_word(w) for w in vocabulary], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], (order + 1).astype(np.int64)
        number = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.shortest = min(map(len, by_words), default=1)
        self.automaton = None
        if by_words:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for ws, values in by_words.items():
                self.automaton.add_word(tuple(number[w] for w in ws), (len(ws), values))
            self.automaton.make_automaton()

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers of a hash array, 0 where the word is in no pattern."""
        if not len(self.hashes) or not len(hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, self.numbers[at], 0)

    def matches(self, numbers: np.ndarray, text_of: np.ndarray) -> Iterator[tuple[int, int, list]]:
        """(first word, end word, values) of every occurrence; none crosses texts."""
        if self.automaton is None or not len(numbers):
            return
        known = numbers > 0
        cut = np.ones(len(numbers) + 1, dtype=bool)
        cut[1:-1] = (known[1:] != known[:-1]) | (text_of[1:] != text_of[:-1])
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        for s, e in zip(*(x[known[starts] & (ends - starts >= self.shortest)].tolist() for x in (starts, ends)), strict=True):
            for last, (n, values) in self.automaton.iter(tuple(numbers[s:e].tolist())):
                yield s + last - n + 1, s + last + 1, values
