"""Noisy-channel restoration of disguised words.

A disguised word is a lattice: each character may stand for itself, for letters that
it resembles, or for nothing; runs of a letter for one or two of it; letters written
apart may belong together.  Viterbi search finds the letters that are likeliest under
a trigram model of characters and the channel's weights."""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Symbols of the model: the boundary 0, letters 1..26, any other character 27.
OTHER = len(LETTERS) + 1
SYMBOLS = OTHER + 1
NUMBER = {c: i + 1 for i, c in enumerate(LETTERS)}

# What signs and digits are customarily written for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
         "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "aeiou", "€": "e", "£": "l"}
SEPARATORS = ".-_*~'/\\"
EDGES = ".,;:?\"'()[]{}<>*#%&~`^=_-/\\|!$+@"
LEADING = "".join(c for c in EDGES if c not in "@$!+(")
KEPT_OTHER = log(0.02)
CUT = log(0.5)
BREAK = log(0.02)
#: Weights of one and of two letters for a run of two, and of three or more.
ONCE_TWICE = {2: (log(0.1), log(0.9)), 3: (log(0.7), log(0.3))}


def symbols_of(word: str) -> list[int]:
    return [NUMBER.get(c, OTHER) for c in word]


def trigram_logs(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b) from counts[a, b, c], drawn towards bigrams and single symbols."""
    one = counts.sum((0, 1)) + 1.0
    one = one / one.sum()
    two = counts.sum(0) + 5 * one
    two = two / two.sum(-1, keepdims=True)
    three = counts + 5 * two[None]
    return np.log(three / three.sum(-1, keepdims=True))


def count_symbols(words: pa.Array, times: np.ndarray) -> np.ndarray:
    """Trigram counts of words of plain letters, each between boundaries."""
    plain = pc.match_substring_regex(words, "^[a-z]+$").to_numpy(zero_copy_only=False)
    some = words.filter(pa.array(plain))
    out = np.zeros(SYMBOLS ** 3)
    if not len(some):
        return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    joined = "  ".join(some.to_pylist()) + " "
    code = np.frombuffer(("  " + joined).encode(), np.uint8).astype(np.int64)
    code = np.where(code == 32, 0, code - 96)
    length = pc.binary_length(some).to_numpy(zero_copy_only=False)
    weight = np.repeat(times[plain], length + 2)
    key = (code[:-2] * SYMBOLS + code[1:-1]) * SYMBOLS + code[2:]
    weight = weight[:len(key)]
    keep = ~((code[1:-1] == 0) & (code[2:] == 0))
    return np.bincount(key[keep], weight[keep], SYMBOLS ** 3).reshape(SYMBOLS, SYMBOLS, SYMBOLS)


class Restorer:
    """Restores words under given trigram logs; remembers what it has restored."""

    def __init__(self, logs: np.ndarray, memory: int = 200_000):
        self.logs = logs.tolist()
        self.memory = memory
        self.known: dict[tuple[str, bool], list[str]] = {}

    def __call__(self, word: str, apart: bool = False) -> list[str]:
        """The words that a disguised word, or a run of single characters, stands for."""
        key = (word, apart)
        if key not in self.known:
            if len(self.known) >= self.memory:
                self.known.clear()
            self.known[key] = self._search(word, apart)
        return self.known[key]

    def _steps(self, word: str):
        """For each run of a character: (symbols, log weight) of what it may stand for."""
        at = 0
        while at < len(word):
            end = at
            while end < len(word) and word[end] == word[at]:
                end += 1
            c, run = word[at], min(end - at, 3)
            at = end
            if c in NUMBER:
                likes, kept = [(NUMBER[c], 0.0)], []
            else:
                looks = LOOKS.get(c, "")
                likes = [(NUMBER[x], log(0.8 / len(looks))) for x in looks]
                kept = [((OTHER,), KEPT_OTHER)]
                if c in SEPARATORS:
                    kept.append(((), CUT))
                    kept.append(((0,), BREAK))
            once, twice = ONCE_TWICE.get(run, (0.0, None))
            out = [((s,), w + once) for s, w in likes] + kept
            if twice is not None:
                out += [((s, s), w + twice) for s, w in likes]
            yield out

    def _search(self, word: str, apart: bool) -> list[str]:
        logs = self.logs
        best = {(0, 0): (0.0, None)}
        for step in self._steps(word):
            after: dict = {}
            for (a, b), (value, path) in best.items():
                for symbols, weight in step:
                    for broken in ((False, True) if apart and b else (False,)):
                        x, y, total, way = a, b, value + weight + (BREAK if broken else 0.0), path
                        for s in ((0, *symbols) if broken else symbols):
                            if s == 0 and y == 0:
                                continue
                            # a boundary counts as the two that stand between words
                            total += logs[x][y][s]
                            x, y = (0, 0) if s == 0 else (y, s)
                            way = (way, s)
                        old = after.get((x, y))
                        if old is None or total > old[0]:
                            after[(x, y)] = (total, way)
            best = after
        ends = [(value + (logs[a][b][0] if b else 0.0), path) for (a, b), (value, path) in best.items()]
        path = max(ends, key=lambda e: e[0])[1]
        found = []
        while path is not None:
            path, s = path
            found.append(s)
        text = "".join(" " if s == 0 else "?" if s == OTHER else LETTERS[s - 1] for s in reversed(found))
        return [w for w in text.split() if "?" not in w]


TRIPLES = "|".join(c * 3 for c in LETTERS)


def cores(words: pa.Array) -> pa.Array:
    """Words without signs at their edges; a leading sign that can be a letter stays."""
    return pc.utf8_rtrim(pc.utf8_ltrim(words, LEADING), EDGES)


def disguised(core: pa.Array) -> np.ndarray:
    """Which words mix letters with other characters, or repeat a letter thrice."""
    odd = pc.match_substring_regex(core, r"[0-9@$!|+(*€£._~-]")
    letters = pc.match_substring_regex(core, "[a-z]")
    return pc.or_(pc.and_(odd, letters), pc.match_substring_regex(core, TRIPLES)).to_numpy(zero_copy_only=False)


def single(core: pa.Array) -> np.ndarray:
    """Which words are one letter, or one sign that may stand for one."""
    return pc.match_substring_regex(core, r"^[a-z0-9@$!|+(*€£]$").to_numpy(zero_copy_only=False)
