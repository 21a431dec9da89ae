"""Token ids of whole texts by a byte-level BPE of the `tokenizers` library.

The common pattern of such tokenizers splits a text between letters or digits and other
signs and before a single space, so a text may be cut there, and the ids of the whole
are those of the pieces in order.  The pieces of a slice of rows are mostly words that
repeat: each different piece is given to the tokenizer once in a task and its ids are
gathered for all places where it stands.  White space of two characters or more is
never cut, nor are apostrophes or special tokens.  Tokenizers with another pattern get
whole texts."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa

from tickloom.llm.words import text_bytes

#: Pieces that a task remembers; it starts anew beyond.
REMEMBERED = 600_000

# UTF-8 of the white space beyond ASCII (U+0085, U+00A0, U+1680,
# U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000).
WIDE_TWO = np.array([0xC285, 0xC2A0])
WIDE_THREE = np.array([0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])
#: ASCII white space, the four separators that some patterns count as such included.
PLAIN = np.array([9 <= b <= 13 or 28 <= b <= 32 for b in range(256)])


APOSTROPHE = 39
ALNUM = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
SIGN = np.array([33 <= b <= 126 and b != APOSTROPHE for b in range(256)]) & ~ALNUM


def _single(data: np.ndarray) -> np.ndarray:
    """Positions of single spaces and line ends between characters that are not white space."""
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[(at > 0) & (at < len(data) - 1)]
    at = at[~PLAIN[data[at - 1]] & ~PLAIN[data[at + 1]]]
    # zeros around the text: a code of two or three bytes never starts or ends outside
    held = np.concatenate((np.zeros(3, np.uint8), data, np.zeros(3, np.uint8)))
    three, two, one, next_one, next_two, next_three = (held[at + 3 + k].astype(np.int32) for k in (-3, -2, -1, 1, 2, 3))
    before, after = two << 8 | one, next_one << 8 | next_two
    # most neighbours are ASCII: only the others can be wide
    maybe = np.flatnonzero((one >= 128) | (next_one >= 128))
    wide = np.zeros(len(at), bool)
    wide[maybe] = (np.isin(before[maybe], WIDE_TWO) | np.isin(after[maybe], WIDE_TWO)
                   | np.isin(three[maybe] << 16 | before[maybe], WIDE_THREE) | np.isin(after[maybe] << 8 | next_three[maybe], WIDE_THREE))
    return at[~wide]


def cuts(data: np.ndarray, special: list[bytes] = ()) -> np.ndarray:
    """Positions at which bytes of text may be cut without a change of their ids."""
    single = _single(data)
    kind = ALNUM[data] + 2 * SIGN[data]
    edge = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
    out = np.concatenate((single, single[data[single] == 10] + 1, edge))
    whole = data.tobytes()
    for mark in special:
        at = whole.find(mark)
        while at >= 0:
            out = out[(out <= at) | (out >= at + len(mark))]
            at = whole.find(mark, at + 1)
    return out


def _values(array: pa.Array) -> list[bytes]:
    data, edges = text_bytes(array)
    held, ends = data.tobytes(), edges.tolist()
    return [held[a:b] for a, b in zip(ends, ends[1:])]


class Ids:
    """The ids of slices of rows, by one tokenizer in one task."""

    def __init__(self, path: str):
        import json
        import os

        # a task has a core, not the machine
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        before = made["pre_tokenizer"] or {}
        self.by_pieces = (before.get("type") == "ByteLevel" and before.get("use_regex", True)
                          and not before.get("add_prefix_space") and not made["normalizer"]
                          and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in made["added_tokens"]))
        self.special = [t["content"].encode() for t in made["added_tokens"]]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def _codes(self, pieces: list[bytes]) -> np.ndarray:
        """The place of each of these different pieces among those known; new ones are tokenised."""
        if len(self.known) + len(pieces) > REMEMBERED:
            self._forget()
        get, n = self.known.get, len(self.known)
        out = np.array([get(p, -1) for p in pieces], np.int64)
        fresh = np.flatnonzero(out < 0)
        if len(fresh):
            new = [pieces[i] for i in fresh]
            found = self.tokenizer.encode_batch_fast([p.decode() for p in new], add_special_tokens=False)
            lists = [e.ids for e in found]
            self.known.update(zip(new, range(n, n + len(new))))
            size = np.array([len(x) for x in lists], np.int64)
            flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum()))
            self.ids = np.concatenate((self.ids, flat))
            self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(size)))
            out[fresh] = np.arange(n, n + len(new))
        return out

    def of(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows in order, and the offsets of the rows in them."""
        data, edges = text_bytes(text)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(edges), np.int64)
        here = np.zeros(len(data) + 1, bool)
        here[edges] = True
        if self.by_pieces:
            here[cuts(data, self.special)] = True
        begin = np.flatnonzero(here[:-1])
        offsets = np.append(begin, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        code = self._codes(_values(coded.dictionary))[coded.indices.to_numpy(zero_copy_only=False)]
        found = pa.LargeListArray.from_arrays(self.starts, self.ids).take(pa.array(code))
        return (found.flatten().to_numpy(zero_copy_only=False),
                np.asarray(found.offsets, np.int64)[np.searchsorted(begin, edges)] - found.offsets[0].as_py())
