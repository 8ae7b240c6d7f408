"""Ids of whole texts by way of their distinct words, for tokenizers whose words are independent."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from fieldloom.llm.common import rolling_bytes

#: Distinct words whose ids a worker keeps (about 40 bytes each); beyond it the store starts anew.
KEPT_WORDS = 1_000_000
#: Words that go to the tokenizer as one text.
JOINED_WORDS = 1000

# Bytes that white space begins with, in ASCII and beyond it; marks and letters of ASCII.
_MAY_BE_SPACE = np.zeros(256, bool)
_MAY_BE_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?*#$%&")] = True
_LETTER = np.zeros(256, bool)
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True


class WordIds:
    """Encodes rows word by word; the tokenizer sees each distinct word once.

    ``tokenizer`` must give a row the ids of its words one after another. Words that
    begin with a space and hold no other go to it as one text; ``leads`` marks the ids
    whose piece begins with a space, which shows where each word's ids begin.
    Distinct words are told apart by 64-bit hashes. ``reference``, if set, encodes words
    with another library; after a call ``differ`` holds the words per row on which the two
    disagree.
    """

    reference = None

    def __init__(self, tokenizer, leads: np.ndarray):
        self.tokenizer, self.leads = tokenizer, leads
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.places = np.zeros((0, 3), np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' places in the order of encoding, their flat ids and numbers of ids."""
        joins, alone = [], []
        for i, w in enumerate(words):
            (joins if w[0] == " " and w.rfind(" ") == 0 else alone).append(i)
        groups = [joins[i : i + JOINED_WORDS] for i in range(0, len(joins), JOINED_WORDS)]
        texts = ["".join([words[i] for i in group]) for group in groups]
        order, flat, sizes = [], [], []
        for group, one in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(one.ids, np.uint32)
            begins = np.flatnonzero(self.leads[ids])
            if len(begins) != len(group) or begins[0] != 0:
                alone.extend(group)
                continue
            order.extend(group)
            flat.append(ids)
            sizes.append(np.diff(begins, append=len(ids)))
        for first in range(0, len(alone), JOINED_WORDS):
            some = alone[first : first + JOINED_WORDS]
            lists = [x.ids for x in self.tokenizer.encode_batch_fast([words[i] for i in some], add_special_tokens=False)]
            order.extend(some)
            sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            flat.append(np.fromiter((i for one in lists for i in one), np.uint32, int(sizes[-1].sum())))
        return np.array(order, np.int64), np.concatenate(flat), np.concatenate(sizes)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        order, flat, sizes = self._encode(words)
        keys, differs = keys[order], np.zeros(len(words), np.int64)
        if self.reference:
            runs = np.split(flat, np.cumsum(sizes)[:-1])
            other = self.reference([words[i] for i in order])
            differs[:] = [one.tolist() != two for one, two in zip(runs, other)]
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(flat), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        places = np.stack([self.used + np.cumsum(sizes) - sizes, sizes, differs], axis=1)
        self.used += len(flat)
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.places = np.insert(self.places, at, places[order], axis=0)

    def __call__(self, data: np.ndarray, edges: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order and the rows' bounds in them; words lie between ``edges``."""
        n_rows = len(bounds) - 1
        self.differ = np.zeros(n_rows, np.int64)
        if len(edges) < 2:
            return np.zeros(0, np.uint32), np.zeros(n_rows + 1, np.int64)
        hashes = rolling_bytes(data)(edges[:-1], edges[1:])
        coded = pa.array(hashes).dictionary_encode()
        distinct, indices = np.asarray(coded.dictionary), np.asarray(coded.indices)
        if len(self.keys) + len(distinct) > KEPT_WORDS:
            self._clear()
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
            new = self.keys[at] != distinct
        else:
            new = np.ones(len(distinct), bool)
        if new.any():
            first = np.zeros(len(distinct), np.int64)
            first[indices[::-1]] = np.arange(len(indices))[::-1]
            raw = data.tobytes()
            spans = zip(edges[first[new]].tolist(), edges[first[new] + 1].tolist())
            self._learn(distinct[new], [raw[a:b].decode() for a, b in spans])
        places = self.places[np.searchsorted(self.keys, distinct)][indices]
        sizes = places[:, 1]
        ends = np.cumsum(sizes)
        take = np.arange(int(ends[-1])) + np.repeat(places[:, 0] - (ends - sizes), sizes)
        row_edges = np.searchsorted(edges, bounds)
        if self.reference:
            self.differ = np.diff(np.concatenate([[0], np.cumsum(places[:, 2])])[row_edges])
        return self.ids[take], np.concatenate([[0], ends])[row_edges]


def byte_level_edges(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Edges of words that the usual byte-level pattern never joins.

    Cuts come before a space that no white space follows, between an ASCII letter
    and a mark, and after a line end between a visible ASCII byte and a letter.
    """
    if not len(data):
        return np.zeros(1, np.int64)
    after = np.concatenate([data[1:], [0x20]])
    before = np.concatenate([[0x20], data[:-1]])
    cut = (data == 0x20) & ~_MAY_BE_SPACE[after]
    cut |= _MARK[data] & _LETTER[before]
    second = np.concatenate([[0x20], before[:-1]])
    cut |= _LETTER[data] & (before == 0x0A) & (second > 0x20) & (second < 0x7F)
    return _with_rows(cut, bounds)


def space_edges(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Edges of words that begin with all spaces of a run."""
    if not len(data):
        return np.zeros(1, np.int64)
    space = data == 0x20
    return _with_rows(space & ~np.concatenate([[False], space[:-1]]), bounds)


def _with_rows(cut: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    full = np.diff(bounds) > 0
    cut[bounds[1:][full] - 1] = False
    cut[bounds[:-1][full]] = True
    return np.concatenate([np.flatnonzero(cut), [len(cut)]])
