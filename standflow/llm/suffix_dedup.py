"""Suffix-array dedup: bytes covered by a string that also starts earlier, by deep-shallow sorting.

Candidate suffixes start at the minimisers of repeated super-k-mers (see `passages`). Each bucket
sorts them deep-shallow: a library sort, a column of eight bytes at a time, down to `SHALLOW` bytes; what
is still equal there goes into blind tries, which find a place with one comparison per suffix. The
text before each minimiser is sorted alike, backwards. Two windows with the minimiser at offset o
are equal if the suffixes share `window - o` bytes and the texts before share o, so the sorted
orders with their common-prefix lengths give the classes of equal windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .passages import HOT, Entries, Plan, Text, repeated_passages, window_bits

SHALLOW = 64


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    diff = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (diff.bit_length() + 7) // 8


class BlindTrie:
    """A trie that keeps only branching depths and bytes. A leaf is a list of equal strings."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | tuple | None = None

    @staticmethod
    def _byte(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1  # an end sorts before any byte

    def add(self, index: int) -> None:
        s, node = self.strings[index], self.root
        if node is None:
            self.root = [index]
            return
        while isinstance(node, tuple):  # blind: bytes between the branches are not looked at
            depth, children = node
            node = children.get(self._byte(s, depth)) or next(iter(children.values()))
        other = self.strings[node[0]]
        common = _common(s, other)
        if common == len(s) == len(other):
            node.append(index)
            return
        parent, node = None, self.root
        while isinstance(node, tuple) and node[0] < common:
            parent, node = node, node[1][self._byte(s, node[0])]
        if isinstance(node, tuple) and node[0] == common:
            node[1][self._byte(s, common)] = [index]
            return
        branch = (common, {self._byte(other, common): node, self._byte(s, common): [index]})
        if parent is None:
            self.root = branch
        else:
            parent[1][self._byte(s, parent[0])] = branch

    def in_order(self) -> tuple[list[int], list[int]]:
        """Indices in order, and the length each shares with the one before."""
        order: list[int] = []
        common: list[int] = []
        stack = [(self.root, 0)]
        while stack:
            node, before = stack.pop()
            if isinstance(node, list):
                order += node
                common += [before] + [len(self.strings[node[0]])] * (len(node) - 1)
            else:
                depth, children = node
                keys = sorted(children)
                stack += [(children[k], depth) for k in keys[:0:-1]] + [(children[keys[0]], before)]
        return order, common


def deep_shallow_sort(strings: list[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of the strings, and what each shares with the one before it."""
    n = len(strings)
    length = np.array([*map(len, strings)], dtype=np.int64)
    words = -(-shallow // 8)
    head = b"".join([s[:shallow].ljust(words * 8, b"\0") for s in strings])
    head = np.frombuffer(head, dtype=">u8").reshape(n, words)
    order, group = np.argsort(np.minimum(length, shallow), kind="stable"), np.zeros(n, np.int64)
    common = np.zeros(n, dtype=np.int64)
    alike = np.zeros(n, dtype=bool)  # with the one before, as far as sorted
    alike[1:] = True
    for w in range(words):
        same = np.flatnonzero(alike | np.append(alike[1:], False))  # only groups still together
        if not len(same):
            break
        word = head[order[same], w].astype(np.uint64)
        by = np.lexsort((word, group[same]))
        order[same], word = order[same][by], word[by]
        differs = np.empty(len(same), dtype=bool)
        differs[0] = True
        differs[1:] = word[1:] != word[:-1]
        cut = same[differs & alike[same]]
        i = np.flatnonzero(differs & alike[same])
        diff = word[i] ^ word[i - 1]
        common[cut] = 8 * w + (64 - _bit_length(diff)) // 8
        alike[cut] = False
        group = np.cumsum(~alike)
    # strings of one padded head differ at their ends at the latest
    short = np.minimum(length[order], shallow)
    end = np.concatenate(([0], np.minimum(short[1:], short[:-1])))
    common = np.where(alike, end, np.minimum(common, end))
    deep = np.flatnonzero(alike | np.append(alike[1:], False))
    for at in np.split(deep, np.flatnonzero(~alike[deep])[1:]) if len(deep) else ():
        trie = BlindTrie(strings)
        for i in order[at].tolist():
            trie.add(i)
        sorted_, shared = trie.in_order()
        order[at] = sorted_
        common[at[1:]] = shared[1:]
    return order, common


def _bit_length(x: np.ndarray) -> np.ndarray:
    high, low = x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)
    # halves are exact as doubles
    bits = np.where(
        high > 0,
        32 + np.frexp(high.astype(np.float64))[1],
        np.frexp(low.astype(np.float64))[1],
    )
    return bits.astype(np.int64)


def _classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Of each string, the number of its class of strings with equal first `depth` symbols."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def earlier_equals(e: Entries, window: int, k: int) -> np.ndarray:
    """Bits of the windows with an equal one earlier, by document and place."""
    bits = np.zeros(len(e.strings), dtype=np.uint64)
    everything = e.all_windows()
    # equal strings first: only the earliest of them goes on
    firsts: dict[bytes, int] = {}
    for i in np.lexsort((e.place, e.doc)).tolist():
        if firsts.setdefault(e.strings[i], i) != i:
            bits[i] = everything[i]
    seeds: dict[bytes, int] = {}
    seed_of = {}
    for s, i in firsts.items():
        seed = s[e.offset[i] : e.offset[i] + k]
        seed_of[i] = seed
        seeds[seed] = seeds.get(seed, 0) + 1
    several = [i for i in firsts.values() if seeds[seed_of[i]] > 1]  # still in document order
    if not several:
        return bits
    rows = np.array(several)
    offset, count = e.offset[rows], e.count[rows]
    cuts = list(zip(several, offset.tolist()))
    after = deep_shallow_sort([e.strings[i][o:] for i, o in cuts])
    before = deep_shallow_sort([e.strings[i][:o][::-1] for i, o in cuts])
    found = np.zeros(len(rows), dtype=np.uint64)
    for o in range(window - k + 1):
        have = np.flatnonzero((offset >= o) & (offset - count < o))
        if len(have) < 2:
            continue
        kind = _classes(*after, window - o)[have] * (len(rows) + 1) + _classes(*before, o)[have]
        later = np.ones(len(have), dtype=bool)
        later[np.unique(kind, return_index=True)[1]] = False  # the earliest of each class
        found[have[later]] |= np.uint64(1) << np.uint64(o)
    bits[rows] |= found
    return bits


def _read(text: str | None) -> Text:
    data = (text or "").encode()
    return Text(np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1), data)


def _report(text: Text, removed: np.ndarray) -> tuple:
    kept = np.frombuffer(text.data, dtype=np.uint8)[~removed].tobytes()
    flags = np.concatenate(([False], removed))
    spans = np.count_nonzero(flags[1:] & ~flags[:-1])
    return len(removed), int(removed.sum()), int(spans), hashlib.sha256(kept).hexdigest(), kept


def remove_repeated_substrings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 100,
    hot: int = HOT,
) -> DataFrame:
    """Remove each byte covered by a string of `length` bytes that also starts earlier.

    Earlier: in a document of smaller id, or in the same document before. Strings are judged on the
    input. Returns id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes (they may cut
    a character). Null text: empty, nothing removed. Null id: later than any other; rows of one id
    are documents in the order of their texts, so a repeated row is removed whole if it is long
    enough. Empty table: no rows. Other columns are not read."""
    k = max(length - 63, length // 4)
    plan = Plan(
        window=length, k=k, read=_read, resolve=lambda e: earlier_equals(e, length, k),
        report=_report, within_document=True, hot=hot,
        schema="n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary",
    )
    return repeated_passages(docs, id_col, text_col, plan)


__all__ = ["remove_repeated_substrings", "deep_shallow_sort", "earlier_equals", "window_bits"]
