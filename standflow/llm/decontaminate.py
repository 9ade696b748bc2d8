"""Benchmark decontamination: CGK embedding, bit-sampling LSH, and exact edit distances.

The CGK walk writes a sequence with repetitions: at step j it writes the current word and moves on
if a random bit of (j, word) says so. Two sequences at a small edit distance fall into step again
after each edit, so their walks agree in most places: edit distance becomes Hamming distance, and
comparing a few sampled steps is an LSH. Here every word of every document starts an item-sized
window. Items are embedded from several of their words on, each as an anchor of the whole window,
so that edits in front of an anchor cost nothing; an anchor that agrees with a window on the sampled
steps of any repetition gives a candidate place, and the exact edit distance (in words, bit-parallel)
of the item to the text around it decides. The tests measure the recall at all
distances allowed.

Items of fewer than 20 words have too few anchors for that. They are cut into one piece more than
edits are allowed, of which one at least is left as it was: all of their occurrences are found.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .bpe import small_batches

SIMILARITY = 0.8
REPETITIONS = 8
STEPS = 14
SAMPLED = 4
STRIDE = 3  # words between the anchors of an item
WALKED = 20  # words of an item from which walks find it
BLOCK_BYTES = 16 << 20  # of benchmark text per pass over the documents
SEED = 20240229
_TO_SPACE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_TABLE = 1 << 20


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return (text or "").lower().encode().translate(_TO_SPACE).split()


def _symbols(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def edit_search(item: list[bytes], text: list[bytes]) -> list[tuple[int, int]]:
    """(distance, end) per place: the least edit distance of the item to any stretch of the text
    that ends there. Myers' bit vectors."""
    m = len(item)
    masks: dict[bytes, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, out = full, 0, m, []
    for end, w in enumerate(text, 1):
        eq = masks.get(w, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        more, less = down | ~(diagonal | up) & full, up & diagonal
        score += bool(more & top) - bool(less & top)
        more, less = more << 1 & full, less << 1 & full
        up, down = (less | ~(diagonal | more)) & full, more & diagonal
        out.append((score, end))
    return out


class Matcher:
    """Items of one block, and where they occur in texts."""

    def __init__(self, items: list[tuple[int, str]], similarity: float):
        self.items = [(i, words_of(t)) for i, t in items]
        self.items = [(i, w) for i, w in self.items if w]
        self.allowed = [int((1 - similarity) * len(w) + 1e-9) for _, w in self.items]
        self.vocabulary = [frozenset(w) for _, w in self.items]
        draw = np.random.default_rng(SEED)
        self.bits = draw.integers(1, 1 << 63, REPETITIONS, dtype=np.uint64) | np.uint64(1)
        # the first step is always sampled: windows whose first word begins no anchor need no walk
        self.steps = [
            np.append(0, 1 + np.sort(draw.choice(STEPS - 1, SAMPLED - 1, replace=False)))
            for _ in range(REPETITIONS)
        ]
        anchors, words = [], []  # (item, word of the item), all words after each other
        self.short: dict[bytes, list[tuple[int, int]]] = {}
        pieces: dict[int, list[tuple[int, int]]] = {}  # by length: (item, word of the item)
        for n, (_, w) in enumerate(self.items):
            # too short for a walk: every word is an anchor by itself
            if len(w) < STEPS:
                for at, word in enumerate(w):
                    self.short.setdefault(word, []).append((n, at))
                continue
            if len(w) < WALKED:
                count = self.allowed[n] + 1
                edges = [len(w) * i // count for i in range(count + 1)]
                for a, b in zip(edges, edges[1:]):
                    pieces.setdefault(b - a, []).append((n, a))
                continue
            anchors += [(n, at, len(words) + at) for at in range(0, len(w) - STEPS + 1, STRIDE)]
            words += w
        self.anchors = np.array(anchors, dtype=np.int64).reshape(-1, 3)
        symbols = np.append(_symbols(words), np.zeros(STEPS, np.uint64))
        self.begins = np.zeros(_TABLE, dtype=bool)
        self.begins[(symbols[self.anchors[:, 2]] & np.uint64(_TABLE - 1)).astype(np.int64)] = True
        self.tables = []
        for r in range(REPETITIONS):
            at, keys = self.anchors[:, 2], None
            filters = []
            for _, keys in self._walk(symbols, at, r):
                seen = np.zeros(_TABLE, dtype=bool)
                seen[(keys & np.uint64(_TABLE - 1)).astype(np.int64)] = True
                filters.append(seen)
            order = np.argsort(keys, kind="stable") if keys is not None else at
            self.tables.append((filters, keys[order] if keys is not None else keys, order))

        self.pieces = []
        for size, each in pieces.items():
            parts = [self.items[n][1][a : a + size] for n, a in each]
            symbols = _symbols([w for part in parts for w in part])
            at = np.arange(len(parts)) * size
            keys = self._piece_keys(symbols, at, size)
            order = np.argsort(keys, kind="stable")
            filters = []
            for x in (symbols[at], keys):
                filters.append(np.zeros(_TABLE, dtype=bool))
                filters[-1][(x & np.uint64(_TABLE - 1)).astype(np.int64)] = True
            self.pieces.append((size, *filters, keys[order], [each[i] for i in order]))

    @staticmethod
    def _piece_keys(symbols: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        keys = np.zeros(len(at), dtype=np.uint64)
        for step in range(size):
            keys = _mix(keys ^ symbols[at + step])
        return keys

    def _walk(self, symbols: np.ndarray, start: np.ndarray, r: int, filters=None) -> Iterator:
        """Walks from the starts: after each sampled step, (the starts, keys so far). With filters,
        walks that cannot be an item's any more are left."""
        at, key = start, np.zeros(len(start), dtype=np.uint64)
        sampled = 0
        for step in range(STEPS):
            here = _mix(symbols[at] ^ self.bits[r])
            if sampled < SAMPLED and self.steps[r][sampled] == step:
                key = _mix(key ^ here)
                if filters is not None:
                    go = filters[sampled][(key & np.uint64(_TABLE - 1)).astype(np.int64)]
                    start, at, key, here = start[go], at[go], key[go], here[go]
                sampled += 1
                yield start, key
                if sampled == SAMPLED:
                    return
            at = at + ((here >> np.uint64(step + 40)) & np.uint64(1)).astype(np.int64)

    def places(self, symbols: np.ndarray) -> set[tuple[int, int]]:
        """(item, word where it would begin) of the candidates."""
        found: set[tuple[int, int]] = set()
        for size, first, whole, keys, places in self.pieces:
            at = np.flatnonzero(first[(symbols & np.uint64(_TABLE - 1)).astype(np.int64)])
            at = at[at + size <= len(symbols)]
            key = self._piece_keys(symbols, at, size)
            go = whole[(key & np.uint64(_TABLE - 1)).astype(np.int64)]
            at, key = at[go], key[go]
            low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
            for s, a, b in zip(at.tolist(), low.tolist(), high.tolist()):
                found.update((n, s - offset) for n, offset in places[a:b])
        begin = np.flatnonzero(self.begins[(symbols & np.uint64(_TABLE - 1)).astype(np.int64)])
        symbols = np.append(symbols, np.zeros(STEPS, np.uint64))
        for r, (filters, keys, order) in enumerate(self.tables if len(self.anchors) else ()):
            for start, key in self._walk(symbols, begin, r, filters):
                pass
            low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
            for s, a, b in zip(start[high > low].tolist(), low[high > low], high[high > low]):
                for n_item, offset, _ in self.anchors[order[a:b]].tolist():
                    found.add((n_item, s - offset))
        return found

    def find(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item id, first word, words, edits) of every occurrence; of overlapping ones of
        an item the closest."""
        words = [words_of(t) for t in texts]
        begins = [0, *accumulate(map(len, words))]
        together = [w for each in words for w in each]
        regions: dict[tuple[int, int], list[tuple[int, int]]] = {}
        places = self.places(_symbols(together))
        if self.short:
            for at, w in enumerate(together):
                places.update((n, at - offset) for n, offset in self.short.get(w, ()))
        for n, start in sorted(places):
            # the anchor's text is the one the window must lie in; a window may begin before it
            size, slack = len(self.items[n][1]), self.allowed[n]
            for t in {self._text(begins, start), self._text(begins, start + size // 2)}:
                low = max(begins[t], start - slack)
                high = min(begins[t + 1], start + size + slack)
                if high - low >= size - slack:
                    spans = regions.setdefault((t, n), [])
                    if spans and spans[-1][1] >= low:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], high))
                    else:
                        spans.append((low, high))
        for (t, n), spans in regions.items():
            for low, high in spans:
                text = words[t][low - begins[t] : high - begins[t]]
                for first, count, edits in self._occurrences(n, text):
                    yield t, self.items[n][0], first + low - begins[t], count, edits

    @staticmethod
    def _text(begins: list[int], word: int) -> int:
        return min(max(bisect_right(begins, word) - 1, 0), len(begins) - 2)

    def _occurrences(self, n: int, text: list[bytes]) -> list[tuple[int, int, int]]:
        item, allowed = self.items[n][1], self.allowed[n]
        out: list[tuple[int, int, int]] = []
        # words of the item that the text cannot match are edits
        if sum(map(self.vocabulary[n].__contains__, text)) < len(item) - allowed:
            return out
        for edits, end in sorted(edit_search(item, text)):
            if edits > allowed:
                break
            begin = max(0, end - len(item) - edits)
            back = edit_search(item[::-1], text[begin:end][::-1])
            length = next(stop for score, stop in back if score == edits)
            first = end - length
            if all(end <= f or f + c <= first for f, c, _ in out):
                out.append((first, length, edits))
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """The items, in blocks of bounded size; equal texts of one id are one item."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // block_bytes + 1
    block = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    for b in range(blocks):
        rows = items.where(block == b).collect()
        yield sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def _each_block(blocks, scan, name: str) -> Iterator[DataFrame]:
    """`scan` of each block; all but the last are written before the next block is read, so the
    driver and a plan hold one block at a time."""
    items = next(blocks)
    for after in blocks:
        yield materialise(scan(items), name)
        items = after
    yield scan(items)


def find_benchmark_items(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per occurrence of an item in a document: id, item, first_word, n_words, edits.

    An item occurs where some stretch of words is within (1 - similarity) of the item's length in
    word edits; of overlapping occurrences of one item, the closest counts. Words are lower-cased
    runs of letters, digits and non-ASCII characters. The benchmark is the stated query set: it is
    read in blocks of bounded size, each against all documents. Null or empty texts have no words,
    and such items occur nowhere; null and repeated ids pass through. Empty tables: no rows."""
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    names = [id_col, item_col, "first_word", "n_words", "edits"]
    schema = ", ".join(f"`{n}` long" for n in names)

    def scan(items: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, similarity)
            for batch in small_batches(batches, 2 << 20):
                ids = batch.column(0).to_pylist()
                rows = [(ids[r[0]], *r[1:]) for r in matcher.find(batch.column(1).to_pylist())]
                columns = zip(*rows) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], names=names
                )

        return picked.mapInArrow(run, schema)

    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    return reduce(DataFrame.unionByName, _each_block(blocks, scan, "occurrences"))


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows whose own text holds no item, with all columns; ids are not looked at, so rows that
    share one, or have none, are judged one by one. The rows stream through the matcher and are
    filtered there: no shuffle. Null and empty texts stay; empty tables: nothing to drop."""
    at = docs.columns.index(text_col)
    kept = docs

    def scan(items: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, similarity)
            for batch in small_batches(batches, 2 << 20):
                bad = {r[0] for r in matcher.find(batch.column(at).to_pylist())}
                clean = [n not in bad for n in range(batch.num_rows)]
                yield batch.filter(pa.array(clean, pa.bool_())) if bad else batch

        return kept.mapInArrow(run, docs.schema)

    for kept in _each_block(
        _blocks(benchmark, item_col, item_text_col, block_bytes), scan, "clean"
    ):
        pass
    return kept
