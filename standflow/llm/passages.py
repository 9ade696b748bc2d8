"""Passages that repeat across a corpus: windows found in an earlier place, in rounds of blocks.

Documents are dealt into blocks by a hash of their id. Four rounds pass between blocks and buckets:

1. A block sends each minimiser of its super-k-mers, with its count, to the minimiser's bucket.
2. The bucket tells each block which of its minimisers occur more than once anywhere.
3. The block sends the super-k-mers of those, equal strings once, to the bucket, which compares
   all strings of a minimiser and answers with one bit per window: it has an earlier equal.
4. The block marks what the windows cover and writes one row per document.

Blocks and buckets hold a bounded share of the text whatever the corpus size, and only packed arrays
travel. A minimiser with more than `hot` occurrences would fill one bucket: its super-k-mers are
taken apart into single windows, which go to the buckets of their own hashes. Every round is a
function of its input alone, so a lost task is simply run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .superkmers import super_kmers

BLOCK_BYTES = 8 << 20
HOT = 50_000
LAST = np.iinfo(np.int64).max  # a null id counts as larger than any other


@dataclass
class Text:
    """A document as symbols, and the bytes that stand for each stretch of them."""

    symbols: np.ndarray
    data: bytes
    begins: np.ndarray | None = None  # None: a symbol is a byte
    ends: np.ndarray | None = None

    def pieces(self, first: np.ndarray, stop: np.ndarray) -> list[bytes]:
        if self.begins is not None:
            first, stop = self.begins[first], self.ends[stop - 1]
        data = self.data
        return [data[i:j] for i, j in zip(first.tolist(), stop.tolist())]


@dataclass
class Entries:
    """What a bucket compares: super-k-mers with their place."""

    strings: list[bytes]
    offset: np.ndarray  # of the minimiser, in symbols
    count: np.ndarray  # of windows
    doc: np.ndarray
    place: np.ndarray  # of the minimiser in the document

    def all_windows(self) -> np.ndarray:
        return window_bits(self.offset, self.count)


def window_bits(offset: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The bits of a run's windows. A window's bit is the minimiser's offset in the window."""
    full = ~np.uint64(0) >> (np.uint64(64) - count.astype(np.uint64))
    return full << (offset - count + 1).astype(np.uint64)


# bits of the windows that have an earlier equal, one uint64 per entry
Resolver = Callable[[Entries], np.ndarray]


@dataclass
class Plan:
    window: int
    k: int
    read: Callable[[str | None], Text]
    resolve: Resolver
    report: Callable[[Text, np.ndarray], tuple]  # from a document and its removed symbols
    schema: str  # of what `report` gives, after the id
    within_document: bool  # whether an earlier place in the same document counts
    hot: int = HOT

    def __post_init__(self):
        assert self.window - self.k + 1 <= 64, "one bit per window of a run"


def pack(*arrays: np.ndarray) -> bytes:
    heads = np.array([a.nbytes for a in arrays], dtype=np.int64).tobytes()
    return zstandard.compress(heads + b"".join(a.tobytes() for a in arrays), 1)


def unpack(blob: bytes, *dtypes) -> list[np.ndarray]:
    data = zstandard.decompress(blob)
    sizes = np.frombuffer(data, dtype=np.int64, count=len(dtypes)).tolist()
    at, out = 8 * len(dtypes), []
    for size, dtype in zip(sizes, dtypes):
        out.append(np.frombuffer(data[at : at + size], dtype=dtype))
        at += size
    return out


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    values, first = np.unique(bucket[order], return_index=True)
    yield from zip(values.tolist(), np.split(order, first[1:]))


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


BUCKET_ROWS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("blob", pa.binary())])
REPLY_ROWS = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
BUCKET_DDL, REPLY_DDL = "bucket int, block int, blob binary", "block int, kind int, blob binary"
LIVE, MASKS = 0, 1


class Block:
    """The documents of a block in order (rows of one id: by text) and their super-k-mers."""

    def __init__(self, table: pa.Table, plan: Plan):
        self.plan = plan
        rows = sorted(
            zip(table["id"].to_pylist(), table["text"].to_pylist()),
            key=lambda r: (LAST if r[0] is None else r[0], r[1] or ""),
        )
        self.ids = [r[0] for r in rows]
        self.order = np.array([LAST if i is None else i for i in self.ids], dtype=np.int64)
        new = np.concatenate(([True], self.order[1:] != self.order[:-1]))
        at = np.arange(len(rows))
        self.rank = at - np.maximum.accumulate(np.where(new, at, 0))  # within one id
        self._raw = [r[1] for r in rows]

    def runs(self) -> Iterator[tuple[int, Text, tuple[np.ndarray, ...]]]:
        for i, raw in enumerate(self._raw):
            text = self.plan.read(raw)
            yield i, text, super_kmers(text.symbols, self.plan.window, self.plan.k)

    def live_runs(self, live: np.ndarray, hot: np.ndarray) -> Iterator[tuple]:
        """(document, text, runs, is live, strings of the live, are hot) per document."""
        for i, text, (start, count, anchor, key) in self.runs():
            at = np.minimum(np.searchsorted(live, key), max(len(live) - 1, 0))
            known = live[at] == key if len(live) else np.zeros(len(key), dtype=bool)
            start, count, anchor = start[known], count[known], anchor[known]
            strings = text.pieces(start, start + count + self.plan.window - 1)
            yield i, text, start, count, anchor, key[known], strings, hot[at[known]]


def _send_minimisers(plan: Plan, buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        found = [r[3] for _, _, r in Block(table, plan).runs()]
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        rows = [
            (b, key[0].as_py(), pack(keys[i], counts[i].astype(np.uint32)))
            for b, i in _by_bucket(_bucket(keys, buckets))
        ]
        return _rows(BUCKET_ROWS, rows)

    return run


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)


def _count_minimisers(hot: int):
    def run(table: pa.Table) -> pa.Table:
        blocks = table["block"].to_pylist()
        parts = [unpack(b, np.uint64, np.uint32) for b in table["blob"].to_pylist()]
        keys, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.bincount(place, np.concatenate([p[1] for p in parts]), len(keys))
        rows, at = [], 0
        for block, (own, _) in zip(blocks, parts):
            n = total[place[at : at + len(own)]]
            at += len(own)
            if (n >= 2).any():
                rows.append((block, LIVE, pack(own[n >= 2], n[n >= 2] > hot)))
        return _rows(REPLY_ROWS, rows)

    return run


def _live(replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    parts = [
        unpack(blob, np.uint64, np.bool_)
        for kind, blob in zip(replies["kind"].to_pylist(), replies["blob"].to_pylist())
        if kind == LIVE
    ]
    if not parts:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=bool)
    live, hot = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(live)
    return live[order], hot[order]


def _send_strings(plan: Plan, buckets: int):
    def run(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        live, hot = _live(replies)
        if not len(live) or not table.num_rows:
            return _rows(BUCKET_ROWS, [])
        block = Block(table, plan)
        strings, meta, seen, at = [], [], set(), 0
        for i, text, start, count, anchor, keys, pieces, is_hot in block.live_runs(live, hot):
            rank = int(block.rank[i]) << 40
            columns = (start, count, anchor, keys, is_hot)
            for s, b, n, a, m, h in zip(pieces, *[c.tolist() for c in columns]):
                if not h:
                    if s not in seen:
                        seen.add(s)
                        strings.append(s)
                        meta.append((m, at, a - b, n, i, rank + a))
                else:
                    first = np.arange(b, b + n)
                    for j, w in enumerate(text.pieces(first, first + plan.window)):
                        if w not in seen:
                            seen.add(w)
                            strings.append(w)
                            spread = xxhash.xxh3_64_intdigest(w)
                            meta.append((spread, at, a - b - j, 1, i, rank + a))
                at += 1
        if not meta:
            return _rows(BUCKET_ROWS, [])
        keys, run_no, offset, count, doc, place = zip(*meta)
        keys, lengths = np.array(keys, dtype=np.uint64), np.array([*map(len, strings)], np.uint32)
        run_no, place = np.array(run_no, np.uint32), np.array(place, np.int64)
        offset, count = np.array(offset, np.uint8), np.array(count, np.uint8)
        doc = block.order[np.array(doc)]
        rows = []
        for b, i in _by_bucket(_bucket(keys, buckets)):
            data = np.frombuffer(b"".join([strings[j] for j in i.tolist()]), dtype=np.uint8)
            blob = pack(run_no[i], offset[i], count[i], doc[i], place[i], lengths[i], data)
            rows.append((b, key[0].as_py(), blob))
        return _rows(BUCKET_ROWS, rows)

    return run


def _compare_strings(resolve: Resolver):
    dtypes = (np.uint32, np.uint8, np.uint8, np.int64, np.int64, np.uint32, np.uint8)

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(b, *dtypes) for b in table["blob"].to_pylist()]
        strings = []
        for p in parts:
            data, ends = p[6].tobytes(), np.cumsum(p[5].astype(np.int64))
            strings += [data[i:j] for i, j in zip((ends - p[5]).tolist(), ends.tolist())]
        _, offset, count, doc, place = (np.concatenate([p[c] for p in parts]) for c in range(5))
        bits = resolve(
            Entries(strings, offset.astype(np.int64), count.astype(np.int64), doc, place)
        )
        rows, at = [], 0
        for block, (run_no, *_) in zip(table["block"].to_pylist(), parts):
            own = bits[at : at + len(run_no)]
            at += len(run_no)
            if own.any():
                rows.append((block, MASKS, pack(run_no[own > 0], own[own > 0])))
        return _rows(REPLY_ROWS, rows)

    return run


def _mark(plan: Plan, out: pa.Schema):
    def run(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows(out, [])
        live, hot = _live(replies)
        masks: dict[int, int] = {}
        for kind, blob in zip(replies["kind"].to_pylist(), replies["blob"].to_pylist()):
            if kind == MASKS:
                for r, m in zip(*[a.tolist() for a in unpack(blob, np.uint32, np.uint64)]):
                    masks[r] = masks.get(r, 0) | m
        block = Block(table, plan)
        first: dict[bytes, tuple[int, int]] = {}  # string: its document, its mask
        rows, at = [], 0
        for i, text, start, count, anchor, _, pieces, is_hot in block.live_runs(live, hot):
            edges = np.zeros(len(text.symbols) + 1, dtype=np.int64)
            doc = block.order[i]

            def cover(window: int, n: int = 1):
                edges[window] += 1
                edges[window + n + plan.window - 1] -= 1

            columns = (start, count, anchor, is_hot)
            for s, b, n, a, h in zip(pieces, *[c.tolist() for c in columns]):
                mask = masks.get(at, 0)
                if not h:
                    known = first.get(s)
                    if known is None:
                        first[s] = (doc, mask)
                    elif plan.within_document or known[0] != doc:
                        cover(b, n)
                        mask = 0
                    else:
                        mask = known[1]
                    while mask:
                        bit = mask.bit_length() - 1
                        cover(a - bit)
                        mask ^= 1 << bit
                else:
                    begin = np.arange(b, b + n)
                    for j, w in enumerate(text.pieces(begin, begin + plan.window)):
                        dup = mask >> (a - b - j) & 1
                        known = first.get(w)
                        if known is None:
                            first[w] = (doc, dup)
                        elif plan.within_document or known[0] != doc:
                            dup = 1
                        else:
                            dup = known[1]
                        if dup:
                            cover(b + j)
                at += 1
            removed = np.cumsum(edges[:-1]) > 0
            rows.append((block.ids[i], *plan.report(text, removed)))
        return _rows(out, rows)

    return run


def repeated_passages(docs: DataFrame, id_col: str, text_col: str, plan: Plan) -> DataFrame:
    """One row per document, from `plan.report`. Runs one job, for the size of the text.

    Rows with one id are documents of their own, in the order of their texts; a null id counts as
    larger than any other; a null text is empty. Only the id and the text are read."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    docs = docs.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    by_block = docs.groupBy("block")
    sent = by_block.applyInArrow(_send_minimisers(plan, blocks), BUCKET_DDL)
    live = sent.groupBy("bucket").applyInArrow(_count_minimisers(plan.hot), REPLY_DDL)
    strings = by_block.cogroup(live.groupBy("block")).applyInArrow(
        _send_strings(plan, blocks), BUCKET_DDL
    )
    masks = strings.groupBy("bucket").applyInArrow(_compare_strings(plan.resolve), REPLY_DDL)
    empty = spark.createDataFrame([], f"{id_col} long, {plan.schema}")
    from pyspark.sql.pandas.types import to_arrow_schema

    return by_block.cogroup(live.unionByName(masks).groupBy("block")).applyInArrow(
        _mark(plan, to_arrow_schema(empty.schema)), empty.schema
    )
