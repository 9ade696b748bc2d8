"""Hierarchical packing of documents into training sequences of several context sizes.

Documents are cut at the largest size ("tier"); what is left of each goes to the smallest tier that
holds it. Tiers are packed from the largest down: a window takes one of its own pieces, then the
longest shorter pieces that still fit, and what is still open is filled with a cut from a shorter
piece, whose rest goes back to where it belongs. So every window is full, and a sequence needs no
padding, as its length is a tier. What is left at the end of a block fills smaller tiers; the few
ids below the smallest tier go on to the next block of the task, and those that a task leaves
over meet in a second, small round. Sequences of a block are dealt to steps of equal size.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standflow.session import materialise

from .bpe import small_batches
from .token_files import task_encoder

WINDOW = 2048
TIERS = (256, 512, 1024, 2048)
BLOCK_TOKENS = 2_000_000
STEP_TOKENS = 64 * WINDOW
ROWS = 4096  # of a batch that goes out
MEET_TASKS = 4096  # tasks whose last ids meet in one group of the second round

_PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long, tier int, step_id long"
)
# numbers of the second round lie beyond those of the first
_SECOND = 1 << 62


@dataclass(frozen=True)
class Piece:
    """Ids of one document from `start` on, `length` of them; `doc` says which."""

    doc: int
    start: int
    length: int

    def cut(self, at: int) -> tuple[Piece, Piece]:
        head = Piece(self.doc, self.start, at)
        return head, Piece(self.doc, self.start + at, self.length - at)


class Pool:
    """Pieces by length, first in first out among equal ones."""

    def __init__(self, pieces: Iterable[Piece] = ()):
        self.by_length: dict[int, deque[Piece]] = {}
        self.lengths: list[int] = []
        for piece in pieces:
            self.add(piece)

    def add(self, piece: Piece) -> None:
        if piece.length not in self.by_length:
            self.by_length[piece.length] = deque()
            insort(self.lengths, piece.length)
        self.by_length[piece.length].append(piece)

    def _pop(self, at: int) -> Piece:
        length = self.lengths[at]
        queue = self.by_length[length]
        piece = queue.popleft()
        if not queue:
            del self.by_length[length]
            del self.lengths[at]
        return piece

    def longest(self, limit: int) -> Piece | None:
        """The longest piece of at most `limit` ids."""
        at = bisect_right(self.lengths, limit)
        return self._pop(at - 1) if at else None

    def shortest(self) -> Piece | None:
        return self._pop(0) if self.lengths else None


def pack(
    pieces: Sequence[Piece], tiers: Sequence[int] = TIERS
) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """(full sequences as (tier, pieces), pieces left over of fewer ids than the smallest tier).

    A window is closed with at most one cut of a piece that fits no gap."""
    window = max(tiers)
    done: list[tuple[int, list[Piece]]] = []
    pool = Pool()
    total = 0
    for piece in pieces:
        while piece.length >= window:
            head, piece = piece.cut(window)
            done.append((window, [head]))
        if piece.length:
            pool.add(piece)
            total += piece.length
    for below, tier in reversed([*zip((0, *sorted(tiers)), sorted(tiers))]):
        # while a piece of this tier is left, and enough to fill its window
        while total >= tier and pool.lengths and pool.lengths[-1] > below:
            sequence, open_ = [], tier
            while open_:
                piece = pool.longest(open_)
                if piece is None:  # all that is left is longer than the gap
                    piece, rest = pool.shortest().cut(open_)
                    pool.add(rest)
                sequence.append(piece)
                open_ -= piece.length
            done.append((tier, sequence))
            total -= tier
    left = []
    while (piece := pool.longest(window)) is not None:
        left.append(piece)
    return done, left


def balanced_steps(tiers: Sequence[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """The step of each sequence: as many steps as needed, sequences from the longest down to the
    step with the fewest ids so far. Steps differ by one sequence at most, and as equal lengths go
    round, each has its share of every tier."""
    steps = max(1, round(sum(tiers) / step_tokens))
    heap = [(0, s) for s in range(steps)]
    out = [0] * len(tiers)
    for i in sorted(range(len(tiers)), key=lambda i: -tiers[i]):
        load, step = heapq.heappop(heap)
        out[i] = step
        heapq.heappush(heap, (load + tiers[i], step))
    return out


class _Writer:
    """Packs blocks of one task and makes their rows. `first` is the number of the task's first
    sequence and step."""

    def __init__(self, first: int, tiers: Sequence[int], step_tokens: int):
        self.sequence = self.step = first
        self.tiers, self.step_tokens = tiers, step_tokens
        self.docs: list[tuple[int | None, bytes, int, int]] = []  # id, ids, tokens, start
        self.pieces: list[Piece] = []
        self.tokens = 0

    def add(self, doc_id: int | None, data: bytes, start: int = 0, doc_tokens: int | None = None):
        """`data`: the ids of a document from `start` on."""
        n = len(data) // 4
        self.pieces.append(Piece(len(self.docs), 0, n))
        self.docs.append((doc_id, data, n if doc_tokens is None else doc_tokens, start))
        self.tokens += n

    def block(self, last: bool, padded: bool = False) -> Iterator[pa.RecordBatch]:
        """The full sequences. What is left stays for the next block; after the last one it is given
        without a sequence, or in a padded one."""
        full, left = pack(self.pieces, self.tiers)
        rows: list[tuple] = []
        steps = balanced_steps([tier for tier, _ in full], self.step_tokens)
        for (tier, sequence), step in zip(full, steps):
            self._rows(rows, sequence, tier, self.step + step)
        self.step += max(steps, default=-1) + 1
        if last and padded and left:
            self._rows(rows, left, max(self.tiers), self.step)
        elif last:
            rows += [(*self._piece(p), None, None, None, None) for p in left]
        kept = [self._piece(p) for p in left]
        self.docs, self.pieces, self.tokens = [], [], 0
        if not last:
            for doc_id, start, _, data, doc_tokens in kept:
                    self.add(doc_id, data, start, doc_tokens)
        for at in range(0, len(rows), ROWS):
            yield _batch(rows[at : at + ROWS])

    def _piece(self, piece: Piece) -> tuple:
        doc_id, data, doc_tokens, start = self.docs[piece.doc]
        part = data[4 * piece.start : 4 * (piece.start + piece.length)]
        return doc_id, start + piece.start, piece.length, part, doc_tokens

    def _rows(self, rows: list, sequence: list[Piece], tier: int, step: int) -> None:
        offset = 0
        for piece in sequence:
            rows.append((*self._piece(piece), self.sequence, offset, tier, step))
            offset += piece.length
        self.sequence += 1


_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ("tier", pa.int32()), ("step_id", pa.int64()),
])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW
    )


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
    tiers: Sequence[int] = TIERS,
    step_tokens: int = STEP_TOKENS,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it), length, ids (little-endian
    unsigned 32-bit integers), doc_tokens (with the end id), sequence_id, offset (in its sequence,
    without gaps from 0), tier (the sequence's context size: it is padded up to this), step_id
    (sequences of one training step).

    Every whole text is encoded as the tokenizers library does and followed by `end_id`; each id lies
    in exactly one piece. Null text: only the end id. Rows of equal or null id are documents of
    their own; an empty table gives no rows; other columns are ignored. `tiers` are powers of two.
    Only the last ids of some `MEET_TASKS` tasks, fewer than the smallest tier, are padded.

    A task packs blocks of about `block_tokens` ids, or one longer document, so it holds no more
    than that. The pieces are written to the shared folder once; packing again gives the same rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        end = np.array([end_id], "<u4").tobytes()
        writer = _Writer(TaskContext.get().partitionId() << 32, tiers, step_tokens)
        for batch in small_batches(batches):
            encoder = encoder or task_encoder(tokenizer_path, 4)
            for i, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                writer.add(i, ids.tobytes() + end)
                if writer.tokens >= block_tokens:
                    yield from writer.block(last=False)
        yield from writer.block(last=True)

    picked = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    task = F.spark_partition_id().alias("task")
    pieces = materialise(picked.mapInArrow(run, _PIECES).select("*", task), "pieces")

    def again(table: pa.Table) -> Iterator[pa.RecordBatch]:
        group = table.column("task")[0].as_py() // MEET_TASKS
        writer = _Writer(_SECOND + (group << 32), tiers, step_tokens)
        rows = table.sort_by([(c, "ascending") for c in ("task", "length", "doc_id", "start", "ids")])
        for r in rows.to_pylist():
            writer.add(r["doc_id"], r["ids"], r["start"], r["doc_tokens"])
        return pa.Table.from_batches(writer.block(last=True, padded=True), _ARROW)

    left_over = pieces.where(F.col("sequence_id").isNull())
    meet = left_over.groupBy(F.floor(F.col("task") / MEET_TASKS).alias("group"))
    packed = pieces.where(F.col("sequence_id").isNotNull()).drop("task")
    return packed.unionByName(meet.applyInArrow(again, _PIECES))


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of these."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset", "tier", "step_id",
    )
