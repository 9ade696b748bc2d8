"""Structure repair of conversations, streamed turn by turn.

Turns are dealt by conversation and sorted by turn; `mapInPandas` then reads one conversation after
the other and carries the state of the search (`turn_repair.py`) from batch to batch. Whether a
turn repeats an earlier one is found before, by a count of role and text on Spark, so the stream
remembers no texts. A conversation of any length takes the memory of two chunks: decided turns
leave, undecided ones wait in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standflow.functions.joins import null_safe_join
from standflow.session import arrow_location, scratch_path

from .turn_repair import (
    CUT_SHORT, DELETE, INSERT, INSERTED, KEEP, MUST_GO, SOUND, Machine, Repair, roles,
)

CHUNK_BYTES = 8 << 20  # of turns that wait together
OUT_ROWS = 4096

_BLANKS = "\x20\x09\x0A\x0B\x0C\x0D"
_LEGAL = {"su", "ua", "au"}

_TURNS = "conv_id string, position long, turn string, role string, text string, edit string"
_REPORT = (
    "conv_id string, n_turns long, gaps long, blank long, duplicate long, truncated long, "
    "illegal long, cost long, audit string, repaired_sha256 string"
)


def _streams(turns: DataFrame) -> DataFrame:
    """Conversations one after the other, turns in order, with whether (role, text) occurs more
    than once in the conversation and in which turn first. Ids and turns go as strings, so that
    nulls leave them exact."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    conversation = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    content = F.concat_ws(":", conversation, F.length("role"), "role", "text")
    rows = rows.withColumn("content", F.unhex(F.sha2(content, 256)))
    order = F.struct(F.col("turn").isNotNull(), F.col("turn").alias("turn"))  # nulls first
    repeated = (
        rows.groupBy("content")
        .agg(F.count(F.lit(1)).alias("n"), F.min(order)["turn"].alias("first_turn"))
        .where(F.col("n") > 1)
        .select("content", "first_turn", F.lit(True).alias("repeated"))
    )
    return (
        rows.join(repeated, ["content"], "left")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
        .select(
            F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv_id"),
            F.col("turn").cast("string").alias("turn"), "role", "text",
            F.coalesce("repeated", F.lit(False)).alias("repeated"),
            F.col("first_turn").cast("string").alias("first_turn"),
        )
    )


class _Spill:
    """Chunks of waiting turns as files of the shared folder; a file goes when its chunk is read
    for the second time."""

    def __init__(self, uri: str):
        self.uri, self.files = uri, 0

    def __call__(self, entries: np.ndarray, turns: list) -> Callable[[], tuple[np.ndarray, list]]:
        fs, folder = pafs.FileSystem.from_uri(self.uri)
        fs.create_dir(folder, recursive=True)
        task = TaskContext.get()
        path = f"{folder}/{task.partitionId()}-{task.taskAttemptId()}-{self.files}"
        self.files += 1
        turn, role, text = zip(*turns)
        table = pa.table({
            "entry": entries, "turn": pa.array(turn, pa.string()),
            "role": pa.array(role, pa.string()), "text": pa.array(text, pa.string()),
        })
        with fs.open_output_stream(path) as out, pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table)
        reads = []

        def load() -> tuple[np.ndarray, list]:
            with fs.open_input_stream(path) as source:
                got = pa.ipc.open_stream(source).read_all()
            reads.append(path)
            if len(reads) == 1:
                return got.column("entry").to_numpy(), []
            fs.delete_file(path)
            return np.empty(0), [*zip(*(got.column(c).to_pylist() for c in ("turn", "role", "text")))]

        return load


class _Conversation:
    """Counts of the turns as they are, and the repaired turns as they are decided."""

    def __init__(self, conv_id: str, machine: Machine, spill: _Spill, chunk: int):
        self.conv_id = conv_id
        self.repair = Repair(machine, spill, chunk)
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.distinct_turns, self.first, self.last = 0, None, None
        self.before: tuple | None = None
        self.state, self.position = 0, 0
        self.audit: list[str] = []
        self.digest = hashlib.sha256()

    def take(self, turn: str | None, role: str, text: str, repeated: bool, first_turn) -> bool:
        """One turn; true if repaired turns can be had."""
        this = (turn, role, text)
        written = text.rstrip(_BLANKS)
        if not written:
            fault = MUST_GO
            self.blank += 1
        elif repeated and (turn != first_turn or this == self.before):
            fault = MUST_GO
            self.duplicate += 1
        elif written[-1] not in ".!?":
            fault = CUT_SHORT
            self.truncated += 1
        else:
            fault = SOUND
        if self.before is not None:
            self.illegal += self.before[1][:1] + role[:1] not in _LEGAL
        if turn is not None and (self.before is None or self.before[0] != turn):
            self.distinct_turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        self.before = this
        self.turns += 1
        return self.repair.turn(role[:1], fault, this, 64 + len(text))

    def repaired(self, edits: list[str], turns: list[tuple]) -> Iterator[tuple]:
        """(turn, role, text, edit) of what stays of these turns."""
        self.audit.append("".join(edits))
        for letters, (turn, role, text) in zip(edits, turns):
            self.state, made = roles(self.state, letters, role[:1])
            for edit, new in made:
                if edit == INSERT:
                    yield None, INSERTED[new], "", edit
                elif edit != DELETE:
                    yield turn, role if edit == KEEP else INSERTED[new], text, edit

    def hashed(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        for turn, role, text, edit in rows:
            if self.position:
                self.digest.update(b"\n")
            self.digest.update(f"{role}:{text}".encode())
            yield self.conv_id, self.position, turn, role, text, edit
            self.position += 1

    def decided(self) -> Iterator[tuple]:
        for edits, turns in self.repair.decided():
            yield from self.hashed(self.repaired(edits, turns))

    def finish(self) -> Iterator[tuple]:
        inserts, rest = self.repair.finish()
        for edits, turns in rest:
            yield from self.hashed(self.repaired(edits, turns))
        self.audit.append(inserts)
        self.state, made = roles(self.state, inserts, "")
        yield from self.hashed((None, INSERTED[new], "", edit) for edit, new in made)

    def report(self) -> tuple:
        gaps = 0
        if self.first is not None:
            gaps = int(self.last) - int(self.first) + 1 - self.distinct_turns
        return (
            self.conv_id, self.turns, gaps, self.blank, self.duplicate, self.truncated,
            self.illegal, self.repair.cost, "".join(self.audit), self.digest.hexdigest(),
        )


def _repair(uri: str, chunk: int, reports: bool):
    """For mapInPandas: repaired turns, or one report per conversation."""

    def events(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        machine, spill = Machine(), _Spill(uri)
        current: _Conversation | None = None
        for frame in frames:
            for conv_id, *row in frame.itertuples(index=False, name=None):
                if current is None or current.conv_id != conv_id:
                    if current is not None:
                        yield from close(current)
                    current = _Conversation(conv_id, machine, spill, chunk)
                if current.take(*row):
                    yield from rows_of(current.decided())
        if current is not None:
            yield from close(current)

    def rows_of(rows: Iterator[tuple]) -> Iterator[tuple]:
        # the report needs the rows too, for their digest
        for row in rows:
            if not reports:
                yield row

    def close(conversation: _Conversation) -> Iterator[tuple]:
        yield from rows_of(conversation.finish())
        if reports:
            yield conversation.report()

    names = [c.split()[0] for c in (_REPORT if reports else _TURNS).split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for row in events(frames):
            rows.append(row)
            size += len(row[4] if not reports else row[8])
            if len(rows) >= OUT_ROWS or size >= CHUNK_BYTES:
                yield pd.DataFrame(rows, columns=names)
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return run


def _run(turns: DataFrame, chunk: int, reports: bool) -> DataFrame:
    spark = turns.sparkSession
    uri = arrow_location(spark, scratch_path(spark, "waiting"))
    schema = _REPORT if reports else _TURNS
    return _streams(turns).mapInPandas(_repair(uri, chunk, reports), schema)


def repaired_turns(turns: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The turns of each conversation after its cheapest repair: conv_id, position (from 0), turn
    (null for inserted ones), role, text, edit (K kept, R other role, I inserted).

    `turns` has conv_id, turn, role and text; other columns are ignored. Turns go in ascending order,
    nulls first, equal ones by role and text. A null role or text is one space; an empty role has
    no initial and fits nowhere as it is. Repeated rows are turns of their own (the later ones
    duplicates); a null conv_id is a conversation like any other. A conversation without a turn that
    stays has no rows; neither has an empty table."""
    out = _run(turns, chunk_bytes, False)
    return out.withColumns({
        "conv_id": F.nullif("conv_id", F.lit("")).cast("long"), "turn": F.col("turn").cast("long"),
    })


def repair_report(turns: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per conversation: conv_id, n_turns, gaps (turn numbers missing between the least and
    the greatest), blank, duplicate and truncated turns (first fault of each), illegal (neighbours
    whose initials are not su, ua or au), cost of the cheapest repair, audit (its edits, least
    string on ties), repaired_sha256 (`role:text` of the repaired turns, joined by newlines). Nulls,
    ties and repeated rows as in `repaired_turns`."""
    out = _run(turns, chunk_bytes, True)
    return out.withColumn("conv_id", F.nullif("conv_id", F.lit("")).cast("long"))


def damage(conversations: DataFrame) -> DataFrame:
    """Turns with faults in them, by a hash of conv_id and turn: of 20, one is dropped, one emptied,
    one loses its `.!?`, one is repeated and one becomes a user's. Nulls are one space."""
    space = F.lit(" ")
    part = lambda c: F.coalesce(F.col(c).cast("string"), space)
    which = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = part("text")
    return (
        conversations.withColumn("__which", which)
        .where(F.col("__which") != 0)
        .select(
            "conv_id", "turn",
            F.when(F.col("__which") == 4, "user").otherwise(part("role")).alias("role"),
            F.when(F.col("__which") == 1, "")
            .when(F.col("__which") == 2, F.regexp_replace(text, "[.!?]", ""))
            .otherwise(text).alias("text"),
            F.explode(F.array_repeat(F.lit(0), F.when(F.col("__which") == 3, 2).otherwise(1)))
            .alias("__copy"),
        )
        .drop("__copy")
    )


def report_all(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """The report on `turns` for every conversation of the first table; one that has lost all its
    turns has zeros, an empty audit and the digest of the empty text."""
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = null_safe_join(every, repair_report(turns), ["conv_id"], "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
