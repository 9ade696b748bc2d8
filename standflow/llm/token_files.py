"""Token ids in binary files, each document compressed on its own with one shared dictionary.

A folder holds `dictionary` (a zstandard dictionary trained on serialized id arrays), the parts
written by tasks, and `manifest` (Parquet; written last, it names the parts that count). A part:

    magic b"TOKF0001", id width in bytes (u32), dictionary hash (u64: XXH64 of the dictionary)
    one zstandard frame per document: its ids, little-endian
    index: per document has_id (u8), id (i64), offset (u64), length (u32), tokens (u32), column-wise
    footer: number of documents (u64), offset of the index (u64), magic

A document is read by one seek to its frame. The reader refuses a dictionary of another hash.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from standflow.session import arrow_location, scratch_path

from .bpe import PieceEncoder, small_batches

# fixed value: how byte-level vocabularies cut text before merging
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
MAGIC = b"TOKF0001"
HEAD, FOOT = "<8sIQ", "<QQ8s"
INDEX = (("has_id", "<u1"), ("id", "<i8"), ("offset", "<u8"), ("length", "<u4"), ("tokens", "<u4"))
TRAIN_DOCS = 300
TRAIN_IDS = 4096
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
RANGE_CHARS = 64  # of a text, by which rows of one id are dealt to parts


def cuts_bytes(path: str) -> bool:
    """Whether a tokenizer file cuts plain text as `PRE_TOKEN` does and merges bytes."""
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    cutter = config.get("pre_tokenizer") or {}
    return (
        config.get("normalizer") is None
        and cutter.get("type") == "ByteLevel"
        and not cutter.get("add_prefix_space", True)
        and cutter.get("use_regex", True)
        and config["model"].get("type") == "BPE"
    )


class LibraryEncoder(PieceEncoder):
    """Ids by the tokenizers library, as `width`-byte integers.

    A tokenizer that cuts or changes text in another way than `cuts_bytes` gets whole texts. Of the
    others, the library gets many new pieces of text in one call, one after the other as in a text; the
    bytes that each id stands for tell which ids belong to which piece. A text that holds a string the tokenizer has an own id for goes to
    the library whole, as that id reaches over pieces."""

    def __init__(self, path: str, width: int):
        super().__init__(PRE_TOKEN, f"<u{width}")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_piece = cuts_bytes(path)
        self.tokenizer.encode_special_tokens = self.by_piece  # pieces are plain text
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        # byte-level vocabularies write each byte as one character
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        texts = pc.fill_null(texts, "")
        if not self.by_piece:
            yield from (np.frombuffer(b, self.dtype) for b in self._library(texts.to_pylist()))
            return
        has_added = np.zeros(len(texts), dtype=bool)
        for token in self.added:
            has_added |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        for i, ids in enumerate(super().encode(texts)):
            if has_added[i]:
                self.tokenizer.encode_special_tokens = False
                try:
                    encoded = self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False)
                finally:
                    self.tokenizer.encode_special_tokens = True
                ids = np.array(encoded.ids, self.dtype)
            yield ids

    def _library(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in encoded]

    def learn(self, pre_tokens: list[str]) -> list[bytes]:
        return self._library(pre_tokens)

    def _new_pieces(self, pieces: list[str]) -> list[bytes]:
        # pieces, each with its space, stand in a row as in a text, if none ends with white space
        in_row = [p != "" and not p[-1].isspace() for p in pieces]
        words = [" " + p for p, r in zip(pieces, in_row) if r]
        rows = (b for at in range(0, len(words), 20_000) for b in self._row(words[at : at + 20_000]))
        others = iter(self._library([" " + p for p, r in zip(pieces, in_row) if not r]))
        return [next(rows) if r else next(others) for r in in_row]

    def _row(self, texts: list[str]) -> Iterator[bytes]:
        ids = np.frombuffer(self._library(["".join(texts)])[0], self.dtype)
        ends = np.cumsum([len(t.encode()) for t in texts])
        reached = np.cumsum(self.bytes_of[ids])
        cuts = np.searchsorted(reached, ends) + 1
        if cuts[-1] != len(ids) or (reached[cuts - 1] != ends).any():
            yield from self._library(texts)
            return
        stops, data = (cuts * self.dtype.itemsize).tolist(), ids.tobytes()
        yield from (data[i:j] for i, j in zip([0, *stops], stops))


@lru_cache(maxsize=1)
def _encoder(path: str, width: int, stamp: tuple[int, int]) -> LibraryEncoder:
    return LibraryEncoder(path, width)


def task_encoder(path: str, width: int) -> LibraryEncoder:
    """The encoder of this Python worker: its next tasks find it loaded, with the pieces it knows.
    Another file under the path is loaded anew."""
    file = os.stat(path)
    return _encoder(path, width, (file.st_mtime_ns, file.st_size))


def id_width(path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4


def train_dictionary(docs: DataFrame, tokenizer_path: str, width: int, end_id: int) -> bytes:
    """From the first `TRAIN_IDS` ids of about `TRAIN_DOCS` documents (at most twice as many) drawn
    by a hash of the id: a bound for the training only, every document is written whole. With too
    little to train on, the dictionary is the raw ids of the sample."""
    n = max(docs.count(), 1)
    share = F.pmod(F.xxhash64("id"), F.lit(n)) < TRAIN_DOCS
    sample = docs.where(share).select(F.substring("text", 1, 8 * TRAIN_IDS).alias("text"))
    texts = [r["text"] for r in sample.limit(2 * TRAIN_DOCS).collect()]
    end = np.array([end_id], f"<u{width}").tobytes()
    encoded = LibraryEncoder(tokenizer_path, width).encode(pa.array(texts, pa.string()))
    ids = sorted(i[:TRAIN_IDS].tobytes() + end for i in encoded)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, ids).as_bytes()
    except zstandard.ZstdError:
        return b"".join(ids)[:DICTIONARY_BYTES] or b"\0" * 8


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _write_part(uri: str, tokenizer_path: str, width: int, end_id: int, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        encoder = task_encoder(tokenizer_path, width)
        end = np.array([end_id], f"<u{width}").tobytes()
        shared = zstandard.ZstdCompressionDict(dictionary)
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared).compress
        index: list[tuple] = []
        fs, folder = _open(uri)
        out = None
        for batch in small_batches(batches):
            if out is None:
                fs.create_dir(folder, recursive=True)
                out = fs.open_output_stream(f"{folder}/{name}")
                offset = out.write(
                    struct.pack(HEAD, MAGIC, width, xxhash.xxh64_intdigest(dictionary))
                )
            for i, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                data = ids.tobytes() + end
                frame = compress(data)
                out.write(frame)
                index.append((i is not None, i or 0, offset, len(frame), len(data) // width))
                offset += len(frame)
        if out is None:
            return
        for (_, dtype), column in zip(INDEX, zip(*index)):
            out.write(np.array(column, dtype=dtype).tobytes())
        out.write(struct.pack(FOOT, len(index), offset, MAGIC))
        out.close()
        row = (task.partitionId(), name, len(index), sum(r[4] for r in index))
        yield pa.RecordBatch.from_arrays(
            [pa.array([v]) for v in row], names=["part", "file", "docs", "tokens"]
        )

    return run


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write the ids of every whole text, and `end_id` after each, in ascending id order (null ids
    first; rows of one id by text). Null text: `end_id` alone. An empty table: no parts. Parts are
    ranges of the id and the beginning of the text, so a frequent id fills many parts. Any tokenizer
    file of the library will do; long texts are compressed whole, one frame each."""
    spark = docs.sparkSession
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    width = id_width(tokenizer_path)
    dictionary = train_dictionary(picked, tokenizer_path, width, end_id)
    uri = arrow_location(spark, folder)
    fs, local = _open(uri)
    fs.create_dir(local, recursive=True)
    with fs.open_output_stream(f"{local}/dictionary") as f:
        f.write(dictionary)
    run = _write_part(f"{uri}/parts", tokenizer_path, width, end_id, dictionary)
    (
        picked.repartitionByRange("id", F.substring("text", 1, RANGE_CHARS))
        .sortWithinPartitions("id", "text")
        .mapInArrow(run, "part long, file string, docs long, tokens long")
        .write.parquet(f"{folder}/manifest")
    )


class PartReader:
    """Random access to the documents of one part."""

    def __init__(self, source: pa.NativeFile, dictionary: bytes):
        self.source = source
        size = source.size()
        magic, self.width, own = struct.unpack(HEAD, source.read_at(struct.calcsize(HEAD), 0))
        foot = struct.calcsize(FOOT)
        docs, at, end = struct.unpack(FOOT, source.read_at(foot, size - foot))
        if magic != MAGIC or end != MAGIC:
            raise ValueError("not a token file")
        if own != xxhash.xxh64_intdigest(dictionary):
            raise ValueError("written with another dictionary")
        data, self.index, begin = source.read_at(size - foot - at, at), {}, 0
        for name, dtype in INDEX:
            self.index[name] = np.frombuffer(data, dtype, docs, begin)
            begin += self.index[name].nbytes
        shared = zstandard.ZstdCompressionDict(dictionary)
        self.decompress = zstandard.ZstdDecompressor(dict_data=shared).decompress

    def __len__(self) -> int:
        return len(self.index["id"])

    def id(self, row: int) -> int | None:
        return int(self.index["id"][row]) if self.index["has_id"][row] else None

    def ids(self, row: int) -> np.ndarray:
        length, offset = int(self.index["length"][row]), int(self.index["offset"][row])
        data = self.decompress(self.source.read_at(length, offset))
        return np.frombuffer(data, dtype=f"<u{self.width}")


def open_part(uri: str, file: str) -> PartReader:
    fs, local = _open(uri)
    with fs.open_input_stream(f"{local}/dictionary") as f:
        dictionary = f.read()
    return PartReader(fs.open_input_file(f"{local}/parts/{file}"), dictionary)


def read_token_digests(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, in the files: id, start (ids of all documents before it), n_tokens, ids_crc32
    (of the ids as little-endian unsigned 32-bit integers)."""
    uri = arrow_location(spark, folder)
    manifest = spark.read.schema("part long, file string, docs long, tokens long").parquet(
        f"{folder}/manifest"
    )
    # one row per part
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = manifest.select("file", F.coalesce(before, F.lit(0)).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(*[c.to_pylist() for c in batch.columns]):
                part = open_part(uri, file)
                tokens = part.index["tokens"].astype(np.int64)
                starts = start + np.cumsum(tokens) - tokens
                sums = [zlib.crc32(part.ids(i).astype("<u4").tobytes()) for i in range(len(part))]
                ids = pa.array([part.id(i) for i in range(len(part))], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(starts), pa.array(tokens), pa.array(sums, pa.int64())],
                    names=[id_col, "start", "n_tokens", "ids_crc32"],
                )

    n = spark.read.parquet(f"{folder}/manifest").count()
    return parts.repartition(max(n, 1), "file").mapInArrow(
        run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long"
    )


def write_and_digest(docs: DataFrame, tokenizer_path: str, **names) -> DataFrame:
    """Write the files below the shared folder and return what is read back from them."""
    folder = scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, folder, tokenizer_path, **names)
    return read_token_digests(docs.sparkSession, folder, names.get("id_col", "doc_id"))
