import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
import tiktoken
from tokenizers import Tokenizer

from standflow.llm import bpe, token_files

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string"
ODD = [
    None, "", " ", "  ", "a  b", "a \n b", "\n\n x", "tab\t x ", "don't we'll", "   lead", "trail  ",
    "é ñ ü 😀😀 日本語", "x  y  z", "!\x1c\x1d? a\x1c b", "\x85 q", "<|endoftext|> a", "b<|endoftext|>", "a" * 5000,
    " " * 3000, "0123456789" * 200, "ab " * 2000, "‍👩‍👧 ok", "===== " * 50, "\r\n \r\n",
]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    chars = "etaoin shrdlu,.\n'é😀AB09_-  "
    texts = ODD + ["".join(r.choices(chars, k=r.randint(1, 400))) for _ in range(300)]
    return [(3 * i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", None), (0, "again", "x")]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS),
        special_tokens={},
    )


def test_round_trip(spark, rows, reference):
    df = spark.createDataFrame(rows, SCHEMA)
    got = bpe.round_trip(df, RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for i, t, _ in rows:
        ids = reference.encode_ordinary(t or "")
        a = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want.append((i, len(ids), a, hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_columns_of_ids_and_text(spark, rows, reference):
    df = spark.createDataFrame(rows, SCHEMA)
    coded = bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN)
    assert coded.columns == ["doc_id", "text", "ids"]
    for r in bpe.decode_documents(coded, RANKS).collect():
        assert r["ids"] == reference.encode_ordinary(r["text"] or "")
        assert r["decoded"] == (r["text"] or "")


def test_transducer_forgets_states(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 40)
    t = bpe.Transducer(bpe.load_ranks(RANKS))
    r = random.Random(1)
    for _ in range(200):
        s = "".join(r.choices("thequicknogaé", k=r.randint(1, 30)))
        assert t.encode(s.encode()) == reference.encode_ordinary(s)


def test_stream_cuts_anywhere():
    data = "aé😀日b߿￿\U0010ffff".encode()
    for size in range(1, 6):
        s = bpe.Utf8Stream()
        assert "".join(s.push(data[i : i + size]) for i in range(0, len(data), size)).encode() == data
        s.close()
    s = bpe.Utf8Stream()
    s.push("😀".encode()[:3])
    with pytest.raises(ValueError):
        s.close()


def test_token_files(spark, rows, tmp_path):
    tokenizer = Tokenizer.from_file(JSON)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    folder = f"file://{tmp_path}/tokens"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    token_files.write_token_files(df, folder, JSON)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = token_files.read_token_digests(spark, folder).collect()
    start, want = 0, []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        want.append((i, start, len(ids), crc))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    names = [f.path for f in pafs.LocalFileSystem().get_file_info(
        pafs.FileSelector(f"{tmp_path}/tokens/parts"))]
    assert len(names) == 4
    part = token_files.open_part(folder, names[0].rpartition("/")[2])
    assert part.ids(len(part) - 1)[-1] == 0
    with open(f"{tmp_path}/tokens/dictionary", "wb") as f:
        f.write(b"another")
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.open_part(folder, names[0].rpartition("/")[2])


def test_token_files_of_another_tokenizer(spark, rows, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert token_files.cuts_bytes(JSON) and not token_files.cuts_bytes(path)
    tokenizer = Tokenizer.from_file(path)
    rows = rows[:120]
    token_files.write_token_files(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/t", path)
    got = token_files.read_token_digests(spark, f"file://{tmp_path}/t").collect()
    want = []
    for i, t, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)


def test_frequent_id_and_long_text_fill_parts(spark, tmp_path):
    tokenizer = Tokenizer.from_file(JSON)
    texts = [f"{i * 7919 % 400} words of row {i}" for i in range(400)] + ["long text, " * 110_000]
    keys = [None if i % 3 == 0 else 7 if i % 3 == 1 else i for i in range(len(texts))]
    df = spark.createDataFrame([(k, t, "x") for k, t in zip(keys, texts)], SCHEMA).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    token_files.write_token_files(df, f"file://{tmp_path}/t", JSON)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    start, want = 0, []
    for k, t in sorted(zip(keys, texts), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [0]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_files.read_token_digests(spark, f"file://{tmp_path}/t").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    parts = {}
    for f in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(f"{tmp_path}/t/parts")):
        part = token_files.open_part(f"file://{tmp_path}/t", f.path.rpartition("/")[2])
        for k in {part.id(i) for i in range(len(part))}:
            parts[k] = parts.get(k, 0) + 1
    assert parts[None] > 1 and parts[7] > 1


def test_pieces_are_cut_once_and_encoders_stay(monkeypatch):
    tokenizer = Tokenizer.from_file(JSON)
    encoder = token_files.task_encoder(JSON, 4)
    assert token_files.task_encoder(JSON, 4) is encoder  # the next task's
    r = random.Random(7)
    words = ["".join(r.choices("etaoinéß'.,\n-09\0\x1c", k=r.randint(1, 6))) for _ in range(300)]
    texts = ["x " + " ".join(r.choices(words, k=40)) for _ in range(30)] + [t for t in ODD if t]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [i.tolist() for i in encoder.encode(pa.array(texts))] == want
    asked = []
    library = encoder._library
    monkeypatch.setattr(encoder, "_library", lambda t: asked.extend(t) or library(t))
    assert [i.tolist() for i in encoder.encode(pa.array(texts[:30]))] == want[:30]
    assert not "".join(asked).strip()  # all known, whether or not a piece is one pre-token
    monkeypatch.setattr(bpe, "MAX_PIECES", 50)  # two generations
    for _ in range(2):
        assert [i.tolist() for i in encoder.encode(pa.array(texts))] == want
    assert len(encoder.known_pieces) <= len(set(" ".join(texts).split(" ")))


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    assert bpe.round_trip(df, RANKS, public_tokenizers.PATTERN).collect() == []
    token_files.write_token_files(df, f"file://{tmp_path}/t", JSON)
    assert token_files.read_token_digests(spark, f"file://{tmp_path}/t").collect() == []
