import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from standflow.llm.packing import Piece, balanced_steps, pack, pack_documents, piece_digests

JSON = public_tokenizers.path("byte_bpe_50k.json")
POWERS = {2**k for k in range(12)}


def check_pieces(rows, docs, end_id, window=2048):
    """Rows are pieces of the documents' ids, each id once, in sequences without gaps; gives the
    length and tier of each sequence."""
    tokenizer = Tokenizer.from_file(JSON)
    want = defaultdict(int)
    for i, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [end_id]
        want[i, np.array(ids, "<u4").tobytes()] += 1
    parts, sequences, tiers = defaultdict(list), defaultdict(list), defaultdict(set)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] > 0
        parts[r["doc_id"], r["doc_tokens"]].append((r["start"], r["ids"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        tiers[r["sequence_id"]].add((r["tier"], r["step_id"]))
    # pieces of documents of equal id and length may stand for one another
    ids_of = defaultdict(list)
    for i, data in want:
        ids_of[i, len(data) // 4] += [data] * want[i, data]
    assert parts.keys() == ids_of.keys()
    for key, found in parts.items():
        for data in ids_of[key]:
            at = 0
            while at < len(data):
                part = next(p for p in found if p[0] * 4 == at and data.startswith(p[1], at))
                found.remove(part)
                at += len(part[1])
        assert not found
    out = {}
    for s, pieces in sequences.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        ((tier, _),) = tiers[s]
        assert at <= tier <= window and tier in POWERS
        out[s] = (at, tier)
    return out


@pytest.fixture(scope="module")
def docs():
    r = random.Random(5)
    words = ["the", "tion", "é", "日本", "x", "qu", "ing", "\n", "a-b", "42"]
    text = lambda n: " ".join(r.choices(words, k=n))
    rows = [(i, text(int(r.paretovariate(0.7) * 20) % 4000)) for i in range(600)]
    rows += [(9, "same"), (9, "same"), (9, "other"), (None, "no id"), (None, None), (700, None)]
    rows += [(701, ""), (702, text(60_000)), (703, "<|endoftext|> in a text"), (704, "a" * 9000)]
    return rows + [(i, "copy of one text") for i in range(1000, 1300)]


@pytest.mark.parametrize("block, parts", [(2_000_000, 1), (5000, 7)])
def test_all_ids_once(spark, docs, block, parts):
    df = spark.createDataFrame(
        [(*d, "x", 1) for d in docs], "doc_id long, text string, ids string, tier int"
    ).repartition(parts)
    packed = pack_documents(df, JSON, 1, block_tokens=block)
    rows = packed.collect()
    sequences = check_pieces(rows, docs, 1)
    padded = [s for s, (n, tier) in sequences.items() if n < tier]
    assert len(padded) <= 1  # the last ids of all tasks
    assert {tier for _, tier in sequences.values()} == {256, 512, 1024, 2048}
    digests = piece_digests(packed).collect()
    assert sorted(zlib.crc32(r["ids"]) for r in rows) == sorted(r["ids_crc32"] for r in digests)
    assert sorted(map(str, packed.collect())) == sorted(map(str, rows))


def test_documents_stay_whole_where_they_can(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    rows = pack_documents(df, JSON, 1).collect()
    sequences = len({r["sequence_id"] for r in rows})
    whole = sum(r["length"] == r["doc_tokens"] for r in rows)
    cuts = len(rows) - len(docs)
    assert cuts <= sequences + sum(r["doc_tokens"] // 2048 for r in rows if r["start"] == 0)
    assert whole > 0.7 * len(docs)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a")]])
def test_few(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pack_documents(df, JSON, 1).collect()
    assert len(got) == len(rows)
    check_pieces(got, rows, 1)


def test_gaps_of_long_windows_take_shorter_pieces():
    lengths = [1500, 400, 140, 8, 200, 56]
    full, left = pack([Piece(i, 0, n) for i, n in enumerate(lengths)])
    assert full[0] == (2048, [Piece(i, 0, lengths[i]) for i in (0, 1, 2, 3)])
    assert full[1] == (256, [Piece(4, 0, 200), Piece(5, 0, 56)])
    assert left == []
    full, left = pack([Piece(0, 0, 5000)])
    assert [t for t, _ in full] == [2048, 2048, 512, 256] and sum(p.length for p in left) == 136


def test_steps_are_balanced():
    r = random.Random(1)
    tiers = r.choices((256, 512, 1024, 2048), k=3000)
    steps = balanced_steps(tiers, 100_000)
    loads, counts = defaultdict(int), defaultdict(int)
    for tier, step in zip(tiers, steps):
        loads[step] += tier
        counts[step, tier] += 1
    assert len(loads) == round(sum(tiers) / 100_000)
    assert max(loads.values()) - min(loads.values()) <= 2048
    for tier in set(tiers):
        of_tier = [n for (_, t), n in counts.items() if t == tier]
        assert max(of_tier) - min(of_tier) <= 8
