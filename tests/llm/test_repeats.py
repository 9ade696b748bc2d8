"""Substring removal by bytes and by words against walks over all windows."""

import hashlib
import random

import numpy as np
import pytest

from standflow.llm.substring_dedup import remove_repeated_windows
from standflow.llm.suffix_dedup import deep_shallow_sort, remove_repeated_substrings
from standflow.llm.superkmers import super_kmers

SCHEMA = "doc_id long, text string, block string"


def corpus(seed: int, words: int = 40) -> list[tuple]:
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeé", k=r.randint(1, 6))) for _ in range(words)]
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    shared = [text(r.randint(20, 60)) for _ in range(4)]
    docs = []
    for i in range(40):
        body = [text(r.randint(0, 30)), r.choice(shared), text(r.randint(0, 10)), r.choice(shared)]
        docs.append((i * 3, " ".join(body), "x"))
    near = text(80).split()
    for i in range(20):
        copy = list(near)
        copy[r.randrange(len(copy))] = "other%d" % i
        docs.append((1000 + i, "\n".join(copy), "x"))
    docs += [(2000, "ab" * 150, None), (2001, "z" * 300, None), (2002, "", "x"), (2003, None, "x")]
    docs += [(2004, near[0] * 60 + "\0\0" + "\0" * 90, None), (None, shared[0], "x")]
    docs += [(0, docs[0][1], "x"), (None, None, None), (2005, " \t\n", "x")]
    r.shuffle(docs)
    return docs


def in_order(docs):
    return sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1] or ""))


def brute_bytes(docs, length):
    seen, out = set(), []
    for i, text, _ in in_order(docs):
        b = (text or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for j in range(len(b) - length + 1):
            w = b[j : j + length]
            if w in seen:
                gone[j : j + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = sum(gone[j] and (j == 0 or not gone[j - 1]) for j in range(len(b)))
        out.append((i, len(b), int(gone.sum()), int(spans), hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(docs, window):
    first, out = {}, []
    rows = [(1 << 62 if i is None else i, i, (t or "").encode().split()) for i, t, _ in docs]
    for key, _, w in rows:
        for j in range(len(w) - window + 1):
            s = tuple(w[j : j + window])
            first[s] = min(first.get(s, key), key)
    for key, i, w in rows:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < key:
                gone[j : j + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def same(a, b):
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted(a, key=key) == sorted(b, key=key)


@pytest.mark.parametrize("seed,length,hot", [(1, 100, 1000), (2, 20, 1000), (3, 40, 2)])
def test_bytes_covered_by_earlier_strings(spark, seed, length, hot):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, SCHEMA)
    got = remove_repeated_substrings(df, length=length, hot=hot).drop("kept")
    expected = brute_bytes(docs, length)
    assert sum(r[2] for r in expected)
    same([tuple(r) for r in got.collect()], expected)


@pytest.mark.parametrize("seed,window,hot", [(1, 50, 1000), (2, 8, 1000), (3, 12, 2)])
def test_words_covered_by_windows_of_smaller_documents(spark, seed, window, hot):
    docs = corpus(seed, 12 if window < 50 else 40)
    df = spark.createDataFrame(docs, SCHEMA)
    got = remove_repeated_windows(df, window=window, hot=hot).drop("kept")
    expected = brute_words(docs, window)
    assert sum(r[2] for r in expected)
    same([tuple(r) for r in got.collect()], expected)


def test_several_blocks_agree_with_one(spark, monkeypatch):
    from standflow.llm import passages

    docs = corpus(7)
    df = spark.createDataFrame(docs, SCHEMA)
    monkeypatch.setattr(passages, "BLOCK_BYTES", 1500)
    same(
        [tuple(r) for r in remove_repeated_substrings(df).drop("kept").collect()],
        brute_bytes(docs, 100),
    )
    same(
        [tuple(r) for r in remove_repeated_windows(df, window=12).drop("kept").collect()],
        brute_words(docs, 12),
    )


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert remove_repeated_substrings(df).collect() == []
    assert remove_repeated_windows(df).collect() == []


@pytest.mark.parametrize("shallow", [8, 16, 64])
def test_deep_shallow_order_and_shared_prefixes(shallow):
    r = random.Random(5)
    strings = [bytes(r.choices(b"ab\0", k=r.randint(0, 40))) for _ in range(300)]
    strings += [b"ab" * 20 + bytes([c]) for c in range(5)] + [b"ab" * 20] * 3 + [b"", b"\0", b"\0\0"]
    order, common = deep_shallow_sort(strings, shallow)
    assert sorted(order.tolist()) == list(range(len(strings)))
    for d in range(1, 41):  # strings with one prefix of d bytes stand together and share d
        classes = {}
        for number, i in zip(np.cumsum(common < d).tolist(), order.tolist()):
            if len(strings[i]) >= d:
                classes.setdefault(strings[i][:d], set()).add(number)
        assert all(len(c) == 1 for c in classes.values())
        assert len(set().union(*classes.values())) == len(classes)


def test_runs_cover_all_windows_once():
    r = np.random.default_rng(1)
    x = r.integers(1, 4, 200_000).astype(np.uint64)
    start, count, anchor, _ = super_kmers(x, 20, 7)
    assert (start[1:] == start[:-1] + count[:-1]).all() and start[0] == 0
    assert start[-1] + count[-1] == len(x) - 19
    assert ((anchor >= start + count - 1) & (anchor + 7 <= start + 20)).all()
