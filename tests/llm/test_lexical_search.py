import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from standflow.llm import lexical_search
from standflow.llm.ball_tree import BallTree, Rows

DOCS = "doc_id long, text string, score string, rank int, term string, block int"
ITEMS = "item_id long, text string, doc_id string, score int"


def terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute_force(docs, items, best):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            n = sum(c.values())
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
                for t in set(terms(text)) if t in c
            )
            if score:
                scores.append((-score, i is None, i or 0))
        for rank, (score, none, i) in enumerate(sorted(scores)[:best], 1):
            out.append((item, rank, None if none else i, -score))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    r = random.Random(3)
    words = [f"w{i}" for i in range(120)] + ["É", "é", "ß", "ÀB", "x-y", "_", "日本語", "A1", "a1"]
    text = lambda n: " ".join(r.choices(words, range(len(words), 0, -1), k=n))
    docs = [(i, text(r.randint(0, 60))) for i in range(300)]
    docs += [(i, "W1 w2, w3. w3") for i in range(400, 480)]  # copies: ties by id
    docs += [(7, "w1 w2"), (7, "w1 w2"), (7, "w9 w9"), (None, "w1 w2 w3"), (None, None), (600, None)]
    docs += [(601, ""), (602, " .,\n"), (603, "w5 " * 40000), (604, text(20000))]
    items = [(i, text(r.randint(3, 40))) for i in range(12)]
    items += [(3, "w1 w2 w3"), (3, "w1 w2 w3"), (None, "é ß w4"), (50, None), (51, ""), (52, "nowhere")]
    return docs, items


@pytest.mark.parametrize("postings", [10**6, 700])
def test_against_brute_force(spark, tables, postings):
    docs, items = tables
    d = spark.createDataFrame([(*x, "s", 1, "t", 0) for x in docs], DOCS).repartition(5)
    i = spark.createDataFrame([(*x, "d", 1) for x in items], ITEMS)
    got = lexical_search.search(d, i, best=20, block_postings=postings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_force(docs, items, 20)


def test_chunks_of_items(spark, tables, monkeypatch):
    docs, items = tables
    monkeypatch.setattr(lexical_search, "CHUNK_ITEMS", 4)
    d = spark.createDataFrame(docs[:80], "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = lexical_search.search(d, i, best=5, block_postings=300).collect()
    assert sorted(map(tuple, got), key=str) == brute_force(docs[:80], items, 5)


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, None)], [(1, "a")])])
def test_empty(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    assert lexical_search.search(d, i).collect() == []


def test_bounds_hold_and_prune():
    r = np.random.default_rng(1)
    # four languages: columns of their own
    columns, values, starts = [], [], [0]
    for row in range(4000):
        own = np.unique(r.integers(0, 200, 40)) + 200 * (row % 4)
        columns.append(own)
        values.append(r.integers(1, 10**6, len(own)))
        starts.append(starts[-1] + len(own))
    rows = Rows(np.arange(4000), np.array(starts), np.concatenate(columns), np.concatenate(values))
    tree = BallTree(rows, 800)

    def check(node, query, exact):
        if node.rows is not None:
            assert node.bound(query) >= node.rows.dot(exact).max()
            return
        for child in node.children:
            check(child, query, exact)
            assert len(child.columns) <= len(node.columns)

    for language in range(4):
        exact = np.zeros(800, np.int64)
        asked = np.unique(r.integers(0, 200, 20)) + 200 * language
        exact[asked] = r.integers(1, 10000, len(asked))
        check(tree.root, exact.astype(float), exact)
        tree.scored = 0
        ids, scores = tree.search(asked, exact[asked], 10)
        every = rows.dot(exact)
        order = np.lexsort((np.arange(4000), -every))[:10]
        assert ids.tolist() == order.tolist() and scores.tolist() == every[order].tolist()
        assert tree.scored < 2000  # the other languages' subtrees stay closed
