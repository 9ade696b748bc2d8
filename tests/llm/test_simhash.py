import random

import pytest
import xxhash
from pyspark.sql import functions as F

from standflow.llm.components import connected_components
from standflow.llm.simhash import fingerprints, links, near_duplicates


def brute_print(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(nodes, near):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def texts():
    r = random.Random(3)
    words = ["".join(r.choices("abcdÀé", k=4)) for _ in range(300)]
    base = [" ".join(r.choices(words, k=r.randint(1, 120))) for _ in range(25)]
    out = list(base) + [None, "", " \n", "One", "one TWO", "one two three", "ONE two\tthree"]
    for t in base[:15]:
        for _ in range(4):
            w = t.split()
            w[r.randrange(len(w))] = r.choice(words)
            out.append(r.choice(["\n", "  ", " "]).join(w))
    return [(10 * i, t, "x") for i, t in enumerate(out)] + [(None, base[0], "x"), (0, base[0], "y")]


@pytest.mark.parametrize("tile", [2, 1024])
def test_components_of_texts(spark, tile):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = [tuple(r) for r in near_duplicates(df, tile=tile).collect()]
    prints = sorted({brute_print(t) for _, t, _ in rows})
    roots = brute_roots(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, t, _ in rows:
        if i is not None:
            k = roots[brute_print(t)]
            least[k] = min(least.get(k, i), i)
    want = [(i, f"{brute_print(t):016x}", least[roots[brute_print(t)]]) for i, t, _ in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert len({r[2] for r in want}) < len(prints)


@pytest.mark.parametrize("tile", [3, 1024])
def test_no_link_is_lost_between_any_fingerprints(spark, tile):
    r = random.Random(9)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        x = r.getrandbits(64)
        prints.add(x)
        for _ in range(12):
            y = x
            for b in r.sample(range(64), r.randint(1, 4)):
                y ^= 1 << b
            prints.add(y)
            x = r.choice([x, y])
    prints = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = {x["node"]: x["root"] for x in connected_components(links(df, tile=tile)).collect()}
    apart = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    roots = brute_roots([signed(p) for p in prints], lambda a, b: apart(a, b) <= 3)
    assert {n: got.get(n, n) for n in roots} == roots


def test_hash_is_that_of_the_engine(spark):
    df = spark.createDataFrame([(1, "One two")], "doc_id long, text string")
    h = df.select(F.xxhash64(F.lower("text"))).first()[0]
    assert fingerprints(df).first()["fp"] == h


def test_long_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(7, 7)]
    df = spark.createDataFrame(chain, "u long, v long")
    got = {x["node"]: x["root"] for x in connected_components(df).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1300)}


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
