import random

import pytest

from standflow.llm import decontaminate as dc

SCHEMA = "doc_id long, text string, item_id long"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def corpus(seed):
    r = random.Random(seed)
    common = ["the", "of", "and", "to", "in"]
    words = ["".join(r.choices("abcdefé", k=r.randint(2, 6))) for _ in range(800)]
    word = lambda: r.choice(common) if r.random() < 0.4 else r.choice(words)
    items = [(i, [word() for _ in range(r.randint(14, 55))]) for i in range(30)]
    items += [(100, [word() for _ in range(6)]), (101, [word() for _ in range(3)])]
    docs, planted = [], {}
    for i in range(300):
        body = [word() for _ in range(r.randint(0, 150))]
        if i % 2:
            k, item = r.choice(items)
            copy, edits = list(item), r.randint(0, int(0.2 * len(item)))
            for _ in range(edits):
                at = r.randrange(len(copy))
                kind = r.randrange(3)
                if kind == 0:
                    copy[at] = word()
                elif kind == 1:
                    del copy[at]
                else:
                    copy.insert(at, word())
            at = r.randint(0, len(body))
            body[at:at] = copy
            planted[i] = k
        docs.append((i, " ".join(body).capitalize() + r.choice([".", "!\n", ""]), 7))
    docs += [(None, " ".join(items[0][1]), 7), (500, None, 7), (501, "", 7), (1, docs[1][1], 7)]
    return docs, [(i, ", ".join(w)) for i, w in items] + [(200, None), (201, " ")], planted


def brute(docs, items, similarity=0.8):
    found = set()
    for d, t, _ in docs:
        text = dc.words_of(t)
        for i, it in items:
            item = dc.words_of(it)
            allowed = int((1 - similarity) * len(item) + 1e-9)
            if item and min((e for e, _ in dc.edit_search(item, text)), default=99) <= allowed:
                found.add((d, i))
    return found


def test_edit_search_is_the_least_distance_to_a_stretch():
    r = random.Random(1)
    for _ in range(60):
        a = r.choices([b"x", b"y", b"z"], k=r.randint(1, 9))
        b = r.choices([b"x", b"y", b"z"], k=r.randint(1, 12))
        for edits, end in dc.edit_search(a, b):
            assert edits == min(distance(a, b[s:end]) for s in range(end + 1))


def test_recall_and_precision(spark):
    hits = total = 0
    for seed in (1, 2):
        docs, items, planted = corpus(seed)
        df = spark.createDataFrame(docs, SCHEMA).repartition(3)
        bench = spark.createDataFrame(items, "item_id long, text string")
        rows = dc.find_benchmark_items(df, bench).collect()
        got, true = {(x["doc_id"], x["item_id"]) for x in rows}, brute(docs, items)
        assert got <= true
        assert {(d, i) for d, i in planted.items()} & true
        hits, total = hits + len(got), total + len(true)
        by_id, by_item = {d: t for d, t, _ in docs}, dict(items)
        for x in rows:
            text = dc.words_of(by_id[x["doc_id"]])[x["first_word"] :][: x["n_words"]]
            assert distance(dc.words_of(by_item[x["item_id"]]), text) == x["edits"]
    assert hits / total > 0.97, hits / total


def test_exact_copies_are_all_found_in_any_block_of_items(spark):
    docs, items, _ = corpus(3)
    exact = [(i, f"x y {t} z\n{t}", 1) for i, t in items]
    df = spark.createDataFrame(exact, SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = dc.find_benchmark_items(df, bench, block_bytes=400).collect()
    got = [(x["doc_id"], x["item_id"]) for x in rows if x["edits"] == 0]
    for i, t in items:
        assert got.count((i, i)) == (2 if t and t.strip() else 0)


@pytest.mark.parametrize("block_bytes", [dc.BLOCK_BYTES, 900])
def test_dropped_rows(spark, block_bytes):
    """Rows are judged by their own text: clean rows stay beside contaminated ones of the same id."""
    docs, items, _ = corpus(4)
    docs += [(1, "clean words", 7), (None, "clean too", 7), (None, None, 7), (None, docs[3][1], 8)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    bench = spark.createDataFrame(items + [(None, items[0][1]), items[1]], "item_id long, text string")
    numbered = spark.createDataFrame([(n, d[1], 0) for n, d in enumerate(docs)], SCHEMA)
    bad = {x["doc_id"] for x in dc.find_benchmark_items(numbered, bench).collect()}
    left = dc.drop_contaminated(df, bench, block_bytes=block_bytes)
    assert left.columns == df.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2])
    want = sorted((d for n, d in enumerate(docs) if n not in bad), key=key)
    assert sorted(map(tuple, left.collect()), key=key) == want
    assert {(1, "clean words", 7), (None, "clean too", 7), (None, None, 7)} <= set(want)
    assert (None, docs[3][1], 8) not in want


def test_dropping_rows_takes_no_shuffle(spark):
    docs, items, _ = corpus(4)
    df = spark.createDataFrame(docs, SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    plan = dc.drop_contaminated(df, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_a_very_long_text(spark):
    docs, items, _ = corpus(4)
    long = "filler text " * 100_000 + items[0][1] + " more" * 50_000
    df = spark.createDataFrame([(1, long, 0), (2, "filler text " * 100_000, 0)], SCHEMA)
    bench = spark.createDataFrame(items[:1], "item_id long, text string")
    got = [tuple(x) for x in dc.find_benchmark_items(df, bench).collect()]
    assert got == [(1, items[0][0], 200_000, len(dc.words_of(items[0][1])), 0)]
    assert [x["doc_id"] for x in dc.drop_contaminated(df, bench).collect()] == [2]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    docs, items, _ = corpus(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert dc.find_benchmark_items(none, bench).collect() == []
    df = spark.createDataFrame(docs, SCHEMA)
    assert dc.find_benchmark_items(df, bench.limit(0)).collect() == []


def recall(length, edits, seed=0, trials=120):
    r = random.Random(f"{length} {edits} {seed}")
    words = ["".join(r.choices("abcdefg", k=6)) for _ in range(3000)]
    hits = 0
    for _ in range(trials):
        item = r.sample(words, length)
        copy = list(item)
        for at in r.sample(range(length), edits):
            copy[at] = r.choice(["", r.choice(words), copy[at] + " " + r.choice(words)])
        text = " ".join([*r.choices(words, k=9), *copy, *r.choices(words, k=9)])
        hits += bool([*dc.Matcher([(1, " ".join(item))], dc.SIMILARITY).find(["x", text, "y"])])
    return hits / trials


@pytest.mark.parametrize("length", range(12, 31))
def test_recall_by_length_of_item_at_the_most_edits(length):
    got = recall(length, length // 5)
    assert got == 1 if length < 20 else got > 0.94, got


@pytest.mark.parametrize("length", range(14, 20))
def test_a_short_item_is_found_without_its_first_words(length):
    item = [f"word{i}" for i in range(length)]
    for begin in (["other"] + item[1:], item[1:], item[2:], ["a", "b"] + item[2:]):
        for text in (begin, ["x"] * 5 + begin + ["y"] * 5):
            found = dc.Matcher([(1, " ".join(item))], dc.SIMILARITY).find(["z z", " ".join(text), "z"])
            assert [x[0] for x in found] == [1]
