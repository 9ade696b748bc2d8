"""The pipeline against a plain walk through its stages, on a small table that has every case."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from standflow.llm import bpe, quality, secrets
from test_decontaminate import brute
from test_scans import brute_spans
from test_simhash import brute_print, brute_roots

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STOP = ["the", "of", "and", "to", "in"]


def corpus():
    r = random.Random(12)
    words = ["".join(r.choices("abcdefghijklm", k=r.randint(3, 8))) for _ in range(900)]

    def body(n):
        return [r.choice(STOP) if r.random() < 0.3 else r.choice(words) for _ in range(n)]

    items = [(i, " ".join(body(r.randint(18, 40)))) for i in range(12)]
    texts = [None, "", " \n ", "too short", " ".join(body(60) + ["#"] * 40)]
    for i in range(60):
        text = body(r.randint(40, 160))
        at = r.randint(0, len(text))
        if i % 6 == 0:
            text[at:at] = r.choice(items)[1].split()
        elif i % 6 == 1:
            text[at:at] = ["password=hunter22x", "é😀", "0123456789abcdef01234567"]
        texts.append(" ".join(text) + r.choice([".", "!\n", ""]))
    texts += [texts[20]] * 3 + [texts[21].upper().replace(" ", "  "), "repeat this line of the text\n" * 30]
    for i in (23, 27, 31, 35):  # edited copies: some are three bits away, some more
        edited = texts[i].split(" ")
        edited[len(edited) // 2] = "edit"
        texts.append(" ".join(edited))
    docs = [(7 * i % 1009, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    docs += [docs[30], (docs[31][0], texts[32], None, None, None), (None, texts[33], "de", "x", 1)]
    return docs, items


def write(spark, folder, docs, items):
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    bench = spark.createDataFrame(items, "item_id long, text string")
    bench.write.parquet(f"{folder}/benchmark.parquet")


def expected(spark, docs, items):
    """Each stage by loops; the verdict of the quality rules is the operator's (tested elsewhere)."""
    frame = spark.createDataFrame([(i, d[1]) for i, d in enumerate(docs)], "doc_id long, text string")
    good = {x["doc_id"] for x in quality.quality_report(frame).where("kept").collect()}
    left = [d for i, d in enumerate(docs) if i in good]
    prints = [brute_print(d[1]) for d in left]
    roots = brute_roots(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 3)
    groups = {}
    for d, p in zip(left, prints):
        groups.setdefault(roots[p], []).append(d)
    blank = lambda d: tuple((x is not None, x) if x is not None else (False, 0) for x in d)
    kept = [min(g, key=lambda d: (d[0] is None, blank(d))) for g in groups.values()]
    held = {n for n, _ in brute([(n, d[1], 0) for n, d in enumerate(kept)], items)}
    out = []
    coder = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")),
    )
    for n, (i, text, lang, source, _) in enumerate(kept):
        if n in held:
            continue
        masked, at = "", 0
        for a, _, b in brute_spans(text, secrets.RULES):
            if a >= at:
                masked += text[at:a] + secrets.MASK
            at = max(at, b)
        masked += text[at:]
        ids = coder.encode_ordinary(masked)
        out.append((i, lang, source, len(ids), ids, hashlib.sha256(masked.encode()).hexdigest()))
    return out, len(left), len(kept)


def test_rows_of_the_pipeline(spark, tmp_path):
    docs, items = corpus()
    write(spark, tmp_path, docs, items)
    got = [tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    want, n_good, n_kept = expected(spark, docs, items)
    key = lambda x: (x[0] is None, x[0] or 0, x[5])
    assert sorted(got, key=key) == sorted(want, key=key)
    # every stage had something to do
    assert len(docs) > n_good > n_kept > len(want) > 10
    assert n_good - n_kept > 8  # exact and edited copies
    mask = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))[b"SEC"]
    assert any(mask in x[4] for x in got)


def test_stages_keep_the_columns(spark, tmp_path):
    docs, items = corpus()
    write(spark, tmp_path, docs[:12], items)
    frame = spark.createDataFrame(docs[:12], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("items", [[], [(1, None)]])
def test_empty_tables(spark, tmp_path, items):
    write(spark, tmp_path, [], items)
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
