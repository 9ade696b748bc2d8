import random

from standflow.llm import quality


def test_a_very_long_clean_text_is_kept(spark):
    r = random.Random(5)
    words = ["the", "of", "and"] + ["".join(r.choices("abcdefgh", k=6)) for _ in range(2000)]
    text = "".join(w + r.choice([" "] * 9 + ["\n"]) for w in r.choices(words, k=200_500))
    frame = spark.createDataFrame([(1, text), (2, "too short")], "doc_id long, text string")
    got = {x["doc_id"]: x for x in quality.quality_report(frame).collect()}
    assert got[1]["n_words"] == 200_500 and got[1]["failed"] == "" and got[1]["kept"]
    assert [x["doc_id"] for x in quality.keep_good(frame).select("doc_id").collect()] == [1]
