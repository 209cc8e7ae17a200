"""Words that get numbers in op8."""

from perimeter.llm import lm


def test_words_are_counted_in_all_training_texts(spark):
    texts = spark.range(40_000).selectExpr("id as doc_id", "concat('w', id % 7, if(id % 7 < id div 8000, ' w6', '')) as text")
    counts = {}
    for i in range(40_000):
        counts[f"w{i % 7}"] = counts.get(f"w{i % 7}", 0) + 1
        if i % 7 < i // 8000:
            counts["w6"] += 1
    want = [w for _, w in sorted((-n, w.encode()) for w, n in counts.items())]
    assert lm.frequent_words(texts) == [lm.END, *want]
