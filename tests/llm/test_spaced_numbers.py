import random

from visionloom.llm import pii
from test_llm import base_spans, docs


def test_numbers_with_wide_separators(spark):
    g = random.Random(6)
    spaced = ["+4   9   3   0   1   2   3   4", "+1 -- 2 -- 3 -- 4 -- 5 -- 6 -- 7 -- 8", "+7...(8)...9...0...1...2...3...4"]
    parts = [*spaced, " ", "word", "+", "5   6", "é😀", "+1   2"]
    texts = ["tel " + t for t in spaced] + ["".join(g.choice(parts) for _ in range(6)) for _ in range(60)]
    assert all(base_spans(t) for t in texts[:3])
    df = docs(spark, list(enumerate(texts)))
    models = pii.fit(df)
    for r in pii.find_spans(df.select("doc_id", "text"), models).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["base_spans"]] == base_spans(r["text"]), r["text"]
    red = {r["doc_id"]: r["text"] for r in pii.redact(df, models).collect()}
    assert all(not any(c.isdigit() for c in red[i]) for i in range(3))
