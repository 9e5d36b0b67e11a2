import hashlib

from visionloom.llm import decontaminate as D
from test_llm import docs


def test_items_without_an_id_count(spark):
    bench = spark.createDataFrame([(None, "a b c d e f g h i j k"), (None, "short one"), (7, "q r s t u v w x y z"), (8, None)], "item_id long, text string")
    rows = [(1, "head a b c d e f g h i j tail short one"), (2, "q r s t u v w x y z a b c d e f g h i j k"), (3, "clean"), (4, None)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {1: (14, 12, 1, sha(""), True), 2: (21, 21, 2, sha("7"), True), 3: (1, 0, 0, sha(""), False), 4: (0, 0, 0, sha(""), False)}
    assert {r[0]: tuple(r[1:]) for r in D.contamination(docs(spark, rows), bench).collect()} == want
    in_blocks = D.find_windows(docs(spark, rows), bench, block_words=5).collect()
    assert {r["doc_id"]: r["hit_items"] for r in in_blocks} == {1: [None], 2: ["7", None], 3: [], 4: []}
    assert {r["doc_id"]: r["text"].split() for r in D.decontaminate(docs(spark, rows), bench).collect() if r["text"]} == {3: ["clean"]}
