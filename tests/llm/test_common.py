import os
from types import SimpleNamespace

import pytest

from visionloom.llm import common, decontaminate


def test_shared_folder_is_told_or_local(spark):
    context = SimpleNamespace(applicationId="app-1", master="spark://cluster:7077")
    told = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: "hdfs://store/shared/"), sparkContext=context)
    assert common.shared_dir(told) == "hdfs://store/shared/llm-app-1"
    with pytest.raises(ValueError):
        common.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=context))


def test_scratch_tables_go_and_results_stay(spark):
    df = spark.range(3)
    with common.scratch(spark) as outlive:
        inner, path = common.written(df, "inner")
        kept = outlive(inner, "kept")
        assert os.path.isdir(path.removeprefix("file://"))
    assert not os.path.isdir(path.removeprefix("file://")) and kept.count() == 3
    root = common.shared_dir(spark).removeprefix("file://")
    assert os.listdir(root)
    common.cleanup(spark)
    assert not os.path.isdir(root)


def test_clashing_columns_are_kept(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k", 7, "x", "y", "z", "w")], "doc_id long, text string, N_WORDS int, __in string, hit_spans string, __covered string, __n_words string")
    bench = spark.createDataFrame([(1, "b c d"), (2, "q r s t u v w x y z")], "item_id long, text string")
    for blocks in (200_000, 3):
        done = decontaminate.find_windows(docs, bench, block_words=blocks)
        assert done.first()["__in"] == "x" and done.first()["hit_items"] == ["1"]
    out = decontaminate.decontaminate(docs, bench)
    assert out.columns == docs.columns and out.first()["N_WORDS"] == 7 and out.first()["text"].split() == list("aefghijk")


def test_long_walks_in_the_automaton_are_short():
    words = [b"a"] * 5000
    sam = decontaminate.Automaton([("one", words), ("two", [b"a"] * 3)], 10)
    spans, names = sam.scan([b"a"] * 20_000)
    assert spans == [(0, 20_000)] and names == {"one", "two"}
