"""What the Jaccard join moves and leaves on disk."""

from __future__ import annotations

import re
import time

from pyspark.sql import functions as F

from tillscope.llm.jaccard import _index, ngram_jaccard
from tillscope.llm.store import written


def _texts(spark, rows, parts=1):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    return frame.repartitionByRange(parts, "doc_id")


def _words(first, count):
    return " ".join(f"w{k}" for k in range(first, first + count))


def _shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = blocks.getAllFiles()
    names = [files.apply(k).getName() for k in range(files.size())]
    return {name for name in names if name.startswith("shuffle_")}


def _left(spark, before, wait=15):
    """Shuffle files that came since ``before`` and stay; Spark removes them a little later."""
    end = time.time() + wait
    while (left := _shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    return left


def test_written_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    rows = spark.range(5000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("s"))
    found = written(rows, "test")
    assert not _left(spark, before)
    assert found.count() == 100
    assert found.agg(F.sum("s")).first()[0] == sum(range(5000))


def test_written_keeps_the_session_as_it_was(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    written(spark.range(10).distinct(), "test")
    assert spark.conf.get(name) == "false"
    spark.conf.unset(name)
    written(spark.range(10).distinct(), "test")
    assert spark.conf.get(name, None) == before


def test_written_can_be_read_from_twice(spark):
    rows = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("n"))
    written(rows, "test")
    assert written(rows, "test").count() == rows.count() == 10


def test_join_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    rows = [(k, _words(k // 2 * 100, 40 + k % 2)) for k in range(40)]
    found = {r.doc_id: r.component_id for r in ngram_jaccard(_texts(spark, rows, 4)).collect()}
    assert found == {k: k // 2 * 2 for k in range(40)}
    last = _left(spark, before, 5)  # the caller's own query is Spark's to clear
    assert len({re.match(r"shuffle_(\d+)", name)[1] for name in last}) <= 8


def test_copies_alone_are_not_indexed(spark):
    """Shingles that only copies of one set have link it with nothing, wherever the copies lie."""
    rows = [(k, _words(k % 5 * 1000, 300)) for k in range(40)]
    assert _index(_texts(spark, rows, 8), 75).count() == 0


def test_index_of_copies_and_near_copies(spark):
    """Copies over all tasks change nothing in the list of a set."""
    near = [_words(0, 200), _words(0, 190), _words(500, 60), _words(505, 60)]
    once = [(k, text) for k, text in enumerate(near)]
    often = [(k, near[k % 4]) for k in range(64)]
    one = _index(_texts(spark, once, 1), 75).select("shingle", "node").collect()
    many = _index(_texts(spark, often, 16), 75).select("shingle", "node").collect()
    assert len(one) > 0
    assert len(many) == len(set(many))
    assert {row.node for row in many} == {row.node for row in one}
    found = {r.doc_id: r.component_id for r in ngram_jaccard(_texts(spark, often, 16)).collect()}
    assert found == {k: 0 if k % 4 < 2 else 2 for k in range(64)}


def test_index_deals_its_rows_twice(spark):
    """By shingle and by set, not by set a second time."""
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    plan = _index(docs, 75)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2
