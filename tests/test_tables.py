"""Table functions called from SQL."""

import random

from inkstrata.functions import tables
from inkstrata.functions.unicode import archive_blocks
from inkstrata.operators.items import tightest_spans


def test_archives_in_sql(spark):
    tables.register(spark)
    texts = ["## A\n\nQuestion: q?\n\n<snippet 0>\nx\n<snippet 2>\ny\nz\n## B", "no head", "", None]
    spark.createDataFrame(list(enumerate(texts)), "id int, text string").createOrReplaceTempView("archives")
    got = spark.sql("SELECT a.id, b.* FROM archives a, LATERAL archive_blocks(a.text) b").collect()
    want = [(i, b["head_no"], b["head"], b["chapter"], b["text"]) for i, t in enumerate(texts) if t is not None for b in archive_blocks(t)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(want) == 5


def test_spans_by_partition_and_order(spark):
    tables.register(spark)
    rng, rows, want = random.Random(6), [], []
    for u in range(40):
        labels = ["a", "b", "c"][: rng.randint(0, 3)]
        sentences = [(" ".join("w" for _ in range(rng.choice((0, 3, 8, 60)))), [x for x in labels if rng.random() < 0.4]) for _ in range(rng.randint(0, 25))]
        rows += [(f"u{u}", i, s, n, labels) for i, (s, n) in enumerate(sentences)]
        kept = [(s, n) for s, n in sentences if s.strip()]
        want += [(f"u{u}", k, t) for k, t in enumerate(tightest_spans([s for s, _ in kept], [set(n) for _, n in kept], set(labels)))]
    rows += [("null", 0, None, ["a"], ["a"]), ("null", 1, "x " * 30, None, ["a"]), ("null", 2, "y", ["a"], None)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "unit string, pos int, sentence string, named array<string>, labels array<string>").repartition(5)
    frame.createOrReplaceTempView("sentences")
    got = spark.sql("SELECT * FROM tight_spans(TABLE(SELECT unit, pos, sentence, named, labels FROM sentences) PARTITION BY unit ORDER BY pos)").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 20
