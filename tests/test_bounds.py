"""Work and memory that grow no faster than the input."""

from pyspark.sql import functions as F

from inkstrata.functions import matcher, text
from inkstrata.operators import itemplan, traces


def test_item_plans_send_small_batches_to_python(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        ex = spark.createDataFrame([("b", 0, 0, "Ann met Bob.", None)], "book string, chapter_index int, chunk_index int, text string, header string")
        al = spark.createDataFrame([("b", "principal", "Ann", 0, "Ann")], "book string, kind string, label string, label_no int, alias string")
        itemplan.plan(ex, al, ex)
        assert spark.conf.get(key) == "1000"
    finally:
        spark.conf.set(key, before)


def test_matches_of_null_and_empty_texts(spark):
    rows = [(0, "Ann and ANN", "k"), (1, None, "k"), (2, "", "k"), (3, "Ann", None), (4, "an Ann", "k")]
    df = spark.createDataFrame(rows, "i int, t string, k string").coalesce(1)
    forms = F.array(*[F.struct(F.lit(g).alias("group"), F.lit(f).alias("form")) for g, f in ((0, "Ann"), (1, "ANN"))])
    got = {r.i: None if r.h is None else [tuple(h) for h in r.h] for r in df.select("i", matcher.find(F.col("t"), F.col("k"), forms).alias("h")).collect()}
    assert got == {0: [(0, 0, 3), (1, 8, 11)], 1: None, 2: [], 3: None, 4: [(0, 3, 6)]}


def test_words_of_a_trace_are_found_once(spark):
    df = spark.createDataFrame([("a b c d e",)], "t string").select(traces.gram_set(F.col("t")).alias("g"))
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1 and len(df.first().g) == 2


def test_words_of_a_sentence_are_counted_once(spark):
    one = "A b c d. " * 3
    df = spark.createDataFrame([(one,)], "t string").select(text.snippets(F.col("t"), 8).alias("s"))
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_count") == 1 and df.first().s == ["A b c d. A b c d.", "A b c d."]


def test_hashes_stand_for_grams(spark):
    from inkstrata.operators import stats

    df = spark.createDataFrame([("a b a b a b c",), ("ab c",), ("",), (None,)], "t string")
    w = text.words(F.col("t"))
    got = df.select(F.size(stats.grams(w, 2)).alias("x"), F.size(stats.gram_hashes(w, 2)).alias("y"), F.size(F.array_intersect(stats.gram_hashes(w, 2), F.array(F.xxhash64(F.array(F.xxhash64(F.lit("a")), F.xxhash64(F.lit("b"))))))).alias("z")).collect()
    assert [(r.x, r.y) for r in got][:3] == [(3, 3), (1, 1), (0, 0)] and [r.z for r in got][:3] == [1, 0, 0] and got[3].x == got[3].y
