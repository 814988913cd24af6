"""The pipeline's stages on the smallest tables, and the registered queries."""

import corpus_pipeline
from inkstrata.llm import queries
from inkstrata.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = docs.cache()
        after = docs.count()
        assert 0 < after <= before and (name != "secrets" or after == before)
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == before and last.where("not lossless").count() == 0
    assert docs.where("text rlike '(?i)token = \"[0-9a-f]{20}'").count() == 0


def test_stages_take_empty_tables(spark):
    docs = table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_stages_take_nulls_repeats_and_clashing_columns(spark):
    """Null ids, texts and languages, an empty and a long text, one row twice: each stage gives its columns, and the last one row for each of its input's."""
    rows = [(None, "a text without id stays", None, "s", 1), (1, None, "en", None, None), (2, "", "en", "s", 0), (3, "long words here " * 9000, "en", "s", 1), (3, "long words here " * 9000, "en", "s", 1), (4, "token = \"abcdef0123456789abcd\"", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "'x' AS spans", "1 AS kept", "array(1) AS piece_ids")
    for name, stage in corpus_pipeline.STAGES[1:-1]:  # the quality draw takes what it takes; the others keep these
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "spans", "kept", "piece_ids"], name
        assert {r.doc_id for r in docs.collect()} == {None, 1, 2, 3, 4}, name
    assert "abcdef0123456789abcd" not in docs.where("doc_id = 4").first().text
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count()


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
