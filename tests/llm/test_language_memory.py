"""What language identification sends to its workers, and that workers give memory back."""

from pyspark.sql import functions as F

from terrane.llm import language
from terrane.llm.common import lean


def test_text_is_sent_once_and_columns_stay(spark):
    docs = spark.createDataFrame([(1, "the one and the other", "en"), (2, None, "de"), (3, "der eine und der andere", "de"), (4, "the next of them", "en")], "doc_id long, text string, lang string")
    models = language.fit(docs, train="true")
    got = language.identify(docs, models)  # without a column for rejected texts
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert "text_" not in got._jdf.queryExecution().toString()
    rows = {r.doc_id: r for r in got.collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3, 4)] == ["en", "und", "de", "en"] and rows[3].text == "der eine und der andere"
    binary = docs.withColumn("text", F.col("text").cast("binary"))
    assert {r.doc_id: r.lang_pred for r in language.identify(binary, models).collect()} == {i: r.lang_pred for i, r in rows.items()}
    over = language.identify(docs, models, lang_to="text")
    assert {r.doc_id: r.text for r in over.collect()} == {i: r.lang_pred for i, r in rows.items()}


def test_lean_functions_yield_the_same():
    assert list(lean(lambda batches: (2 * b for b in batches))([1, 2, 3])) == [2, 4, 6]
