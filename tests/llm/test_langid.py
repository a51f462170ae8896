import numpy as np
from pyspark.sql import functions as F

from quillstack.llm import langid

from .edge import docs, empty


def test_held_out_accuracy(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.predict(rows, langid.fit(rows, langid.learnable())).where(~langid.learnable())
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.99


def test_mixture_of_two_languages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars between 1000 and 3000")
    model = langid.fit(rows)
    en, fr = (rows.where(f"lang = '{x}'").orderBy("doc_id").first()["text"][:900] for x in ("en", "fr"))
    got = langid.predict(spark.createDataFrame([(1, en + " " + fr, "x"), (2, en, "x")], "doc_id long, text string, lang string"), model).orderBy("doc_id").collect()
    assert set(got[0]["languages"]) == {"en", "fr"} and 0.3 < got[0]["score"] < 0.7
    assert set(got[1]["languages"]) == {"en"} and got[1]["lang_pred"] == "en"


def test_edges(spark):
    rows = docs(spark)
    got = langid.predict(rows, langid.fit(rows, langid.learnable()))
    assert got.count() == rows.count() and got.columns.count("score") == 1
    for r in got.collect():
        letters = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    assert langid.predict(empty(spark), langid.fit(empty(spark))).count() == 0
    untaught = langid.predict(rows, langid.fit(rows.where("false")))
    assert {r["lang_pred"] for r in untaught.select("lang_pred").collect()} == {"und"}


def test_trigrams_stay_in_their_document():
    import pyarrow as pa

    from quillstack.llm.textbytes import utf8

    both = langid.trigrams(*utf8(pa.array(["ab  c!", None, "", "d", "é"])))
    for i, t in enumerate(["ab  c!", None, "", "d", "é"]):
        _, alone = langid.trigrams(*utf8(pa.array([t])))
        assert np.array_equal(both[1][both[0] == i], alone)
